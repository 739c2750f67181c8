"""URL filters: path rules first, then association rules mined by FP-growth.

A URL becomes a set of tokens: scheme, hyphenated parts of the host labels before the last two, host suffixes of two
labels or more, path segments with digits made one sign, and names of query parameters. From labelled URLs Spark's
FP-growth mines the combinations that bad ones share; those whose support, confidence for the bad label and lower bound
of it reach the bounds are rules, and a rule is dropped if a shorter rule inside it is as confident. A URL that holds
all tokens of a rule is blocked. Rules are matched by an inverted index: each is filed under its rarest token, so a URL
meets the rules filed under its tokens.

Tokens that stand in exactly the same labelled URLs count as one item, and a rule asks for all of them. A rule may have
any number of items. FP-growth's work grows with all subsets of a URL's items, so it mines the URLs of up to LONG items;
longer ones are mined level by level, until no combination is left; what holds for bad URLs only is not made longer. A combination that is frequent over both is frequent
in one of them at half the support, so these candidates hold every rule; they are counted again over all labelled URLs.

Labels come from the labels table (page_id = doc_id; bad: low quality or toxic). A caller may hand in `seeds`, host words
of known bad kinds, as weak labels of pages without a label: a given label always wins. Each rule tells how many given
labels stand behind it. Rules are mined over all labelled pages.

Nulls and odd rows: a null url, or one without "://", has an empty host and path, no rule and no tokens, and is allowed;
a null label counts as none; a page with several labels is bad if any of them is; repeated rows are judged alike; of
several rules that fit, the most confident counts (ties: larger support, then smaller tokens); urls and segments of any
length are taken whole; an empty table gives no rows; without labels nothing is mined; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

#: A rule's share of bad URLs, and the least that this share may truly be (Wilson's lower bound at Z standard errors).
MIN_CONFIDENCE = 0.8
MIN_LOWER_BOUND = 0.7
Z = 1.96
#: A rule holds for this many bad URLs at least, and for this share of the labelled ones.
MIN_COUNT = 10
MIN_SUPPORT = 0.0005
#: Items of a URL up to which FP-growth mines it.
LONG = 12


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production path rules (verdict, host, path).
RULES = (
    PathRule("block", "com", "/en/"),
    PathRule("allow", "example.com", "/en/7"),
    PathRule("allow", "net", "/de/"),
    PathRule("block", "example.net", "/de/8"),
    PathRule("block", "org", "/es/"),
)


def _lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    return _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def path_rule(host: Column, path: Column, rules: tuple[PathRule, ...]) -> Column:
    """The verdict and text of the longest rule that fits, else null. Ties: the longer host, then the earlier rule."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host)))
    fitted = F.lit(None).cast("struct<verdict:string,rule:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fitted = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))).otherwise(fitted)
    return fitted


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, sorted; none for an empty host."""
    labels = F.array_remove(F.split(host, r"\."), "")
    n = F.size(labels)
    words = F.flatten(F.transform(F.slice(labels, 1, F.greatest(n - 2, F.lit(1))), lambda x: F.array_remove(F.split(x, "-"), "")))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))
    segments = F.array_remove(F.transform(F.split(path, "/"), lambda x: F.regexp_replace(_lower(x), r"\d+", "0")), "")
    names = F.array_remove(F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)), "")
    tag = lambda own, name: F.transform(own, lambda x: F.concat(F.lit(f"{name}="), x))
    scheme = F.array(F.concat(F.lit("scheme="), _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    every = F.array_sort(F.array_distinct(F.concat(scheme, tag(words, "word"), tag(suffixes, "host"), tag(segments, "path"), tag(names, "query"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def labelled(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = ()) -> DataFrame:
    """tokens, bad, given of all pages (page_id, tokens) that the table labels, or else a seed does."""
    known = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("page_id IS NOT NULL AND bad IS NOT NULL")
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"word={s}") for s in seeds])) if seeds else F.lit(False)
    joined = pages.where(F.size("tokens") > 0).join(known, "page_id", "left").withColumn("given", F.col("bad").isNotNull())
    return joined.withColumn("bad", F.coalesce("bad", F.when(seeded, True))).where("bad IS NOT NULL").select("tokens", "bad", "given")


def token_items(sets: DataFrame, floor: int) -> DataFrame:
    """item, members, seen: the tokens in `floor` bad URLs or more; those in exactly the same URLs are one item.

    Which sets a token is in is told by the sums of two numbers drawn for each set.
    """
    draws = [F.xxhash64("tokens", F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"d{k}") for k in range(2)]
    each = sets.select("n", "bad", *draws, F.explode("tokens").alias("token"))
    counted = each.groupBy("token").agg(F.sum("n").alias("seen"), F.sum("bad").alias("bad"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).where(F.col("bad") >= floor)
    return counted.groupBy("seen", "bad", "d0", "d1").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members")).select("item", "members", "seen")


def lower_bound(confidence: Column, n: Column) -> Column:
    """Wilson's lower bound of a share that was seen among n."""
    c = confidence
    return (c + Z * Z / (2 * n) - Z * F.sqrt(c * (1 - c) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def level_wise(sets: DataFrame, least: int, floor: int) -> DataFrame:
    """rule: combinations that are in `least` long bad URLs or more, of all (items sorted, n, bad), level by level until none is left.

    A rule that holds for bad URLs only is not made longer: no rule around it can be more confident.
    """
    long = (F.size("items") > LONG).cast("int")
    at = sets.select("items", "n", "bad", long.alias("long"), F.posexplode("items").alias("last", "x")).withColumn("rule", F.array("x")).drop("x")
    out = None
    while True:
        counted = at.groupBy("rule").agg(F.sum("n").alias("seen"), F.sum("bad").alias("support"), F.sum(F.col("bad") * F.col("long")).alias("here"))
        frequent = materialize(counted.where(F.col("here") >= least), "level")
        out = frequent.select("rule") if out is None else out.unionByName(frequent.select("rule"))
        perfect = (F.col("support") == F.col("seen")) & (F.col("support") >= floor) & (lower_bound(F.lit(1.0), F.col("seen")) >= MIN_LOWER_BOUND)
        more = frequent.where(~perfect).select("rule")
        if not more.limit(1).count():
            return out
        grown = at.join(broadcast_if_small(more, F.length(F.array_join("rule", ""))), "rule")
        grown = grown.withColumn("i", F.explode(F.when(F.col("last") + 1 < F.size("items"), F.sequence(F.col("last") + 1, F.size("items") - 1))))
        at = grown.select("items", "n", "bad", "long", F.col("i").alias("last"), F.concat("rule", F.array(F.get("items", F.col("i")))).alias("rule"))


def contained(sets: DataFrame, tokens: str, rules: DataFrame) -> DataFrame:
    """Each set (array column `tokens`) with each of the rules (rule, anchor) that it holds, by the index of anchors."""
    index = broadcast_if_small(rules, F.length(F.array_join("rule", "")) + 16 * F.size("rule"))
    return sets.withColumn("anchor", F.explode(tokens)).join(index, "anchor").where(F.size(F.array_except("rule", tokens)) == 0).drop("anchor")


def anchored(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """Add `anchor`, the rarest of each rule's tokens (token, seen)."""
    filed = rules.select("rule", F.explode("rule").alias("token")).join(seen, "token")
    return rules.join(filed.groupBy("rule").agg(F.min_by("token", F.struct("seen", "token")).alias("anchor")), "rule")


def mine_rules(cases: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """rule (token array), confidence, support, seen, given_bad, given_seen, anchor: from (tokens, bad, given)."""
    from pyspark.ml.fpm import FPGrowth

    spark = cases.sparkSession
    out = "rule array<string>, confidence double, support long, seen long, given_bad long, given_seen long, anchor string"
    flag = lambda c: F.sum(c.cast("long"))
    sets = materialize(cases.groupBy("tokens").agg(F.count("*").alias("n"), flag(F.col("bad")).alias("bad"), flag(F.col("given")).alias("given_seen"), flag(F.col("given") & F.col("bad")).alias("given_bad")), "cases")
    total = sets.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], out)
    floor = max(min_count, int(-(-min_support * total // 1)))
    items = materialize(token_items(sets, floor), "items")
    of_set = sets.withColumn("token", F.explode("tokens")).join(broadcast_if_small(items.select(F.col("item").alias("token")), F.length("token")), "token")
    carried = of_set.groupBy("tokens", "n", "bad", "given_seen", "given_bad").agg(F.sort_array(F.collect_list("token")).alias("items")).drop("tokens")
    carried = materialize(carried, "carried")

    bad = carried.where("bad > 0").select("items", "bad")
    long = bad.where(F.size("items") > LONG)
    any_long = bool(long.limit(1).count())
    least = -(-floor // 2) if any_long else floor
    short = bad.where(F.size("items") <= LONG).select(F.explode(F.expr("array_repeat(items, cast(bad as int))")).alias("items"))
    rows = short.count()
    found = spark.createDataFrame([], "rule array<string>")
    if rows >= least:
        model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / rows), minConfidence=1.0).fit(short)
        found = model.freqItemsets.select(F.sort_array("items").alias("rule"))
    if any_long:
        found = found.unionByName(level_wise(carried, least, floor)).distinct()
    seen = items.select(F.col("item").alias("token"), "seen")
    candidates = materialize(anchored(materialize(found, "itemsets"), seen), "candidates")

    counted = contained(carried, "items", candidates).groupBy("rule").agg(F.sum("n").alias("seen"), F.sum("bad").alias("support"), F.sum("given_bad").alias("given_bad"), F.sum("given_seen").alias("given_seen"))
    rules = counted.withColumn("confidence", F.col("support") / F.col("seen"))
    sure = lower_bound(F.col("confidence"), F.col("seen")) >= MIN_LOWER_BOUND
    rules = materialize(rules.where((F.col("support") >= floor) & (F.col("confidence") >= min_confidence) & sure), "rules")
    # drop a rule if a shorter one inside it is at least as confident
    whole = rules.select(F.col("rule").alias("longer"), F.col("confidence").alias("own"))
    inside = contained(whole, "longer", anchored(rules, seen)).where((F.size("rule") < F.size("longer")) & (F.col("confidence") >= F.col("own")))
    covered = inside.select(F.col("longer").alias("rule")).distinct()
    kept = rules.join(covered, "rule", "left_anti")
    # items back to tokens; every token of an item is seen as often as the item
    members = kept.select("*", F.explode("rule").alias("item")).drop("seen").join(items, "item")
    spelt = members.groupBy("rule", "confidence", "support", "given_bad", "given_seen").agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("tokens"), F.min_by("item", F.struct("seen", "item")).alias("anchor"))
    kept = spelt.join(kept.select("rule", "seen"), "rule")
    return materialize(kept.select(F.col("tokens").alias("rule"), "confidence", "support", "seen", "given_bad", "given_seen", "anchor"), "filed")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, confidence, matched: the best rule of each distinct token set of (tokens) that has one; others give no row."""
    met = contained(pages.select("tokens"), "tokens", rules.select("rule", "confidence", "support", "anchor"))
    best = met.groupBy("tokens").agg(F.min_by(F.struct("confidence", "rule"), F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("rule").alias("r"))).alias("b"))
    return best.select("tokens", F.col("b.confidence").alias("confidence"), F.array_join("b.rule", " ").alias("matched"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[PathRule, ...] = RULES, seeds: tuple[str, ...] = (), **bounds: float) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule and its confidence where one matched."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    parsed = materialize(parsed, "urls")
    mined = mine_rules(labelled(parsed.select("page_id", "tokens"), labels, seeds), **bounds)
    matched = materialize(match_rules(parsed, mined), "matched")  # the sets that a rule fits, and no others
    matched = broadcast_if_small(matched, F.length(F.array_join("tokens", "")) + 16 * F.size("tokens"))
    judged = parsed.join(matched, "tokens", "left").withColumn("fitted", path_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fitted.verdict"), F.when(F.col("matched").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fitted.rule").alias("rule"), verdict.alias("verdict"), "matched", "confidence")


def op10_association_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
