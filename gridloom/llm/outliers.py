"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every document gets counts over its whole text. Documents that pass the base rules give a vector of transformed
statistics; per language and source, a minimum-covariance-determinant estimate of centre and scatter is taken over all
of them, and a document is rejected if its Mahalanobis distance is beyond a chi-square quantile.

The estimate runs concentration steps from four starts (medians and quartiles, spatial signs, a central box, and plain
moments), keeps per group the one with the smallest determinant, then reweights. The closest share of a group is cut off
by a histogram of distances, so no group is ever gathered or sorted in one task. Each statistic has a least spread
(LEAST_SD), since most are zero for most texts. The same estimate is taken per language and over all documents, and a
group's centre and scatter are those of a mixture of its own documents with PRIOR_ROWS of its language, which in turn is
mixed with as many of all: a small group leans on its language, a large one stands alone, and nothing changes at a size.

Nulls and odd rows: a null text has no words and fails the base rules; a null language or source is a value of its own;
repeated rows count each time; a group of any size, even one document, has an estimate; an empty table gives no rows;
other columns are left out of the result, or kept as they are by `keep_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, materialize, table, words_of

#: Fixed values of the base rules and the symbol count.
NOT_SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED = 50

#: The transformed statistics and their least spreads. For lines and repeats it is one repeated line, and one more
#: window of three words, in a text of TYPICAL_WORDS words, so that each statistic can pass the cut by itself.
TYPICAL_WORDS = 270
LEAST_SD = {"word_length": 0.05, "symbols": 0.5, "same_lines": math.log1p(100 / TYPICAL_WORDS), "repeats": math.log1p(300 / TYPICAL_WORDS)}
NAMES = list(LEAST_SD)
#: Documents of its language that a group is mixed with, and of all that a language is.
PRIOR_ROWS = 100
#: The share of a group that a concentration step keeps, the number of steps, and the tail beyond which to reject.
SHARE = 0.75
STEPS = 4
TAIL = 1e-3
#: Bins of the distance histogram for each doubling of the distance.
BINS_PER_DOUBLING = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(value), with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def repeat_words(words: Column, width: int = 3) -> Column:
    """How many words stand in windows of `width` words that the array holds twice or more.

    Windows are compared by their 64-bit hashes. Hash and position are packed into one long to sort fast; where the
    packed part of the hash is shared by different hashes, or positions need over 21 bits, pairs are sorted instead.
    """
    low = (1 << 21) - 1

    def covered(positions: Column) -> Column:
        n = F.size(positions)
        steps = F.transform(positions, lambda p, k: F.when(k + 1 < n, F.least(F.lit(width), F.get(positions, k + 1) - p)).otherwise(F.lit(width)).cast("int"))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    def paired(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def count(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            return let(F.sort_array(F.transform(again, lambda x: x["k"])), covered)

        return let(rows, count)

    def packed(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, k: h.bitwiseAND(F.lit(~low)).bitwiseOR(k.cast("long"))))
        at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        shared = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(~low)) == 0, F.lit(False))

        def count(s: Column) -> Column:
            again = F.filter(s, lambda x, k: shared(x, F.get(s, k - 1)) | shared(x, F.get(s, k + 1)))

            def checked(a: Column) -> Column:
                mixed = F.exists(F.sequence(F.lit(1), F.size(a)), lambda k: shared(F.get(a, k - 1), F.get(a, k)) & (F.get(hashes, at(F.get(a, k - 1))) != F.get(hashes, at(F.get(a, k)))))
                return F.when(F.size(a) == 0, F.lit(0)).when(mixed, paired(hashes)).otherwise(let(F.sort_array(F.transform(a, at)), covered))

            return let(again, checked)

        return let(rows, count)

    def over(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.when(n == F.size(F.array_distinct(hashes)), F.lit(0)).when(n <= low, packed(hashes)).otherwise(paired(hashes))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda k: F.xxhash64(*[F.get(w, k + d) for d in range(width)]))

    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(let(let(words, windows), over))


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and the five counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda own: F.size(own) - F.size(F.array_distinct(own)))
    per_words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    counted = docs.select(
        *keep,
        per_words.alias("_w"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
    )
    return counted.select(*keep, F.col("_w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of NAMES."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(100 * F.col(c) / n)
    values = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    return [v.alias(name) for v, name in zip(values, NAMES)]


def chi_square_tail(x: float, even_dof: int) -> float:
    half = x / 2
    return math.exp(-half) * sum(half**k / math.factorial(k) for k in range(even_dof // 2))


def chi_square_quantile(tail: float, even_dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, even_dof) > tail else (low, mid)
    return high


ALL = "all"


def _levels() -> tuple[Column, Column, Column]:
    """The keys of a document's group, its language, and all."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.hex(c)), F.lit("-")) for c in ("lang", "source"))
    return F.concat(lang, F.lit("/"), source), lang, F.lit(ALL)


def _with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Join a row for each group: by broadcast while the groups are few (counted), else by a shuffle that Spark may split."""
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups) if few else groups, key)


def _moments(scale: float) -> list[Column]:
    """Aggregates n, m0.., c00..: mean and covariance, the covariance scaled and with the least spreads added."""
    p = range(len(NAMES))
    means = [F.avg(NAMES[i]).alias(f"m{i}") for i in p]
    scatter = [(F.covar_pop(NAMES[i], NAMES[j]) * scale + (LEAST_SD[NAMES[i]] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i in p for j in range(i + 1)]
    return [F.count("*").alias("n"), *means, *scatter]


def _scatter_names() -> list[str]:
    return [f"c{i}{j}" for i in range(len(NAMES)) for j in range(i + 1)]


def _factored(groups: DataFrame, *keys: str) -> DataFrame:
    """keys, n, centre m_i, scatter c_ij, and the factors l_ij and d_i of the scatter, L D L'."""
    p = range(len(NAMES))
    out = groups
    for j in p:
        out = out.withColumn(f"d{j}", F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 * F.col(f"d{k}") for k in range(j)), F.lit(0.0)))
        for i in range(j + 1, len(NAMES)):
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}") for k in range(j)), F.lit(0.0))) / F.col(f"d{j}"))
    factors = [f"d{j}" for j in p] + [f"l{i}{j}" for j in p for i in range(j + 1, len(NAMES))]
    return out.select(*keys, "n", *[f"m{i}" for i in p], *_scatter_names(), *factors, sum((F.log(f"d{j}") for j in p), F.lit(0.0)).alias("log_det"))


def _with_distance(rows: DataFrame) -> DataFrame:
    """Add `distance`, the squared Mahalanobis distance, to rows that carry their group's factors."""
    out = rows
    for i, name in enumerate(NAMES):
        out = out.withColumn(f"z{i}", F.col(name) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0)))
    return out.withColumn("distance", sum((F.col(f"z{i}") ** 2 / F.col(f"d{i}") for i in range(len(NAMES))), F.lit(0.0)))


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0: medians and quartile spreads; 1: plain moments; 2: spatial signs; 3: moments of a central box."""
    p = range(len(NAMES))
    quartiles = rows.groupBy("pool").agg(F.count("*").alias("n"), *[F.percentile_approx(NAMES[i], [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in p])
    spread = lambda i: (F.greatest(F.col(f"q{i}")[2] - F.col(f"q{i}")[0], F.lit(0.0)) / 1.349) ** 2 + LEAST_SD[NAMES[i]] ** 2  # noqa: E731  quartiles of a normal are 1.349 sd apart
    middle = materialize(quartiles.select("pool", "n", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in p], *[F.sqrt(spread(i)).alias(f"s{i}") for i in p]), "middle")
    centre = [F.col(f"m{i}") for i in p]
    robust = middle.select("pool", F.lit(0).alias("start"), "n", *centre, *[(F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    scaled = _with_groups(rows, middle, "pool").select("pool", "n", *centre, *[f"s{i}" for i in p], *NAMES, *[((F.col(NAMES[i]) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"u{i}") for i in p])
    length = F.greatest(sum((F.col(f"u{i}") ** 2 for i in p), F.lit(0.0)), F.lit(1e-9))
    first = lambda c: F.first(c).alias(c)  # noqa: E731  one value in a pool
    signs = scaled.groupBy("pool").agg(first("n"), *[first(f"m{i}") for i in p], *[first(f"s{i}") for i in p], *[(F.avg(F.col(f"u{i}") * F.col(f"u{j}") / length) * len(NAMES)).alias(f"e{i}{j}") for i in p for j in range(i + 1)])
    signs = signs.select("pool", F.lit(2).alias("start"), "n", *centre, *[(F.col(f"e{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}") + (LEAST_SD[NAMES[i]] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    box = scaled.where(" AND ".join(f"abs(u{i}) <= 1.5" for i in p))
    boxed = box.groupBy("pool").agg(*_moments(1.0)).withColumn("start", F.lit(3))
    classical = rows.groupBy("pool").agg(*_moments(1.0)).withColumn("start", F.lit(1))
    return _factored(robust.unionByName(classical).unionByName(signs).unionByName(boxed), "pool", "start")


def _closest(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of each (pool, start) in the lowest distance bins that hold SHARE of it."""
    measured = _with_distance(_with_groups(rows, groups, "pool"))
    measured = measured.withColumn("bin", F.floor(F.log2(F.greatest("distance", F.lit(1e-9))) * BINS_PER_DOUBLING).cast("int"))
    histogram = measured.groupBy("pool", "start", "bin").agg(F.count("*").alias("k"))
    whole = Window.partitionBy("pool", "start")
    reached = F.sum("k").over(whole.orderBy("bin")) - F.col("k") < SHARE * F.sum("k").over(whole)
    last = histogram.withColumn("in", reached).where("in").groupBy("pool", "start").agg(F.max("bin").alias("last"))
    return measured.join(F.broadcast(last) if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else last, ["pool", "start"]).where("bin <= last")


def estimate(rows: DataFrame) -> DataFrame:
    """For written `rows` (pool, statistics): each pool's reweighted estimate, with its factors."""
    p = len(NAMES)
    inner = chi_square_quantile(1 - SHARE, p)
    consistency = SHARE / (1 - chi_square_tail(inner, p + 2))
    groups = materialize(_starts(rows), "starts")
    for _ in range(STEPS):
        groups = materialize(_factored(_closest(rows, groups).groupBy("pool", "start").agg(*_moments(consistency)), "pool", "start"), "step")
    best = groups.groupBy("pool").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    groups = materialize(groups.join(best, ["pool", "start"]), "least")
    near = _with_distance(_with_groups(rows, groups, "pool")).where(F.col("distance") <= chi_square_quantile(0.025, p))
    again = _factored(near.groupBy("pool").agg(*_moments(1.0)), "pool")
    missed = groups.drop("start").join(again, "pool", "left_anti")
    return materialize(again.unionByName(missed), "estimate")


def _mixed(groups: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Moments of each group's documents mixed with PRIOR_ROWS of the prior with the same `key`."""
    p = range(len(NAMES))
    moments = [f"m{i}" for i in p] + _scatter_names()
    joined = _with_groups(groups, prior.select(key, *[F.col(c).alias(f"p_{c}") for c in moments]), key)
    w = F.col("n") / (F.col("n") + PRIOR_ROWS)
    gap = [F.col(f"m{i}") - F.col(f"p_m{i}") for i in p]
    means = [(w * F.col(f"m{i}") + (1 - w) * F.col(f"p_m{i}")).alias(f"m{i}") for i in p]
    scatter = [(w * F.col(f"c{i}{j}") + (1 - w) * F.col(f"p_c{i}{j}") + w * (1 - w) * gap[i] * gap[j]).alias(f"c{i}{j}") for i in p for j in range(i + 1)]
    return joined.select("pool", "lang", F.lit(ALL).alias("all"), "n", *means, *scatter)


def group_estimates(vectors: DataFrame) -> DataFrame:
    """pool, and the centre and factors to judge its documents by, for written `vectors` (lang, source, statistics)."""
    group, lang, every = _levels()
    keys = materialize(vectors.select(group.alias("pool"), lang.alias("lang")).distinct(), "keys")
    rows = materialize(vectors.select(F.explode(F.array(group, lang, every)).alias("pool"), *NAMES), "levels")
    known = estimate(rows).select("pool", "n", *[f"m{i}" for i in range(len(NAMES))], *_scatter_names())
    top = known.where(F.col("pool") == ALL).withColumnRenamed("pool", "all")
    langs = known.join(keys.select(F.col("lang").alias("pool")).distinct(), "pool").withColumn("lang", F.col("pool")).withColumn("all", F.lit(ALL))
    langs = _mixed(langs, top, "all")
    groups = _mixed(known.join(keys, "pool").withColumn("all", F.lit(ALL)), langs.drop("pool"), "lang")
    return materialize(_factored(groups, "pool"), "groups")


def with_distance(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Add `distance` to rows (lang, source, statistics)."""
    return _with_distance(_with_groups(rows.withColumn("pool", _levels()[0]), known.drop("n"), "pool"))


def within_tail() -> Column:
    return F.col("distance") <= chi_square_quantile(TAIL, len(NAMES))


def judge(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the five counts, base_failed, kept, distance (null where the base rules fail)."""
    counted = materialize(text_counts(docs, key, "lang", "source").withColumn("base_failed", base_failed()), "counts")
    passing = materialize(counted.where("NOT base_failed").select(key, *COUNTS, "lang", "source", *vector()), "vectors")
    judged = with_distance(passing, group_estimates(passing.select("lang", "source", *NAMES)))
    passed = judged.select(key, *COUNTS, F.lit(False).alias("base_failed"), within_tail().alias("kept"), "distance")
    failed = counted.where("base_failed").select(key, *COUNTS, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.

    Rows are written beside their statistics, so each text is counted once and none has to be found again by an id.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    counted = text_counts(packed, "_row", "lang", "source").where(~base_failed())
    passing = materialize(counted.select("_row", "lang", "source", *vector()), "passing")
    known = group_estimates(passing.select("lang", "source", *NAMES))
    return with_distance(passing, known).where(within_tail()).select("_row.*")


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
