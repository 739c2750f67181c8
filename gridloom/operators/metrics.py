"""Metrics of ranked lists and of classifications, as windows and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discounted(gain: Column, place: Column) -> Column:
    return gain / F.log2(place + 1)


def query_metrics(ranked: DataFrame, pool: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row per query: ap_hit, ap_exact, n_ranked and for every k ndcg, precision, recall, hit rate, mean Jaccard, exact rate.

    ranked: query_id, rk (1, 2, ... without gaps), hit, exact, jac, gain. pool: the same for all allowed candidates,
    ranks aside; ideal gains and totals come from it. Its column n, if there is one, tells how many candidates a row stands
    for. An empty list scores 0; an ideal of 0 gives a null ndcg.
    """
    pool = pool if "n" in pool.columns else pool.withColumn("n", F.lit(1))
    upto = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranked.withColumn("_hits", F.sum("hit").over(upto)).withColumn("_exacts", F.sum("exact").over(upto))
    by_k = []
    for k in ks:
        top = F.col("rk") <= k
        in_k = lambda c, t=top: F.when(t, F.col(c))
        by_k += [F.sum(F.when(top, discounted(F.col("gain"), F.col("rk")))).alias(f"_dcg{k}"), F.avg(in_k("hit")).alias(f"precision_{k}"), F.sum(in_k("hit")).alias(f"_top{k}"), F.max(in_k("hit")).alias(f"hit_rate_{k}"), F.avg(in_k("jac")).alias(f"mean_jaccard_{k}"), F.max(in_k("exact")).alias(f"exact_rate_{k}")]
    own = running.groupBy("query_id").agg(F.count("*").alias("n_ranked"), F.sum(F.when(F.col("hit") > 0, F.col("_hits") / F.col("rk"))).alias("_ap_hit"), F.sum(F.when(F.col("exact") > 0, F.col("_exacts") / F.col("rk"))).alias("_ap_exact"), *by_k)
    grouped = pool.groupBy("query_id", "gain").agg(F.sum("n").alias("n"), F.sum(F.col("hit") * F.col("n")).alias("hit"), F.sum(F.col("exact") * F.col("n")).alias("exact"))
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    placed = grouped.withColumn("_last", F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_first", F.col("_last") - F.col("n") + 1)

    def ideal_gain(k: int) -> Column:
        places = F.sequence("_first", F.least("_last", F.lit(k)))
        return F.when(F.col("_first") <= k, F.aggregate(places, F.lit(0.0), lambda s, place: s + discounted(F.col("gain"), place)))

    ideal = placed.groupBy("query_id").agg(F.sum("hit").alias("_all_hit"), F.sum("exact").alias("_all_exact"), *[F.sum(ideal_gain(k)).alias(f"_ideal{k}") for k in ks])
    both = ideal.join(own, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = [
        "query_id", F.coalesce("n_ranked", F.lit(0)).alias("n_ranked"),
        (zero("_ap_hit") / F.greatest("_all_hit", F.lit(1.0))).alias("ap_hit"), (zero("_ap_exact") / F.greatest("_all_exact", F.lit(1.0))).alias("ap_exact"),
    ]
    for k in ks:
        ndcg = F.when(F.col("n_ranked").isNull(), 0.0).when(F.col(f"_ideal{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_ideal{k}"))
        out += [ndcg.alias(f"ndcg_{k}"), zero(f"precision_{k}").alias(f"precision_{k}"), (zero(f"_top{k}") / F.greatest("_all_hit", F.lit(1.0))).alias(f"recall_{k}"), *[zero(f"{n}_{k}").alias(f"{n}_{k}") for n in ("hit_rate", "mean_jaccard", "exact_rate")]]
    return both.select(*out)


#: Of every query and of every k, in the order of `query_metrics`.
LIST_METRICS, METRICS_AT = ("ap_hit", "ap_exact"), ("ndcg", "precision", "recall", "hit_rate", "mean_jaccard", "exact_rate")


def list_schema(ks: tuple[int, ...]) -> str:
    """The columns of `list_metrics`."""
    return ", ".join(["query_id long", "n_ranked long", *[f"{n} double" for n in LIST_METRICS], *[f"{n}_{k} double" for k in ks for n in METRICS_AT]])


def list_metrics(query_id: int, jac: np.ndarray, ks: tuple[int, ...]) -> dict[str, pa.Array]:
    """`query_metrics` of one whole list, which is its own pool, from the similarities (and gains) of its candidates in order."""
    rk = np.arange(1, len(jac) + 1)
    good = {"hit": jac > 0, "exact": jac == 1.0}
    total = {x: max(int(g.sum()), 1) for x, g in good.items()}
    out = {f"ap_{x}": (np.cumsum(g)[g] / rk[g]).sum() / total[x] for x, g in good.items()}
    for k in ks:
        places, best = np.log2(rk[:k] + 1), np.sort(np.partition(jac, len(jac) - k)[-k:] if len(jac) > k else jac)[::-1]
        ideal, top = (best / places).sum(), int(good["hit"][:k].sum())
        out |= {f"ndcg_{k}": (jac[:k] / places).sum() / ideal if ideal > 0 else None, f"precision_{k}": top / len(places), f"recall_{k}": top / total["hit"], f"hit_rate_{k}": float(top > 0), f"mean_jaccard_{k}": jac[:k].mean(), f"exact_rate_{k}": float(good["exact"][:k].any())}
    return {"query_id": pa.array([query_id], pa.int64()), "n_ranked": pa.array([len(jac)], pa.int64()), **{n: pa.array([x], pa.float64()) for n, x in out.items()}}


def mean_all(per_query: DataFrame, *names: str) -> DataFrame:
    """The mean of each column; nulls are left out, and a column of nulls has a null mean."""
    return per_query.agg(*[F.avg(n).alias(n) for n in names])


def flat(row: DataFrame, section: str) -> DataFrame:
    """One row of numbers as rows (section, metric, value)."""
    names = row.columns
    return row.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")


def preference_outcomes(preferences: DataFrame, scores: DataFrame) -> DataFrame:
    """preferences with preferred_score, less_preferred_score, credit (1, 0.5, 0; null if a score is missing) and outcome.

    scores: (query_id, candidate_id, score), one row a pair.
    """
    for side in ("preferred", "less_preferred"):
        own = scores.select("query_id", F.col("candidate_id").alias(f"{side}_candidate_id"), F.col("score").alias(f"{side}_score"))
        preferences = preferences.join(own, ["query_id", f"{side}_candidate_id"], "left")
    a, b = F.col("preferred_score"), F.col("less_preferred_score")
    missing = a.isNull() | b.isNull()
    credit = F.when(missing, F.lit(None)).when(F.isnan(a) | F.isnan(b), 0.0).when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)
    return preferences.withColumn("credit", credit).withColumn("outcome", F.when(missing, "missing").when(credit == 1.0, "correct").when(credit == 0.5, "tie").otherwise("incorrect"))


def preference_accuracy(outcomes: DataFrame) -> DataFrame:
    """Accuracy, tie rate, compared and missing counts: overall, by group and by rule, in one pass."""
    sets = outcomes.groupingSets([[], ["rule_group"], ["rule_type"]], "rule_group", "rule_type")
    level = F.when(F.grouping("rule_group") == 0, "group").when(F.grouping("rule_type") == 0, "rule").otherwise("overall")
    return sets.agg(level.alias("level"), F.avg("credit").alias("accuracy"), F.avg(F.when(F.col("credit").isNotNull(), (F.col("credit") == 0.5).cast("double"))).alias("tie_rate"), F.count("credit").alias("compared"), F.count_if(F.col("credit").isNull()).alias("missing"))


def trial_metrics(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """trial, best_rank, mean_rank, median_rank, mrr, and hit, recall, precision at each k; precision divides by k itself."""
    good = F.col("positive") == 1
    at = lambda k: F.count_if(good & (F.col("rk") <= k))
    parts = [F.min(F.when(good, F.col("rk"))).alias("best_rank"), F.avg(F.when(good, F.col("rk"))).alias("mean_rank"), F.percentile(F.when(good, F.col("rk")), 0.5).alias("median_rank"), F.coalesce(F.max(F.when(good, 1.0 / F.col("rk"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        parts += [(at(k) > 0).cast("double").alias(f"hit_{k}"), (at(k) / F.greatest(F.count_if(good), F.lit(1))).alias(f"recall_{k}"), (at(k) / F.lit(k)).alias(f"precision_{k}")]
    return ranked.groupBy("trial").agg(*parts)


def multilabel_scores(rows: DataFrame) -> DataFrame:
    """From (sample, cls, truth 0/1, guess 0/1): macro and micro F1, exact match, subset recall, Hamming accuracy."""
    by_class = rows.groupBy("cls").agg(*[F.count_if((F.col("truth") == t) & (F.col("guess") == g)).alias(n) for n, t, g in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))])
    f1 = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    of_classes = by_class.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1_macro"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1_micro"))
    by_sample = rows.groupBy("sample").agg(F.min((F.col("truth") == F.col("guess")).cast("double")).alias("exact"), F.min(F.when(F.col("truth") == 1, F.col("guess")).cast("double")).alias("covered"), F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("same"))
    of_samples = by_sample.agg(F.avg("exact").alias("exact_match"), F.avg("covered").alias("subset_recall"), F.avg("same").alias("hamming_accuracy"))
    return of_classes.join(F.broadcast(of_samples))  # one row each


def ranking_curves(rows: DataFrame) -> DataFrame:
    """From (cls, truth 0/1, score): average precision and AUROC of each class; a class without both truths has nulls.

    Equal scores count as one step.
    """
    steps = rows.groupBy("cls", "score").agg(F.sum("truth").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    down = Window.partitionBy("cls").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("tp", F.sum("p").over(down)).withColumn("seen", F.sum("n").over(down))
    negatives = F.col("n") - F.col("p")
    own = steps.groupBy("cls").agg(F.sum("p").alias("pos"), F.sum(negatives).alias("neg"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("area"), F.sum(negatives * (F.col("tp") - F.col("p") / 2)).alias("wins"))
    return own.select("cls", F.when((F.col("pos") > 0), F.col("area") / F.col("pos")).alias("average_precision"), F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("wins") / (F.col("pos") * F.col("neg"))).alias("auroc"))


def class_scores(rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """From (truth, guess): precision, recall, F-beta and support of each class."""
    pairs = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.lit(1).alias("t"), (F.col("truth") == F.col("guess")).cast("int").alias("g")), F.struct(F.col("guess").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("x"), (F.col("truth") == F.col("guess")).alias("same")).select("x.*", "same")
    # a right guess is counted once, from its truth side
    own = pairs.where("t = 1 OR NOT same").groupBy("cls").agg(F.count_if((F.col("t") == 1) & (F.col("g") == 1)).alias("tp"), F.count_if(F.col("t") == 0).alias("fp"), F.count_if((F.col("t") == 1) & (F.col("g") == 0)).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    own = own.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    b2 = beta * beta
    return own.withColumn("f_beta", safe((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))
