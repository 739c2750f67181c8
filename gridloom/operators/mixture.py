"""Gaussian mixtures of the points of every map, all maps at once.

Each round is one plan over all maps: a point rates its map's components, the shares are summed up by (map, component),
and those sums are the next components. A component whose share falls under what its parameters cost is dropped, which
settles how many a map needs. Spreads have a prior of about one cell, so no component shrinks onto a point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid as G
from ..sources.scratch import written

#: Components to start with, rounds, the cost of a component in points, and the prior: so many points of this variance.
COMPONENTS, ROUNDS, COST = 8, 12, 2.5
PRIOR_POINTS, PRIOR_VARIANCE = 1.0, 0.25
#: Rounds of one plan; then the components are written.
TOGETHER = 3


def seeds(points: Column, w: int, k: int) -> Column:
    """Up to k cells far from each other: the first point, then always the one farthest from those taken; ties to the first."""
    square = lambda a, b: (G.row_of(a, w) - G.row_of(b, w)) * (G.row_of(a, w) - G.row_of(b, w)) + (G.column_of(a, w) - G.column_of(b, w)) * (G.column_of(a, w) - G.column_of(b, w))

    def more(taken: Column, _: Column) -> Column:
        farthest = F.array_max(F.transform(points, lambda p: F.struct(F.array_min(F.transform(taken, lambda t: square(p, t))).alias("d"), (-p).alias("minus"))))
        return G.let(farthest, lambda f: F.when(f["d"] > 0, F.concat(taken, F.array(-f["minus"]))).otherwise(taken))

    return F.aggregate(F.sequence(F.lit(2), F.lit(k)), F.slice(points, 1, 1), more)


def first_components(maps: DataFrame, w: int, k: int = COMPONENTS) -> DataFrame:
    """map_id, k, weight, mr, mc, srr, scc, src: equal shares around the seeds, each as wide as a k-th of the map's variance."""
    n = F.size("points")
    mean = lambda f: F.aggregate("points", F.lit(0.0), lambda s, i: s + f(i)) / n
    row, column = lambda i: G.row_of(i, w).cast("double"), lambda i: G.column_of(i, w).cast("double")
    own = maps.where(n >= 2).withColumn("_s", seeds(F.col("points"), w, k))
    spread = (mean(lambda i: row(i) * row(i)) - mean(row) * mean(row) + mean(lambda i: column(i) * column(i)) - mean(column) * mean(column)) / 2
    own = own.withColumn("_v", F.greatest(spread / F.size("_s"), F.lit(PRIOR_VARIANCE)))
    rows = own.select("map_id", F.posexplode("_s").alias("k", "i"), F.size("_s").alias("n"), "_v")
    return rows.select("map_id", "k", (1.0 / F.col("n")).alias("weight"), row(F.col("i")).alias("mr"), column(F.col("i")).alias("mc"), F.col("_v").alias("srr"), F.col("_v").alias("scc"), F.lit(0.0).alias("src"))


def log_density(c: Column, r: Column, col: Column) -> Column:
    """log(weight * density) of a component (struct) at a point."""
    det = c["srr"] * c["scc"] - c["src"] * c["src"]
    dr, dc = r - c["mr"], col - c["mc"]
    return F.log(c["weight"]) - math.log(2 * math.pi) - 0.5 * F.log(det) - 0.5 * (dr * dr * c["scc"] - 2 * dr * dc * c["src"] + dc * dc * c["srr"]) / det


def rated(points: DataFrame, components: DataFrame) -> DataFrame:
    """map_id, r, c, ratings (struct k, p: log of weight times density) and top (their log-sum) of every point (map_id, r, c)."""
    names = ("k", "weight", "mr", "mc", "srr", "scc", "src")
    held = components.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_own"))  # COMPONENTS at most
    joined = points.join(held, "map_id")
    ratings = F.transform("_own", lambda c: F.struct(c["k"].alias("k"), log_density(c, F.col("r"), F.col("c")).alias("p")))
    rows = joined.select("map_id", "r", "c", ratings.alias("ratings")).withColumn("_m", F.array_max(F.transform("ratings", lambda x: x["p"])))
    return rows.withColumn("top", F.col("_m") + F.log(F.aggregate("ratings", F.lit(0.0), lambda s, x: s + F.exp(x["p"] - F.col("_m"))))).drop("_m")


def em_round(points: DataFrame, components: DataFrame, cost: float = COST) -> DataFrame:
    """The next components: sums of shares by (map, component), costs taken off, spreads held by the prior."""
    shares = rated(points, components).select("map_id", "r", "c", F.explode(F.transform("ratings", lambda x: F.struct(x["k"].alias("k"), F.exp(x["p"] - F.col("top")).alias("s")))).alias("x"))
    s, r, c = F.col("x.s"), F.col("r"), F.col("c")
    sums = shares.groupBy("map_id", F.col("x.k").alias("k")).agg(F.sum(s).alias("n"), F.sum(s * r).alias("r"), F.sum(s * c).alias("c"), F.sum(s * r * r).alias("rr"), F.sum(s * c * c).alias("cc"), F.sum(s * r * c).alias("rc"))
    own = Window.partitionBy("map_id")  # COMPONENTS rows at most
    least = F.when(F.col("n") == F.max("n").over(own), 1e-3).otherwise(0.0)
    kept = sums.withColumn("_w", F.greatest(F.col("n") - cost, least)).where("_w > 0").withColumn("_whole", F.sum("_w").over(own))
    n, extra = F.col("n"), PRIOR_POINTS * PRIOR_VARIANCE
    mr, mc = F.col("r") / n, F.col("c") / n
    spread = lambda both, a, b, prior: (F.col(both) - n * a * b + prior) / (n + PRIOR_POINTS)
    return kept.select("map_id", "k", (F.col("_w") / F.col("_whole")).alias("weight"), mr.alias("mr"), mc.alias("mc"), spread("rr", mr, mr, extra).alias("srr"), spread("cc", mc, mc, extra).alias("scc"), spread("rc", mr, mc, 0.0).alias("src"))


def objective(points: DataFrame, components: DataFrame, cost: float = COST) -> DataFrame:
    """map_id, components, objective: log likelihood, less the components' costs and the prior's penalty. No round lowers it but one that drops a component."""
    likelihood = rated(points, components).groupBy("map_id").agg(F.sum("top").alias("_l"))
    det = F.col("srr") * F.col("scc") - F.col("src") ** 2
    penalty = cost * F.log("weight") + 0.5 * PRIOR_POINTS * (F.log(det) + PRIOR_VARIANCE * (F.col("srr") + F.col("scc")) / det)
    return likelihood.join(components.groupBy("map_id").agg(F.count("*").alias("components"), F.sum(penalty).alias("_p")), "map_id").select("map_id", "components", (F.col("_l") - F.col("_p")).alias("objective"))


def mixtures(maps: DataFrame, w: int, k: int = COMPONENTS, rounds: int = ROUNDS, cost: float = COST) -> tuple[DataFrame, DataFrame]:
    """The points and the settled components of maps (map_id, points: set cells). Maps of one point or none have none."""
    points = written(maps.select("map_id", F.explode("points").alias("i")).select("map_id", G.row_of(F.col("i"), w).cast("double").alias("r"), G.column_of(F.col("i"), w).cast("double").alias("c")), "points")
    components = written(first_components(maps, w, k), "components")
    for at in range(rounds):
        components = em_round(points, components, cost)
        if at % TOGETHER == TOGETHER - 1 or at == rounds - 1:
            components = written(components, "components")
    return points, components


def mixture_labels(points: DataFrame, components: DataFrame) -> DataFrame:
    """map_id, r, c, component: the likeliest, ties to the first."""
    best = F.array_max(F.transform("ratings", lambda x: F.struct(F.round(x["p"], 9).alias("p"), (-x["k"]).alias("minus"))))
    return rated(points, components).select("map_id", "r", "c", (-best["minus"]).alias("component"))
