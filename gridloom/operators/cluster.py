"""Clusters of a map's points with parameters read off the map itself.

A map's points are one short array, so its distance curve, the knee of the curve and the clusters at that radius are
expressions in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..sources.scratch import written

#: Neighbours that make a core point (itself included), and the radius of maps with too few points.
MIN_POINTS = 5
FEW_RADIUS, LEAST_RADIUS = 3.0, 0.5


def gradient(values: Column) -> Column:
    """Central differences; one-sided at both ends. At least two values."""
    last = F.size(values) - 1
    at = lambda i: F.get(values, i)
    return F.transform(values, lambda _, i: F.when(i == 0, at(F.lit(1)) - at(F.lit(0))).when(i == last, at(i) - at(i - 1)).otherwise((at(i + 1) - at(i - 1)) / 2))


def distance_curve(points: Column, w: int, k: int = MIN_POINTS) -> Column:
    """For cells of one map, the sorted distances to the k-th nearest point, each point its own nearest."""
    square = lambda a, b: ((G.row_of(a, w) - G.row_of(b, w)) * (G.row_of(a, w) - G.row_of(b, w)) + (G.column_of(a, w) - G.column_of(b, w)) * (G.column_of(a, w) - G.column_of(b, w))).cast("int")
    return F.array_sort(F.transform(points, lambda a: F.sqrt(F.get(F.array_sort(F.transform(points, lambda b: square(a, b))), k - 1).cast("double"))))


def knee(curve: Column) -> Column:
    """The value where a rising curve bends most: the largest second gradient past its first quarter, ties to the first."""
    bend = lambda c: F.transform(gradient(c), lambda x: F.round(x, 9))
    quarter = F.floor(F.size(curve) / 4).cast("int")
    best = G.let(G.let(gradient(curve), bend), lambda b: F.array_max(F.filter(F.transform(b, lambda x, i: F.when(i >= quarter, F.struct(x.alias("bend"), (-i).alias("minus")))), lambda s: s.isNotNull())))
    return F.get(curve, -best["minus"])


def with_radius(maps: DataFrame, w: int, min_points: int = MIN_POINTS) -> DataFrame:
    """Add `points` (set cells) and `radius`: the knee of the map's distance curve, at least half a cell; 3 for maps with min_points or fewer."""
    own = maps.withColumn("points", F.filter(F.transform("mask", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()))
    enough = F.size("points") > min_points
    curve = F.when(enough, distance_curve(F.col("points"), w, min_points))
    return own.withColumn("_curve", curve).withColumn("radius", F.when(enough, F.greatest(knee(F.col("_curve")), F.lit(LEAST_RADIUS))).otherwise(FEW_RADIUS)).drop("_curve")


def neighbours(points: Column, radius: Column, w: int) -> Column:
    """For each point of a map, the places in `points` of those within the radius, its own included.

    Both are bound once for a map: the optimizer puts a column that is used once in place, in a loop over pairs of points too.
    """
    near = lambda a, b, radius: F.sqrt(((G.row_of(a, w) - G.row_of(b, w)) * (G.row_of(a, w) - G.row_of(b, w)) + (G.column_of(a, w) - G.column_of(b, w)) * (G.column_of(a, w) - G.column_of(b, w))).cast("double")) <= radius
    own = lambda a, p, far: F.filter(F.transform(p, lambda b, j: F.when(near(a, b, far), j)), lambda j: j.isNotNull())
    return G.let(radius, lambda far: G.let(points, lambda p: F.transform(p, lambda a: own(a, p, far))))


def least_near(labels: Column, near: Column) -> Column:
    """For each point the least label above 0 among its neighbours, 0 if there is none."""
    return F.transform(near, lambda own: F.coalesce(F.array_min(F.filter(F.transform(own, lambda j: F.get(labels, j)), lambda x: x > 0)), F.lit(0)))


def dbscan_by_radius(maps: DataFrame, w: int, min_points: int = MIN_POINTS) -> DataFrame:
    """map_id, r, c, cluster for maps with `points` and `radius`, each map by its own: core points joined within the radius,
    border points with the smallest such cluster, others null. A cluster is named by its first core cell plus one.
    """
    own = written(maps.select("map_id", "points", neighbours(F.col("points"), F.col("radius"), w).alias("near")), "near")
    core = F.zip_with("points", "near", lambda p, own: F.when(F.size(own) >= min_points, p + 1).otherwise(0))

    def step(state: Column) -> Column:
        new = F.zip_with(state["labels"], least_near(state["labels"], F.col("near")), lambda x, y: F.when(x > 0, y).otherwise(0))
        return G.let(new, lambda n: F.struct(n.alias("labels"), (n == state["labels"]).alias("done")))

    first = F.struct(core.alias("labels"), F.lit(False).alias("done"))
    settled = F.aggregate("points", first, lambda s, _: F.when(s["done"], s).otherwise(step(s)))["labels"]
    found = G.let(settled, lambda labels: least_near(labels, F.col("near")))
    rows = own.select("map_id", F.explode(F.arrays_zip(F.col("points").alias("i"), found.alias("cluster"))).alias("x"))
    return rows.select("map_id", G.row_of(F.col("x.i"), w).alias("r"), G.column_of(F.col("x.i"), w).alias("c"), F.when(F.col("x.cluster") > 0, F.col("x.cluster")).alias("cluster"))
