"""Moved, turned, scaled and corrupted copies of maps, drawn by hash, tried until one is different enough.

Every copy has an ordered list of tries: the wanted kind first, then the other kinds, each so many times. All tries are
rows, a try is a column expression over the map's points, and the first accepted one of each copy is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from .benchmark import mixed

#: Kinds in fallback order, and what their parameters are drawn from.
KINDS = ("corrupted_affine", "affine", "scale", "rotate", "translate")
ANGLES = (-60.0, -45.0, -30.0, -20.0, 20.0, 30.0, 45.0, 60.0)
SCALES = (0.65, 0.75, 1.30, 1.45)
MOVES = tuple((dx, dy) for dx in range(-6, 7) for dy in range(-6, 7) if 2.0 <= math.hypot(dx, dy) <= 6.0)
DROPOUTS, NOISES = (0.10, 0.20, 0.30), (0.05, 0.10)
#: A copy is accepted with at least this share of the cells (three at least), at most this share of the valid area, and an IoU under this.
LEAST_CELLS, LEAST_SHARE, MOST_SHARE, MOST_IOU = 3, 0.30, 0.80, 0.98
LAST_RESORT = (3, -3)


def _draw(options: tuple, key: Column, part: Column, seed: int) -> Column:
    """One of the options, by hash."""
    at = F.floor(mixed(key, part, seed) * len(options) / 4294967296).cast("int")
    return F.get(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(o, ("dx", "dy"))]) if isinstance(o, tuple) else F.lit(o) for o in options]), at)


def tries(maps: DataFrame, retries: int) -> DataFrame:
    """A row for each try of each kind of copy: wanted, kind, order, and its parameters dx, dy, angle, scale, dropout, noise."""
    every = [(w, k, n * retries + t) for w in range(len(KINDS)) for n, k in enumerate([w, *[x for x in range(len(KINDS)) if x != w]]) for t in range(retries)]
    listed = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"), F.lit(o).alias("order")) for w, k, o in every], F.struct(*[F.lit(-1).alias(x) for x in ("w", "k", "order")])))
    rows = maps.select("*", listed.alias("t")).where("t.w >= 0").select(*maps.columns, "t.*")
    part = F.col("w") * 512 + F.col("order")
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), F.col("k"))
    moved, turned, sized = kind.isin("translate", "affine", "corrupted_affine"), kind.isin("rotate", "affine", "corrupted_affine"), kind.isin("scale", "affine", "corrupted_affine")
    drawn = lambda options, seed: _draw(options, F.col("map_id"), part, seed)
    corrupt = kind == "corrupted_affine"
    return rows.select(
        *maps.columns, F.get(F.array(*[F.lit(x) for x in KINDS]), F.col("w")).alias("wanted"), kind.alias("kind"), "order", part.alias("part"),
        F.when(moved, drawn(MOVES, 11)["dx"]).otherwise(0).alias("dx"), F.when(moved, drawn(MOVES, 11)["dy"]).otherwise(0).alias("dy"), F.when(turned, drawn(ANGLES, 12)).otherwise(0.0).alias("angle"),
        F.when(sized, drawn(SCALES, 13)).otherwise(1.0).alias("scale"), F.when(corrupt, drawn(DROPOUTS, 14)).otherwise(0.0).alias("dropout"), F.when(corrupt, drawn(NOISES, 15)).otherwise(0.0).alias("noise"),
    )


def moved_cells(points: Column, h: int, w: int) -> Column:
    """The distinct cells of points scaled and turned around (h / 2, w / 2) and moved, each to the nearest cell, halves to even."""
    cos, sin = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    rel_r, rel_c = lambda i: (G.row_of(i, w) - h / 2) * F.col("scale"), lambda i: (G.column_of(i, w) - w / 2) * F.col("scale")
    near = lambda x: F.rint(F.round(x, 9)).cast("int")
    to = lambda i: F.struct(near(cos * rel_r(i) - sin * rel_c(i) + h / 2 + F.col("dy")).alias("r"), near(sin * rel_r(i) + cos * rel_c(i) + w / 2 + F.col("dx")).alias("c"))
    inside = F.filter(F.transform(points, to), lambda p: (p["r"] >= 0) & (p["r"] < h) & (p["c"] >= 0) & (p["c"] < w))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda p: p["r"] * w + p["c"])))


def changed_copies(maps: DataFrame, h: int, w: int, retries: int = 5) -> DataFrame:
    """map_id, wanted, kind, accepted, parameters, cells, iou: for each kind of copy of maps (map_id, mask, valid) the first try that
    is accepted; if none is, a plain move by LAST_RESORT, whatever it gives.
    """
    cells = lambda m: F.filter(F.transform(m, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    own = maps.select("map_id", cells(F.col("mask")).alias("points"), cells(F.col("valid")).alias("ground"))
    tried = tries(own, retries)
    last = own.select("*", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("wanted")).select(
        *own.columns, "wanted", F.lit("translate").alias("kind"), F.lit(len(KINDS) * retries).alias("order"), F.lit(0).alias("part"), F.lit(LAST_RESORT[0]).alias("dx"), F.lit(LAST_RESORT[1]).alias("dy"),
        *[F.lit(v).alias(n) for n, v in (("angle", 0.0), ("scale", 1.0), ("dropout", 0.0), ("noise", 0.0))],
    )
    rows = tried.unionByName(last).withColumn("cells", F.array_intersect(moved_cells(F.col("points"), h, w), "ground"))
    share = lambda i, seed: mixed(F.col("map_id") * 31 + F.col("part"), i, seed) / 4294967296.0
    rows = rows.withColumn("cells", F.filter("cells", lambda i: share(i, 16) >= F.col("dropout")))
    free = F.array_sort(F.transform(F.array_except("ground", "cells"), lambda i: F.struct(share(i, 17).alias("h"), i.alias("i"))))
    more = F.slice(F.transform(free, lambda x: x["i"]), F.lit(1), F.rint(F.size("points") * F.col("noise")).cast("int"))
    rows = rows.withColumn("cells", F.array_sort(F.array_union("cells", more)))
    both, either = F.size(F.array_intersect("cells", "points")), F.size(F.array_union("cells", "points"))
    rows = rows.withColumn("iou", F.when(either == 0, 1.0).otherwise(both / either))
    least = F.greatest(F.lit(LEAST_CELLS), F.ceil(F.size("points") * LEAST_SHARE))
    fits = (F.size("cells") >= least) & (F.size("cells") <= MOST_SHARE * F.size("ground")) & (F.col("iou") < MOST_IOU)
    rows = rows.withColumn("accepted", fits & (F.col("order") < len(KINDS) * retries))
    kept = ["kind", "accepted", "order", "dx", "dy", "angle", "scale", "dropout", "noise", "cells", "iou"]
    # orders that do not count are null: a filter would be pushed down to the points, with the copy worked out again wherever it is named
    counts = F.when(F.col("accepted") | (F.col("order") == len(KINDS) * retries), F.col("order"))
    first = F.min_by(F.struct(*kept), counts)
    return rows.groupBy("map_id", "wanted").agg(first.alias("x")).select("map_id", "wanted", "x.*")
