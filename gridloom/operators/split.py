"""Splitting of region tokens that two patterns have grown together in.

A ring around the middle shows as a peak in a region's histogram of radii. The cells near the peak are kept as the ring,
what is left falls into its own connected regions, and the split stands only if both parts are worth it. Counting and
gating are groups of Spark over the cells; only the regions of what is left are labelled inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import segment as S
from ..sources.scratch import written
from .merge import token_sums, with_shape

#: When a region is suspected of being two, and when its ring is split off.
SUSPECT = {"area": 40, "cues": 1, "aspect": 2.5, "elongation": 8.0, "compactness": 1.2, "fill": 0.25}
RING = {"least": 5, "area": 30, "bins": 28, "reach": 1.05, "sectors": 36, "half_width": 0.075, "coverage": 0.18, "ring_share": 0.18, "rest_share": 0.06, "parts": 6, "kept": 0.75}


def cues() -> Column:
    """How many of four signs of two grown-together patterns a token has: long box, long axes, ragged edge, empty box."""
    tall, wide = F.col("r_max") - F.col("r_min") + 1, F.col("c_max") - F.col("c_min") + 1
    signs = [
        F.greatest(tall / wide, wide / tall) >= SUSPECT["aspect"], F.round(F.col("lambda_1") / F.greatest("lambda_2", F.lit(1e-6)), 9) >= SUSPECT["elongation"],
        F.col("perimeter") / F.col("area") >= SUSPECT["compactness"], F.col("area") / (tall * wide) <= SUSPECT["fill"],
    ]
    return G.total([s.cast("int") for s in signs])


def suspicious(tokens: DataFrame) -> DataFrame:
    """Tokens of enough cells with enough cues."""
    return tokens.withColumn("cues", cues()).where((F.col("area") >= SUSPECT["area"]) & (F.col("cues") >= SUSPECT["cues"]))


def ring_split(cells: DataFrame, h: int, w: int, radius: float, p: dict = RING) -> DataFrame:
    """map_id, token, part, area for the tokens of (map_id, token, r, c) that split: part 0 is the ring, others are named by
    their first cell plus one. Tokens that do not split have no rows.
    """
    key = ["map_id", "token"]
    away = F.sqrt((F.col("r") - h / 2) * (F.col("r") - h / 2) + (F.col("c") - w / 2) * (F.col("c") - w / 2)) / radius
    width = p["reach"] / p["bins"]
    turn = F.pmod(F.degrees(F.atan2(F.col("r") - F.lit(h / 2), F.col("c") - F.lit(w / 2))), F.lit(360.0))
    rows = cells.select(*key, "r", "c", away.alias("d"), F.least(F.floor(F.round(away / width, 9)), F.lit(p["bins"] - 1)).alias("bin"), F.floor(turn / (360.0 / p["sectors"])).alias("sector"))
    bins = rows.where(F.col("d") <= p["reach"]).groupBy(*key, "bin").agg(F.count("*").alias("n"))
    peaks = bins.groupBy(*key).agg(F.max(F.struct("n", (-F.col("bin")).alias("minus"))).alias("x")).select(*key, F.col("x.n").alias("peak"), ((0.5 - F.col("x.minus")) * width).alias("centre"))
    rows = rows.join(peaks, key).withColumn("ring", F.round(F.abs(F.col("d") - F.col("centre")), 9) <= p["half_width"])
    sums = rows.groupBy(*key, "peak").agg(F.count("*").alias("n"), F.count_if("ring").alias("in_ring"), F.count_distinct(F.when(F.col("ring"), F.col("sector"))).alias("sectors"))
    least = lambda share: F.greatest(F.lit(float(p["least"])), F.col("n") * share)
    split = sums.where(
        (F.col("n") >= max(3 * p["least"], p["area"])) & (F.col("peak") >= F.greatest(F.lit(2.0 * p["least"]), F.col("n") * p["ring_share"])) & (F.col("in_ring") >= least(p["ring_share"]))
        & (F.col("n") - F.col("in_ring") >= least(p["rest_share"])) & (F.col("sectors") / p["sectors"] >= p["coverage"])
    ).select(*key, "n", "in_ring")
    split = written(split, "split")
    rest = rows.where("NOT ring").join(split.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_set((F.col("r") * w + F.col("c")).cast("int")).alias("cells"))  # a token's cells
    mask = F.transform(G.cells_of(h, w), lambda i: F.array_contains("cells", i).cast("int"))
    labelled = S.with_components(rest.select(*key, mask.alias("mask")), "labels", "mask", h, w).select(*key, F.explode("labels").alias("part")).where("part > 0")
    parts = labelled.groupBy(*key, "part").agg(F.count("*").alias("area")).where(F.col("area") >= p["least"])
    parts = parts.unionByName(split.select(*key, F.lit(0).alias("part"), F.col("in_ring").alias("area")))
    own = Window.partitionBy(*key)
    sized = parts.withColumn("_parts", F.count("*").over(own)).withColumn("_kept", F.sum("area").over(own)).join(split.select(*key, "n"), key)
    return sized.where((F.col("_parts") > 1) & (F.col("_parts") <= p["parts"]) & (F.col("_kept") >= p["kept"] * F.col("n"))).select(*key, "part", "area")


def split_suspicious(cells: DataFrame, h: int, w: int, radius: float, p: dict = RING) -> DataFrame:
    """Ring splits of the suspicious tokens of (map_id, token, r, c, n, edges)."""
    cells = written(cells, "cells")
    own = suspicious(with_shape(token_sums(cells), h, w)).select("map_id", "token")
    return ring_split(cells.join(own, ["map_id", "token"], "left_semi"), h, w, radius, p)
