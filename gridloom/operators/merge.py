"""Merging of region tokens that one pattern was cut into.

Tokens of a map form a graph: two are joined if they lie on one ring, on one line or in one blob, asked in this order.
What the edges connect becomes one token, whose statistics are added up from its parts' sums: no pixel is read again.
A map has few tokens, so pairs within a map are a join of its rows, and the order-dependent contraction is a fold over
its short list of edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import segment as S
from ..sources.scratch import written
from .segment import eigenvalues, region_cells

#: The default gates of the three predicates.
GATES = {
    "min_area": 5, "ring_least_radius": 0.25, "ring_radial_gap": 0.14, "ring_theta_gap": 55.0, "line_least_area": 4, "line_elongation": 4.0, "line_gap": 11.0, "line_angle_gap": 30.0,
    "line_perp_gap": 5.0, "blob_gap": 3.0, "blob_bbox": 220,
}
THETA_BINS = 72
ADDED = ("area", "mass", "perimeter", "sum_r", "sum_c", "sum_rr", "sum_cc", "sum_rc")


def token_sums(cells: DataFrame) -> DataFrame:
    """Sums and box of every token of (map_id, token, r, c, n, edges): all that its statistics need, and additive."""
    r, c = F.col("r").cast("bigint"), F.col("c").cast("bigint")
    return cells.groupBy("map_id", "token").agg(
        F.count("*").alias("area"), F.sum("n").alias("mass"), F.sum("edges").cast("bigint").alias("perimeter"),
        F.sum(r).alias("sum_r"), F.sum(c).alias("sum_c"), F.sum(r * r).alias("sum_rr"), F.sum(c * c).alias("sum_cc"), F.sum(r * c).alias("sum_rc"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.array_sort(F.collect_list(F.struct("r", "c"))).alias("pixels"),
    )


def with_shape(sums: DataFrame, h: int, w: int) -> DataFrame:
    """Add centroid, principal axes, axis (degrees from the row axis, 0 to 180; 0 if no direction is longer) and radial (share of half the diagonal) to sums."""
    n = F.col("area").cast("double")
    own = sums.withColumn("centroid_r", F.col("sum_r") / n).withColumn("centroid_c", F.col("sum_c") / n)
    rr, cc = F.col("sum_rr") / n - F.col("centroid_r") ** 2, F.col("sum_cc") / n - F.col("centroid_c") ** 2
    rc = F.col("sum_rc") / n - F.col("centroid_r") * F.col("centroid_c")
    large, small = eigenvalues(rr, cc, rc)
    own = own.withColumn("lambda_1", large).withColumn("lambda_2", small)
    axis = F.pmod(F.round(0.5 * F.degrees(F.atan2(F.round(2 * rc, 9) + 0.0, F.round(rr - cc, 9) + 0.0)), 9), F.lit(180.0))
    away = F.sqrt((F.col("centroid_r") - h / 2) ** 2 + (F.col("centroid_c") - w / 2) ** 2) / max(math.hypot(h, w) / 2, 1)
    return own.withColumn("axis", F.when(F.col("lambda_1") > 1e-10, axis).otherwise(0.0)).withColumn("radial", away)


def _gap(a: Column, b: Column, distance) -> Column:
    """The least distance between the members of two arrays."""
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: distance(x, y)))))


def ring_fits(g: dict = GATES) -> Column:
    """Both tokens lie off the middle, about as far out as each other, and near in angle."""
    turn = lambda x, y: F.least(F.abs(x - y), F.lit(THETA_BINS) - F.abs(x - y))
    near = _gap(F.col("a_bins"), F.col("b_bins"), turn) * (360.0 / THETA_BINS) <= g["ring_theta_gap"]
    return (F.round(F.least("a_radial", "b_radial"), 9) >= g["ring_least_radius"]) & (F.round(F.abs(F.col("a_radial") - F.col("b_radial")), 9) <= g["ring_radial_gap"]) & near


def line_fits(g: dict = GATES) -> Column:
    """One token at least is long, both point the same way, and the way between them runs along that."""
    turn = F.abs(F.pmod(F.col("a_axis") - F.col("b_axis") + 90.0, F.lit(180.0)) - 90.0)
    long = F.greatest(*[F.col(f"{s}_lambda_1") / F.greatest(f"{s}_lambda_2", F.lit(1e-6)) for s in "ab"])
    dr, dc = F.col("b_centroid_r") - F.col("a_centroid_r"), F.col("b_centroid_c") - F.col("a_centroid_c")
    theta = F.radians((F.col("a_axis") + F.col("b_axis")) / 2)
    off = F.abs(dr * F.sin(theta) - dc * F.cos(theta))
    return (F.least("a_area", "b_area") >= g["line_least_area"]) & (F.round(turn, 9) <= g["line_angle_gap"]) & (F.round(long, 9) >= g["line_elongation"]) & (F.round(F.sqrt(dr * dr + dc * dc), 9) <= g["line_gap"]) & (F.round(off, 9) <= g["line_perp_gap"])


def blob_fits(g: dict = GATES) -> Column:
    """The tokens nearly touch and their common box is small."""
    square = lambda x, y: (x["r"] - y["r"]) * (x["r"] - y["r"]) + (x["c"] - y["c"]) * (x["c"] - y["c"])
    tall = F.greatest("a_r_max", "b_r_max") - F.least("a_r_min", "b_r_min") + 1
    wide = F.greatest("a_c_max", "b_c_max") - F.least("a_c_min", "b_c_min") + 1
    return (tall * wide <= g["blob_bbox"]) & (_gap(F.col("a_pixels"), F.col("b_pixels"), square) <= g["blob_gap"] ** 2)


def merge_edges(tokens: DataFrame, h: int, w: int, predicates: tuple[str, ...] = ("ring", "line", "blob"), gates: dict = GATES) -> DataFrame:
    """map_id, a, b, reason for tokens (numbered by `at` within their map) that the first fitting predicate joins; a is before b."""
    fits = {"ring": ring_fits, "line": line_fits, "blob": blob_fits}
    bits = S.angle_bins(F.col("pixels"), h / 2, w / 2, THETA_BINS)
    own = tokens.withColumn("bins", F.filter(F.transform(bits, lambda b, i: F.when(b, i)), lambda x: x.isNotNull()))
    side = lambda p: own.select("map_id", *[F.col(c).alias(f"{p}_{c}") for c in own.columns if c != "map_id"])
    pairs = side("a").join(side("b"), "map_id").where("a_at < b_at")  # a map's tokens, a few
    reason = F.lit(None).cast("string")
    for name in reversed(predicates):
        reason = F.when(fits[name](gates), name).otherwise(reason)
    return pairs.withColumn("reason", reason).where("reason IS NOT NULL").select("map_id", F.col("a_at").alias("a"), F.col("b_at").alias("b"), "reason")


def contract(edges: Column, n: Column) -> Column:
    """struct(labels, reasons) of n tokens after joining along `edges` (array of struct a, b, reason) in order.

    labels: each token's leader; reasons: of a leader, the predicates that joined something to it, in that order.
    """
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("labels"), F.array_repeat(F.lit("single"), n).alias("reasons"))

    def join(state: Column, edge: Column) -> Column:
        a, b = F.get(state["labels"], edge["a"]), F.get(state["labels"], edge["b"])
        labels = F.transform(state["labels"], lambda x: F.when(x == b, a).otherwise(x))
        longer = lambda x: F.when(x == "single", edge["reason"]).when(F.array_contains(F.split(x, r"\+"), edge["reason"]), x).otherwise(F.concat(x, F.lit("+"), edge["reason"]))
        reasons = F.transform(state["reasons"], lambda x, i: F.when(i == a, longer(x)).otherwise(x))
        return F.when(a == b, state).otherwise(F.struct(labels.alias("labels"), reasons.alias("reasons")))

    return F.aggregate(edges, start, join)


def merged_tokens(cells: DataFrame, h: int, w: int, predicates: tuple[str, ...] = ("ring", "line", "blob"), gates: dict = GATES) -> DataFrame:
    """One row for each merged token of (map_id, token, r, c, n, edges): the sums and shape of all its parts, `parts` and `reason`.

    Tokens under the least area are left out first. A merged token has the name of its first part.
    """
    own = with_shape(token_sums(cells).where(F.col("area") >= gates["min_area"]), h, w)
    places = own.groupBy("map_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    own = written(own.join(places, "map_id").withColumn("at", F.array_position("tokens", F.col("token")).cast("int") - 1).drop("tokens"), "tokens")
    edges = merge_edges(own, h, w, predicates, gates).groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "reason"))).alias("edges"))
    counts = own.groupBy("map_id").agg(F.count("*").cast("int").alias("n"))
    none = F.expr("cast(array() as array<struct<a:int,b:int,reason:string>>)")
    folded = counts.join(edges, "map_id", "left").select("map_id", contract(F.coalesce("edges", none), F.col("n")).alias("x"))
    named = folded.select("map_id", F.posexplode("x.labels").alias("at", "label"), F.col("x.reasons").alias("reasons"))
    named = named.select("map_id", "at", "label", F.get("reasons", F.col("label")).alias("reason"))
    parts = own.join(named, ["map_id", "at"])
    joined = parts.groupBy("map_id", "label", "reason").agg(
        F.min("token").alias("token"), F.count("*").alias("parts"), *[F.sum(x).alias(x) for x in ADDED],
        F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max"), F.min("c_min").alias("c_min"), F.max("c_max").alias("c_max"), F.array_sort(F.flatten(F.collect_list("pixels"))).alias("pixels"),
    )
    return with_shape(joined, h, w).drop("label")


def geometry_merge_tokens(maps: DataFrame, h: int, w: int, gates: dict = GATES) -> DataFrame:
    """Mode `geometry-merge`: the connected regions of a map, merged."""
    return merged_tokens(region_cells(maps, h, w), h, w, gates=gates)


def dilated_cells(maps: DataFrame, h: int, w: int, radius: int = 1) -> DataFrame:
    """Cells as in `region_cells`, but regions are those of the mask grown by `radius`; the cells stay the mask's own."""
    span = range(-radius, radius + 1)
    grown = maps.select("map_id", "counts", "mask", G.dilate(F.col("mask"), h, w, [(dr, dc) for dr in span for dc in span]).alias("_grown"))
    labelled = S.with_components(grown, "_labels", "_grown", h, w).withColumn("_wide", F.zip_with("_labels", "mask", lambda x, m: F.when(m > 0, x).otherwise(0))).withColumn("_edges", S.exposed_edges(F.col("_wide"), h, w))
    rows = labelled.select("map_id", F.posexplode(F.arrays_zip(F.col("_wide").alias("token"), F.col("counts").alias("n"), F.col("_edges").alias("edges"))).alias("i", "x")).where("x.token > 0")
    rows = rows.select("map_id", F.col("x.token").alias("wide"), G.row_of(F.col("i"), w).alias("r"), G.column_of(F.col("i"), w).alias("c"), F.col("i").alias("cell"), F.col("x.n").cast("double").alias("n"), F.col("x.edges").alias("edges"))
    first = rows.groupBy("map_id", "wide").agg((F.min("cell") + 1).alias("token"))
    return rows.join(first, ["map_id", "wide"]).select("map_id", "token", "r", "c", "n", "edges")
