"""Queries that filter and clean maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import grid as G
from ..operators import segment as T
from ..operators.sampling import numbered
from . import adapters as A
from .adapters import H, SQL_GRID, W
from .raster import rounded

#: The bounds of the reject reasons, for grids of this size.
BOUNDS = {"wafer_area": 0.2, "density_low": 0.18, "density_high": 0.26, "component": 4, "components": 15, "component_share": 0.2, "small_area": 2, "small_share": 0.5}


@query("f1_labelled_maps", f"with {A.SQL_LABELS}, all_maps as (select distinct cast(floor(event_id / 3) as bigint) as map_id from events), kept as (select map_id, count(*) as n from label_rows where label <> 'error' group by 1) select map_id, n, map_id as original_index from all_maps join kept using (map_id)")
def labelled_maps(spark, sf_dir):
    """Maps with a label once one class is struck out; their ids stay as the original index."""
    rows = A.label_rows(spark, sf_dir).where("label <> 'error'")
    return rows.groupBy("map_id").agg(F.count("*").alias("n")).withColumn("original_index", F.col("map_id"))


@query("f2_defect_threshold", f"with {A.SQL_CELLS} select map_id, cast(sum(n) as bigint) as defects, case when sum(n) < 48 then 'SKIPPED' else 'OK' end as status from cells group by 1")
def defect_threshold(spark, sf_dir):
    own = A.cells(spark, sf_dir).groupBy("map_id").agg(F.sum("n").alias("defects"))
    return own.withColumn("status", F.when(F.col("defects") < 48, "SKIPPED").otherwise("OK"))


@query("f4_class_split", f"with {A.SQL_DEFECTS}, s as (select wafer_id, case when xrel > 990 then null else classnumber end as classnumber, xindex from defects) select wafer_id, cast(classnumber as bigint) as classnumber, count(*) as n, round(avg(xindex), 6) + 0.0 as mean_x from s where classnumber is not null and classnumber <> 0 group by 1, 2")
def class_split(spark, sf_dir):
    """Defects without a finite class are left out, and so is class 0."""
    s = A.defects(spark, sf_dir).withColumn("classnumber", F.when(F.col("xrel") > 990, F.lit(float("nan"))).otherwise(F.col("classnumber").cast("double")))
    s = s.where(~F.isnan("classnumber")).withColumn("classnumber", F.col("classnumber").cast("bigint")).where("classnumber <> 0")
    return s.groupBy("wafer_id", "classnumber").agg(F.count("*").alias("n"), F.avg("xindex").alias("mean_x")).select("wafer_id", "classnumber", "n", rounded("mean_x"))


def _drop_round(before: str, after: str) -> str:
    return f", {after} as (select a.map_id, a.r, a.c from {before} a join {before} b on a.map_id = b.map_id and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and not (a.r = b.r and a.c = b.c) group by 1, 2, 3 having count(*) >= 2)"


@query("f5_adjacency_clean", f"with {A.SQL_CELLS}, d0 as (select map_id, r, c from cells){_drop_round('d0', 'd1')}{_drop_round('d1', 'd2')}{_drop_round('d2', 'd3')} select a.map_id, a.n as before_n, coalesce(b.n, 0) as after_n from (select map_id, count(*) n from d0 group by 1) a left join (select map_id, count(*) n from d3 group by 1) b using (map_id)")
def adjacency_clean(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("kept", G.drop_sparse(F.col("mask"), H, W))
    ones = lambda c: F.size(F.filter(c, lambda x: x > 0)).cast("bigint")
    return own.select("map_id", ones("mask").alias("before_n"), ones("kept").alias("after_n"))


@query("f6_spatial_filter", f"""with {SQL_GRID}, k as (select a.map_id, a.r, a.c, count(*) filter (b.n > 0 and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1) as near3, count(*) filter (b.n > 0) as near5 from grid a join grid b on a.map_id = b.map_id and abs(a.r - b.r) <= 2 and abs(a.c - b.c) <= 2 group by 1, 2, 3)
 select map_id, cast(r as bigint) r, cast(c as bigint) c, cast(case when near3 >= 3 then 1.0 when near5 >= 5 then 0.5 else 0.0 end as double) as v from k""")
def spatial_filter(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("v", G.spatial_filter(F.col("mask"), H, W))
    return A.exploded(own, "v").select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v")


@query("f7_quality_and_dedup", f"""with {SQL_GRID}, m as (select map_id, string_agg(cast(status as varchar), '' order by r, c) as body, count(*) filter (status = 2) as defects, count(*) filter (status > 0) as valid from grid group by 1),
 u as (select *, row_number() over (partition by sha1(body) order by map_id) as copy from m where defects >= 3 and valid / 256.0 between 0.05 and 0.98 and defects / cast(valid as double) between 0.0001 and 0.3) select map_id, defects, valid, sha1(body) as digest from u where copy = 1""")
def quality_and_dedup(spark, sf_dir):
    """Maps of sensible areas; of maps with equal cells the first stays."""
    own = A.maps(spark, sf_dir)
    ones = lambda s: F.size(F.filter("status", s)).cast("bigint")
    own = own.select("map_id", ones(lambda x: x == 2).alias("defects"), ones(lambda x: x > 0).alias("valid"), F.sha1(F.array_join(F.transform("status", lambda x: x.cast("string")), "").cast("binary")).alias("digest"))
    own = own.where((F.col("defects") >= 3) & (F.col("valid") / 256.0).between(0.05, 0.98) & (F.col("defects") / F.col("valid")).between(0.0001, 0.3))
    first = own.groupBy("digest").agg(F.min("map_id").alias("map_id"))
    return own.join(first, ["digest", "map_id"]).select("map_id", "defects", "valid", "digest")


@query("f7_text_dedup", "with u as (select doc_id, text, row_number() over (partition by sha1(text) order by doc_id) as copy, count(*) over (partition by sha1(text)) as copies from documents where text is not null) select doc_id, copies from u where copy = 1")
def text_dedup(spark, sf_dir):
    """The first document of each exact text; texts are compared by digest, which is all that is shuffled."""
    d = A.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("f8_single_class_maps", f"with {A.SQL_LABELS}, k as (select map_id, count(*) as n, min(label) as label from label_rows group by 1), v as (select map_id, label from k where n = 1), t as (select label, count(*) as total from v group by 1) select map_id, label, total from v join t using (label)")
def single_class_maps(spark, sf_dir):
    one = A.label_rows(spark, sf_dir).groupBy("map_id").agg(F.count("*").alias("n"), F.min("label").alias("label")).where("n = 1").drop("n")
    return one.join(one.groupBy("label").agg(F.count("*").alias("total")), "label").select("map_id", "label", "total")


_FEATURES = f"""with recursive {SQL_GRID}, d as (select map_id, r, c from cells),
 reach(map_id, r, c, label) as (select map_id, r, c, r * 16 + c from d union select reach.map_id, b.r, b.c, reach.label from reach join d b on b.map_id = reach.map_id and abs(b.r - reach.r) <= 1 and abs(b.c - reach.c) <= 1),
 lab as (select map_id, r, c, min(label) + 1 as token from reach group by 1, 2, 3), comp as (select map_id, token, count(*) as area from lab group by 1, 2),
 cf as (select map_id, count(*) as components, max(area) as largest, sum(area) as defects, coalesce(sum(area) filter (area <= 2), 0) as small, -sum(area / total * ln(area / total)) as entropy from (select *, cast(sum(area) over (partition by map_id) as double) as total from comp) group by 1),
 rad as (select map_id, r, c, sqrt((r - 7.5) * (r - 7.5) + (c - 7.5) * (c - 7.5)) / 7.68 as d from d),
 hist as (select map_id, case when d = 1.2 then 9 else floor(d / 0.12) end as b, count(*) as k from rad where d <= 1.2 group by 1, 2),
 ring as (select map_id, max(k) / cast(sum(k) as double) as ring_score from hist group by 1),
 sf as (select map_id, avg(cast(d < 0.3 as double)) as center_ratio, avg(cast(d > 0.8 as double)) as edge_ratio, avg(d) as radial_mean, stddev_pop(d) as radial_std, var_samp(r) as vr, var_samp(c) as vc, covar_samp(r, c) as vx, greatest(max(r) - min(r), max(c) - min(c)) + 1 as lng, least(max(r) - min(r), max(c) - min(c)) + 1 as sht from rad group by 1),
 e as (select *, (vr + vc) / 2 as m, sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + vx * vx) as h from sf)"""
_FEATURE_COLUMNS = ["largest_ratio", "small_ratio", "entropy", "radial_mean", "radial_std", "center_ratio", "edge_ratio", "ring_score", "linearity", "box_aspect"]
_FEATURE_SQL = ["largest / cast(defects as double)", "small / cast(defects as double)", "entropy", "radial_mean", "radial_std", "center_ratio", "edge_ratio", "ring_score", "1 - greatest(m - h, 0) / (m + h + 1e-8)", "lng / cast(sht as double)"]


def spatial_features(spark, sf_dir):
    """Component, radial and shape features of each map, from its regions and its defect cells."""
    cells = T.region_cells(A.maps(spark, sf_dir), H, W)
    areas = cells.groupBy("map_id", "token").agg(F.count("*").alias("area"))
    p = F.col("area") / F.col("total")
    comp = areas.withColumn("total", F.sum("area").over(T.Window.partitionBy("map_id")))
    comp = comp.groupBy("map_id").agg(F.count("*").alias("components"), F.max("area").alias("largest"), F.sum("area").alias("defects"), F.sum(F.when(F.col("area") <= BOUNDS["small_area"], F.col("area")).otherwise(0)).alias("small"), (-F.sum(p * F.log(p))).alias("entropy"))
    d = F.sqrt((F.col("r") - 7.5) ** 2 + (F.col("c") - 7.5) ** 2) / (0.48 * min(H, W))
    rad = cells.withColumn("d", d)
    bin_of = F.when(F.col("d") == 1.2, 9).otherwise(F.floor(F.col("d") / 0.12))
    ring = rad.where("d <= 1.2").groupBy("map_id", bin_of.alias("b")).agg(F.count("*").alias("k")).groupBy("map_id").agg((F.max("k") / F.sum("k")).alias("ring_score"))
    tall, wide = F.max("r") - F.min("r"), F.max("c") - F.min("c")
    shape = rad.groupBy("map_id").agg(F.avg((F.col("d") < 0.3).cast("double")).alias("center_ratio"), F.avg((F.col("d") > 0.8).cast("double")).alias("edge_ratio"), F.avg("d").alias("radial_mean"), F.stddev_pop("d").alias("radial_std"), F.var_samp("r").alias("vr"), F.var_samp("c").alias("vc"), F.covar_samp("r", "c").alias("vx"), ((F.greatest(tall, wide) + 1) / (F.least(tall, wide) + 1)).alias("box_aspect"))
    large, small = T.eigenvalues(F.col("vr"), F.col("vc"), F.col("vx"))
    own = comp.join(ring, "map_id").join(shape, "map_id").withColumn("linearity", 1 - small / (large + 1e-8))
    return own.withColumn("largest_ratio", F.col("largest") / F.col("defects")).withColumn("small_ratio", F.col("small") / F.col("defects"))


@query("g32_spatial_features", f"{_FEATURES} select map_id, components, largest, " + ", ".join(f"round({s}, 6) + 0.0 as {n}" for n, s in zip(_FEATURE_COLUMNS, _FEATURE_SQL)) + " from cf join ring using (map_id) join e using (map_id)")
def spatial_feature_rows(spark, sf_dir):
    return spatial_features(spark, sf_dir).select("map_id", "components", "largest", *map(rounded, _FEATURE_COLUMNS))


_SCORE_SQL = "case when largest_ratio >= 0.08 then 1.0 else 0 end + case when ring_score >= 0.35 then 1.0 else 0 end + case when linearity >= 0.8 and box_aspect >= 3 then 1.0 else 0 end + case when center_ratio >= 0.35 then 0.75 else 0 end + case when edge_ratio >= 0.35 then 0.75 else 0 end + case when small_ratio <= 0.5 and components <= 1000 then 0.5 else 0 end"
_REASONS = [("density_too_low", "defects / 208.0 < 0.18"), ("density_too_high", "defects / 208.0 > 0.26"), ("max_component_too_small", "largest < 4"), ("too_fragmented", "components > 15 and largest_ratio < 0.2"), ("small_components_dominant", "small_ratio > 0.5")]
_CLEAN_SQL = f"{_FEATURES}, f as (select map_id, components, largest, defects, " + ", ".join(f"{s} as {n}" for n, s in zip(_FEATURE_COLUMNS, _FEATURE_SQL)) + " from cf join ring using (map_id) join e using (map_id))"


def reject_reasons(features, valid: int):
    """Add `reasons`, the names of the rules that a map breaks, in a fixed order."""
    b = BOUNDS
    density = F.col("defects") / valid
    rules = [
        ("wafer_area_too_small", F.lit(valid / (H * W) < b["wafer_area"])), ("density_too_low", density < b["density_low"]), ("density_too_high", density > b["density_high"]), ("max_component_too_small", F.col("largest") < b["component"]),
        ("too_fragmented", (F.col("components") > b["components"]) & (F.col("largest_ratio") < b["component_share"])), ("small_components_dominant", F.col("small_ratio") > b["small_share"]),
    ]
    return features.withColumn("reasons", F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules])))


def structure_score():
    when = lambda cond, v: F.when(cond, v).otherwise(0.0)
    c = F.col
    return when(c("largest_ratio") >= 0.08, 1.0) + when(c("ring_score") >= 0.35, 1.0) + when((c("linearity") >= 0.8) & (c("box_aspect") >= 3), 1.0) + when(c("center_ratio") >= 0.35, 0.75) + when(c("edge_ratio") >= 0.35, 0.75) + when((c("small_ratio") <= 0.5) & (c("components") <= 1000), 0.5)


def groups(spark, sf_dir):
    own = reject_reasons(spatial_features(spark, sf_dir), 208).withColumn("score", structure_score())
    fatal = F.arrays_overlap("reasons", F.array(*map(F.lit, ("wafer_area_too_small", "density_too_low", "density_too_high"))))
    return own.withColumn("grp", F.when(fatal, "rejected").when(F.col("score") >= 1.75, "high").when(F.col("score") >= 1.0, "medium").otherwise("rejected"))


@query("f9_reject_reasons", f"{_CLEAN_SQL} select map_id, concat_ws('|', " + ", ".join(f"case when {s} then '{n}' end" for n, s in _REASONS) + ") as reasons from f")
def reject_reason_rows(spark, sf_dir):
    return groups(spark, sf_dir).select("map_id", F.array_join("reasons", "|").alias("reasons"))


@query("f10_structure_groups", f"{_CLEAN_SQL}, s as (select *, {_SCORE_SQL} as score from f) select map_id, cast(score as double) as score, case when defects / 208.0 < 0.18 or defects / 208.0 > 0.26 then 'rejected' when score >= 1.75 then 'high' when score >= 1.0 then 'medium' else 'rejected' end as grp from s")
def structure_groups(spark, sf_dir):
    return groups(spark, sf_dir).select("map_id", "score", "grp")


@query("b14_medium_subsample", f"{_CLEAN_SQL}, s as (select *, {_SCORE_SQL} as score from f), g as (select map_id from s where not (defects / 208.0 < 0.18 or defects / 208.0 > 0.26) and score >= 1.0 and score < 1.75), k as (select map_id, row_number() over (order by (map_id * 2654435761 + 3) % 4294967296, map_id) as place, count(*) over () as n from g) select map_id, place from k where place <= round_even(n * 0.5, 0)")
def medium_subsample(spark, sf_dir):
    """Half of the medium group, in hash order. The group's size is counted first, so no window runs over all rows."""
    g = groups(spark, sf_dir).where("grp = 'medium'").select("map_id")
    n = g.agg(F.bround(F.count("*") * 0.5).cast("int").alias("keep")).first()["keep"]
    mixed = (F.col("map_id") * 2654435761 + 3) % 4294967296
    return numbered(g, [mixed, "map_id"], F.floor(mixed / (1 << 20)), "place").where(F.col("place") <= n)
