"""Queries that cut maps into region tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import grid as G
from ..functions import segment as S
from ..operators import segment as T
from . import adapters as A
from .adapters import H, SQL_GRID, W
from .raster import rounded

VALID = 208

_LABELLED = f"""with recursive {SQL_GRID}, d as (select map_id, r, c, n from cells),
 reach(map_id, r, c, label) as (select map_id, r, c, r * 16 + c from d union select reach.map_id, b.r, b.c, reach.label from reach join d b on b.map_id = reach.map_id and abs(b.r - reach.r) <= 1 and abs(b.c - reach.c) <= 1),
 lab as (select reach.map_id, reach.r, reach.c, min(label) + 1 as token, any_value(d.n) as n from reach join d on d.map_id = reach.map_id and d.r = reach.r and d.c = reach.c group by 1, 2, 3),
 edge as (select a.map_id, a.r, a.c, 4 - count(b.r) as edges from lab a left join lab b on a.map_id = b.map_id and a.token = b.token and abs(a.r - b.r) + abs(a.c - b.c) = 1 group by 1, 2, 3)"""


@query("g1_components", f"{_LABELLED} select map_id, cast(r as bigint) r, cast(c as bigint) c, cast(token as bigint) token from lab")
def components(spark, sf_dir):
    return T.region_cells(A.maps(spark, sf_dir), H, W).select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "token")])


@query("g1_components_4", _LABELLED.replace("abs(b.r - reach.r) <= 1 and abs(b.c - reach.c) <= 1", "abs(b.r - reach.r) + abs(b.c - reach.c) <= 1") + " select map_id, count(distinct token) as regions, count(*) as cells from lab group by 1")
def components_4(spark, sf_dir):
    own = T.region_cells(A.maps(spark, sf_dir), H, W, offsets=G.NEIGHBOURS_4)
    return own.groupBy("map_id").agg(F.countDistinct("token").alias("regions"), F.count("*").alias("cells"))


@query("g2_perimeter", f"{_LABELLED} select lab.map_id, cast(token as bigint) token, cast(sum(edges) as bigint) as perimeter, count(*) as area from lab join edge using (map_id, r, c) group by 1, 2")
def perimeter(spark, sf_dir):
    own = T.region_cells(A.maps(spark, sf_dir), H, W)
    return own.groupBy("map_id", F.col("token").cast("bigint").alias("token")).agg(F.sum("edges").cast("bigint").alias("perimeter"), F.count("*").alias("area"))


_GROWN = """, grown as (select a.map_id, a.r, a.c, max(cast(b.n > 0 as int)) * cast(a.status > 0 as int) as g, any_value(a.status) as status from grid a join grid b on a.map_id = b.map_id and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.map_id, a.r, a.c, a.status),
 shut as (select a.map_id, a.r, a.c, min(case when b.status = 0 then 1 else b.g end) * cast(a.status > 0 as int) as s from grown a join grown b on a.map_id = b.map_id and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.map_id, a.r, a.c, a.status)"""


@query("g3_closing", f"with {SQL_GRID}{_GROWN} select map_id, cast(r as bigint) r, cast(c as bigint) c, cast(g as bigint) as dilated, cast(s as bigint) as closed from grown join shut using (map_id, r, c)")
def closing(spark, sf_dir):
    """Dilation and closing inside the valid area; cells outside it count as set for the erosion."""
    own = A.maps(spark, sf_dir)
    grown = F.zip_with(G.dilate(F.col("mask"), H, W), "valid", lambda d, v: d * v)
    own = own.withColumn("dilated", grown).withColumn("closed", G.close_within(F.col("mask"), F.col("valid"), H, W))
    return A.exploded(own, "dilated", "closed").select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "dilated", "closed")])


@query("g4_diamond", f"""with {SQL_GRID}, g as (select a.map_id, a.r, a.c, max(cast(b.n > 0 as int)) as d from grid a join grid b on a.map_id = b.map_id and abs(a.r - b.r) + abs(a.c - b.c) <= 2 group by 1, 2, 3),
 e as (select a.map_id, a.r, a.c, case when a.r between 2 and 13 and a.c between 2 and 13 or (select count(*) from g x where x.map_id = a.map_id and abs(a.r - x.r) + abs(a.c - x.c) <= 2) = 13 then min(b.d) else 0 end as s from g a join g b on a.map_id = b.map_id and abs(a.r - b.r) + abs(a.c - b.c) <= 2 group by 1, 2, 3)
 select map_id, cast(sum(d) as bigint) as dilated, cast(sum(s) as bigint) as closed from g join e using (map_id, r, c) group by 1""")
def diamond(spark, sf_dir):
    own = A.maps(spark, sf_dir)
    grown = G.dilate(F.col("mask"), H, W, G.diamond(2))
    add = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x).cast("bigint")
    return own.select("map_id", add(grown).alias("dilated"), add(G.erode(grown, H, W, G.diamond(2))).alias("closed"))


_STATS = f"""{_LABELLED}, s as (select lab.map_id, token, count(*) as area, cast(sum(n) as double) as mass, avg(r) mr, avg(c) mc, var_pop(r) vr, var_pop(c) vc, covar_pop(r, c) vx, max(r) - min(r) + 1 as tall, max(c) - min(c) + 1 as wide, sum(edges) as per,
 avg(sqrt((r - 8) * (r - 8) + (c - 8) * (c - 8))) / sqrt(128.0) as radial_mean, stddev_pop(sqrt((r - 8) * (r - 8) + (c - 8) * (c - 8))) / sqrt(128.0) as radial_std from lab join edge using (map_id, r, c) group by 1, 2)"""
_STAT_NAMES = ["centroid_r", "centroid_c", "lambda_1", "lambda_2", "compactness", "fill", "aspect", "radial", "radial_mean", "radial_std"]
_STAT_SQL = ["mr", "mc", "(vr + vc) / 2 + sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + vx * vx)", "greatest((vr + vc) / 2 - sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + vx * vx), 0)", "per / cast(area as double)", "area / cast(tall * wide as double)", "greatest(tall, wide) / cast(least(tall, wide) as double)", "sqrt((mr - 8) * (mr - 8) + (mc - 8) * (mc - 8)) / sqrt(128.0)", "radial_mean", "radial_std"]


@query("g5_component_stats", f"{_STATS} select map_id, cast(token as bigint) token, area, mass, cast(per as bigint) as perimeter, " + ", ".join(f"round({s}, 5) + 0.0 as {n}" for n, s in zip(_STAT_NAMES, _STAT_SQL)) + " from s")
def component_stats(spark, sf_dir):
    """Unweighted statistics, radii over half the diagonal."""
    own = T.token_statistics(T.region_cells(A.maps(spark, sf_dir), H, W), H, W)
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), "area", "mass", "perimeter", *[(F.round(n, 5) + 0.0).alias(n) for n in _STAT_NAMES])


_TURN = "(case when degrees(atan2(r - 8.0, c - 8.0)) < 0 then degrees(atan2(r - 8.0, c - 8.0)) + 360 else degrees(atan2(r - 8.0, c - 8.0)) end)"
#: Weighted statistics of region tokens, and what of them goes into the geometry vector.
SQL_TOKENS = f"""{_LABELLED}, pix as (select lab.*, edges, cast(least(floor({_TURN} / 5.0), 71) as int) as bin, cast(least(floor({_TURN} / 30.0), 11) as int) as sector, sqrt((r - 8) * (r - 8) + (c - 8) * (c - 8)) / {A.RADIUS!r} as d from lab join edge using (map_id, r, c)),
 w1 as (select map_id, token, count(*) as area, cast(sum(n) as double) as mass, max(n) as peak, cast(sum(edges) as double) as per, sum(n * r) / cast(sum(n) as double) as mr, sum(n * c) / cast(sum(n) as double) as mc, sum(n * d) / sum(n) as rm, stddev_pop(d) as radial_std, count(distinct bin) / 72.0 as coverage,
 sum(n * r * r) / cast(sum(n) as double) as mrr, sum(n * c * c) / cast(sum(n) as double) as mcc, sum(n * r * c) / cast(sum(n) as double) as mrc, min(r) as r0, max(r) - min(r) + 1 as tall, min(c) as c0, max(c) - min(c) + 1 as wide from pix group by 1, 2),
 w2 as (select *, (mrr - mr * mr + mcc - mc * mc) / 2 + sqrt(((mrr - mr * mr - mcc + mc * mc) / 2) * ((mrr - mr * mr - mcc + mc * mc) / 2) + (mrc - mr * mc) * (mrc - mr * mc)) as l1, greatest((mrr - mr * mr + mcc - mc * mc) / 2 - sqrt(((mrr - mr * mr - mcc + mc * mc) / 2) * ((mrr - mr * mr - mcc + mc * mc) / 2) + (mrc - mr * mc) * (mrc - mr * mc)), 0) as l2, sqrt((mr - 8) * (mr - 8) + (mc - 8) * (mc - 8)) / {A.RADIUS!r} as rad from w1),
 sec as (select map_id, token, sum(k * k) as kk from (select map_id, token, sector, count(*) as k from pix group by 1, 2, 3) group by 1, 2),
 b2 as (select distinct map_id, token, bin + 72 * k as x from pix cross join (select unnest(range(0, 2)) as k)), isl as (select map_id, token, x - row_number() over (partition by map_id, token order by x) as g from b2),
 runs as (select map_id, token, least(max(len), 72) / 72.0 as max_run from (select map_id, token, g, count(*) as len from isl group by 1, 2, 3) group by 1, 2),
 gaps as (select map_id, token, least(coalesce(max(gap), 0), 72) / 72.0 as max_gap from (select map_id, token, lead(x) over (partition by map_id, token order by x) - x - 1 as gap from b2) group by 1, 2),
 box as (select map_id, token, r0, c0, tall, wide, greatest(0.30 * greatest(least(tall, wide) / 2.0, 1.0), 1.0) as rho from w1),
 disc as (select map_id, token, count(*) as cells_in from (select *, unnest(range(tall)) as y from box) b cross join (select unnest(range(16)) as x) where x < wide and (y - (tall - 1) / 2.0) * (y - (tall - 1) / 2.0) + (x - (wide - 1) / 2.0) * (x - (wide - 1) / 2.0) <= rho * rho group by 1, 2),
 occ as (select box.map_id, box.token, count(*) as hit from box join pix using (map_id, token) where (pix.r - r0 - (tall - 1) / 2.0) * (pix.r - r0 - (tall - 1) / 2.0) + (pix.c - c0 - (wide - 1) / 2.0) * (pix.c - c0 - (wide - 1) / 2.0) <= rho * rho group by 1, 2),
 tok as (select w2.*, sqrt(kk / 12.0 - (area / 12.0) * (area / 12.0)) / (area / 12.0) as cv, max_run, max_gap, coalesce(hit, 0) / cast(cells_in as double) as occupancy from w2 join sec using (map_id, token) join runs using (map_id, token) join gaps using (map_id, token) join disc using (map_id, token) left join occ using (map_id, token)),
 geo as (select *, list_transform([area / cast(tall * wide as double), ln(1 + greatest(tall, wide) / cast(least(tall, wide) as double)) / ln(16.0), ln(1 + l1 / greatest(l2, 1e-6)) / ln(64.0), per / area / 4, coverage, max_run, 1.0 / (1.0 + cv), 1 - max_gap, radial_std, occupancy], lambda x: least(greatest(x, 0.0), 1.0)) as geometry from tok)"""
_TOKEN_COLUMNS = {"centroid_r": "mr", "centroid_c": "mc", "lambda_1": "l1", "radial": "rad", "radial_mean": "rm", "radial_std": "radial_std", "coverage": "coverage", "angular_cv": "cv", "max_run": "max_run", "max_gap": "max_gap"}


@query("g6_token_stats", f"{SQL_TOKENS} select map_id, cast(token as bigint) token, area, mass, cast(peak as double) as peak, " + ", ".join(f"round({s}, 5) + 0.0 as {n}" for n, s in _TOKEN_COLUMNS.items()) + " from tok")
def token_stats(spark, sf_dir):
    """Centroid, axes and mean radius weighted by count, radii over that of the valid area, angles in 72 bins and 12 sectors."""
    own = T.token_statistics(T.region_cells(A.maps(spark, sf_dir), H, W), H, W, weighted=True, radius=A.RADIUS)
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), "area", "mass", "peak", *[(F.round(n, 5) + 0.0).alias(n) for n in _TOKEN_COLUMNS])


@query("g7_circular_runs", f"""with {SQL_GRID}, b as (select distinct map_id, cast(least(floor((case when degrees(atan2(r - 8.0, c - 8.0)) < 0 then degrees(atan2(r - 8.0, c - 8.0)) + 360 else degrees(atan2(r - 8.0, c - 8.0)) end) / 5.0), 71) as int) as bin from grid where n > 0),
 t as (select map_id, bin + 72 * k as x from b cross join (select unnest(range(0, 2)) as k)), i as (select map_id, x - row_number() over (partition by map_id order by x) as g from t), r as (select map_id, count(*) as len from i group by map_id, g),
 gaps as (select map_id, lead(x) over (partition by map_id order by x) - x - 1 as gap from t)
 select map_id, least(max(len), 72) as longest_run, (select least(max(gap), 72) from gaps where gaps.map_id = r.map_id) as longest_gap from r group by 1""")
def circular_runs(spark, sf_dir):
    bits = S.angle_bins(S.G.let(F.transform("mask", lambda x, i: F.when(x > 0, F.struct(G.row_of(i, W).alias("r"), G.column_of(i, W).alias("c")))), lambda p: F.filter(p, lambda x: x.isNotNull())), 8.0, 8.0)
    own = A.maps(spark, sf_dir).select("map_id", bits.alias("bits"))
    return own.select("map_id", S.longest_run(F.col("bits")).cast("bigint").alias("longest_run"), S.longest_run(F.transform("bits", lambda b: ~b)).cast("bigint").alias("longest_gap"))


@query("g7_bridged_runs")
def bridged_runs(spark, sf_dir):
    """Runs after gaps of up to two bins are bridged."""
    cells = F.filter(F.transform("mask", lambda x, i: F.when(x > 0, F.struct(G.row_of(i, W).alias("r"), G.column_of(i, W).alias("c")))), lambda p: p.isNotNull())
    own = A.maps(spark, sf_dir).select("map_id", S.angle_bins(cells, 8.0, 8.0).alias("bits")).select("map_id", "bits", S.bridged(F.col("bits"), 2).alias("filled"))
    return own.select("map_id", F.size(F.filter("bits", lambda b: b)).alias("bins"), F.size(F.filter("filled", lambda b: b)).alias("bridged"), S.longest_run(F.col("filled")).alias("longest_run"))


_KIND_SQL = "case when round(l1 / greatest(l2, 1e-6), 9) >= 6 or asp >= 4 then 'line' when fil >= 0.45 and com <= 1.6 then 'blob' when round(rad, 9) <= 0.35 then 'central' else 'irregular' end"
_KINDS = f"{_STATS}, v as (select *, round(({_STAT_SQL[2]}), 9) as l1, round({_STAT_SQL[3]}, 9) as l2, {_STAT_SQL[6]} as asp, {_STAT_SQL[5]} as fil, {_STAT_SQL[4]} as com, {_STAT_SQL[7]} as rad from s)"


@query("g8_component_kinds", f"{_KINDS} select map_id, cast(token as bigint) token, area, {_KIND_SQL} as kind from v")
def component_kinds(spark, sf_dir):
    own = T.token_statistics(T.region_cells(A.maps(spark, sf_dir), H, W), H, W)
    own = own.withColumn("lambda_1", F.round("lambda_1", 9)).withColumn("lambda_2", F.round("lambda_2", 9)).withColumn("kind", T.token_kind(ring=False))
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), "area", "kind")


@query("g10_cc_tokens")
def cc_tokens(spark, sf_dir):
    return T.cc_tokens(A.maps(spark, sf_dir), H, W, VALID)


@query("d7_token_signatures", f"""{_LABELLED}, t as (select map_id, token, string_agg('[' || r || ',' || c || ']', ',' order by r, c) as pixels from lab group by 1, 2)
 select map_id, cast(token as bigint) as token, sha1('{{"map_id":' || map_id || ',"pixels":[' || pixels || '],"proposal_method":"cc","proposal_source":"regions","proposal_type":"","token_id":' || token || '}}') as signature from t""")
def token_signatures(spark, sf_dir):
    own = T.token_statistics(T.region_cells(A.maps(spark, sf_dir), H, W), H, W)
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), T.token_signature("cc", source="regions").alias("signature"))


def _by_kind(values):
    return "case kind " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


@query("g11_diverse_tokens", f"""{SQL_TOKENS}, kd as (select *, area / cast(tall * wide as double) as fill, greatest(tall, wide) / cast(least(tall, wide) as double) as asp from tok where area >= 3),
 kk as (select *, case when round(rad, 9) >= 0.65 and coverage >= 0.25 and round(radial_std, 9) <= 0.14 then 'edge_ring' when round(l1 / greatest(l2, 1e-6), 9) >= 6 or asp >= 4 then 'line' when fill >= 0.45 and per / area <= 1.6 then 'blob' when round(rad, 9) <= 0.35 then 'central' else 'irregular' end as kind from kd),
 im as (select *, round(sqrt(area) + case when round(rad, 9) <= 0.35 then 2.0 else 0.0 end + {_by_kind(T.RESIDUAL_BONUS)} + least(fill, 1.0), 9) as score from kk), ld as (select *, row_number() over (partition by map_id, kind order by score desc, token) = 1 as leads from im),
 tn as (select *, row_number() over (partition by map_id, leads order by round({_by_kind(T.DISPLAY_ORDER)} + 0.01 * score, 9) desc, token) as turn from ld), fs as (select *, leads and turn <= 3 as first_pick from tn),
 rt as (select *, count(*) filter (first_pick) over (partition by map_id) as firsts, row_number() over (partition by map_id, first_pick order by score desc, token) as rest from fs)
 select map_id, cast(token as bigint) as token, kind, area, row_number() over (partition by map_id order by round({_by_kind(T.DISPLAY_ORDER)} + 0.01 * area, 9) desc, token) as place from rt where first_pick or rest + firsts <= 6""")
def diverse_tokens(spark, sf_dir):
    """Six regions of a map at most, of three kinds if there are as many."""
    own = T.diverse_tokens(A.maps(spark, sf_dir), H, W, VALID, radius=A.RADIUS)
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), "kind", "area", F.col("place").cast("bigint").alias("place"))


@query("g24_largest_regions", f"{_LABELLED}, a as (select map_id, token, count(*) as area from lab group by 1, 2), k as (select *, row_number() over (partition by map_id order by area desc, token) as place from a) select map_id, cast(token as bigint) token, area, place from k where place <= 3")
def largest_regions(spark, sf_dir):
    own = T.region_cells(A.maps(spark, sf_dir), H, W).groupBy("map_id", "token").agg(F.count("*").alias("area"))
    return T.keep_top(own, F.col("area"), 3).select("map_id", F.col("token").cast("bigint").alias("token"), "area", F.col("place").cast("bigint").alias("place"))


@query("g13_arc_ring_residual")
def arc_ring_residual(spark, sf_dir):
    return T.arc_ring_residual_tokens(A.maps(spark, sf_dir), H, W, VALID)


@query("g15_sparse_density")
def sparse_density(spark, sf_dir):
    return T.sparse_density_tokens(A.maps(spark, sf_dir), H, W)


@query("g16_auto_mode", f"{_LABELLED}, a as (select map_id, token, count(*) as area from lab group by 1, 2) select map_id, sum(area) >= 3 and count(*) >= 2 and (max(area) < 3 or max(area) <= 0.5 * sum(area)) as fragmented from a group by 1")
def auto_mode(spark, sf_dir):
    return T.fragmented(A.maps(spark, sf_dir), H, W)


@query("g25_core_points", f"with {A.SQL_CELLS} select a.map_id, cast(a.r as bigint) r, cast(a.c as bigint) c, count(*) as near, count(*) >= 4 as core from cells a join cells b on a.map_id = b.map_id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4 group by 1, 2, 3")
def core_points(spark, sf_dir):
    own = T.core_points(A.cells(spark, sf_dir), 2.0, 4)
    return own.select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "near", "core")


@query("g25_dbscan", f"""with recursive {A.SQL_CELLS}, k as (select a.map_id, a.r, a.c, count(*) >= 4 as core from cells a join cells b on a.map_id = b.map_id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4 group by 1, 2, 3),
 reach(map_id, r, c, label) as (select map_id, r, c, r * 16 + c + 1 from k where core union select reach.map_id, b.r, b.c, reach.label from reach join k b on b.core and b.map_id = reach.map_id and (b.r - reach.r) * (b.r - reach.r) + (b.c - reach.c) * (b.c - reach.c) <= 4),
 l as (select map_id, r, c, min(label) as cluster from reach group by 1, 2, 3)
 select k.map_id, cast(k.r as bigint) r, cast(k.c as bigint) c, cast(coalesce(any_value(l.cluster), (select min(x.cluster) from l x where x.map_id = k.map_id and (x.r - k.r) * (x.r - k.r) + (x.c - k.c) * (x.c - k.c) <= 4)) as bigint) as cluster from k left join l on l.map_id = k.map_id and l.r = k.r and l.c = k.c group by k.map_id, k.r, k.c""")
def dbscan(spark, sf_dir):
    own = T.dbscan(A.maps(spark, sf_dir), H, W, 2.0, 4)
    return own.select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "cluster")])


@query("g28_tensor_votes", f"""with {A.SQL_CELLS}, p as (select a.map_id, a.r, a.c, (a.r - b.r) as dr, (a.c - b.c) as dc, cast((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) as double) as d2 from cells a join cells b on a.map_id = b.map_id and not (a.r = b.r and a.c = b.c)),
 s as (select map_id, r, c, sum(exp(-d2 / 4)) s, sum(exp(-d2 / 4) * dr * dr / d2) a, sum(exp(-d2 / 4) * dc * dc / d2) b, sum(exp(-d2 / 4) * dr * dc / d2) x from p where d2 <= 36 group by 1, 2, 3),
 e as (select map_id, r, c, (2 * s - a - b) / 2 as m, sqrt(((b - a) / 2) * ((b - a) / 2) + x * x) as h from s) select map_id, cast(r as bigint) r, cast(c as bigint) c, round(2 * h, 5) + 0.0 as stick, round(greatest(m - h, 0), 5) + 0.0 as ball from e""")
def tensor_votes(spark, sf_dir):
    own = T.votes(A.cells(spark, sf_dir), 2.0)
    return own.select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), (F.round("stick", 5) + 0.0).alias("stick"), (F.round("ball", 5) + 0.0).alias("ball"))


@query("g28_salient_points")
def salient_points(spark, sf_dir):
    return T.salient(T.votes(A.cells(spark, sf_dir), 2.0))


@query("m13_cluster_statistics", f"{_LABELLED}, a as (select map_id, token, cast(count(*) as double) as area from lab group by 1, 2) select map_id, count(*) as tokens, round(avg(area), 6) + 0.0 as mean_area, round(stddev_pop(area), 6) + 0.0 as std_area, cast(min(area) as bigint) as least_area, cast(max(area) as bigint) as most_area, round(median(area), 6) + 0.0 as median_area from a group by 1")
def cluster_statistics(spark, sf_dir):
    a = T.region_cells(A.maps(spark, sf_dir), H, W).groupBy("map_id", "token").agg(F.count("*").alias("area"))
    own = a.groupBy("map_id").agg(F.count("*").alias("tokens"), F.avg("area").alias("mean_area"), F.stddev_pop("area").alias("std_area"), F.min("area").alias("least_area"), F.max("area").alias("most_area"), F.percentile("area", 0.5).alias("median_area"))
    return own.select("map_id", "tokens", rounded("mean_area"), rounded("std_area"), "least_area", "most_area", rounded("median_area"))


@query("m7_proposal_statistics", f"{_KINDS}, k as (select map_id, token, area, {_KIND_SQL} as kind from v) select kind, count(*) as tokens, count(distinct map_id) as maps, round(avg(area), 6) + 0.0 as mean_area, round(median(area), 6) + 0.0 as median_area from k group by 1")
def proposal_statistics(spark, sf_dir):
    k = component_kinds(spark, sf_dir)
    own = k.groupBy("kind").agg(F.count("*").alias("tokens"), F.countDistinct("map_id").alias("maps"), F.avg("area").alias("mean_area"), F.percentile("area", 0.5).alias("median_area"))
    return own.select("kind", "tokens", "maps", rounded("mean_area"), rounded("median_area"))


@query("e2_token_summary", f"{_LABELLED}, t as (select map_id, token, count(*) as area from lab group by 1, 2 having count(*) >= 12), m as (select distinct map_id from cells) select m.map_id, cast(t.token as bigint) token, area, t.token is null as placeholder from m left join t using (map_id)")
def token_summary(spark, sf_dir):
    """Tokens of twelve cells or more, and a placeholder row for each map without one."""
    own = A.maps(spark, sf_dir).select("map_id", "counts", "mask")
    t = T.region_cells(own, H, W).groupBy("map_id", "token").agg(F.count("*").alias("area")).where("area >= 12")
    return own.select("map_id").join(t, "map_id", "left").select("map_id", F.col("token").cast("bigint").alias("token"), "area", F.col("token").isNull().alias("placeholder"))


@query("d4_shape_profile", f"""with {SQL_GRID}, d as (select map_id, r, c, sqrt((r - 8) * (r - 8) + (c - 8) * (c - 8)) as rad, degrees(atan2(r - 8.0, c - 8.0)) as a from grid where n > 0),
 b as (select map_id, 'ring' as part, least(cast(floor(rad) as bigint), 7) as bin from d union all select map_id, 'sector', least(cast(floor((case when a < 0 then a + 360 else a end) / 30.0) as bigint), 11) from d),
 k as (select map_id, part, bin, count(*) as n from b group by 1, 2, 3) select map_id, part, bin, n, round(n / sum(n) over (partition by map_id, part), 6) + 0.0 as share from k""")
def shape_profile(spark, sf_dir):
    """Radial and angular histograms of a map's defects around the middle."""
    d = A.exploded(A.maps(spark, sf_dir), "counts").where("counts > 0")
    ring = F.least(F.floor(F.sqrt((F.col("r") - 8) ** 2 + (F.col("c") - 8) ** 2)), F.lit(7))
    sector = F.least(F.floor(F.pmod(F.degrees(F.atan2(F.col("r") - F.lit(8.0), F.col("c") - F.lit(8.0))), F.lit(360.0)) / 30.0), F.lit(11))
    rows = d.select("map_id", F.explode(F.array(F.struct(F.lit("ring").alias("part"), ring.cast("bigint").alias("bin")), F.struct(F.lit("sector").alias("part"), sector.cast("bigint").alias("bin")))).alias("x")).select("map_id", "x.*")
    k = rows.groupBy("map_id", "part", "bin").agg(F.count("*").alias("n"))
    return k.withColumn("share", F.col("n") / F.sum("n").over(T.Window.partitionBy("map_id", "part"))).select("map_id", "part", "bin", "n", rounded("share"))


@query("g16_auto_tokens")
def auto_tokens(spark, sf_dir):
    """Each map by the mode that suits it."""
    return T.segment(A.maps(spark, sf_dir), "auto", H, W, VALID).select("map_id", "token", "kind", "area", "centroid_r", "centroid_c", "coverage", "place")
