"""Queries that merge and regroup region tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import merge as M
from ..operators import segment as T
from . import adapters as A
from .adapters import H, W
from .segments import _LABELLED

_G = M.GATES
_SUMS = "count(*) as area, cast(sum(n) as double) as mass, cast(sum(edges) as bigint) as perimeter, sum(r) as sr, sum(c) as sc, sum(r * r) as srr, sum(c * c) as scc, sum(r * c) as src, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1"
_SHAPED = """select *, sr / cast(area as double) as mr, sc / cast(area as double) as mc, srr / cast(area as double) - (sr / cast(area as double)) * (sr / cast(area as double)) as vr, scc / cast(area as double) - (sc / cast(area as double)) * (sc / cast(area as double)) as vc,
 src / cast(area as double) - (sr / cast(area as double)) * (sc / cast(area as double)) as vx"""
_AXES = """select *, (vr + vc) / 2 + sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + vx * vx) as l1, greatest((vr + vc) / 2 - sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + vx * vx), 0) as l2, sqrt((mr - 8) * (mr - 8) + (mc - 8) * (mc - 8)) / sqrt(128.0) as rad, round(0.5 * degrees(atan2(round(2 * vx, 9) + 0.0, round(vr - vc, 9) + 0.0)), 9) as raw_axis"""
_MERGED = f"""{_LABELLED}, ts as (select map_id, token, {_SUMS} from lab join edge using (map_id, r, c) group by 1, 2 having count(*) >= {_G['min_area']}), t1 as ({_SHAPED} from ts), t2 as ({_AXES} from t1),
 tk as (select *, case when l1 > 1e-10 then case when raw_axis < 0 then raw_axis + 180 else raw_axis end else 0.0 end as axis, row_number() over (partition by map_id order by token) as pos from t2),
 bins as (select distinct lab.map_id, tk.pos, cast(least(floor((case when degrees(atan2(lab.r - 8.0, lab.c - 8.0)) < 0 then degrees(atan2(lab.r - 8.0, lab.c - 8.0)) + 360 else degrees(atan2(lab.r - 8.0, lab.c - 8.0)) end) / 5.0), 71) as int) as bin from lab join tk using (map_id, token)),
 tg as (select a.map_id, a.pos as i, b.pos as j, min(least(abs(a.bin - b.bin), 72 - abs(a.bin - b.bin))) * 5.0 as gap from bins a join bins b on a.map_id = b.map_id and a.pos < b.pos group by 1, 2, 3),
 px as (select lab.map_id, lab.r, lab.c, tk.pos from lab join tk using (map_id, token)), pd as (select a.map_id, a.pos as i, b.pos as j, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) as d2 from px a join px b on a.map_id = b.map_id and a.pos < b.pos group by 1, 2, 3),
 pr as (select a.map_id, a.pos as i, b.pos as j, round(least(a.rad, b.rad), 9) >= {_G['ring_least_radius']} and round(abs(a.rad - b.rad), 9) <= {_G['ring_radial_gap']} and tg.gap <= {_G['ring_theta_gap']} as ring,
 least(a.area, b.area) >= {_G['line_least_area']} and round(abs((case when a.axis - b.axis + 90.0 < 0 then a.axis - b.axis + 270.0 else (a.axis - b.axis + 90.0) % 180.0 end) - 90.0), 9) <= {_G['line_angle_gap']} and round(greatest(a.l1 / greatest(a.l2, 1e-6), b.l1 / greatest(b.l2, 1e-6)), 9) >= {_G['line_elongation']}
 and round(sqrt((b.mr - a.mr) * (b.mr - a.mr) + (b.mc - a.mc) * (b.mc - a.mc)), 9) <= {_G['line_gap']} and round(abs((b.mr - a.mr) * sin(radians((a.axis + b.axis) / 2)) - (b.mc - a.mc) * cos(radians((a.axis + b.axis) / 2))), 9) <= {_G['line_perp_gap']} as line,
 (greatest(a.r1, b.r1) - least(a.r0, b.r0) + 1) * (greatest(a.c1, b.c1) - least(a.c0, b.c0) + 1) <= {_G['blob_bbox']} and pd.d2 <= {_G['blob_gap'] ** 2} as blob
 from tk a join tk b on a.map_id = b.map_id and a.pos < b.pos join tg on tg.map_id = a.map_id and tg.i = a.pos and tg.j = b.pos join pd on pd.map_id = a.map_id and pd.i = a.pos and pd.j = b.pos),
 ed as (select map_id, i, j, case when ring then 'ring' when line then 'line' else 'blob' end as reason, row_number() over (partition by map_id order by i, j) as k from pr where ring or line or blob),
 sizes as (select map_id, count(*) as n from tk group by 1),
 fold(map_id, k, labels, reasons) as (select map_id, cast(0 as bigint), range(1, n + 1), list_transform(range(n), lambda x: 'single') from sizes union all
 select f.map_id, e.k, list_transform(f.labels, lambda x: case when x = f.labels[e.j] then f.labels[e.i] else x end),
 list_transform(f.reasons, lambda x, p: case when f.labels[e.i] = f.labels[e.j] or p <> f.labels[e.i] then x when x = 'single' then e.reason when list_contains(string_split(x, '+'), e.reason) then x else x || '+' || e.reason end)
 from fold f join ed e on e.map_id = f.map_id and e.k = f.k + 1),
 done as (select map_id, arg_max(labels, k) as labels, arg_max(reasons, k) as reasons from fold group by 1),
 nm as (select tk.*, labels[pos] as label, reasons[labels[pos]] as reason from tk join done using (map_id)),
 mg as (select map_id, label, reason, min(token) as token, count(*) as parts, cast(sum(area) as bigint) as area, sum(mass) as mass, cast(sum(perimeter) as bigint) as perimeter, sum(sr) as sr, sum(sc) as sc, sum(srr) as srr, sum(scc) as scc, sum(src) as src, min(r0) as r0, max(r1) as r1, min(c0) as c0, max(c1) as c1 from nm group by 1, 2, 3), m1 as ({_SHAPED} from mg), m2 as ({_AXES} from m1)"""


def _five(name: str, alias: str | None = None):
    return (F.round(F.col(name), 5) + 0.0).alias(alias or name)


@query("g23_geometry_merge", f"{_MERGED} select map_id, cast(token as bigint) as token, parts, reason, area, mass, perimeter, round(mr, 5) + 0.0 as centroid_r, round(mc, 5) + 0.0 as centroid_c, round(l1, 5) + 0.0 as lambda_1, round(l2, 5) + 0.0 as lambda_2, round(rad, 5) + 0.0 as radial, cast((r1 - r0 + 1) * (c1 - c0 + 1) as bigint) as box from m2")
def geometry_merge(spark, sf_dir):
    """Regions joined along rings, lines and blobs, with the statistics of all their parts."""
    own = M.geometry_merge_tokens(A.maps(spark, sf_dir), H, W)
    box = ((F.col("r_max") - F.col("r_min") + 1) * (F.col("c_max") - F.col("c_min") + 1)).cast("bigint").alias("box")
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), "parts", "reason", "area", "mass", "perimeter", *map(_five, ("centroid_r", "centroid_c", "lambda_1", "lambda_2", "radial")), box)


@query("g23_merge_edges", f"{_MERGED} select ed.map_id, cast(a.token as bigint) as a_token, cast(b.token as bigint) as b_token, reason from ed join tk a on a.map_id = ed.map_id and a.pos = i join tk b on b.map_id = ed.map_id and b.pos = j")
def merge_edges(spark, sf_dir):
    """Which tokens of a map belong together, and why."""
    own = M.with_shape(M.token_sums(T.region_cells(A.maps(spark, sf_dir), H, W)).where(F.col("area") >= _G["min_area"]), H, W)
    own = M.written(own.withColumn("at", F.col("token")), "tokens")
    return M.merge_edges(own, H, W).select("map_id", F.col("a").cast("bigint").alias("a_token"), F.col("b").cast("bigint").alias("b_token"), "reason")


_WIDE = _LABELLED.replace("abs(b.r - reach.r) <= 1 and abs(b.c - reach.c) <= 1", "abs(b.r - reach.r) <= 3 and abs(b.c - reach.c) <= 3")


@query("g22_dilated_groups", f"{_WIDE} select map_id, cast(token as bigint) as token, count(*) as area, cast(sum(n) as double) as mass, cast(sum(edges) as bigint) as perimeter, round(avg(r), 5) + 0.0 as centroid_r, round(avg(c), 5) + 0.0 as centroid_c from lab join edge using (map_id, r, c) group by 1, 2")
def dilated_groups(spark, sf_dir):
    """Regions of the mask grown by one cell; their statistics come from the cells before growing."""
    own = M.with_shape(M.token_sums(M.dilated_cells(A.maps(spark, sf_dir), H, W)), H, W)
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), "area", "mass", "perimeter", _five("centroid_r"), _five("centroid_c"))
