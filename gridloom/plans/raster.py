"""Queries over grids: rasters, representations, resizing, pooling and test-bin maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import grid as G
from ..operators import raster as R
from . import adapters as A
from .adapters import H, SQL_DEFECTS, SQL_GRID, SQL_TEST_ROWS, W

PLACES = 6


def rounded(name: str):
    """Results are compared across engines at six places."""
    return (F.round(F.col(name), PLACES) + F.lit(0.0)).alias(name)


def _cells(df, *values, w=W):
    return A.exploded(df, *values, w=w)


_BOUNDS = ", b as (select wafer_id, min(xindex) x0, max(xindex) x1, min(yindex) y0, max(yindex) y1 from defects group by 1)"


@query("r1_die_index_map", f"""with {SQL_DEFECTS}{_BOUNDS}, p as (
 select wafer_id, cast(least(greatest(floor((1.0 - case when y1 > y0 then (yindex - y0) / (y1 - y0) else 0.0 end) * 20), 0), 19) as bigint) as r,
 cast(least(greatest(floor(case when x1 > x0 then (xindex - x0) / (x1 - x0) else 0.0 end * 20), 0), 19) as bigint) as c from defects join b using (wafer_id))
 select wafer_id, r, c, count(*) as n from p group by 1, 2, 3""")
def die_index_map(spark, sf_dir):
    placed = R.map_by_range(A.defects(spark, sf_dir), "wafer_id", "xindex", "yindex", 20, 20)
    return R.rasterize(placed, "wafer_id").select("wafer_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "n")


@query("r2_relative_map", f"""with {SQL_DEFECTS}, b as (select wafer_id, min(xrel) x0, max(xrel) x1, min(yrel) y0, max(yrel) y1 from defects group by 1), p as (
 select wafer_id, cast(least(greatest(floor((1.0 - case when y1 > y0 then (yrel - y0) / (y1 - y0) else 0.0 end) * 20), 0), 19) as bigint) as r,
 cast(least(greatest(floor(case when x1 > x0 then (xrel - x0) / (x1 - x0) else 0.0 end * 20), 0), 19) as bigint) as c from defects join b using (wafer_id))
 select wafer_id, r, c, count(*) as n from p group by 1, 2, 3""")
def relative_map(spark, sf_dir):
    placed = R.map_by_range(A.defects(spark, sf_dir), "wafer_id", "xrel", "yrel", 20, 20)
    return R.rasterize(placed, "wafer_id").select("wafer_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "n")


@query("r3_physical_map", f"""with {SQL_DEFECTS}{_BOUNDS}, p as (
 select wafer_id, cast(floor((1 - (yindex - y0 + yrel / 1024.0) / (y1 - y0 + 1)) * 24) as bigint) as r, cast(floor((xindex - x0 + xrel / 1024.0) / (x1 - x0 + 1) * 24) as bigint) as c
 from defects join b using (wafer_id) where not (x0 = x1 and y0 = y1))
 select wafer_id, r, c, count(*) as n, (r - 11.5) * (r - 11.5) + (c - 11.5) * (c - 11.5) > 144.0 as outside from p where r between 0 and 23 and c between 0 and 23 group by 1, 2, 3""")
def physical_map(spark, sf_dir):
    placed = R.rasterize(R.map_physical(A.defects(spark, sf_dir), "wafer_id", 24, 24, 1024.0, 1024.0), "wafer_id")
    return placed.select("wafer_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "n", R.outside_circle(F.col("r"), F.col("c"), 24, 24).alias("outside"))


@query("r4_rasterize", f"with {SQL_GRID} select map_id, cast(r as bigint) r, cast(c as bigint) c, n, cast(status as bigint) status, cast(sum(n) over (partition by map_id) as bigint) as mapped_count from grid")
def rasterize(spark, sf_dir):
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x)
    own = A.maps(spark, sf_dir).withColumn("mapped_count", total)
    return A.exploded(own, "counts", "status", keys=("map_id", "mapped_count")).select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col("counts").cast("bigint").alias("n"), F.col("status").cast("bigint").alias("status"), "mapped_count")


@query("r6_binary_count_density", f"""with {SQL_GRID}
 select map_id, cast(r as bigint) r, cast(c as bigint) c, cast(n >= 1 as bigint) as bin, n, round(n / sum(n) over (partition by map_id), 6) + 0.0 as density from grid""")
def binary_count_density(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("density", G.density(F.col("counts")))
    rows = _cells(own, "mask", "counts", "density")
    return rows.select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col("mask").cast("bigint").alias("bin"), F.col("counts").cast("bigint").alias("n"), rounded("density"))


_BLUR = """, d as (select map_id, r, c, n / sum(n) over (partition by map_id) as v from grid),
 k as (select d, exp(-d * d / 2.0) / (select sum(exp(-x * x / 2.0)) from (select unnest(range(-3, 4)) as x)) as w from (select unnest(range(-3, 4)) as d))"""


@query("r7_soft_edge", f"""with {SQL_GRID}{_BLUR}
 select a.map_id, cast(a.r as bigint) r, cast(a.c as bigint) c, round(sum(kr.w * kc.w * b.v), 6) + 0.0 as soft from grid a cross join k kr cross join k kc
 join d b on b.map_id = a.map_id and b.r = least(greatest(a.r + kr.d, 0), 15) and b.c = least(greatest(a.c + kc.d, 0), 15) group by 1, 2, 3""")
def soft_edge(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("soft", G.blur(G.density(F.col("counts")), H, W, edge=True))
    return _cells(own, "soft").select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), rounded("soft"))


@query("r8_soft_zero", f"""with {SQL_GRID}{_BLUR}
 select a.map_id, cast(a.r as bigint) r, cast(a.c as bigint) c, round(sum(kr.w * kc.w * coalesce(b.v, 0)), 6) + 0.0 as soft from grid a cross join k kr cross join k kc
 left join d b on b.map_id = a.map_id and b.r = a.r + kr.d and b.c = a.c + kc.d group by 1, 2, 3""")
def soft_zero(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("soft", G.blur(G.density(F.col("counts")), H, W, edge=False))
    return _cells(own, "soft").select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), rounded("soft"))


_NEAR = """, near as (select a.map_id, a.r, a.c, max(b.n) as most from grid a join grid b on a.map_id = b.map_id and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and not (a.r = b.r and a.c = b.c) group by 1, 2, 3)"""


@query("r9_three_value_count", f"""with {SQL_GRID}{_NEAR} select map_id, cast(r as bigint) r, cast(c as bigint) c,
 cast(case when n >= 2 then 1.0 when n >= 1 then 0.5 when most > 0 then 0.5 else 0.0 end as double) as v from grid join near using (map_id, r, c)""")
def three_value_count(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("v", G.three_value_counts(F.col("counts"), H, W))
    return _cells(own, "v").select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v")


@query("r10_three_value_mask", f"""with {SQL_GRID}{_NEAR} select map_id, cast(r as bigint) r, cast(c as bigint) c,
 cast(case when n >= 1 then 1.0 when most > 0 then 0.5 else 0.0 end as double) as v from grid join near using (map_id, r, c)""")
def three_value_mask(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("v", G.three_value_mask(F.col("mask"), H, W))
    return _cells(own, "v").select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v")


@query("r11_mountain", f"""with {SQL_GRID}, h as (
 select a.map_id, a.r, a.c, sum(exp(-((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) / 4.5)) as v from grid a join cells b on a.map_id = b.map_id group by 1, 2, 3)
 select map_id, cast(r as bigint) r, cast(c as bigint) c, round(v / sum(v) over (partition by map_id), 6) + 0.0 as v from h""")
def mountain(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("v", G.mountain(F.col("counts"), H, W))
    return _cells(own, "v").select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), rounded("v"))


@query("r13_map_statistics", f"""with {SQL_GRID} select map_id, count(*) filter (status = 2) as defects, count(*) filter (status > 0) as valid,
 round(count(*) filter (status = 2) / cast(count(*) filter (status > 0) as double), 6) + 0.0 as defect_ratio,
 cast(min(r) filter (status = 2) as bigint) r_min, cast(min(c) filter (status = 2) as bigint) c_min, cast(max(r) filter (status = 2) as bigint) r_max, cast(max(c) filter (status = 2) as bigint) c_max,
 round(avg(r) filter (status = 2), 6) + 0.0 as centroid_r, round(avg(c) filter (status = 2), 6) + 0.0 as centroid_c,
 round(avg(r) filter (status = 2) / 16, 6) + 0.0 as norm_r, round(avg(c) filter (status = 2) / 16, 6) + 0.0 as norm_c from grid group by 1""")
def map_statistics(spark, sf_dir):
    """Areas, ratio, bounding box and centroid; a map without defects has an empty box and the middle as its centroid."""
    rows = _cells(A.maps(spark, sf_dir), "status")
    hit = F.col("status") == 2
    of = lambda f, c: f(F.when(hit, F.col(c)))
    stats = rows.groupBy("map_id").agg(
        F.count_if(hit).alias("defects"), F.count_if(F.col("status") > 0).alias("valid"),
        *[F.coalesce(of(f, c), F.lit(0)).cast("bigint").alias(f"{c}_{n}") for f, n in ((F.min, "min"), (F.max, "max")) for c in ("r", "c")],
        F.coalesce(of(F.avg, "r"), F.lit(H / 2)).alias("centroid_r"), F.coalesce(of(F.avg, "c"), F.lit(W / 2)).alias("centroid_c"),
    )
    stats = stats.withColumn("defect_ratio", F.col("defects") / F.greatest("valid", F.lit(1))).withColumn("norm_r", F.col("centroid_r") / H).withColumn("norm_c", F.col("centroid_c") / W)
    return stats.select("map_id", "defects", "valid", rounded("defect_ratio"), "r_min", "c_min", "r_max", "c_max", *map(rounded, ("centroid_r", "centroid_c", "norm_r", "norm_c")))


@query("r12_preprocess_bundle")
def preprocess_bundle(spark, sf_dir):
    """All derived grids of a map, as arrays in one row."""
    own = A.maps(spark, sf_dir)
    n = F.col("counts")
    return own.select("map_id", "status", "mask", "valid", "counts", G.density(n).alias("density"), G.blur(G.density(n), H, W, edge=False).alias("soft"), G.three_value_mask(F.col("mask"), H, W).alias("three_value"), G.mountain(n, H, W).alias("mountain"))


@query("r14_decouple", f"with {SQL_GRID} select map_id, cast(r as bigint) r, cast(c as bigint) c, cast(least(greatest(status - 1, 0), 1) as bigint) as defect, cast(status > 0 as bigint) as valid from grid")
def decouple(spark, sf_dir):
    own = A.maps(spark, sf_dir).select("map_id", G.decouple(F.col("status")).alias("x")).select("map_id", "x.*")
    return _cells(own, "defect", "valid").select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "defect", "valid")])


@query("r15_resize", f"""with {SQL_GRID}, t as (select unnest(range(144)) as i)
 select map_id, cast(i // 12 as bigint) r, cast(i % 12 as bigint) c, cast(status as bigint) status from (select distinct map_id from cells) m cross join t
 join grid using (map_id) where grid.r = cast(floor((i // 12) * 16 / 12.0) as int) and grid.c = cast(floor((i % 12) * 16 / 12.0) as int)""")
def resize(spark, sf_dir):
    own = A.maps(spark, sf_dir).select("map_id", G.fit(F.col("status"), H, W, 12, 12).alias("status"))
    return _cells(own, "status", w=12).select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "status")])


@query("r15_pad", f"""with {SQL_GRID}, t as (select unnest(range(400)) as i)
 select m.map_id, cast(i // 20 as bigint) r, cast(i % 20 as bigint) c, cast(coalesce(status, 0) as bigint) status from (select distinct map_id from cells) m cross join t
 left join grid g on g.map_id = m.map_id and g.r = i // 20 - 2 and g.c = i % 20 - 2""")
def pad(spark, sf_dir):
    own = A.maps(spark, sf_dir).select("map_id", G.fit(F.col("status"), H, W, 20, 20).alias("status"))
    return _cells(own, "status", w=20).select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "status")])


_GREY = ", grey as (select map_id, r, c, case status when 2 then 255 when 1 then 127 else 0 end as v from grid)"
_POOLED = {
    "max": "max(v)",
    "min": "min(v)",
    "mean": "round(avg(v), 6) + 0.0",
    "white_priority": "case when bool_or(v = 255) then 255 when bool_or(v = 127) then 127 else 0 end",
    "zero_dominant": "case when 2 * count(*) filter (v = 0) > count(*) then 0 else max(v) end",
}


@query("r16_pooling", f"with {SQL_GRID}{_GREY} select map_id, cast(r // 3 as bigint) r, cast(c // 3 as bigint) c, " + ", ".join(f"cast({s} as double) as p_{n}" for n, s in _POOLED.items()) + " from grey group by 1, 2, 3")
def pooling(spark, sf_dir):
    grey = F.transform("status", lambda s: F.when(s == 2, 255).when(s == 1, 127).otherwise(0))
    own = A.maps(spark, sf_dir).select("map_id", grey.alias("grey"))
    own = own.select("map_id", *[F.transform(G.pool(F.col("grey"), H, W, 3, how), lambda x: x.cast("double")).alias(f"p_{how}") for how in _POOLED])
    rows = _cells(own, *[f"p_{how}" for how in _POOLED], w=6)
    return rows.select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), *[rounded(f"p_{how}") for how in _POOLED])


@query("r18_bin_policies", f"""with {SQL_DEFECTS}, v as (select wafer_id, classnumber as bin, count(*) as n from defects group by 1, 2)
 select wafer_id, cast(bin as bigint) bin, n, cast(case when bin >= 3 then 0 else bin end as bigint) as ignored, cast(case when bin >= 3 then 2 else bin end as bigint) as as_defect from v""")
def bin_policies(spark, sf_dir):
    v = A.defects(spark, sf_dir).groupBy("wafer_id", F.col("classnumber").alias("bin")).agg(F.count("*").alias("n"))
    of = lambda p: G.by_policy(F.array("bin"), p)[0].cast("bigint")
    return v.select("wafer_id", F.col("bin").cast("bigint").alias("bin"), "n", of("ignore").alias("ignored"), of("as_defect").alias("as_defect"))


_STATUS = "case when pf is null or upper(trim(pf)) in ('', 'N/A', 'NA', 'NONE', 'NULL') then 0 when upper(trim(pf)) in ('P', 'PASS', '1', 'TRUE', 'Y', 'YES', 'OK') then 1 else 2 end"


@query("r20_die_grid", f"""with {SQL_TEST_ROWS}, b as (select lot_id, wafer_number, min(die_x) x0, max(die_y) y1 from test_rows group by 1, 2)
 select lot_id, wafer_number, y1 - die_y as r, die_x - x0 as c, cast(max({_STATUS}) as bigint) as status, count(*) as tests from test_rows join b using (lot_id, wafer_number) group by 1, 2, 3, 4""")
def die_grid(spark, sf_dir):
    return R.worst_status(R.die_grid(A.test_rows(spark, sf_dir)))


@query("r20_hardbin_grid", f"""with {SQL_TEST_ROWS}, b as (select lot_id, wafer_number, min(die_x) x0, max(die_y) y1 from test_rows group by 1, 2)
 select lot_id, wafer_number, hardbin, y1 - die_y as r, die_x - x0 as c, count(*) as tests from test_rows join b using (lot_id, wafer_number) group by 1, 2, 3, 4, 5""")
def hardbin_grid(spark, sf_dir):
    return R.die_grid(A.test_rows(spark, sf_dir)).groupBy("lot_id", "wafer_number", "hardbin", "r", "c").agg(F.count("*").alias("tests"))


@query("s15_actual_locations", f"""with {SQL_DEFECTS}, a as (select wafer_id, xindex * 1024.0 + xrel - 512.0 as xa, yindex * 1024.0 + yrel - 512.0 as ya from defects)
 select wafer_id, floor(xa / 800.0) as xindex, floor(ya / 800.0) as yindex, count(*) as n, round(sum(xa - floor(xa / 800.0) * 800.0), 3) as xrel_total, round(sum(ya), 3) as y_total from a group by 1, 2, 3""")
def actual_locations(spark, sf_dir):
    moved = R.regrid(R.actual_locations(A.defects(spark, sf_dir), 1024.0, 1024.0, 512.0, 512.0), 800.0, 800.0)
    return moved.groupBy("wafer_id", "xindex", "yindex").agg(F.count("*").alias("n"), F.round(F.sum("xrel"), 3).alias("xrel_total"), F.round(F.sum("y_actual"), 3).alias("y_total"))


@query("b9_exact_moves", f"""with {SQL_GRID} select map_id, cast(15 - c as bigint) r, cast(r as bigint) c, 'rot90' as move, cast(status as bigint) status from grid
 union all select map_id, 15 - r, 15 - c, 'rot180', status from grid union all select map_id, r, 15 - c, 'flip', status from grid
 union all select g.map_id, g.r, g.c, 'shift', coalesce(s.status, 0) from grid g left join grid s on s.map_id = g.map_id and s.r = g.r - 1 and s.c = g.c - 2""")
def exact_moves(spark, sf_dir):
    own = A.maps(spark, sf_dir)
    names = {"rot90": "rot90", "rot180": "rot180", "flip": "flip", "shift": "shift:1:2"}
    moved = own.select("map_id", F.explode(F.array(*[F.struct(F.lit(n).alias("move"), G.transform_cells(F.col("status"), H, W, how).alias("status")) for n, how in names.items()])).alias("x")).select("map_id", "x.*")
    return A.exploded(moved, "status", keys=("map_id", "move")).select("map_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "move", F.col("status").cast("bigint").alias("status"))


@query("r5_representations")
def representations(spark, sf_dir):
    """Every registered representation of a map, one row each."""
    own = A.maps(spark, sf_dir)
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.transform(f(F.col("counts"), F.col("mask"), H, W), lambda x: x.cast("double")).alias("grid")) for n, f in G.REPRESENTATIONS.items()])
    return own.select("map_id", F.explode(made).alias("x")).select("map_id", "x.*")


@query("r17_pseudo_bins")
def pseudo_bins(spark, sf_dir):
    own = A.maps(spark, sf_dir).withColumn("bins", G.pseudo_bins(F.col("mask"), F.col("valid"), H, W))
    return _cells(own, "bins", "status").select("map_id", "r", "c", "status", "bins")


_SHARE = "((map_id * 65536 + r * 16 + c) * 2654435761 + {}) % 4294967296 / 4294967296.0"


@query("b9_hashed_moves", f"with {SQL_GRID} select map_id, cast(r as bigint) r, cast(c as bigint) c, cast(case when {_SHARE.format(3)} < 0.1 then 0 else n > 0 end as bigint) as dropout_10, cast(case when status > 0 and {_SHARE.format(5)} < 0.03 then 1 else n > 0 end as bigint) as noise_3 from grid")
def hashed_moves(spark, sf_dir):
    """Random changes of a map, drawn by hash."""
    own = A.maps(spark, sf_dir)
    own = own.withColumn("dropout_10", G.dropout(F.col("mask"), F.col("map_id"), 0.1, 3)).withColumn("noise_3", G.noise(F.col("mask"), F.col("valid"), F.col("map_id"), 0.03, 5))
    return _cells(own, "dropout_10", "noise_3").select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "dropout_10", "noise_3")])
