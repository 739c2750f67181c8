"""Queries that cluster the points of each map with parameters of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import cluster as C
from ..operators import mixture as X
from ..operators import spectral as P
from . import adapters as A
from .adapters import SQL_CELLS, W
from .raster import rounded

_STEP = "case i when 0 then lead({0}) over w - {0} when n - 1 then {0} - lag({0}) over w else (lead({0}) over w - lag({0}) over w) / 2 end"
_RADIUS = f"""{SQL_CELLS}, d as (select a.map_id, a.r, a.c, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) as d2 from cells a join cells b using (map_id)),
 o as (select map_id, r, c, sqrt(cast(d2 as double)) as k, row_number() over (partition by map_id, r, c order by d2) as place from d), size_of as (select map_id, count(*) as n from cells group by 1),
 curve as (select o.map_id, k, n, row_number() over (partition by o.map_id order by k) - 1 as i from o join size_of using (map_id) where place = 5 and n > 5),
 g1 as (select *, {_STEP.format("k")} as g from curve window w as (partition by map_id order by i)), g2 as (select *, {_STEP.format("g")} as bend from g1 window w as (partition by map_id order by i)),
 best as (select map_id, k, row_number() over (partition by map_id order by round(bend, 9) desc, i) as place from g2 where i >= n // 4),
 radius as (select s.map_id, s.n, case when s.n > 5 then greatest(b.k, 0.5) else 3.0 end as radius from size_of s left join best b on b.map_id = s.map_id and b.place = 1)"""


def sized(spark, sf_dir):
    return C.with_radius(A.maps(spark, sf_dir).select("map_id", "mask"), W)


@query("g25_elbow_radius", f"with {_RADIUS} select map_id, n as points, round(radius, 6) + 0.0 as radius from radius")
def elbow_radius(spark, sf_dir):
    """The knee of each map's curve of distances to the fifth nearest point."""
    return sized(spark, sf_dir).select("map_id", F.size("points").cast("bigint").alias("points"), rounded("radius"))


@query("g25_auto_dbscan", f"""with recursive {_RADIUS}, near as (select a.map_id, a.r, a.c, count(*) >= 5 as core from cells a join cells b using (map_id) join radius using (map_id) where sqrt(cast((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) as double)) <= radius group by 1, 2, 3),
 reach(map_id, r, c, label) as (select map_id, r, c, r * 16 + c + 1 from near where core union select reach.map_id, b.r, b.c, reach.label from reach join radius using (map_id) join near b on b.core and b.map_id = reach.map_id and sqrt(cast((b.r - reach.r) * (b.r - reach.r) + (b.c - reach.c) * (b.c - reach.c) as double)) <= radius),
 lab as (select map_id, r, c, min(label) as cluster from reach group by 1, 2, 3)
 select p.map_id, cast(p.r as bigint) as r, cast(p.c as bigint) as c, cast(min(lab.cluster) as bigint) as cluster from near p join radius using (map_id) left join lab on lab.map_id = p.map_id and sqrt(cast((p.r - lab.r) * (p.r - lab.r) + (p.c - lab.c) * (p.c - lab.c) as double)) <= radius group by 1, 2, 3""")
def auto_dbscan(spark, sf_dir):
    """DBSCAN of every map at its own radius."""
    return C.dbscan_by_radius(sized(spark, sf_dir), W).select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "cluster")])


@query("g26_mixture")
def mixture(spark, sf_dir):
    """The Gaussian components of every map's points, with the points that fall to each."""
    maps = A.maps(spark, sf_dir).select("map_id", F.filter(F.transform("mask", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()).alias("points"))
    points, components = X.mixtures(maps, W)
    areas = X.mixture_labels(points, components).groupBy("map_id", F.col("component").alias("k")).agg(F.count("*").alias("area"))
    return components.join(areas, ["map_id", "k"], "left").select("map_id", F.col("k").alias("component"), *map(rounded, ("weight", "mr", "mc", "srr", "scc", "src")), F.coalesce("area", F.lit(0).cast("bigint")).alias("area"))


@query("g27_spectral")
def spectral(spark, sf_dir):
    """Spectral clusters of every map's points, as many as its eigenvalues tell."""
    return P.spectral_clusters(sized(spark, sf_dir), W)
