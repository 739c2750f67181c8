"""Queries for similarity of whole maps: maps whose id is divisible by 20 ask, all maps answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import similarity as S
from ..sources import scratch
from . import adapters as A
from .adapters import H, SQL_GRID, W
from .raster import rounded

_PAIRS = f"""with {SQL_GRID}, p as (
 select a.map_id as query_id, b.map_id as candidate_id, a.r, a.c, a.status, cast(a.n > 0 as double) as x, cast(b.n > 0 as double) as y, a.n * 1.0 as nx, b.n * 1.0 as ny
 from grid a join grid b on a.r = b.r and a.c = b.c and a.map_id <> b.map_id where a.map_id % 20 = 0 and a.status in (1, 2)),
 s as (select query_id, candidate_id, cast(count(*) as double) n, sum(x) a, sum(y) b, sum(x * y) ab, sum(x * x) aa, sum(y * y) bb, sum(least(x, y)) low, sum(greatest(x, y)) high from p group by 1, 2)"""


def bit_pairs(spark, sf_dir):
    own = S.with_bits(A.maps(spark, sf_dir), H, W).select("map_id", "bits", "area")
    return S.blocked_pairs(own.where("map_id % 20 = 0"), own, "map_id")


def _scored(spark, sf_dir, method):
    return S.score_masks(bit_pairs(spark, sf_dir), method, H, W).select(F.col("q_map_id").alias("query_id"), F.col("c_map_id").alias("candidate_id"), rounded("score"))


_FORMULAS = {
    "p1_dice": ("dice", "case when a + b = 0 then 1.0 else 2 * low / (a + b) end"),
    "p2_iou": ("iou", "case when high = 0 then 1.0 else low / high end"),
    "p3_ncc": ("ncc", "case when n = 0 then 0.0 when aa - a * a / n < 1e-12 or bb - b * b / n < 1e-12 then case when abs(ab - a * b / n) < 1e-12 then 1.0 else 0.0 end else (ab - a * b / n) / sqrt((aa - a * a / n) * (bb - b * b / n)) end"),
    "p4_cosine": ("cosine", "case when aa = 0 and bb = 0 then 1.0 when aa = 0 or bb = 0 then 0.0 else ab / sqrt(aa * bb) end"),
    "p6_coverage": ("coverage", "case when a = 0 then 1.0 else low / a end"),
    "p7_leakage_control": ("leakage-control", "case when b = 0 then 1.0 else low / b end"),
}
for _name, (_method, _sql) in _FORMULAS.items():
    query(_name, f"{_PAIRS} select query_id, candidate_id, round({_sql}, 6) + 0.0 as score from s")(lambda spark, sf_dir, m=_method: _scored(spark, sf_dir, m))


@query("p8_coverage_leakage", f"""{_PAIRS}, f as (select query_id, candidate_id, low / (a + 1e-12) as coverage, (b - low) / (b + 1e-12) as leakage from s)
 select query_id, candidate_id, round(coverage - 0.5 * leakage, 6) + 0.0 as score, round(coverage, 6) + 0.0 as coverage, round(leakage, 6) + 0.0 as leakage from f""")
def coverage_leakage(spark, sf_dir):
    own = bit_pairs(spark, sf_dir).withColumn("s", S.mask_sums(H, W)).select(F.col("q_map_id").alias("query_id"), F.col("c_map_id").alias("candidate_id"), S.coverage_leakage(F.col("s")).alias("x"))
    return own.select("query_id", "candidate_id", "x.*").select("query_id", "candidate_id", *map(rounded, ("score", "coverage", "leakage")))


@query("p5_chamfer", f"""with {SQL_GRID}, d as (select map_id, r, c from grid where n > 0), v as (select map_id, r, c from grid where status in (1, 2)), q as (select distinct map_id from cells where map_id % 20 = 0),
 x as (select a.map_id q, b.map_id c, a.r, a.c as cc, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) m from d a join d b on a.map_id <> b.map_id where a.map_id % 20 = 0 group by 1, 2, 3, 4),
 y as (select a.map_id q, b.map_id c, b.r, b.c as cc, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) m from d a join d b on a.map_id <> b.map_id where a.map_id % 20 = 0 group by 1, 2, 3, 4)
 select x.q as query_id, x.c as candidate_id, round(1.0 - least((x.m + y.m) / sqrt(512.0), 1.0), 6) + 0.0 as score
 from (select q, c, avg(m) m from x group by 1, 2) x join (select q, c, avg(m) m from y group by 1, 2) y on x.q = y.q and x.c = y.c""")
def chamfer(spark, sf_dir):
    maps = scratch.written(S.with_bits(A.maps(spark, sf_dir), H, W).select("map_id", "bits", "area"), "bits")
    return S.block_chamfer(maps.where("map_id % 20 = 0"), maps, H, W)


@query("p9_top_similar", f"""{_PAIRS}, t as (select query_id, candidate_id, round(case when high = 0 then 1.0 else low / high end, 6) + 0.0 as score from s),
 k as (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from t) select query_id, candidate_id, score, rank from k where rank <= 5""")
def top_similar(spark, sf_dir):
    own = S.with_bits(A.maps(spark, sf_dir), H, W).select("map_id", "bits", "area")
    ranked = S.best_by_iou(own.where("map_id % 20 = 0"), own, 5)
    return ranked.select("query_id", "candidate_id", (0.0 - F.col("key")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("p10_smoke_rankings", f"""{_PAIRS}, t as (select query_id, candidate_id, round(low / greatest(high, 1), 6) + 0.0 as iou, round(case when a = 0 or b = 0 then 0.0 else low / a - 0.5 * (b - low) / b end, 6) + 0.0 as coverage_leakage from s),
 k as (select *, row_number() over (partition by query_id order by iou desc, candidate_id) as rank from t) select query_id, candidate_id, iou, coverage_leakage, rank from k where rank <= 100""")
def smoke_rankings(spark, sf_dir):
    """The plain baseline: here two empty maps score 0, unlike in p2_iou."""
    maps = scratch.written(S.with_bits(A.maps(spark, sf_dir), H, W).select("map_id", "bits", "area"), "bits")
    best = S.best_by_iou(maps.where("map_id % 20 = 0"), maps, 100, empty=0.0)
    own = S.listed_pairs(maps, maps, best.select("query_id", "candidate_id", "rank"), "map_id", ("rank",)).withColumn("s", S.mask_sums(H, W))
    own = own.withColumn("iou", F.col("s.low") / F.greatest("s.high", F.lit(1.0)))
    own = own.withColumn("coverage_leakage", F.when((F.col("s.a") == 0) | (F.col("s.b") == 0), 0.0).otherwise(F.col("s.low") / F.col("s.a") - 0.5 * (F.col("s.b") - F.col("s.low")) / F.col("s.b")))
    return own.select(F.col("q_map_id").alias("query_id"), F.col("c_map_id").alias("candidate_id"), rounded("iou"), rounded("coverage_leakage"), F.col("rank").cast("bigint").alias("rank"))


_CENTRES = f"""with {SQL_GRID}, m as (select map_id, cast(count(*) as double) n, avg(r) r, avg(c) c from grid where n > 0 group by 1),
 p as (select q.map_id query_id, c.map_id candidate_id, least(q.n, c.n) / greatest(q.n, c.n) as size_sim, 1.0 - least(sqrt((q.r - c.r) * (q.r - c.r) + (q.c - c.c) * (q.c - c.c)) / sqrt(512.0), 1.0) as position_sim
 from m q join m c on q.map_id <> c.map_id where q.map_id % 20 = 0)"""


def centres(spark, sf_dir):
    rows = A.exploded(A.maps(spark, sf_dir), "counts").where("counts > 0")
    return rows.groupBy("map_id").agg(F.count("*").cast("double").alias("n"), F.avg("r").alias("r"), F.avg("c").alias("c"))


@query("p11_size_position", f"{_CENTRES} select query_id, candidate_id, round(size_sim, 6) + 0.0 as size_sim, round(position_sim, 6) + 0.0 as position_sim from p")
def size_position(spark, sf_dir):
    m = centres(spark, sf_dir)
    p = S.blocked_pairs(m.where("map_id % 20 = 0"), m, "map_id")
    apart = F.sqrt((F.col("q_r") - F.col("c_r")) ** 2 + (F.col("q_c") - F.col("c_c")) ** 2) / (512.0**0.5)
    p = p.withColumn("size_sim", F.least("q_n", "c_n") / F.greatest("q_n", "c_n")).withColumn("position_sim", 1.0 - F.least(apart, F.lit(1.0)))
    return p.select(F.col("q_map_id").alias("query_id"), F.col("c_map_id").alias("candidate_id"), rounded("size_sim"), rounded("position_sim"))


@query("p12_label_gated_score", f"""with {A.SQL_LABELS}, s as (select map_id, list(label) as ls from label_rows group by 1),
 p as (select q.map_id query_id, c.map_id candidate_id, len(list_intersect(q.ls, c.ls)) / cast(len(c.ls) as double) as o, least(len(q.ls), len(c.ls)) / cast(greatest(len(q.ls), len(c.ls)) as double) as z from s q join s c on q.map_id <> c.map_id where q.map_id % 20 = 0)
 select query_id, candidate_id, round(case when o < 0.6 then 0.0 else (0.6 * o + 0.2 * z) / 0.8 end, 6) + 0.0 as score from p""")
def label_gated_score(spark, sf_dir):
    """Label overlap blended with a size term; a second term is absent, so the weights of the others are rescaled.

    Sets of labels are scored with each other; a query carries its set's scores, and a pair looks its own up.
    """
    s = scratch.written(A.label_rows(spark, sf_dir).groupBy("map_id").agg(F.array_sort(F.collect_list("label")).alias("ls")), "labels")
    sets = s.select("ls").distinct().withColumn("k", F.row_number().over(S.Window.orderBy("ls")) - 1)  # a few: sets of three events' types
    both = sets.select(F.col("ls").alias("q_ls")).crossJoin(sets.select(F.col("ls").alias("c_ls"), "k"))
    nq, nc = F.size("q_ls"), F.size("c_ls")
    terms = {"size": (F.least(nq, nc) / F.greatest(nq, nc), 0.2), "shape": (F.lit(None).cast("double"), 0.2)}
    both = both.withColumn("score", S.gated_label_score(F.col("q_ls"), F.col("c_ls"), terms)).withColumn("score", rounded("score"))
    scores = both.groupBy(F.col("q_ls").alias("ls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("scores"))
    asks = s.where("map_id % 20 = 0").join(F.broadcast(scores), "ls").select("map_id", "scores")
    p = S.blocked_pairs(asks, s.join(F.broadcast(sets), "ls").select("map_id", "k"), "map_id", S.SLIM_BLOCK)
    return p.select(F.col("q_map_id").alias("query_id"), F.col("c_map_id").alias("candidate_id"), F.get("q_scores", F.col("c_k")).alias("score"))


@query("p13_shift_search", f"""with {SQL_GRID}, mv as (select dr, dc, row_number() over (order by abs(dr) + abs(dc), dr, dc) as o from (select unnest(range(-2, 3)) as dr) cross join (select unnest(range(-2, 3)) as dc)),
 t as (select a.map_id q, b.map_id c, mv.o, mv.dr, mv.dc, count(*) as both_n from cells a join mv on true join cells b on b.map_id <> a.map_id and b.r + mv.dr = a.r and b.c + mv.dc = a.c where a.map_id % 20 = 0 group by 1, 2, 3, 4, 5),
 nb as (select c.map_id, mv.o, count(*) n from cells c join mv on c.r + mv.dr between 0 and 15 and c.c + mv.dc between 0 and 15 group by 1, 2), na as (select map_id, count(*) n from cells group by 1),
 allp as (select a.map_id q, b.map_id c, nb.o, mv.dr, mv.dc, a.n as an, nb.n as bn from na a join na b on a.map_id <> b.map_id join nb on nb.map_id = b.map_id join mv on mv.o = nb.o where a.map_id % 20 = 0),
 s as (select allp.q, allp.c, allp.o, allp.dr, allp.dc, coalesce(both_n, 0) / cast(an + bn - coalesce(both_n, 0) as double) as score from allp left join t on t.q = allp.q and t.c = allp.c and t.o = allp.o),
 k as (select *, row_number() over (partition by q, c order by score desc, o) rk from s)
 select q as query_id, c as candidate_id, round(score, 6) + 0.0 as score, cast(dr as bigint) dr, cast(dc as bigint) dc from k where rk = 1""")
def shift_search(spark, sf_dir):
    maps = scratch.written(S.with_bits(A.maps(spark, sf_dir), H, W).select("map_id", "bits"), "bits")
    return S.block_shift_search(maps.where("map_id % 20 = 0"), maps, H, W, 2)


_FEATURES = f"""with {SQL_GRID}, d as (select map_id, r, c, sqrt((r - 7.5) * (r - 7.5) + (c - 7.5) * (c - 7.5)) as rad from grid where n > 0),
 m as (select map_id, cast(count(*) as double) n, avg(r) / 16 as r, avg(c) / 16 as c from d group by 1),
 hb as (select map_id, least(cast(floor(rad) as int), 7) as b, cast(count(*) as double) k from d group by 1, 2),
 hn as (select map_id, b, k / sqrt(sum(k * k) over (partition by map_id)) as v from hb)"""


def features(spark, sf_dir):
    """map_id, n, centroid shares and the unit radial histogram (8 rings) of each map."""
    rows = A.exploded(A.maps(spark, sf_dir), "counts").where("counts > 0")
    ring = F.least(F.floor(F.sqrt((F.col("r") - 7.5) ** 2 + (F.col("c") - 7.5) ** 2)), F.lit(7)).cast("int")
    rings = [F.count_if(ring == k).cast("double") for k in range(8)]
    m = rows.groupBy("map_id").agg(F.count("*").cast("double").alias("n"), (F.avg("r") / H).alias("r"), (F.avg("c") / W).alias("c"), F.array(*rings).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return m.withColumn("hist", F.transform("raw", lambda x: x / norm)).drop("raw")


@query("d5_map_features", f"{_FEATURES} select m.map_id, m.n, round(m.r, 6) + 0.0 as r, round(m.c, 6) + 0.0 as c, cast(b as bigint) as ring, round(v, 6) + 0.0 as share from m join hn using (map_id)")
def map_features(spark, sf_dir):
    rows = features(spark, sf_dir).select("map_id", "n", rounded("r"), rounded("c"), F.posexplode("hist").alias("ring", "share")).where("share > 0")
    return rows.select("map_id", "n", "r", "c", F.col("ring").cast("bigint").alias("ring"), rounded("share"))


@query("p15_hard_negatives", f"""{_FEATURES}, p as (select q.map_id query_id, c.map_id candidate_id, least(q.n, c.n) / greatest(q.n, c.n) as k, sqrt((q.r - c.r) * (q.r - c.r) + (q.c - c.c) * (q.c - c.c)) as d from m q join m c on q.map_id <> c.map_id where q.map_id % 20 = 0),
 h as (select a.map_id q, b.map_id c, sum(a.v * b.v) as dot from hn a join hn b on a.b = b.b where a.map_id % 20 = 0 group by 1, 2),
 s as (select query_id, candidate_id, round(0.45 * k + 0.35 * exp(-d / 0.25) + 0.2 * coalesce(dot, 0) + case when k >= 0.5 and d <= 0.35 then 0.2 else 0.0 end, 6) + 0.0 as score from p left join h on h.q = query_id and h.c = candidate_id),
 t as (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from s) select query_id, candidate_id, score, rank from t where rank <= 20""")
def hard_negatives(spark, sf_dir):
    m = features(spark, sf_dir)
    ranked = S.best_hard_negatives(m.where("map_id % 20 = 0"), m, 20)
    return ranked.select("query_id", "candidate_id", (0.0 - F.col("key")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("p16_cross_modal", """with p as (select a.vec_id query_id, b.vec_id candidate_id, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) + 0.0 as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
 select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from p""")
def cross_modal(spark, sf_dir):
    """All candidates of each query vector by cosine of unit vectors."""
    v = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return S.whole_lists(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", S.list_rows, "query_id long, candidate_id long, score double, rk long").withColumnRenamed("rk", "rank")
