"""Queries for label statistics, splits, samples and benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import sampling as B
from ..operators import similarity as S
from . import adapters as A
from . import rankings as Q
from .raster import rounded

SQL_SIGNATURES = f"{A.SQL_LABELS}, sig as (select map_id, string_agg(label, '|' order by label) as signature, count(*) as cardinality from label_rows group by 1)"


def signatures(spark, sf_dir):
    """map_id, signature, cardinality."""
    s = A.label_rows(spark, sf_dir).groupBy("map_id").agg(F.array_sort(F.collect_set("label")).alias("l"))
    return s.select("map_id", F.array_join("l", "|").alias("signature"), F.size("l").cast("bigint").alias("cardinality"))


def _mix(column: str, seed: int) -> str:
    return f"(({column} % 2147483648) * 2654435761 + {seed}) % 4294967296"


@query("m11_label_statistics", f"with {SQL_SIGNATURES} select signature, cardinality, count(*) as maps, round(count(*) / cast((select count(*) from sig) as double), 6) + 0.0 as share from sig group by 1, 2")
def label_statistics(spark, sf_dir):
    own = signatures(spark, sf_dir).groupBy("signature", "cardinality").agg(F.count("*").alias("maps"))
    whole = own.agg(F.sum("maps").alias("n"))  # one row
    return own.join(F.broadcast(whole)).withColumn("share", F.col("maps") / F.col("n")).select("signature", "cardinality", "maps", rounded("share"))


@query("m11_class_counts", f"with {A.SQL_LABELS} select label, count(*) as maps from label_rows group by 1")
def class_counts(spark, sf_dir):
    return A.label_rows(spark, sf_dir).groupBy("label").agg(F.count("*").alias("maps"))


_SIZES = "case when n >= 3 then greatest(floor(n * 0.7), 1) else floor(n * 0.7) end as a0, case when n >= 3 then greatest(floor(n * 0.1), 1) else floor(n * 0.1) end as b0"
_SPLIT = f"""with {SQL_SIGNATURES}, p as (select *, count(*) over (partition by signature) as n, row_number() over (partition by signature order by {_mix('map_id', 17)}, map_id) as k from sig), q as (select *, {_SIZES} from p),
 o as (select *, case when n >= 3 then greatest(a0 + b0 + 1 - n, 0) else 0 end as over_n from q), r as (select *, a0 - least(over_n, greatest(a0 - 1, 0)) as a, b0 - (over_n - least(over_n, greatest(a0 - 1, 0))) as b from o),
 s as (select map_id, signature, case when k <= a then 'train' when k <= a + b then 'val' else 'test' end as split from r)"""


def split(spark, sf_dir):
    return B.stratified_split(signatures(spark, sf_dir), "signature", "map_id", 17)


@query("b1_stratified_split", f"{_SPLIT} select map_id, signature, split from s")
def stratified_split(spark, sf_dir):
    return split(spark, sf_dir).select("map_id", "signature", "split")


@query("b2_older_split", f"with {SQL_SIGNATURES}, p as (select *, count(*) over (partition by signature) as n, row_number() over (partition by signature order by {_mix('map_id', 5)}, map_id) as k from sig) select map_id, signature, case when n >= 10 then case when k <= floor(n * 0.8) then 'train' when k <= floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end when n >= 3 then case when k = n - 1 then 'val' when k = n then 'test' else 'train' end else 'train' end as split from p")
def older_split(spark, sf_dir):
    return B.older_split(signatures(spark, sf_dir), "signature", "map_id", 5).select("map_id", "signature", "split")


@query("b3_plain_split", f"with {SQL_SIGNATURES} select map_id, case when {_mix('map_id', 23)} < 4294967296 * 0.8 then 'train' when {_mix('map_id', 23)} < 4294967296 * 0.9 then 'val' else 'test' end as split from sig")
def plain_split(spark, sf_dir):
    """Without strata a row's own hash decides, so nothing is sorted or shuffled."""
    at = B.hash_order("map_id", 23)
    return signatures(spark, sf_dir).select("map_id", F.when(at < 4294967296 * 0.8, "train").when(at < 4294967296 * 0.9, "val").otherwise("test").alias("split"))


@query("s7_split_filter", f"{_SPLIT} select map_id, signature from s where split = 'test'")
def split_filter(spark, sf_dir):
    return split(spark, sf_dir).where("split = 'test'").select("map_id", "signature")


@query("b4_query_sample", f"with {SQL_SIGNATURES}, t as (select *, row_number() over (partition by signature order by {_mix('map_id', 29)}, map_id) as turn from sig) select map_id, signature from t order by turn, signature, map_id limit 100")
def query_sample(spark, sf_dir):
    return B.round_robin(signatures(spark, sf_dir), "signature", "map_id", 100, 29).select("map_id", "signature")


_POOL = f"""with {Q.SQL_RANKED}, t as (select query_id, candidate_id, jac as jaccard, case when jac >= 1 then 'exact' when jac >= 0.5 then 'high' when jac > 0 then 'low' else 'none' end as bucket from graded),
 p as (select *, row_number() over (partition by query_id, bucket order by {_mix('candidate_id', 31)}, candidate_id) as k from t), f as (select *, cast(k > case bucket when 'exact' then 50 when 'high' then 100 when 'low' then 100 else 750 end as int) as fill, case bucket when 'exact' then 0 when 'high' then 1 when 'low' then 2 else 3 end as b from p),
 u as (select *, row_number() over (partition by query_id order by fill, b, k) as turn from f)"""


def pools(spark, sf_dir):
    own = Q.labels(spark, sf_dir)
    return B.label_set_pools(own.where("id % 20 = 0"), own, 1000, seed=31)


@query("b5_candidate_pools", f"{_POOL} select query_id, candidate_id, round(jaccard, 6) + 0.0 as jaccard, bucket from u where turn <= 1000")
def candidate_pools(spark, sf_dir):
    return pools(spark, sf_dir).select("query_id", "candidate_id", rounded("jaccard"), "bucket")


@query("s8_candidate_groups", f"{_POOL}, m as (select * from u where turn <= 1000) select query_id, count(*) as candidates, min(candidate_id) as first_id, cast(sum(candidate_id) as bigint) as id_sum from m group by 1")
def candidate_groups(spark, sf_dir):
    return pools(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("candidates"), F.min("candidate_id").alias("first_id"), F.sum("candidate_id").alias("id_sum"))


@query("s8_id_universe", f"{_POOL}, m as (select * from u where turn <= 1000) select query_id as id from m union select candidate_id from m")
def id_universe(spark, sf_dir):
    m = pools(spark, sf_dir)
    return m.select(F.col("query_id").alias("id")).union(m.select("candidate_id")).distinct()


@query("b11_other_class_fill", f"with {SQL_SIGNATURES}, one as (select * from sig where cardinality = 1), q as (select map_id, signature from one where map_id % 20 = 0), p as (select q.map_id query_id, c.map_id candidate_id, c.signature, row_number() over (partition by q.map_id, c.signature order by {_mix('c.map_id', 37)}, c.map_id) as k from q join one c on c.signature <> q.signature) select query_id, candidate_id, signature from p where k <= 3")
def other_class_fill(spark, sf_dir):
    """Three maps of each other class for each query, in hash order."""
    one = signatures(spark, sf_dir).where("cardinality = 1").select("map_id", "signature")
    return B.first_of_other_classes(one.where("map_id % 20 = 0"), one, "map_id", "signature", 3, 37).select("query_id", "candidate_id", "signature")


@query("b13_class_weights", f"with {SQL_SIGNATURES}, n as (select signature, count(*) as n from sig group by 1) select map_id, signature, round(1.0 / n, 6) + 0.0 as weight from sig join n using (signature)")
def class_weights(spark, sf_dir):
    return B.class_weights(signatures(spark, sf_dir).select("map_id", "signature"), "signature").select("map_id", "signature", rounded("weight"))


@query("b13_weighted_sample")
def weighted_sample(spark, sf_dir):
    weighted = B.class_weights(signatures(spark, sf_dir).select("map_id", "signature"), "signature")
    return B.weighted_sample(weighted, "map_id", 200, 41)


@query("m12_metadata_report", f"with {A.SQL_CELLS}, s as (select map_id, cast(sum(n) as double) as defects, cast(count(*) as double) as cells_n from cells group by 1) select count(*) as maps, round(avg(defects), 6) + 0.0 as mean_defects, round(stddev_samp(defects), 6) + 0.0 as std_defects, min(defects) as least, max(defects) as most, round(median(defects), 6) + 0.0 as median_defects, round(avg(cells_n), 6) + 0.0 as mean_cells from s")
def metadata_report(spark, sf_dir):
    s = A.cells(spark, sf_dir).groupBy("map_id").agg(F.sum("n").cast("double").alias("defects"), F.count("*").cast("double").alias("cells_n"))
    own = s.agg(F.count("*").alias("maps"), F.avg("defects").alias("mean_defects"), F.stddev_samp("defects").alias("std_defects"), F.min("defects").alias("least"), F.max("defects").alias("most"), F.percentile("defects", 0.5).alias("median_defects"), F.avg("cells_n").alias("mean_cells"))
    return own.select("maps", rounded("mean_defects"), rounded("std_defects"), "least", "most", rounded("median_defects"), rounded("mean_cells"))


@query("e1_one_per_signature", f"with {SQL_SIGNATURES}, k as (select *, row_number() over (partition by signature order by {_mix('map_id', 43)}, map_id) as at_k from sig) select map_id, signature, cardinality from k where at_k = 1")
def one_per_signature(spark, sf_dir):
    s = signatures(spark, sf_dir)
    return s.groupBy("signature", "cardinality").agg(F.min_by("map_id", F.struct(B.hash_order("map_id", 43), "map_id")).alias("map_id")).select("map_id", "signature", "cardinality")


@query("e5_label_export_counts", f"with {SQL_SIGNATURES} select replace(signature, '|', '_') as folder, count(*) as maps from sig group by 1")
def label_export_counts(spark, sf_dir):
    return signatures(spark, sf_dir).groupBy(F.replace(F.col("signature"), F.lit("|"), F.lit("_")).alias("folder")).agg(F.count("*").alias("maps"))


@query("e4_blend_sources", f"with {SQL_SIGNATURES}, real as (select map_id from sig where map_id % 2 = 0), made as (select map_id from sig where map_id % 2 = 1 and {_mix('map_id', 47)} < 4294967296 * 0.25) select map_id, 'real' as origin from real union all select map_id, 'synthetic' from made")
def blend_sources(spark, sf_dir):
    """All of one source and a hash-drawn quarter of the other."""
    s = signatures(spark, sf_dir).select("map_id")
    made = s.where((F.col("map_id") % 2 == 1) & (B.hash_order("map_id", 47) < 4294967296 * 0.25))
    return s.where("map_id % 2 = 0").withColumn("origin", F.lit("real")).unionByName(made.withColumn("origin", F.lit("synthetic")))


@query("e7_best_split", f"with {A.SQL_DEFECTS}, s as (select wafer_id, classnumber, count(*) as n, sum(xindex * xindex + yindex * yindex) as spread from defects group by 1, 2), b as (select *, row_number() over (partition by wafer_id order by n desc, classnumber) as k from s), t as (select wafer_id, classnumber, n from b where k = 1) select wafer_id, cast(classnumber as bigint) as classnumber, n, row_number() over (order by n desc, wafer_id) as place from t order by place limit 10")
def best_split(spark, sf_dir):
    """The largest class of each wafer, and the ten wafers with the largest ones."""
    s = A.defects(spark, sf_dir).groupBy("wafer_id", F.col("classnumber").cast("bigint").alias("classnumber")).agg(F.count("*").alias("n"))
    best = s.groupBy("wafer_id").agg(F.max_by(F.struct("classnumber", "n"), F.struct("n", -F.col("classnumber"))).alias("b")).select("wafer_id", "b.classnumber", "b.n")
    top = best.orderBy(F.desc("n"), "wafer_id").limit(10)
    return top.withColumn("place", F.row_number().over(S.Window.orderBy(F.desc("n"), "wafer_id")).cast("bigint"))
