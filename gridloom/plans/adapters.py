"""The domain's tables as projections of the given ones.

maps: grids of 16 x 16 with a round valid area, from lineitem; labels: label sets from events; defects and test rows
from lineitem; vectors and rankings from embeddings. The SQL of the same projections stands beside them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid as G

H = W = 16
#: The farthest valid cell from the middle (8, 8) of a map.
RADIUS = max(math.hypot(r - H / 2, c - W / 2) for r in range(H) for c in range(W) if (r - 7.5) ** 2 + (c - 7.5) ** 2 <= 64)

SQL_CELLS = """cells as (
 select l_suppkey as map_id, cast(l_partkey % 16 as int) as r, cast(l_orderkey % 16 as int) as c, cast(count(*) as bigint) as n
 from lineitem where l_quantity > 45
 and (l_partkey % 16 - 7.5) * (l_partkey % 16 - 7.5) + (l_orderkey % 16 - 7.5) * (l_orderkey % 16 - 7.5) <= 64 group by 1, 2, 3)"""
SQL_GRID = SQL_CELLS + """, grid as (
 select m.map_id, cast(g.g // 16 as int) as r, cast(g.g % 16 as int) as c, coalesce(x.n, 0) as n,
 cast(case when (g.g // 16 - 7.5) * (g.g // 16 - 7.5) + (g.g % 16 - 7.5) * (g.g % 16 - 7.5) > 64 then 0 when x.n > 0 then 2 else 1 end as int) as status
 from (select distinct map_id from cells) m cross join (select unnest(range(256)) as g) g
 left join cells x on x.map_id = m.map_id and x.r = g.g // 16 and x.c = g.g % 16)"""
SQL_LABELS = """label_rows as (
 select distinct cast(floor(event_id / 3) as bigint) as map_id, event_type as label from events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_circle(r, c):
    return (r - 7.5) * (r - 7.5) + (c - 7.5) * (c - 7.5) <= 64


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, r, c, n: defect counts of the cells that have any."""
    r, c = F.pmod("l_partkey", F.lit(16)).cast("int"), F.pmod("l_orderkey", F.lit(16)).cast("int")
    own = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("map_id"), r.alias("r"), c.alias("c"))
    return own.where(_in_circle(F.col("r"), F.col("c"))).groupBy("map_id", "r", "c").agg(F.count("*").alias("n"))


def grids(cell_counts: DataFrame) -> DataFrame:
    """map_id, counts, status, valid, mask: one row with full arrays for each map of (map_id, r, c, n).

    Maps are few bytes and much work, so they are dealt to a fixed number of partitions, which is not cut down by size.
    """
    spark = cell_counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    cell_counts = cell_counts.repartition(parts, "map_id")
    entries = F.map_from_entries(F.collect_list(F.struct((F.col("r") * W + F.col("c")).alias("i"), F.col("n").cast("int").alias("n"))))
    counted = cell_counts.groupBy("map_id").agg(G.dense(entries, H, W, F.lit(0)).alias("counts"))
    inside = F.transform(G.cells_of(H, W), lambda i: _in_circle(G.row_of(i, W), G.column_of(i, W)).cast("int"))
    with_valid = counted.withColumn("valid", inside)
    status = F.zip_with("counts", "valid", lambda n, v: F.when(v == 0, 0).when(n > 0, 2).otherwise(1))
    return with_valid.withColumn("status", status).withColumn("mask", F.transform("status", lambda s: (s == 2).cast("int")))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(cells(spark, sf_dir))


def exploded(df: DataFrame, *values: str, keys: tuple[str, ...] = ("map_id",), w: int = W) -> DataFrame:
    """keys, r, c and one column for each named array."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("i", "x"))
    return rows.select(*keys, G.row_of(F.col("i"), w).alias("r"), G.column_of(F.col("i"), w).alias("c"), *[F.col(f"x.{v}").alias(v) for v in values])


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, label: the distinct event types of three events in a row."""
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).cast("bigint").alias("map_id"), F.col("event_type").alias("label")).distinct()


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("wafer_id"),
        (F.col("l_partkey") % 41 - 20).cast("double").alias("xindex"),
        (F.col("l_orderkey") % 41 - 20).cast("double").alias("yindex"),
        (F.col("l_extendedprice") % 1000).cast("double").alias("xrel"),
        (F.col("l_quantity") * 20).cast("double").alias("yrel"),
        F.col("l_linenumber").cast("int").alias("classnumber"),
    )


SQL_DEFECTS = """defects as (
 select l_suppkey as wafer_id, cast(l_partkey % 41 - 20 as double) as xindex, cast(l_orderkey % 41 - 20 as double) as yindex,
 cast(l_extendedprice % 1000 as double) as xrel, cast(l_quantity * 20 as double) as yrel, cast(l_linenumber as int) as classnumber from lineitem)"""


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("lot_id"), F.col("l_suppkey").cast("string").alias("wafer_number"),
        (F.col("l_partkey") % 20).cast("bigint").alias("die_x"), (F.col("l_orderkey") % 20).cast("bigint").alias("die_y"),
        F.when(F.col("l_linestatus") == "O", "P").otherwise(F.col("l_linestatus")).alias("pf"), F.col("l_linenumber").cast("string").alias("hardbin"),
    )


SQL_TEST_ROWS = """test_rows as (
 select l_returnflag as lot_id, cast(l_suppkey as varchar) as wafer_number, cast(l_partkey % 20 as bigint) as die_x, cast(l_orderkey % 20 as bigint) as die_y,
 case when l_linestatus = 'O' then 'P' else l_linestatus end as pf, cast(l_linenumber as varchar) as hardbin from lineitem)"""
