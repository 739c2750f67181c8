"""Queries over streams of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..streaming import raster as R
from . import adapters as A


@query("x1_stream_raster", f"with {A.SQL_CELLS} select map_id, cast(r as bigint) r, cast(c as bigint) c, n from cells")
def stream_raster(spark, sf_dir):
    """The raster of r4_rasterize from a stream, a micro-batch at a time."""
    r, c = F.pmod("l_partkey", F.lit(16)).cast("bigint"), F.pmod("l_orderkey", F.lit(16)).cast("bigint")
    own = R.table_stream(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("map_id"), r.alias("r"), c.alias("c"))
    return R.accumulate(own.where((F.col("r") - 7.5) * (F.col("r") - 7.5) + (F.col("c") - 7.5) * (F.col("c") - 7.5) <= 64), ["map_id", "r", "c"])


@query("x2_stream_windows")
def stream_windows(spark, sf_dir):
    """Hourly counts of events by type, with ten minutes for late ones; open windows at the end are not given out."""
    events = R.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.windowed_counts(events, "ts", "event_type", "1 hour", "10 minutes")
