"""Streams of defects and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def accumulate(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key of all that a stream has now.

    Every micro-batch is counted apart and written under its own number, so a batch that is run again replaces itself;
    counts add up, and the sum over batches is the raster of everything seen.
    """
    spark = stream.sparkSession
    path, log = scratch_path(spark, "parts"), scratch_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts by window and kind, once the watermark has passed a window's end; later rows are dropped."""
    spark = stream.sparkSession
    path, log = scratch_path(spark, "windows"), scratch_path(spark, "stream")
    own = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"))
    flat = own.select(F.col("w.start").alias("window_start"), kind, "n")
    flat.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(path)
