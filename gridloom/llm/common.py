"""What the corpus operators share: scratch tables, words, and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Tables up to this many rows may be broadcast; past it, a shuffled join is used.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 16 << 20
#: Rows and bytes of texts that a Python function works on at once.
TEXT_ROWS = 1000
TEXT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Unset, a new local one in local mode, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            current = spark.sparkContext.getCheckpointDir()
        folder = current
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Of what is built and run inside, Spark deletes the shuffle files as soon as a run ends; the session's own setting comes back after.

    For results that are written or fetched once. Waiting for the driver to collect its garbage leaves the files of several large shuffles on disk together.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors, prunes columns. Its shuffle files are deleted then."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches of a mapInArrow function in slices of at most TEXT_ROWS rows and, past one row, TEXT_BYTES bytes of column `text`."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        filled, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            before = int(filled[begin] - sizes[begin])
            end = min(begin + TEXT_ROWS, max(begin + 1, int(np.searchsorted(filled, before + TEXT_BYTES, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only when the counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def broadcast_if_small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast hint only when the counted rows are within BROADCAST_ROWS and the added `size` within BROADCAST_BYTES."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if row["n"] <= BROADCAST_ROWS and row["bytes"] <= BROADCAST_BYTES else df


def task_count(spark: SparkSession) -> int:
    """Partitions for an explicit deal: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
