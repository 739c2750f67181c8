"""Gapless numbers within classes, without one task per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one class are dealt over this many buckets, numbered apart and shifted by the counts before them.
BUCKETS = 64


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """Add `name`: 0, 1, 2 ... within each value of `keys`, without gaps.

    A class is numbered in `buckets` parts, so a class of any size is shared by that many tasks.
    Rows equal in `order` get neighbouring numbers in either order. `df` is read twice: hand in a written table.
    """
    b, before = f"_{name}_bucket", f"_{name}_before"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, b, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias(before))
    inner = Window.partitionBy(*keys, b).orderBy(*order)
    numbered = dealt.withColumn("_rn", F.row_number().over(inner) - 1)
    return numbered.join(starts, [*keys, b]).withColumn(name, (F.col("_rn") + F.col(before)).cast("long")).drop(b, before, "_rn")


def lexical(*columns: str) -> list[Column]:
    return [F.col(c) for c in columns]
