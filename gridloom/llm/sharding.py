"""Shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone; when one more shard is added, a row either
stays or moves into the new shard, and only about 1/(n+1) of the rows move.

Nulls and odd rows: a null key counts as the key -1; a null text has size 8 and the checksum of no bytes; repeated
rows each get a slot of their own; an empty table gives no rows; other columns are kept out of the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .ranking import number_within

#: Jump consistent hash (Lamping and Veach, 2014): the published multiplier of its generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_buckets(keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of each unsigned 64-bit key among `shards`, for all keys at once."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64, copy=True)
    bucket = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        bucket[live] = ahead[live]
        state[live] = state[live] * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((bucket[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key; keys are mixed by xxHash first, so runs of ids spread evenly."""

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(F.coalesce(key, F.lit(-1).cast("long"))))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(key).alias(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    placed = slim.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))
    numbered = number_within(materialize(placed, "shards"), ["shard"], [key, "text_crc32", "size"], "slot")
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write whole rows under `path`/shard=N."""
    docs.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=24)
