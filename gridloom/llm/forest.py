"""Approximate nearest neighbours by a hash-prefix forest.

Every tree turns a vector into a long string of sign bits and keeps a block's strings in a sorted array. A query
descends to its longest matching prefix in each tree, then all trees ascend together, one bit at a time, until the
prefix ranges hold enough visits. The rows in these ranges are gathered, and they alone are scored, on the original
vectors.

Rows are dealt into blocks, each row into one; every query asks each block of its vector length and keeps its best of
all. Queries are dealt into blocks of a bounded number too, so a task's memory is bounded. How many visits are needed
depends on the data, so each block sets it for itself: the least share of its rows that finds TARGET_RECALL of the true
neighbours of SAMPLE_QUERIES of its rows. Vectors of different norms are lifted by one coordinate for hashing, so that
the largest inner product has the smallest angle.

Nulls and odd rows: a vector that is null, zero, or holds a null or non-finite component takes no part, nor does a null
id; vectors of different lengths have no inner product, so each length is searched apart; rows that repeat an id are
rows of their own, and a query leaves out its own row only. Ties in score go to the smaller id. With fewer candidates
than asked for, all are returned; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, table, task_count

TREES = 128
BITS = 32
SEED = 7
#: Components in a block of rows (rows x dimension), the least rows that make blocks for parallel work, and queries in a block.
BLOCK_COMPONENTS = 1 << 21
LEAST_BLOCK = 8192
BLOCK_QUERIES = 4096
#: The calibration in a block: rows asked, the recall aimed at, and the visits tried, as multiples of the rows.
SAMPLE_QUERIES = 64
TARGET_RECALL = 0.93
VISITS = (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.14, 0.2, 0.28, 0.4, 0.55, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 30.0, float(TREES))
#: Rows hashed at once.
SLICE = 1 << 12


def planes(dimension: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Hyperplanes (dimension + 1, trees * bits), the last row for the lifted coordinate."""
    return np.random.default_rng(seed).normal(size=(dimension + 1, trees * bits)).astype(np.float32)


def hash_strings(vectors: np.ndarray, normals: np.ndarray, largest: float | None, bits: int = BITS) -> np.ndarray:
    """(trees, rows) strings as numbers, first bit highest. largest: the norm to lift rows to; None for queries."""
    lift = np.zeros(len(vectors)) if largest is None else np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.float64)  # sums stay exact below 2**53
    out = []
    scale = largest or float(np.abs(vectors).max(initial=1.0))
    for at in range(0, len(vectors), SLICE):
        lifted = np.column_stack([vectors[at : at + SLICE], lift[at : at + SLICE]]) / scale
        signs = lifted.astype(np.float32) @ normals > 0
        out.append((signs.reshape(len(signs), -1, bits) @ weights).astype(np.uint64).T)
    return np.concatenate(out, axis=1) if out else np.zeros((normals.shape[1] // bits, 0), np.uint64)


@dataclass
class Forest:
    """The sorted arrays of one block."""

    strings: np.ndarray
    order: np.ndarray
    bits: int = BITS

    @classmethod
    def of(cls, vectors: np.ndarray, normals: np.ndarray, largest: float, bits: int = BITS) -> Forest:
        own = hash_strings(vectors, normals, largest, bits)
        order = np.argsort(own, axis=1, kind="stable")
        return cls(np.take_along_axis(own, order, axis=1), order.astype(np.int32), bits)

    def ranges(self, queries: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): where the rows that share the first `level` bits with each query begin and end."""
        free = (np.uint64(1) << (self.bits - level).astype(np.uint64)) - np.uint64(1)
        low, high = queries & ~free, queries | free
        begin = np.stack([np.searchsorted(s, q, "left") for s, q in zip(self.strings, low)])
        end = np.stack([np.searchsorted(s, q, "right") for s, q in zip(self.strings, high)])
        return begin, end

    def ascend(self, queries: np.ndarray, visits: float) -> tuple[np.ndarray, np.ndarray]:
        """The ranges at the deepest common level that holds `visits` rows over all trees (level 0, all rows, if none does).

        Ranges only grow on the way up, so the level is found by bisection rather than bit by bit. One level up would
        about double the visits, so only as many trees go up that level as are still needed, in their order.
        """
        n = queries.shape[1]
        low, high = np.zeros(n, np.int64), np.full(n, self.bits, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            begin, end = self.ranges(queries, mid)
            enough = (end - begin).sum(axis=0) >= visits
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        begin, end = self.ranges(queries, low)
        deep_begin, deep_end = self.ranges(queries, np.minimum(low + 1, self.bits))
        wide, narrow = end - begin, deep_end - deep_begin
        before = np.cumsum(wide - narrow, axis=0) - (wide - narrow)  # gained by the trees ahead
        up = narrow.sum(axis=0) + before < visits
        return np.where(up, begin, deep_begin), np.where(up, end, deep_end)

    def gather(self, begin: np.ndarray, end: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The rows in one query's ranges, each once, in order; `mark` (bool, one a row, all False) is left as it was."""
        for order, b, e in zip(self.order, begin, end):
            mark[order[b:e]] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        return found


def best_of(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, found: np.ndarray, query: np.ndarray, key: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best of the `found` rows for a query, its own row (key) left out."""
    found = found[keys[found] != key]
    own = np.einsum("ij,j->i", rows[found], query)
    if len(found) > k:
        edge = np.partition(own, len(own) - k)[len(own) - k]
        near = own >= edge
        found, own = found[near], own[near]
    order = np.lexsort((ids[found], -own))[:k]
    return found[order], own[order]


def calibrate(forest: Forest, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int, normals: np.ndarray, target: float = TARGET_RECALL) -> float:
    """The least of VISITS whose recall for a sample of the block's own rows reaches `target`."""
    asked = np.arange(len(rows))[:: max(1, len(rows) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    every = np.arange(len(rows))
    truth = [set(best_of(rows, ids, keys, every, rows[i], keys[i], k)[0].tolist()) for i in asked]
    total = sum(map(len, truth))
    strings = hash_strings(rows[asked], normals, None)
    mark = np.zeros(len(rows), bool)

    def recall(visits: float) -> bool:
        begin, end = forest.ascend(strings, visits * len(rows))
        return sum(len(own & set(forest.gather(begin[:, j], end[:, j], mark).tolist())) for j, own in enumerate(truth)) >= target * total

    low, high = 0, len(VISITS) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(VISITS[mid]) else (mid + 1, high)
    return VISITS[low]


def nearest(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, queries: np.ndarray, query_keys: np.ndarray, k: int, visits: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query in turn, in one block: its position, rows' positions and scores of its k best candidates; and the candidates of all."""
    normals = planes(rows.shape[1])
    largest = float(np.sqrt((rows**2).sum(axis=1).max(initial=0.0))) or 1.0
    forest = Forest.of(rows, normals, largest)
    if visits is None:
        visits = calibrate(forest, rows, ids, keys, k, normals)
    mark = np.zeros(len(rows), bool)
    out: list[tuple] = []
    scored = 0
    for at in range(0, len(queries), SLICE):
        begin, end = forest.ascend(hash_strings(queries[at : at + SLICE], normals, None), visits * len(rows))
        for i in range(begin.shape[1]):
            found = forest.gather(begin[:, i], end[:, i], mark)
            scored += len(found)
            best, score = best_of(rows, ids, keys, found, queries[at + i], query_keys[at + i], k)
            out.append((np.full(len(best), at + i), best, score))
    join = lambda j, kind: np.concatenate([x[j] for x in out]) if out else np.zeros(0, kind)
    return join(0, np.int64), join(1, np.int64), join(2, np.float64), scored


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    own = column.combine_chunks()
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def search(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows where `is_query` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    own = materialize(own.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("d"), "v"), "vectors")
    # how many blocks of rows and of queries each vector length takes
    counts = own.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    by_memory = F.ceil(F.col("n") * F.col("d") / BLOCK_COMPONENTS)
    for_tasks = F.least(F.lit(task_count(spark)), F.ceil(F.col("n") / LEAST_BLOCK))
    grid = materialize(counts.where("q > 0").select("d", F.greatest(by_memory, for_tasks).cast("int").alias("blocks"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("query_blocks")), "grid")
    few = grid.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    dealt = own.join(F.broadcast(grid) if few else grid, "d")
    block = F.pmod(F.xxhash64("row"), "blocks").cast("int")
    query_block = F.pmod(F.xxhash64("row", F.lit(1)), "query_blocks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = dealt.select("d", block.alias("block"), every("query_blocks").alias("query_block"), F.lit(False).alias("asks"), "row", "vec_id", "v")
    asked = dealt.where(is_query).select("d", every("blocks").alias("block"), query_block.alias("query_block"), F.lit(True).alias("asks"), "row", "vec_id", "v")

    def run(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy()
        keys, ids, values = part.column("row").to_numpy(), part.column("vec_id").to_numpy(), _matrix(part.column("v"), part.column("d")[0].as_py())
        order = np.argsort(keys, kind="stable")
        held, asking = order[~asks[order]], order[asks[order]]
        q, r, s, _ = nearest(values[held], ids[held], keys[held], values[asking], keys[asking], k) if len(held) and len(asking) else (np.zeros(0, np.int64),) * 4
        return pa.table({"row": keys[asking[q]], "query_id": ids[asking[q]], "vec_id": ids[held[r]], "score": s.astype(np.float64)})

    found = rows.unionByName(asked).groupBy("d", "block", "query_block").applyInArrow(run, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
