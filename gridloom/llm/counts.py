"""Jaccard join of documents by count vectors in R-trees.

A document is the set of its word shingles, and two documents link when their sets' Jaccard similarity is at least a
percentage. Tokens are hashed into GROUPS groups; a set's counts by group are a point, and the sum of two points' smaller
coordinates bounds the overlap of their sets from above. R-trees over the points find the pairs whose bound is high
enough, boxes against boxes first, and each such pair is verified on the sets themselves.

No tree over all points can be in one task, and boxes of unrelated texts overlap in nearly every coordinate, so points
are first dealt into cells. Within a band of sizes a linked pair differs in at most d tokens. Hashed into d + k groups,
two such sets have k groups or more in common whose contents are the same, and the hash of a group's content is the key
of a cell. Groups of one token or none tell little: a set that has fewer than k of them leaves them out, and one that
has more pairs each of them with the groups of a second hashing.

Cells of two or three members are pairs that the bound decides at once. Larger cells hang all members on the least one.
What these candidates connect is one cluster, dealt into blocks of bounded size. Each pair of blocks is one task with two
trees; pairs that are connected already are skipped, so a task returns links in proportion to its rows, never all pairs.

Nulls and odd rows: a null or empty text has no shingles and links with nothing, not even with another empty one; fewer
words than a shingle make one shingle; rows with equal sets are one node; a row without an id gets its component, but is
never the smallest; an empty table gives no rows; other columns are left out. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, byte_slices, materialize, table
from .components import components
from .sets import digest_of, distinct_shingles, may_link, mix, point_of, points, verified_links

SHINGLE = 3
PERCENT = 90
#: Groups of up to this many tokens make no key of their own.
WEAK = 1
#: A size band spans this many steps of the similarity.
STEPS = 3

_A, _B, _C, _D = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB))


def difference(total: int, percent: int) -> int:
    """How many tokens two linked sets with `total` tokens between them can differ in."""
    return total * (100 - percent) // (100 + percent)


class Bands:
    """Size bands: linked sets are in one band, or in neighbouring ones with the larger near its band's start."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def upto(self, n: int) -> None:
        while self.starts[-1] <= n:
            end = self.starts[-1]
            for _ in range(STEPS):
                end = max(end + 1, -(-end * 100 // self.percent))
            self.starts.append(end)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, most differing tokens) of every band in which a set of n tokens looks for partners."""
        self.upto(n)
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        found = []
        for band in (own, own - 1):
            if band < 0:
                continue
            last = self.starts[band + 1] - 1  # the largest smaller partner of a pair in this band
            if band == own or n * self.percent <= 100 * last:
                found.append((band, difference(last + 100 * last // self.percent, self.percent)))
        return found


def _hashed_groups(tokens: np.ndarray, odd: np.uint64, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature of the contents, count) of each group of tokens."""
    own = (((mix(tokens * odd) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=groups)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens * _D)[order], dtype=np.uint64)])
    ends = np.cumsum(count)
    return sums[ends] - sums[ends - count], count


def cell_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys of all cells of a set: two linked, different sets share one at least."""
    found = [np.zeros(0, np.uint64)]
    for band, differ in bands.of(len(tokens)):
        if not differ:
            continue  # only equal sets link
        spare = 2 + differ // 30
        signature, count = _hashed_groups(tokens, _A, differ + spare)
        place = np.full(len(count), band + 1, np.uint64) * _B + np.arange(len(count), dtype=np.uint64) * _C
        keys = mix(mix(signature + place) + place)
        weak = count <= WEAK
        found.append(keys[~weak])
        if weak.sum() >= spare:
            second, _ = _hashed_groups(tokens, _C, differ + 1)
            again = mix(second + np.arange(len(second), dtype=np.uint64) * _B)
            found.append(mix((keys[weak][:, None] ^ again[None, :]) * _A).reshape(-1))
    return np.concatenate(found)


def set_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, row (hash of id and text), n, digest of the set, keys, point of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in byte_slices(batches, 2):
            sets = [distinct_shingles(t.as_py(), shingle) for t in batch.column(2)]
            keys = [cell_keys(s, bands) if len(s) else s for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(digest_of, sets)), pa.binary()), lists, pa.array([point_of(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "digest", "keys", "point"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, row long, n long, digest binary, keys array<long>, point binary")


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of written `nodes` (node, n, keys, point): what they connect holds every linked pair."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sums = [F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor("node").alias("x")]
    cells = materialize(keyed.groupBy("key").agg(*sums).where("n > 1"), "cells")
    third = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    two = cells.where("n = 2 OR n = 3").select("a", "b")
    three = cells.where("n = 3").select("a", third.alias("c"), "b")
    pairs = two.unionByName(three.select("a", F.col("c").alias("b"))).unionByName(three.select(F.col("c").alias("a"), "b")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("point").alias(f"p{k}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            least = np.minimum(points(batch.column(4)), points(batch.column(5))).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(may_link(least, total, percent)))

    near = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(bound, "a long, b long")
    large = cells.where("n > 3").select("key", "a")
    few = large.count() * 32 <= BROADCAST_BYTES
    stars = keyed.join(F.broadcast(large) if few else large, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    return materialize(near.unionByName(stars), "candidates")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links."""
    rows = materialize(set_rows(docs, shingle, percent), "sets")
    first = [F.first(c).alias(c) for c in ("row", "n", "keys", "point")]
    grouped = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *first)
    nodes = materialize(grouped.withColumn("node", F.coalesce("doc_id", F.xxhash64("digest"))), "nodes")
    # Different sets may share their smallest id; all but one of them are named by their digest.
    shared = nodes.groupBy("node").agg(F.count("*").alias("sets")).where("sets > 1").select("node")
    if shared.limit(1).count():
        nodes = materialize(nodes.join(shared.withColumn("shared", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("digest")).otherwise(F.col("node"))).drop("shared"), "nodes")
    edges = candidates(nodes, percent)
    found = components(edges)
    clusters = materialize(found.select(F.col("root").alias("cluster"), "node").unionByName(found.select(F.col("root").alias("cluster"), F.col("root").alias("node")).distinct()), "clusters")
    links = materialize(verified_links(docs, nodes, clusters, shingle, percent), "links")
    rooted = nodes.select("digest", "doc_id", "node").join(components(links), "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = rooted.join(smallest, "root").select("digest", "component_id")
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    linked = own.where("n_shingles > 0").join(of_set, "digest").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
