"""Sets of word shingles, their points of counts, and R-trees over the points that verify links within clusters.

A cluster is what some operator's candidates connect. Its sets are dealt into blocks of bounded size; each pair of blocks
is one task with two trees, boxes are met first, and the pairs that are left are verified on the sets themselves. Pairs
that are connected already are skipped, so a task returns links in proportion to its rows, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, byte_slices, materialize

GROUPS = 64
#: Points of a leaf, and boxes under one box.
LEAF, FAN = 32, 8
#: A cluster's block holds up to about so many shingles and members.
BLOCK_TOKENS, BLOCK_MEMBERS = 1 << 20, 4096
#: Pairs whose bounds are worked out at once.
AT_ONCE = 1 << 14

_POINT = np.uint64(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """A 64-bit hash of each run of `shingle` words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - shingle + 1, 1)
    out = np.full(n, min(len(words), shingle), np.uint64)
    for k in range(min(len(words), shingle)):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
    return out


def point_of(tokens: np.ndarray) -> np.ndarray:
    """Counts by group."""
    return np.bincount((mix(tokens * _POINT) >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32)


def distinct_shingles(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def digest_of(tokens: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(tokens.tobytes())


def points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, GROUPS)


def may_link(bound: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of at most `bound` is enough for sets with `total` tokens between them."""
    return (100 + percent) * bound >= percent * total


class Tree:
    """An R-tree, loaded at once: leaves of LEAF points sorted into tiles, boxes of FAN boxes above them."""

    def __init__(self, point: np.ndarray, n: np.ndarray):
        self.order = self._tiles(point, n)
        self.point, self.n = point[self.order], n[self.order]
        begin = np.arange(0, len(n), LEAF)
        self.low_n, self.high_n, self.high = [np.minimum.reduceat(self.n, begin)], [np.maximum.reduceat(self.n, begin)], [np.maximum.reduceat(self.point, begin, axis=0)]
        while len(self.low_n[-1]) > 1:
            begin = np.arange(0, len(self.low_n[-1]), FAN)
            self.low_n.append(np.minimum.reduceat(self.low_n[-1], begin))
            self.high_n.append(np.maximum.reduceat(self.high_n[-1], begin))
            self.high.append(np.maximum.reduceat(self.high[-1], begin, axis=0))

    @staticmethod
    def _tiles(point: np.ndarray, n: np.ndarray) -> np.ndarray:
        """An order in which neighbours are near: halves by size, then by the coordinate that varies most, down to leaves."""
        order, todo = np.arange(len(n)), [(0, len(n), 0)]
        while todo:
            begin, end, depth = todo.pop()
            if end - begin <= LEAF:
                continue
            own = order[begin:end]
            along = n[own] if depth == 0 else point[own, point[own].var(axis=0).argmax()]
            half = -(-(end - begin) // (2 * LEAF)) * LEAF
            order[begin:end] = own[np.argpartition(along, min(half, end - begin - 1))]
            todo += [(begin, begin + half, depth + 1), (begin + half, end, depth + 1)]
        return order

    def leaf(self, k: int) -> slice:
        return slice(k * LEAF, min((k + 1) * LEAF, len(self.n)))


def meeting_leaves(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of leaves whose boxes may hold a linked pair; of one tree, each pair once."""

    def fits(level: int, i: np.ndarray, j: np.ndarray, tree: Tree, other: Tree, other_level: int) -> np.ndarray:
        low = tree.low_n[level][i] + other.low_n[other_level][j]
        sizes = (100 * tree.high_n[level][i] >= percent * other.low_n[other_level][j]) & (100 * other.high_n[other_level][j] >= percent * tree.low_n[level][i])
        out = np.zeros(len(i), bool)
        on = np.flatnonzero(sizes)
        bound = np.minimum(tree.high[level][i[on]], other.high[other_level][j[on]]).sum(axis=1, dtype=np.int64)
        out[on] = may_link(bound, low[on], percent)
        return out

    todo = [(len(a.low_n) - 1, len(b.low_n) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        la, lb, i, j = todo.pop()
        keep = fits(la, i, j, a, b, lb)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == lb == 0:
            yield from zip(i.tolist(), j.tolist())
            continue
        down_a, down_b = la >= lb, lb >= la  # the higher side goes down; both, if level
        for at in range(0, len(i), AT_ONCE // (FAN * FAN)):
            x, y = i[at : at + AT_ONCE // (FAN * FAN)], j[at : at + AT_ONCE // (FAN * FAN)]
            if down_a:
                x, y = (x[:, None] * FAN + np.arange(FAN)).reshape(-1), np.repeat(y, FAN)
            if down_b:
                x, y = np.repeat(x, FAN), (y[:, None] * FAN + np.arange(FAN)).reshape(-1)
            there = (x < len(a.low_n[la - down_a])) & (y < len(b.low_n[lb - down_b]))
            if a is b:
                there &= x <= y
            todo.append((la - down_a, lb - down_b, x[there], y[there]))


def tree_links(sets: list[np.ndarray], point: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (positions) that connect what links between side 0 and side 1 connect; within the rows, if all are of one side."""
    n = np.array([len(s) for s in sets], np.int64)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sides = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [Tree(point[own], n[own]) for own in sides]
    a, b = trees[0], trees[-1]
    at_a, at_b = sides[0][a.order], sides[-1][b.order]
    links = []
    for i, j in meeting_leaves(a, b, percent):
        left, right = a.leaf(i), b.leaf(j)
        roots_left = np.array([find(x) for x in at_a[left].tolist()])
        roots_right = np.array([find(x) for x in at_b[right].tolist()])
        apart = roots_left[:, None] != roots_right[None, :]
        if not apart.any():
            continue
        bound = np.minimum(a.point[left][:, None, :], b.point[right][None, :, :]).sum(axis=2, dtype=np.int64)
        for x, y in np.argwhere(apart & may_link(bound, a.n[left][:, None] + b.n[right][None, :], percent)).tolist():
            p, q = int(at_a[left][x]), int(at_b[right][y])
            if find(p) == find(q):
                continue
            one, other = sets[p], sets[q]
            same = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
            if 100 * same >= percent * (len(one) + len(other) - same):
                links.append((p, q))
                root[find(q)] = find(p)
    return links


def verified_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes within written `clusters` (cluster, node): they connect what all linked pairs connect."""
    sized = clusters.join(nodes.select("node", "n", "row", "digest"), "node")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int")
    wanted = materialize(sized.join(sized.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").drop("n"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 0):
            found = [distinct_shingles(t.as_py(), shingle) for t in batch.column(0)]
            same = [digest_of(s) == d for s, d in zip(found, batch.column(1).to_pylist())]  # a hash of id and text may be shared
            columns = [*(batch.column(k) for k in range(2, 5)), pa.array([point_of(s).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "blocks", "node", "point", "tokens"]).filter(pa.array(same))

    few = wanted.count() * 96 <= BROADCAST_BYTES
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(wanted) if few else wanted, "row").select("text", "digest", "cluster", "blocks", "node")
    kept = joined.mapInArrow(sets, "cluster long, blocks int, node long, point binary, tokens binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = kept.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "point", "tokens")

    def link(part: pa.Table) -> pa.Table:
        part = part.sort_by([("node", "ascending")])
        node, side = part.column("node").to_numpy(), part.column("block").to_numpy()
        new = np.concatenate([[True], node[1:] != node[:-1]])  # repeated rows
        own = [np.frombuffer(t, np.uint64) for t, first in zip(part.column("tokens").to_pylist(), new) if first]
        node, side = node[new], side[new]
        paired = part.column("i")[0].as_py() == part.column("j")[0].as_py() or len(np.unique(side)) == 2
        found = np.array(tree_links(own, points(part.column("point"))[new], side, percent) if paired else [], np.int64).reshape(-1, 2)
        return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long")
