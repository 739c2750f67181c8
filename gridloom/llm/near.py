"""Near-duplicate documents by long SimHash fingerprints and the generalised pigeonhole principle.

At a Jaccard similarity of 0.8 two texts differ in some 15 % of their fingerprint bits, far beyond what 64 bits can be
split for. So a fingerprint has WORDS words of 64 bits here. Each word's correlated bits are grouped into partitions,
and a dynamic programme gives every partition a threshold of its own (-1: not probed) from estimated candidate counts:
the cheapest thresholds at which a pair of the asked similarity is within the threshold of some partition with
probability RECALL. A threshold of t is probed by exact keys that leave out each choice of t bits. Candidates are
checked on another word first and then on the whole fingerprint, whose distance tells the similarity to about 0.02; a
pair may be up to TOLERANCE below the asked similarity there. What these pairs connect is a cluster, and in each cluster
the sets of shingles themselves decide: texts are read once more, and the exact Jaccard similarity of the asked size or
more makes a link.

Equal fingerprints are one node: fingerprints are those of sets, each shingle counted once. Keys that up to PAIRED nodes
share are compared pairwise. Larger buckets, as made by groups of many near copies, are handed on as (least node, member):
a group's many buckets have few least nodes, so a member is sent a few times, not once for each probe. The members of one
least node are dealt into blocks, each pair of blocks is one task, and it returns links in proportion to its rows, never
all pairs.

Nulls and odd rows: a null text has no words, and texts without words are copies of each other; fewer words than a
shingle make one shingle; rows with the same id and the same text count once; different texts under one id are
documents of their own; rows without an id cannot be named as anyone's copies and stay; an empty table gives no rows;
other columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, byte_slices, materialize
from .components import components
from .sets import digest_of, distinct_shingles, mix, verified_links
from .simhash import mask_of, split_bits

BITS = 64
WORDS = 32
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.96
TOLERANCE = 0.04
#: Thresholds tried, partitions of a word tried, and the cost of a probed row against that of a candidate pair.
THRESHOLDS = (0, 1, 2)
PARTS = (2, 3, 4)
ROW_COST = 8.0
#: Buckets up to this size are compared pairwise; of larger ones one row a member goes on, so rows stay in proportion to the input.
PAIRED = 8
#: Members of a block; two blocks are compared by a matrix of distances.
BLOCK = 2048
#: Standard deviations that the word checked first may be beyond the expected distance.
FIRST_CHECK = 3.5
#: Shingle hashes counted at once.
SLICE = 1 << 13

_ODD = np.random.default_rng(11).integers(1, 1 << 63, size=(WORDS, 1), dtype=np.uint64) | np.uint64(1)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """(rows, 64): how often each bit (0: highest) is set in each row of 64-bit numbers, by carry-save addition of whole columns."""
    total, weight = np.zeros((len(words), BITS), np.int64), 1
    while True:
        carries = []
        while (third := words.shape[1] // 3) > 0:
            a, b, c = words[:, :third], words[:, third : 2 * third], words[:, 2 * third : 3 * third]
            odd = a ^ b
            carries.append((a & b) | (c & odd))
            words = np.concatenate([odd ^ c, words[:, 3 * third :]], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(words).astype(">u8").view(np.uint8).reshape(len(words), -1, 8), axis=2)
        total += weight * bits.reshape(len(words), -1, BITS).sum(axis=1, dtype=np.int64)
        if not carries:
            return total
        words, weight = np.concatenate(carries, axis=1), 2 * weight


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits: a bit is 1 if it is set in over half of the shingles' hashes for that word."""
    counts = np.zeros((WORDS, BITS), np.int64)
    for at in range(0, len(hashes), SLICE):
        counts += bit_counts(mix(hashes[None, at : at + SLICE] * _ODD))
    return np.packbits(counts * 2 > len(hashes), axis=1).view(">u8").astype(np.uint64).reshape(-1)


def long_prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, content (hash of the text), row (hash of both), n, digest of the set, node (hash of the fingerprint), fp of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in byte_slices(batches, 3):
            sets = [distinct_shingles(t.as_py(), shingle) for t in batch.column(3)]
            fps = [long_fingerprint(own).tobytes() for own in sets]
            nodes = np.fromiter(map(xxh3_64_intdigest, fps), np.uint64, len(fps)).view(np.int64)
            columns = [*(batch.column(k) for k in range(3)), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(digest_of, sets)), pa.binary()), pa.array(nodes), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "row", "n", "digest", "node", "fp"])

    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, content long, row long, n long, digest binary, node long, fp binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def word_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Nodes, and for each word how often each pair of its bits is set together, over all nodes."""
    upper = np.triu_indices(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((WORDS, BITS, BITS)), 0
        for batch in batches:
            own = _matrix(batch.column(0))
            for w in range(WORDS):
                bits = np.unpackbits(own[:, w].astype(">u8").view(np.uint8)).reshape(-1, BITS).astype(np.float32)
                total[w] += bits.T @ bits
            n += len(own)
        if n:
            flat = total[:, upper[0], upper[1]].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat)), pa.int32()), pa.array(np.concatenate([[n], flat]).astype(np.int64))], ["at", "n"])

    counted = nodes.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    flat, rows = np.zeros(WORDS * len(upper[0])), 0
    for r in counted.collect():  # WORDS * 2,080 + 1 rows at any size
        if r["at"] < 0:
            rows = r["n"]
        else:
            flat[r["at"]] = r["n"]
    together = np.zeros((WORDS, BITS, BITS))
    together[:, upper[0], upper[1]] = flat.reshape(WORDS, -1)
    return rows, np.maximum(together, together.transpose(0, 2, 1))


def differing(similarity: float) -> float:
    """The share of fingerprint bits that differ at a Jaccard similarity, for texts of equal length."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def within(bits: int, threshold: int, share: float) -> float:
    """The probability that at most `threshold` of `bits` bits differ."""
    return sum(math.comb(bits, t) * share**t * (1 - share) ** (bits - t) for t in range(threshold + 1))


def allocate_for_recall(parts: list[tuple[list[float], list[float]]], miss: float, steps: int = 400) -> tuple[float, float, list[int]]:
    """Cost, missed share, and a threshold index (-1: none) for each part, the cheapest whose missed share is `miss` or less.

    parts[i] has the cost and the chance of a hit at each threshold. If `miss` is out of reach, the least missed share.
    """
    unit = -math.log(miss) / steps
    best: list[tuple[float, list[int]] | None] = [None] * (steps + 1)
    best[0] = (0.0, [])
    for costs, chances in parts:
        gains = [int(-math.log(max(1 - c, 1e-300)) / unit) for c in chances]  # rounded down, so the bound holds
        step: list[tuple[float, list[int]] | None] = [x and (x[0], [*x[1], -1]) for x in best]
        for at, held in enumerate(best):
            if held:
                for k, (cost, gain) in enumerate(zip(costs, gains)):
                    to = min(steps, at + gain)
                    if step[to] is None or held[0] + cost < step[to][0]:
                        step[to] = (held[0] + cost, [*held[1], k])
        best = step
    top = max(k for k, x in enumerate(best) if x)
    cost, chosen = best[top]
    missed = math.prod(1 - parts[i][1][k] for i, k in enumerate(chosen) if k >= 0)
    return cost, missed, chosen


def choose_probes(rows: int, together: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(word, mask) of every probe: the cheapest thresholds, of the cheapest number of partitions, that reach RECALL."""
    share = differing(similarity)
    p = together.diagonal(axis1=1, axis2=2) / max(rows, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1 - 1e-9)
    plans = []
    for m in PARTS:
        split = [(w, bits) for w in range(WORDS) for bits in split_bits(rows, together[w], m)]
        parts = []
        for w, bits in split:
            same, odds = float(np.prod(agree[w, bits])), float(np.sum((1 - agree[w, bits]) / agree[w, bits]))
            near, costs = 1.0, []
            for t in THRESHOLDS:
                near += odds**t / math.factorial(t) if t else 0.0
                ways = math.comb(len(bits), t)
                costs.append(ROW_COST * rows * ways + rows * (rows - 1) / 2 * min(1.0, same * near) * max(1.0, ways / near))
            parts.append((costs, [within(len(bits), t, share) for t in THRESHOLDS]))
        cost, missed, chosen = allocate_for_recall(parts, 1 - RECALL)
        plans.append((max(missed, 1 - RECALL), cost, m, [(split[i], THRESHOLDS[k]) for i, k in enumerate(chosen) if k >= 0]))
    *_, chosen = min(plans)
    return [(w, mask_of([b for b in bits if b not in out])) for (w, bits), t in chosen for out in combinations(bits, t)]


def distance_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def dense_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first position, position) for all rows that links within distance `most` join, by one product of sign matrices."""
    signs = np.unpackbits(fps.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    least = signs.shape[1] - 2 * most  # the product at that distance
    near = np.empty((len(fps), len(fps)), bool)
    for at in range(0, len(fps), 512):
        near[at : at + 512] = signs[at : at + 512] @ signs.T >= least
    free = np.ones(len(fps), bool)
    links = []
    for head in range(len(fps)):
        if not free[head]:
            continue
        free[head] = False
        edge = np.array([head])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & free)
            free[edge] = False
            links += [(head, x) for x in edge.tolist()]
    return links


def _bucket_pairs(keys: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by key: positions of pairs to verify in small buckets, positions of the rows of large ones, and the first row of each of those rows' buckets."""
    n = len(keys)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    end = np.repeat(begin + size, size)
    large = np.repeat(size > PAIRED, size)
    left, right = [], []
    at = np.flatnonzero(~large)
    step = 1
    while len(at := at[at + step < end[at]]):
        near = np.bitwise_count(first[at] ^ first[at + step]) <= most
        left.append(at[near])
        right.append(at[near] + step)
        step += 1
    join = lambda own: np.concatenate(own) if own else np.zeros(0, np.int64)
    return join(left), join(right), np.flatnonzero(large), np.repeat(begin, size)[large]


def near_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of written `nodes` (node, fp), one row a fingerprint, that are at `similarity` or more."""
    rows, together = word_statistics(nodes)
    probes = choose_probes(rows, together, similarity) if rows > 1 else []
    most = int(differing(similarity - TOLERANCE) * WORDS * BITS)
    share = differing(similarity)
    first_most = int(BITS * share + FIRST_CHECK * math.sqrt(BITS * share * (1 - share)))
    words = np.array([w for w, _ in probes], np.int64)
    masks = np.array([m for _, m in probes], np.int64).view(np.uint64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "node", "first"]
        salts = mix(np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            nodes, fps = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for at in range(0, len(nodes), 512):
                own = fps[at : at + 512]
                bucket = mix((own[:, words] & masks) ^ salts)  # 64 bits for the probe and its key together
                first = own[:, (words + 1) % WORDS]
                parts = [bucket.reshape(-1).view(np.int64), np.repeat(nodes[at : at + 512], len(words)), first.reshape(-1).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # batches since the begin of the last bucket

        def send(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            keys, nodes, first = (np.concatenate(x) for x in zip(*parts))
            left, right, large, begin = _bucket_pairs(keys, first.view(np.uint64), first_most)
            a = np.concatenate([np.minimum(nodes[left], nodes[right]), nodes[begin]])  # nodes of a bucket are in order
            b = np.concatenate([np.maximum(nodes[left], nodes[right]), nodes[large]])
            pair = np.arange(len(a)) < len(left)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(pair)], ["a", "b", "pair"])

        for batch in batches:
            own = [batch.column(k).to_numpy() for k in range(3)]
            if not len(own[0]):
                continue
            last = int(np.searchsorted(own[0], own[0][-1], "left"))  # the last bucket may go on
            if last or held and held[0][0][0] != own[0][0]:
                held.append([x[:last] for x in own])
                yield from send(held)
                held = []
            held.append([x[last:] for x in own])
        if held:
            yield from send(held)

    keyed = nodes.select("node", "fp").mapInArrow(probe, "bucket long, node long, first long")
    met = keyed.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(meet, "a long, b long, pair boolean")
    met = materialize(met.distinct(), "met")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = distance_of(_matrix(batch.column(2)), _matrix(batch.column(3))) <= most
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    def compare(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("node").to_numpy(), kind="stable")
        nodes, fps = part.column("node").to_numpy()[order], _matrix(part.column("fp"))[order]
        links = np.array(dense_links(fps, most), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[links[:, 0]], "b": nodes[links[:, 1]]})

    named = lambda n, fp: nodes.select(F.col("node").alias(n), F.col("fp").alias(fp))
    small = met.where("pair").join(named("a", "fa"), "a").join(named("b", "fb"), "b").select("a", "b", "fa", "fb").mapInArrow(verify, "a long, b long")
    members = met.where("NOT pair").select(F.col("a").alias("least"), F.col("b").alias("node"))
    sized = members.groupBy("least").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sized, "least").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(nodes.select("node", "fp"), "node").select("least", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "fp")
    return small.unionByName(dealt.groupBy("least", "i", "j").applyInArrow(compare, "a long, b long"))


def clusters_of(links: DataFrame) -> DataFrame:
    """cluster, node of all nodes that links connect."""
    found = components(links).select(F.col("root").alias("cluster"), "node")
    return found.unionByName(found.select("cluster", F.col("cluster").alias("node")).distinct())


def near_groups(docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, content, root of written `prints` of `docs`: rows of one root are linked, directly or through others."""
    first = [F.first(c).alias(c) for c in ("fp", "row", "n", "digest")]
    nodes = materialize(prints.groupBy("node").agg(*first), "nodes")
    clusters = materialize(clusters_of(near_links(nodes.select("node", "fp"), similarity)), "clusters")
    links = verified_links(docs, nodes, clusters, shingle, round(100 * similarity))
    return prints.select("doc_id", "content", "node").join(components(links), "node", "left").select("doc_id", "content", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of each group of near copies, with their own columns."""
    prints = materialize(long_prints(docs, shingle), "prints")
    groups = materialize(near_groups(docs, prints, shingle, similarity).groupBy("doc_id", "content", "root").agg(F.count("*").alias("n")), "groups")
    least = groups.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("kept"))
    joined = groups.join(least, "root").withColumn("stays", F.struct("doc_id", "content") == F.col("kept"))
    odd = materialize(joined.where("NOT stays OR n > 1").select("doc_id", F.col("content").alias("_content"), "stays"), "odd")
    few = odd.count() * 32 <= BROADCAST_BYTES  # two longs and a flag, with what a hash table adds
    side = F.broadcast if few else lambda df: df.hint("merge")
    own = docs.withColumn("_content", F.xxhash64("text"))
    rest = own.join(side(odd.drop("stays")), ["doc_id", "_content"], "left_anti")
    repeated = own.join(side(odd.where("stays").drop("stays")), ["doc_id", "_content"], "left_semi").dropDuplicates(["doc_id", "_content"])
    return rest.unionByName(repeated).select(*docs.columns)
