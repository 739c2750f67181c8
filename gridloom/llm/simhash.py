"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: a bit is 1 if it is set in over half of the hashes of a text's word shingles. Two fingerprints link at
`distance` or fewer differing bits. Bits are split into partitions, correlated bits together; a dynamic programme gives
every partition its own threshold (-1: not probed) from estimated candidate counts, such that any linked pair must be
within the threshold of at least one partition. A threshold of t is probed by exact keys that leave out each choice of
t bits, so every probe is an equi-join. Candidates are verified on the whole fingerprint.

Buckets of up to `PAIRED` fingerprints are compared pairwise. Larger ones are not: two fingerprints at distance 2 or
less share a point at distance 1 or less from both, so every member goes to those points and links to the least
fingerprint there. That is exact, linear in the bucket, and no point gathers over 65 fingerprints.

Nulls and odd rows: a null text has no words and the fingerprint 0, which links like any other; fewer words than a
shingle make one shingle; repeated rows share a component; a null id gets its component, but is never the smallest; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, materialize, table
from .components import components

BITS = 64
#: Buckets up to this size are compared pairwise, larger ones through meeting points.
PAIRED = 64
#: Shingle hashes whose bits are counted at once.
SLICE = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit number, of unsigned 64-bit shingle hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        own = hashes[at : at + SLICE].astype(">u8")
        counts += np.unpackbits(own.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        pieces, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        pieces = map(b" ".join, zip(*(words[k : k + n] for k in range(shingle))))
    return majority(np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint of each whole text, ASCII letters lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            fps = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{key} long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each pair of bits is set together (the diagonal: each bit), over all fingerprints."""
    upper = np.triu_indices(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            own = batch.column(0).to_numpy().astype(">i8")
            for at in range(0, len(own), SLICE):
                bits = np.unpackbits(own[at : at + SLICE].view(np.uint8)).reshape(-1, BITS).astype(np.float32)
                total += bits.T @ bits
            n += len(own)
        if n:
            i, j = (np.append(x, -1).astype(np.int32) for x in upper)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.append(total[upper], n).astype(np.int64))], ["i", "j", "n"])

    counted = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    together, rows = np.zeros((BITS, BITS)), 0
    for r in counted.collect():  # 2,081 rows at any size
        if r["i"] < 0:
            rows = r["n"]
        else:
            together[r["i"], r["j"]] = together[r["j"], r["i"]] = r["n"]
    return rows, together


def split_bits(rows: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the bits (0: highest), correlated bits in one partition, sizes at most one apart.

    Each partition starts from the free bit of highest entropy and takes the free bits most correlated with it so far.
    """
    p = np.diag(together) / max(rows, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(together / max(rows, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [max(sorted(free), key=lambda b: sd[b])]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: correlation[b, own].mean())
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int] | tuple[int, ...]) -> int:
    """The signed long whose given bits (0: highest) are set."""
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def same_key_pairs(fps: DataFrame, masks: list[int]) -> list[float]:
    """For each mask, the number of pairs of fingerprints that agree on its bits."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
    sizes = fps.select(keys.alias("x")).groupBy("x.k", "x.key").agg(F.count("*").alias("n"))
    pairs = sizes.groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    found = {r["k"]: r["pairs"] for r in pairs.collect()}  # a row for each mask
    return [found.get(k, 0.0) for k in range(len(masks))]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one for each partition, that sum to distance - partitions + 1.

    costs[i][t + 1] is the cost of probing partition i at threshold t; -1 is free and probes nothing.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in enumerate(own, -1):
                now = (cost + c, [*chosen, t])
                if total + t not in step or now < step[total + t]:
                    step[total + t] = now
        best = step
    return best[distance - len(costs) + 1]


def choose_masks(fps: DataFrame, distance: int, parts: tuple[int, ...] = (2, 3, 4), row_cost: float = 8.0) -> list[int]:
    """The key masks to probe: the cheapest thresholds of the cheapest number of partitions.

    The estimate at threshold 0 is the exact number of pairs that agree on a partition, over all fingerprints. At t it
    is scaled by the odds that t of its bits differ, taken from how often each bit is set. `row_cost` is the cost of a
    probed row against that of a candidate pair.
    """
    rows, together = bit_statistics(fps)
    p = np.diag(together) / max(rows, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1 - 1e-9)
    odds = (1 - agree) / agree
    splits = [split_bits(rows, together, m) for m in parts if m <= distance + 2]
    flat = [bits for split in splits for bits in split]
    pairs = dict(zip((tuple(b) for b in flat), same_key_pairs(fps, [mask_of(b) for b in flat])))
    plans = []
    for split in splits:
        costs = []
        for bits in split:
            own, ways, extra = [0.0], 1.0, 1.0
            for t in range(distance + 1):
                if t:
                    ways *= (len(bits) - t + 1) / t
                    extra += float(np.sum(odds[bits]) ** t)
                own.append(pairs[tuple(bits)] * extra + row_cost * rows * ways)
            costs.append(own)
        cost, thresholds = allocate(costs, distance)
        plans.append((cost, len(split), split, thresholds))
    _, _, split, thresholds = min(plans)
    masks = []
    for bits, t in zip(split, thresholds):
        if t >= 0:
            masks += [mask_of([b for b in bits if b not in out]) for out in combinations(bits, t)]
    return masks


def _free_flips(masks: list[int]) -> Column:
    """For the column `k` of a mask: the single-bit values outside the mask, and 0."""
    choices = [F.array(*[F.lit(mask_of([b])) for b in range(BITS) if not m & mask_of([b])], F.lit(0).cast("long")) for m in masks]
    return F.element_at(F.array(*choices), F.col("k") + 1)


def links_within(fps: DataFrame, distance: int, masks: list[int] | None = None, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) of distinct fingerprints: every linked pair is joined by a chain of them, and each of them holds.

    `fps` (fp) has no repeated rows and is read several times: hand in a written table. Distances over 2 have no
    meeting points, so there every bucket is compared pairwise.
    """
    masks = masks if masks is not None else choose_masks(fps, distance)
    probes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
    keyed = fps.select("fp", probes.alias("x")).select("x.k", "x.key", "fp")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes, ["k", "key"]), "probes")
    small = met if distance > 2 else met.where(F.col("n") <= paired)
    left, right = small.select("k", "key", F.col("fp").alias("a")), small.select("k", "key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    links = left.join(right, ["k", "key"]).where(near).select("a", "b")
    if distance > 2:
        return links
    if distance == 2:
        flips = _free_flips(masks)
    else:  # at distance 1 the smaller of the two values at a bit is the meeting point; at 0 no two differ
        return met.select("k", "key", F.col("fp").alias("a")).join(met.select("k", "key", F.col("fp").alias("b")), ["k", "key"]).where(near).select("a", "b")
    points = met.where(F.col("n") > paired).select("k", "fp", F.explode(flips).alias("flip")).select("k", (F.col("fp").bitwiseXOR(F.col("flip"))).alias("point"), "fp")
    least = points.groupBy("k", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = points.join(least, ["k", "point"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return links.unionByName(starred)


def link_documents(prints: DataFrame, distance: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) for written `prints` (key, fp): the smallest key reachable over links."""
    fps = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "fps")
    roots = components(links_within(fps.select("fp"), distance))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(key, "fp", "component_id")


def op9_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(table(spark, sf_dir, "documents"), shingle=3), "prints")
    linked = link_documents(prints, distance=2)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
