"""Collocations by broadcast double-array tries.

Words and phrases are counted for each language. A phrase can be frequent only if its words and the phrases inside it
are, so candidates are found level by level: frequent words; pairs of frequent words whose hash is tallied often enough;
triples of two such pairs, tallied likewise. Each level's frequent hashes reach the tasks as one bitmap of fixed size,
which may let some more through but never loses one. The candidates then stand in double-array tries of at most
`phrases` each. For every trie the words are read once: all positions of a batch walk it together, one word further at
each level, states that end a candidate are counted by bincount, and Spark sums the tasks' counts. Those counts are the
result; tallies of hashes only choose candidates.

Texts are split once. Each slice of texts is then written as numbers into its own list of words, and every later pass
reads these in place of texts. Words are known by a 64-bit hash of language and word. That no two words of the corpus share one is checked as they are
counted; if two do, the next seed is taken.

Nulls and odd rows: a null text is empty, a null language is `und`; ids are not looked at, so repeated rows count each;
texts of any length count whole; ties are ordered by phrase; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tries
from .common import broadcast_if_small, byte_slices, materialize, shuffles_removed, table

LEAST = 10
INSIDE = 50
TOP = 2000
SCALE = 1_000_000
#: Phrases of one trie; a corpus with more candidates is read once for each trie.
PHRASES = 1 << 18
#: Bits of the bitmaps that tell frequent hashes.
BITMAP_BITS = 27
#: Positions tallied, and words known, before a task hands its tallies on and starts anew.
TALLIED = 1 << 20
KNOWN = 1 << 18

#: Passes that a level's tallies are made in, each over its share of the hashes: only one share's shuffle is on disk at a time.
SHARES = 3

#: Bytes of a row group of split texts: what a reading task holds at once.
ROW_GROUP = 8 << 20

#: Pieces end at these characters; words at blanks and tabs.
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Odd multipliers that tell first, second and third words apart.
_FIRST, _SECOND, _THIRD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two words in order."""
    x = a.view(np.uint64) * _FIRST ^ b.view(np.uint64) * _SECOND
    x = (x ^ (x >> np.uint64(32))) * _THIRD
    return (x ^ (x >> np.uint64(29))).view(np.int64)


class _Ids(dict):
    """Word bytes -> number, for one language."""

    def __init__(self, lang: bytes, lexicon: Lexicon):
        super().__init__({b"\n": 0})
        self.lang, self.lexicon = lang, lexicon

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        own = self[word] = len(self.lexicon.hashes)
        h = xxh64_intdigest(self.lang + b"\n" + word, self.lexicon.seed)
        self.lexicon.hashes.append(h - (1 << 64) if h >> 63 else h)
        self.lexicon.langs.append(self.lang)
        self.lexicon.words.append(word)
        return own


class Lexicon:
    """The words that a task has met so far; number 0 is the end of a piece."""

    def __init__(self, seed: int):
        self.seed = seed
        self.clear()

    def clear(self) -> None:
        self.hashes, self.langs, self.words, self.by_lang = [0], [b""], [b""], {}
        self._array = np.zeros(1, np.int64)

    def array(self) -> np.ndarray:
        """The hash of each number."""
        if len(self._array) < len(self.hashes):
            self._array = np.concatenate([self._array, np.array(self.hashes[len(self._array) :], np.int64)])
        return self._array

    def numbers(self, batch: pa.RecordBatch) -> np.ndarray:
        """The words of all texts of a batch (lang, text), in order, as numbers."""
        end, parts = np.zeros(1, np.int64), [np.zeros(0, np.int64)]
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = self.by_lang.get(lang)
            if ids is None:
                ids = self.by_lang[lang] = _Ids(lang, self)
            words = text.as_py().translate(_TABLE).lower().replace(b"\n", b" \n ").split(b" ")
            parts += [np.fromiter(map(ids.__getitem__, filter(None, words)), np.int64), end]
        return np.concatenate(parts)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))


def split_words(docs: DataFrame, seed: int) -> DataFrame:
    """Two kinds of rows: w, lang, word, n of words counted by the tasks; and own, numbers of a slice of texts.

    own: the hashes of the slice's words, 0 (the end of a piece) first; numbers: all its words in order, as positions in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = Lexicon(seed), np.zeros(0, np.int64)
        schema = pa.schema([("w", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("own", pa.binary()), ("numbers", pa.binary())])

        def send() -> pa.RecordBatch:
            own = np.flatnonzero(counts[1:]) + 1
            none = pa.nulls(len(own), pa.binary())
            names = [pa.array([x[k] for k in own], pa.binary()).cast(pa.string()) for x in (lexicon.langs, lexicon.words)]
            return pa.RecordBatch.from_arrays([pa.array(lexicon.array()[own]), *names, pa.array(counts[own]), none, none], schema=schema)

        for batch in byte_slices(batches):
            found = lexicon.numbers(batch)
            used = np.bincount(found, minlength=len(lexicon.hashes))
            there = used > 0
            there[0] = True
            own = lexicon.array()[there]
            numbers = (np.cumsum(there) - 1)[found].astype(number_type(len(own)))
            used[: len(counts)] += counts
            counts = used
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, schema.field(k).type) for k in range(4)), pa.array([own.tobytes()], pa.binary()), pa.array([numbers.tobytes()], pa.binary())], schema=schema)
            if len(counts) > KNOWN:
                yield send()
                lexicon.clear()
                counts = np.zeros(0, np.int64)
        yield send()
        pa.default_memory_pool().release_unused()  # the worker goes on to the next passes

    return _texts(docs).mapInArrow(run, "w long, lang string, word string, n long, own binary, numbers binary")


def number_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, numbers) of each slice that `split_words` wrote."""
    for batch in batches:
        for own, numbers in zip(batch.column(0), batch.column(1)):
            hashes = np.frombuffer(own.as_buffer(), np.int64)
            yield hashes, np.frombuffer(numbers.as_buffer(), number_type(len(hashes)))


def word_counts(written: DataFrame) -> DataFrame:
    """w, lang, word, n of every word."""
    return written.where("w IS NOT NULL").groupBy("w", "lang", "word").agg(F.sum("n").alias("n"))


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """The bitmap of the low BITMAP_BITS of all hashes: built by Spark, one row for each 32,768 bits."""
    bit = F.pmod(F.col(column), F.lit(1 << BITMAP_BITS)) + 1
    with shuffles_removed(hashes.sparkSession):
        chunks = hashes.groupBy(F.bitmap_bucket_number(bit).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        rows = chunks.collect()  # 4,096 rows of 4 KB at most, at any size
    whole = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in rows:
        at = (row["chunk"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return whole


def _of_share(hashes: np.ndarray, share: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(SHARES) == share


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & ((1 << BITMAP_BITS) - 1)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0


def _tallies(texts: DataFrame, find: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """`names` and n: how often each combination occurs of what `find` gets from the hashes and numbers of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            order = np.argsort(reduce(_blend, columns))  # equal rows are neighbours; a shared hash only parts some of them
            new = np.zeros(max(len(order) - 1, 0), bool)
            for c in columns:
                own = c[order]
                new |= own[1:] != own[:-1]
            first = np.flatnonzero(np.concatenate([[True], new])) if len(order) else order
            n = np.diff(np.append(first, len(order)))
            columns = [c[order[first]] for c in columns]
            for at in range(0, len(n), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[part]) for c in columns), pa.array(n[part], pa.int64())], [*names, "n"])

        for own, numbers in slices(batches):
            held.append(find(own, numbers))
            size += len(held[-1][0])
            if size >= TALLIED:
                yield from send()
                size = 0
        if held:
            yield from send()

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))


def candidates(texts: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """w1, w2, w3 (0 for pairs): all phrases that can occur `least` times or more, and few others; written."""
    context = texts.sparkSession.sparkContext
    often = context.broadcast(bitmap_of(words.where(F.col("n") >= least), "w"))  # 16 MB at any size

    def frequent_pairs(own: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        good = ((own != 0) & _in_bitmap(often.value, own))[numbers]
        at = np.flatnonzero(good[1:] & good[:-1])
        h = own[numbers]
        return h, at, _blend(h[at], h[at + 1])

    def pairs(share: int) -> DataFrame:
        def own_pairs(own: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
            pair = frequent_pairs(own, numbers)[2]
            return [pair[_of_share(pair, share)]]

        return _tallies(texts, own_pairs, ["pair"]).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    known = context.broadcast(reduce(np.bitwise_or, (bitmap_of(pairs(k), "pair") for k in range(SHARES))))

    def phrases(share: int) -> DataFrame:
        def own_phrases(own: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
            h, at, pair = frequent_pairs(own, numbers)
            good = _in_bitmap(known.value, pair)
            at, here = at[good], _of_share(pair[good], share)  # a triple goes with its first pair
            triple = at[:-1][(np.diff(at) == 1) & here[:-1]]
            at = at[here]
            third = np.concatenate([np.zeros(len(at), np.int64), h[triple + 2]])
            at = np.concatenate([at, triple])
            return [h[at], h[at + 1], third]

        tallied = _tallies(texts, own_phrases, ["w1", "w2", "w3"]).groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"))
        return tallied.where(F.col("n") >= least).select("w1", "w2", "w3")

    return reduce(DataFrame.unionByName, [materialize(phrases(k), "candidates") for k in range(SHARES)])


def trie_counts(texts: DataFrame, spread: Broadcast[tries.DoubleArray]) -> DataFrame:
    """w1, w2, w3 (0 for pairs), a: occurrences of the phrases of one trie, all positions of a slice walking it together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = spread.value, np.zeros(len(spread.value.check), np.int32)
        held, size = [], 0

        def count() -> None:
            states = np.concatenate(held)
            low = int(states.min())
            ended = np.bincount(states - low)
            counts[low : low + len(ended)] += ended.astype(np.int32)
            held.clear()

        for own, numbers in slices(batches):
            word = known.codes(own)[numbers]
            at, states = known.at(np.zeros(len(word), np.int64), word)
            for k in (1, 2):
                at, states = at[at + k < len(word)], states[at + k < len(word)]
                on, states = known.at(states, word[at + k])
                at = at[on]
                if len(states):
                    held.append(states)
                    size += len(states)
            if size >= TALLIED:
                count()
                size = 0
        if held:
            count()
        found = np.flatnonzero(counts)
        for k in range(0, len(found), 1 << 17):
            states = found[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(states, pa.int32()), pa.array(counts[states].astype(np.int64))], ["state", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = spread.value.path(batch.column(0).to_numpy().astype(np.int64))
            path = np.pad(path, ((0, 0), (0, 3 - path.shape[1])))
            yield pa.RecordBatch.from_arrays([*(pa.array(path[:, c]) for c in range(3)), batch.column(1)], ["w1", "w2", "w3", "a"])

    counted = texts.mapInArrow(run, "state int, n long").groupBy("state").agg(F.sum("n").alias("a"))
    return counted.mapInArrow(spell, "w1 long, w2 long, w3 long, a long")


def phrase_counts(texts: DataFrame, found: DataFrame, phrases: int = PHRASES) -> DataFrame:
    """w1, w2, w3, a of written candidates, one pass over the words for each trie of about `phrases`."""
    rounds = -(-found.count() // phrases) or 1
    parts = []
    for k in range(rounds):
        own = found.where(F.pmod(F.xxhash64("w1"), F.lit(rounds)) == k).select("w1", "w2", "w3").toArrow()  # about `phrases` rows of 24 bytes
        trie = tries.build(np.stack([own.column(c).to_numpy() for c in range(3)], axis=1).reshape(-1, 3))
        spread = texts.sparkSession.sparkContext.broadcast(trie)  # at most about `phrases` phrases
        parts.append(materialize(trie_counts(texts, spread), "phrases"))
        spread.destroy()  # its files would stay on every disk, one for each trie
    return reduce(DataFrame.unionByName, parts)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly: decimals hold the products, and no score is over SCALE."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(SCALE).cast("decimal(7,0)"), whole(left) * whole(right))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, phrases: int = PHRASES, seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of each language."""
    while True:
        written = materialize(split_words(docs, seed), "split", compression="zstd", **{"parquet.block.size": ROW_GROUP})
        words = materialize(word_counts(written), "words")
        if not words.groupBy("w").count().where("count > 1").limit(1).count():  # no two words share a hash
            break
        seed += 1
    texts = written.where("numbers IS NOT NULL").select("own", "numbers")
    langs = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = candidates(texts, words, least)
    counted = phrase_counts(texts, found, phrases).where(F.col("a") >= least)
    common = words.where(F.col("n") >= least).select("w", "lang", "word", F.col("n").alias("f"))
    named = lambda k: common.select(F.col("w").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))

    pairs, triples = counted.where("w3 = 0").drop("w3"), counted.where("w3 <> 0")
    covers = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    covers = covers.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    kept = pairs.join(covers, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {inside} * a").drop("longer")
    two = kept.join(named(1), "w1").join(named(2), "w2")
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))

    begin = pairs.select("w1", "w2", F.col("a").alias("f12"))
    rest = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = triples.join(begin, ["w1", "w2"]).join(rest, ["w2", "w3"]).join(named(1), "w1").join(named(2), "w2").join(named(3), "w3")
    cuts = [F.struct(score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("f1", "f23"), ("f12", "f3")), 1)]
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.least(*cuts).alias("cut"))
    three = three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(broadcast_if_small(langs, F.octet_length("lang") + 8), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
