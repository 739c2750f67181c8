"""Packing token sequences by vector best-fit.

Documents become token ids plus an end id, long ones are cut, and pieces are packed under three capacities at once:
tokens, documents, and attention cost (the sum of squared lengths). Packing follows the exact histogram of piece
lengths: its size is set by the token capacity, not by the corpus, so the driver plans for any number of pieces and
Spark hands each piece its place. Pieces go longest first; each goes to the open bin that ranks best by the weighted
residual norm (or dot product) among those that have room in every capacity.

Nulls and odd rows: a null text is empty and has the end id alone; a null id stays null; repeated rows are pieces of
their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, table
from .ranking import number_within

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, first_sequence long, offset long"


class WordIds(dict):
    """Word bytes -> little-endian ids of this word, worked out by the tokenizer at first sight.

    For tokenizers that never join across white space, a text's ids are its words' ids in turn. Letters followed by
    ASCII punctuation are two pre-tokens, so each of them is looked up on its own. If the tokenizer is of the byte-level
    kind (`byte_level`), letters up to U+017F are handed to its BPE model as the pre-tokenizer would hand them: lower
    case, bytes spelled as characters. Both tables start anew at their limits, which bounds memory and changes no result.
    """

    #: ASCII punctuation other than the apostrophe, which starts contractions.
    TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: How byte-level tokenizers spell the bytes that are no printable characters: U+0100 and up, in order.
    SPELLED = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
    LAST_PLAIN = "\u017f"
    DOTTED = "\u0130"

    def __init__(self, vocabulary: str, limit: int = 200_000, byte_level: bool | None = None):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        if byte_level is None:
            with open(vocabulary, encoding="utf-8") as f:
                steps = json.load(f)
            kinds = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])]
            last = ((steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1]
            byte_level = kinds == ["NFC", "Replace", "Lowercase"] and last.get("type") == "ByteLevel" and not last.get("add_prefix_space")
        self.byte_level = byte_level
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.parts: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_text(self, text: bytes) -> bytes:
        """The ids of a whole text. Added tokens reach across words, so a text that holds one goes through the tokenizer as it is."""
        folded = text.lower()
        if any(token in folded for token in self.added):
            return self.encode(text.decode())
        return b"".join(map(self.__getitem__, text.split()))

    def part(self, own: bytes) -> bytes:
        """The ids of a run of letters or of punctuation."""
        ids = self.parts.get(own)
        if ids is None:
            if len(self.parts) >= self.limit // 2:
                self.parts.clear()
            if self.byte_level and (own.isalpha() or own.decode().isalpha()):
                tokens = self.model.tokenize(own.decode("latin-1").translate(self.SPELLED))
                ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
            else:
                ids = self.encode(own.decode())
            self.parts[own] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        letters = word.rstrip(self.TAIL)
        tail = word[len(letters) :]
        if not letters.isalpha():
            text = letters.decode()
            if not text.isalpha() or max(text) > self.LAST_PLAIN or self.DOTTED in text:
                ids = self[word] = self.encode(word.decode()) if letters else self.part(word)
                return ids
            letters = text.lower().encode()
        else:
            letters = letters.lower()
        ids = self[word] = self.part(letters) + self.part(tail) if tail else self.part(letters)
        return ids


def cut_pieces(docs: DataFrame, vocabulary: str, max_tokens: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(vocabulary)
        end = np.asarray([end_id], "<u4").tobytes()
        width = 4 * max_tokens
        for batch in byte_slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of.of_text(text.as_py() or b"") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    for column, value in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], max_tokens: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm") -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for `counts[length]` pieces of each length, as runs, and the number of bins.

    A run (length, rank_from, rank_to, first_bin, offset) puts the pieces of this length with ranks in
    [rank_from, rank_to) into bins first_bin, first_bin + 1, ... at `offset`. Open bins are kept as runs of equal bins,
    so a step serves many pieces. `weights` weigh the three residuals (tokens, documents, attention); `rule` is "norm"
    (smallest weighted residual norm after placing) or "dot" (largest weighted dot product of item and residual).
    Ties go to the older bins. A capacity never stops a piece alone in its bin, except tokens.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be 'norm' or 'dot'")
    capacity = np.array([max_tokens, max_docs, max_attention], np.float64)
    scale = np.asarray(weights, np.float64) / capacity**2
    size = 1024
    room = np.zeros((size, 3), np.int64)
    first, amount, filled = (np.zeros(size, np.int64) for _ in range(3))
    open_runs, bins, plan = 0, 0, []

    def add(rest, at, n, used):
        nonlocal room, first, amount, filled, open_runs, size
        if rest[0] <= 0 or rest[1] <= 0 or n <= 0:
            return
        if open_runs == size:
            room = np.concatenate([room, np.zeros_like(room)])
            first, amount, filled = (np.concatenate([x, np.zeros_like(x)]) for x in (first, amount, filled))
            size *= 2
        room[open_runs], first[open_runs], amount[open_runs], filled[open_runs] = rest, at, n, used
        open_runs += 1

    def place(rest, at, n, used, item, rank, left):
        """Fill bins at..at+n-1 one after another with as many of `left` pieces as fit; what remains open is added."""
        per = int(min(rest // item))
        full, over = divmod(left, per)
        if full >= n:
            full, over = n, 0
        for k in range(per):
            if full:
                plan.append((int(item[0]), rank + k * full, rank + (k + 1) * full, at, used + k * int(item[0])))
        rank += per * full
        add(rest - per * item, at, full, used + per * int(item[0]))
        if over:
            plan.extend((int(item[0]), rank + k, rank + k + 1, at + full, used + k * int(item[0])) for k in range(over))
            add(rest - over * item, at + full, 1, used + over * int(item[0]))
        add(rest, at + full + bool(over), n - full - bool(over), used)
        return per * full + over

    for length in sorted(counts, reverse=True):
        left, rank, item = counts[length], 0, np.array([length, 1, length * length], np.int64)
        if length > max_tokens:
            raise ValueError(f"a piece of {length} tokens is over {max_tokens}")
        while left:
            own = room[:open_runs]
            fits = np.flatnonzero((own >= item).all(axis=1))
            if len(fits):
                if rule == "norm":
                    rated = (((own[fits] - item) ** 2) * scale).sum(axis=1)
                else:
                    rated = -((own[fits] * item) * scale).sum(axis=1)
                best = fits[np.lexsort((first[fits], rated))[0]]
                rest, at, n, used = room[best].copy(), int(first[best]), int(amount[best]), int(filled[best])
                open_runs -= 1
                for column in (room, first, amount, filled):
                    column[best] = column[open_runs]
            else:
                rest, at, used = np.maximum(capacity.astype(np.int64), item), bins, 0
                n = -(-left // int(min(rest // item)))
                bins += n
            done = place(rest, at, n, used, item, rank, left)
            left, rank = left - done, rank + done
    return plan, bins


def pack_pieces(pieces: DataFrame, max_tokens: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm") -> DataFrame:
    """Add sequence_id and offset. `pieces` (doc_id, piece, length, ...) is read several times: hand in a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    plan, _ = plan_bins(counts, max_tokens, max_docs, max_attention, weights, rule)
    runs = spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "_length")  # bounded by max_tokens, not by the corpus
    ranked = number_within(pieces, ["length"], ["doc_id", "piece"], "_rank")
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    placed = ranked.join(F.broadcast(runs), here)
    return placed.select(*pieces.columns, (F.col("first_sequence") + F.col("_rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """Tokenize, cut and pack whole documents. The defaults let documents and attention weigh in without ever binding."""
    pieces = materialize(cut_pieces(docs, vocabulary, max_tokens), "pieces")
    return pack_pieces(pieces, max_tokens, max_docs or max_tokens, max_attention or max_tokens * max_tokens, weights, rule)


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
