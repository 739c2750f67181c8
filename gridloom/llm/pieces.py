"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here, and its normaliser, white-space marker, scores and byte fallback are rebuilt
as a `Tokenizer`: a unigram model keeps its scores, a BPE model's scores become the order of its merges. Ids equal
those of the sentencepiece library (see tests/llm).

Whole texts are encoded by parts. Pieces hold the marker at their start only, or nothing else, and none holds a line
end; so no piece crosses from one marked word to the next, and a text's ids are those of its words in turn. Distinct new
words of a batch go to the tokenizer together, which encodes them on several threads. Models without these properties,
and texts with runs of spaces or the marker itself, are encoded whole.

Nulls and odd rows: a null or empty text has no ids and decodes to the empty text; null ids decode to null; a null
doc_id stays null; repeated rows are encoded alike; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the sentencepiece model format: the marker, piece types and model types.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Words in each of the two tables of ids that a worker holds: when the newer one is full, the older one is dropped.
HELD_WORDS = 120_000
#: Documents whose new words are encoded in one call, and the threads that encode them.
TOGETHER = 200
THREADS = 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    marker_last: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> PieceModel:
    """The parts of a sentencepiece ModelProto that encoding needs."""
    model = PieceModel()
    for number, value in _wire(data):
        if number == 1:
            own = dict(_wire(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            model.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_wire(value))
            model.model_type = own.get(3, UNIGRAM)
            model.byte_fallback = bool(own.get(35, 0))
            model.marker_last = bool(own.get(24, 0))
        elif number == 3:
            own = dict(_wire(value))
            model.charsmap = own.get(2, b"")
            model.add_prefix, model.squeeze_spaces, model.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
    return model


def load_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse_model(f.read())


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, best score first.

    Among equal scores the pair with the longer left side comes first: runs of the marker share one score, and
    sentencepiece, which then takes the leftmost pair, grows such a run from its left end.
    """
    scores = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in scores and piece[cut:] in scores:
                found.append((-score, -cut if set(piece) == {MARK} else 0, piece[:cut], piece[cut:]))
    found.sort(key=lambda x: x[:2])
    return [(a, b) for _, _, a, b in found]


def build_tokenizer(model: PieceModel, prefix: bool | None = None):
    """A Tokenizer with the model's ids. prefix: whether to mark the start of a text (default: as the model says)."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    if model.marker_last or not model.escape_spaces:
        raise NotImplementedError("markers at word ends, or spaces left as they are")
    if any(kind == USER for _, _, kind in model.pieces):
        raise NotImplementedError("user-defined pieces")
    unknown = next((k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.model_type == BPE:
        vocabulary = {p: k for k, (p, _, _) in enumerate(model.pieces)}
        name = model.pieces[unknown][0] if unknown is not None else None
        core = models.BPE(vocab=vocabulary, merges=_merges(model), unk_token=name, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise NotImplementedError(f"model type {model.model_type}")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_prefix if prefix is None else prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    return tokenizer


class PieceCodec:
    """Encodes and decodes texts given as UTF-8 bytes; ids come as little-endian 32-bit numbers."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.whole = build_tokenizer(model)
        self.words = build_tokenizer(model, prefix=False)
        normal = [p for p, _, kind in model.pieces if kind == NORMAL]
        self.by_words = not model.charsmap and not model.squeeze_spaces and model.add_prefix and not any("\n" in p or (MARK in p[1:] and set(p) != {MARK}) for p in normal)
        self.held: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.table = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """Words, each to be marked unless it starts with a line end."""
        return text.replace(b"\n", b" \n").split(b" ")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_words:
            return [np.asarray(e.ids, "<u4").tobytes() for e in self.whole.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        parts = [self.split(t) if t else [] for t in texts]
        mark = MARK.encode()
        odd = {k for k, own in enumerate(parts) if b"" in own or mark in texts[k]}
        if len(self.held) >= HELD_WORDS:
            self.older, self.held = self.held, {}
        order = []
        for w in {w for k, own in enumerate(parts) if k not in odd for w in own if w not in self.held}:
            ids = self.older.get(w)
            if ids is None:
                order.append(w)
            else:
                self.held[w] = ids
        marked = [w.decode() if w[:1] == b"\n" else MARK + w.decode() for w in order]
        for w, e in zip(order, self.words.encode_batch(marked, add_special_tokens=False)):
            self.held[w] = np.asarray(e.ids, "<u4").tobytes()
        get = self.held.__getitem__
        out = [b"" if k in odd else b"".join(map(get, own)) for k, own in enumerate(parts)]
        if odd:
            rows = sorted(odd)
            for k, e in zip(rows, self.whole.encode_batch([texts[k].decode() for k in rows], add_special_tokens=False)):
                out[k] = np.asarray(e.ids, "<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the space that marks its start is dropped."""
        text = b"".join(map(self.table.__getitem__, ids.tolist()))
        return text[1:] if self.model.add_prefix and text[:1] == b" " else text


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """key, ids, n_tokens, restored: whether decoding the ids gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the first batch is encoded
        codec = PieceCodec(load_model(model_path))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = [t.as_py() or b"" for t in part.column(1)]
                packed = codec.encode(texts)
                flat = [np.frombuffer(p, "<u4") for p in packed]
                same = [codec.decode(f) == t for f, t in zip(flat, texts)]
                ends = np.cumsum([0, *map(len, flat)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "restored"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, restored boolean")


def decode_documents(encoded: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """key and text of (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(load_model(model_path))
        for batch in batches:
            texts = [None if i.as_py() is None else codec.decode(np.asarray(i.as_py(), np.int64)).decode("utf-8", "replace") for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(key).cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
