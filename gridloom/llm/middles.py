"""Fill-in-the-middle rewriting by displacement scatter.

A text is cut at two token boundaries into prefix, middle and suffix, which are written in another order with marker
strings between them. All texts of an Arrow slice are one byte buffer. One scan marks where tokens start; a difference
array holds how much further, or less far, every byte is to move than the byte before it; its running sum is the shift
of each byte, and one scatter writes all outputs. Restoring scans an output for its markers, builds the shifts back in
the same way, and gathers.

Tokens are runs of ASCII letters and single other code points, so they start at bytes that are no continuation bytes,
and no regular expression runs.

Nulls and odd rows: a null text is empty, and an empty text is plain; a null id draws its cuts from the digest of `1:`
alone; repeated rows give equal rows; texts of any length are rewritten whole; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, table

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Out of 100: texts that are rewritten, and rewritten ones that start with the suffix.
REWRITTEN, SUFFIX_FIRST = 90, 20
WIDTH = len(PREFIX)


def token_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions at which tokens start. `begins`: the first byte of each text."""
    if not len(data):
        return np.zeros(0, np.int64)
    folded = data | 0x20
    letter = (folded >= 0x61) & (folded <= 0x7A)
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[begins[begins < len(data)]] = False
    return np.flatnonzero(~goes_on & ((data & 0xC0) != 0x80))


def find(data: np.ndarray, marker: bytes) -> np.ndarray:
    """Positions of `marker` in the buffer, those across two texts included."""
    if len(data) < len(marker):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[: len(data) - len(marker) + 1] == marker[0])
    for k in range(1, len(marker)):
        at = at[data[at + k] == marker[k]]
    return at


def shifts(size: int, edges: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """The shift of each of `size` bytes: from each edge on, the move that stands there, until the next edge.

    Edges are given in the order of the segments of each text; empty segments share an edge, where the last one counts.
    """
    step = np.zeros(size + 1, np.int64)
    at = np.stack(edges, axis=1).reshape(-1)
    move = np.stack(moves, axis=1).reshape(-1)
    np.add.at(step, at, np.diff(move, prepend=0))
    return np.cumsum(step[:size])


def places(form: np.ndarray, begin: np.ndarray, cuts: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Output offsets (one more than texts), and of prefix, middle and suffix: edges in the text and moves to the output."""
    moved = form != PLAIN
    out = np.concatenate([[0], np.cumsum(end - begin + 3 * WIDTH * moved)])
    base = out[:-1] - begin
    prefix, middle, suffix = cuts[:, 0] - begin, cuts[:, 1] - cuts[:, 0], end - cuts[:, 1]
    psm, spm = form == PSM, form == SPM
    moves = [
        base + np.where(psm, WIDTH, np.where(spm, 2 * WIDTH + suffix, 0)),
        base + np.where(psm, 3 * WIDTH + suffix, np.where(spm, 3 * WIDTH + suffix, 0)),
        base + np.where(psm, 2 * WIDTH - middle, np.where(spm, WIDTH - prefix - middle, 0)),
    ]
    return out, [begin, cuts[:, 0], cuts[:, 1]], moves


def rewrite(data: np.ndarray, begin: np.ndarray, cuts: np.ndarray, end: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output bytes, offsets) of all texts: texts lie in `data` one after another."""
    out, edges, moves = places(form, begin, cuts, end)
    written = np.empty(out[-1], np.uint8)
    written[np.arange(len(data)) + shifts(len(data), edges, moves)] = data
    on = np.flatnonzero(form != PLAIN)
    spm = form[on] == SPM
    prefix, suffix = (cuts[on, 0] - begin[on]), (end[on] - cuts[on, 1])
    at_prefix = out[on] + np.where(spm, WIDTH + suffix, 0)
    at_suffix = out[on] + np.where(spm, 0, WIDTH + prefix)
    at_middle = out[on] + 2 * WIDTH + prefix + suffix
    for marker, at in ((PREFIX, at_prefix), (SUFFIX, at_suffix), (MIDDLE, at_middle)):
        for k in range(WIDTH):
            written[at + k] = marker[k]
    return written, out


def restore(written: np.ndarray, out: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text bytes, offsets), from outputs and forms alone. Rewritten texts hold no marker, so each output holds each once."""
    on = np.flatnonzero(form != PLAIN)
    length = np.diff(out)

    def marks(marker: bytes) -> np.ndarray:
        at = find(written, marker)
        text = np.searchsorted(out, at, side="right") - 1
        own = np.isin(text, on) & (at + WIDTH <= out[np.minimum(text + 1, len(out) - 1)])
        return at[own]

    p, s, m = (marks(x) for x in (PREFIX, SUFFIX, MIDDLE))
    spm = form[on] == SPM
    prefix, suffix, middle = length.copy(), np.zeros_like(length), np.zeros_like(length)  # a plain text is all prefix
    prefix[on] = np.where(spm, m, s) - p - WIDTH
    suffix[on] = np.where(spm, p, m) - s - WIDTH
    middle[on] = out[on + 1] - m - WIDTH
    end = np.cumsum(prefix + middle + suffix)
    begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
    cuts = np.stack([begin + prefix, begin + prefix + middle], axis=1)
    _, edges, moves = places(form, begin, cuts, end)
    size = int(end[-1]) if len(end) else 0
    return written[np.arange(size) + shifts(size, edges, moves)], np.concatenate([[0], end])


def draws(doc: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(b"1:" + (b"" if doc is None else str(doc).encode())).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its offsets from 0."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def cut_texts(docs: list[int | None], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, cuts in bytes, form) of each text."""
    begin, end = offsets[:-1], offsets[1:]
    starts = token_starts(data, begin)
    first = np.searchsorted(starts, begin)
    n = np.searchsorted(starts, end) - first
    h = np.array([draws(d) for d in docs], np.int64).reshape(-1, 4)
    units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    edge = np.append(starts, len(data))
    cuts = np.where(units < n[:, None], edge[np.minimum(first[:, None] + units, len(starts))], end[:, None])
    marked = np.zeros(len(n), bool)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        at = find(data, marker)
        text = np.searchsorted(offsets, at, side="right") - 1
        marked[text[at + WIDTH <= end[np.minimum(text, len(end) - 1)]]] = True
    plain = (begin == end) | marked | (h[:, 2] % 100 >= REWRITTEN)
    form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM))
    cuts[plain] = end[plain, None]
    return n, cuts, form


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", outputs: bool = True) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and with `outputs` the output itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            ids = batch.column(0).to_pylist()
            data, offsets = buffer_of(batch.column(1))
            n, cuts, form = cut_texts(ids, data, offsets)
            written, out = rewrite(data, offsets[:-1], cuts, offsets[1:], form)
            restored, back = restore(written, out, form)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            plain = form == PLAIN
            counts = [pa.array(chars[b] - chars[a], pa.int64(), mask=plain) for a, b in ((offsets[:-1], cuts[:, 0]), (cuts[:, 0], cuts[:, 1]))]
            digest = lambda own, at: pa.array([hashlib.sha256(own[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([FORMS[f] for f in form], pa.string()), *counts, digest(written, out), digest(restored, back)]
            if outputs:
                columns.append(pa.array([written[a:b].tobytes() for a, b in zip(out[:-1], out[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * outputs
    schema = f"{key} long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output binary" * outputs
    own = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    made = own.mapInArrow(run, schema)
    return made.withColumn("output", F.col("output").cast("string")) if outputs else made


def op12_scatter_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), outputs=False)
