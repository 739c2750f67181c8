"""WARC archives: a writer with payload revisits, and a reader that salvages damaged files.

The reader checks every record: gzip checksum, version line, named fields, Content-Length and the end of the block, and
the block and payload digests where given. After a failed check it looks for the next place that starts a valid record
(a gzip member, or a version line in plain files), carries on there, and reports the bytes between as a quarantined gap.

Nulls and odd rows: a null payload is written as empty; a null id is written as an empty one and read back as null; a
null url as an empty one, and every character of a url but printable ASCII is percent-encoded; of repeated rows that hold the
largest id of a payload, each is a response; an empty table gives no archive and no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, scratch_path, table, task_count

#: Fixed values of the WARC 1.1 format and of this writer.
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
RECORD_URN = "urn:x-page:"
END = b"\r\n\r\n"
BLANK_LINE = re.compile(rb"\n\r?\n")
NOT_PRINTABLE = re.compile(r"[^\x21-\x7e]+")

#: Compressed bytes after which a task starts its next archive; a larger record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16


@dataclass
class Piece:
    """A valid record, or (reason set) a gap of quarantined bytes."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    reason: str | None = None


class Damaged(ValueError):
    """A check failed. Of a gzip member: what could be inflated, how far that reaches, whether it may be wrong, and the records in it."""

    def __init__(self, reason: str, raw: bytes = b"", end: int = 0, doubtful: bool = False):
        super().__init__(reason)
        self.raw, self.end, self.doubtful = raw, end, doubtful
        self.pieces: list[Piece] = []


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One uncompressed record, HTTP headers included."""
    own = "" if page_id is None else str(page_id)
    target = NOT_PRINTABLE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD_URN}{own}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_URN}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + END + block + END


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _named_fields(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The fields from `at` to the first empty line, and where that ends. Lines end at LF; other separators are data."""
    fields: dict[str, str] = {}
    last = None
    while True:
        stop = data.find(b"\n", at)
        if stop < 0:
            raise Damaged("no end of fields")
        try:
            line = data[at:stop].removesuffix(b"\r").decode("utf-8", "strict")
        except UnicodeDecodeError as bad:
            raise Damaged("bad fields") from bad
        at = stop + 1
        if not line:
            return fields, at
        if line[0] in " \t" and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise Damaged("malformed field")
        last = name.lower()
        if last in fields and last != "warc-concurrent-to":  # all others stand once; twice, two records have run together
            raise Damaged("repeated field")
        fields[last] = value.strip()


def parse_record(data: bytes, at: int = 0) -> Piece:
    """The record that starts at `at`; Damaged if a check fails."""
    version = VERSION_LINE.match(data, at)
    if not version:
        raise Damaged("no version line")
    fields, start = _named_fields(data, version.end())
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    length = int(length)
    if start + length > len(data):
        raise Damaged("block is cut short")
    tail = data[start + length : start + length + 4]
    if tail != END and tail[:2] != b"\n\n":
        raise Damaged("block does not end where it should")
    block = data[start : start + length]
    end = start + length + (4 if tail == END else 2)
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        blank = BLANK_LINE.search(block)  # servers end lines with CR LF or with LF alone
        payload = block[blank.end() :] if blank else b""
    for name, held in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        kind, _, digest = fields.get(name, "").partition(":")
        if kind.lower() == "sha1" and not (name == "warc-payload-digest" and fields.get("warc-type") == "revisit") and digest.upper() != base32_sha1(held):
            raise Damaged(f"{name} differs")
    return Piece(at, end, fields, payload)


def _inflate(view: memoryview, at: int, most: int | None = None) -> tuple[bytes, int]:
    """The member at `at` and where it ends; with `most`, only its first bytes. Damaged holds what could be inflated (`raw`),
    how far that reaches (`end`) and whether the bytes before it may be wrong (`doubtful`).
    """
    unpacker, out, pos = zlib.decompressobj(31), [], at
    got = 0
    while not unpacker.eof:
        chunk = view[pos : pos + CHUNK]
        if not len(chunk):
            raise Damaged("member is cut short", b"".join(out), pos)
        before = unpacker.copy() if most is None else None
        try:
            piece = unpacker.decompress(chunk, most or 0)
        except zlib.error as bad:
            if before is not None:  # the chunk once more, byte by byte, up to the error
                for k in range(len(chunk)):
                    try:
                        out.append(before.decompress(chunk[k : k + 1]))
                    except zlib.error:
                        break
                    pos += 1
            raise Damaged("member fails its checks", b"".join(out), pos, doubtful=True) from bad
        out.append(piece)
        got += len(piece)
        pos += len(chunk)
        if most and got:
            return b"".join(out), pos
    return b"".join(out), pos - len(unpacker.unused_data)


def _pieces_in(raw: bytes, at: int, end: int, doubtful: bool = False) -> list[Piece]:
    """The records of inflated bytes, and gaps where a check fails; the search goes on at the next version line.

    From doubtful bytes only records are taken whose digest proves them.
    """
    found: list[Piece] = []
    pos, gap, reason = 0, None, ""
    while pos < len(raw):
        try:
            piece = parse_record(raw, pos)
            if doubtful and not {"warc-block-digest", "warc-payload-digest"} & set(piece.headers):
                raise Damaged("no digest in a damaged member")
        except Damaged as bad:
            if gap is None:
                gap, reason = pos, str(bad)
            line = VERSION_LINE.search(raw, pos + 1)
            pos = line.start() if line else len(raw)
            continue
        if gap is not None:
            found.append(Piece(at, end, reason=f"bytes {gap} to {pos} of the member: {reason}"))
            gap = None
        found.append(Piece(at, end, piece.headers, piece.payload))
        pos = piece.end
    if gap is not None:
        found.append(Piece(at, end, reason=f"bytes {gap} to {pos} of the member: {reason}"))
    return found


def _read_at(data: bytes, view: memoryview, at: int) -> tuple[list[Piece], int]:
    """What starts at `at`, a record or the records and gaps of a gzip member, and where it ends.

    Damaged, if there is no record; of a member that is cut or broken it holds the records before that (`pieces`).
    """
    if data[at : at + 2] != GZIP_MAGIC[:2]:
        piece = parse_record(data, at)
        return [piece], piece.end
    try:
        raw, end = _inflate(view, at)
    except Damaged as bad:
        bad.pieces = [p for p in _pieces_in(bad.raw, at, bad.end, bad.doubtful) if p.reason is None]
        raise
    pieces = _pieces_in(raw, at, end)
    if all(p.reason is not None for p in pieces):
        raise Damaged(pieces[0].reason if pieces else "empty member")
    return pieces, end


class Starts:
    """The places where a record may start. What was found ahead is kept, so a file is searched once, however damaged."""

    def __init__(self, data: bytes, view: memoryview):
        self.data, self.view = data, view
        self.member = self.plain = -1

    def _next_member(self, at: int) -> int:
        found = self.data.find(GZIP_MAGIC, at)
        while found >= 0:
            try:
                if _inflate(self.view, found, 16)[0].startswith(b"WARC/1."):
                    return found
            except Damaged:
                pass
            found = self.data.find(GZIP_MAGIC, found + 1)
        return len(self.data)

    def after(self, at: int) -> int:
        """The next start from `at` on, else the end."""
        if self.member < at:
            self.member = self._next_member(at)
        if self.plain < at:
            line = VERSION_LINE.search(self.data, at)
            self.plain = line.start() if line else len(self.data)
        return min(self.member, self.plain)


def salvage(data: bytes) -> Iterator[Piece]:
    """Every valid record in order, and a gap for each run of bytes that belongs to none.

    A member may hold several records: one of them damaged, the others are still returned, with a gap that names its bytes
    in the member. Of a member that is cut or broken the records before that are returned, then its bytes are a gap.
    """
    view, pos = memoryview(data), 0
    starts = Starts(data, view)
    gap, reason = None, ""
    while pos < len(data):
        try:
            pieces, end = _read_at(data, view, pos)
        except Damaged as bad:
            if bad.pieces and gap is not None:
                yield Piece(gap, pos, reason=reason)
                gap = None
            yield from bad.pieces
            if gap is None:
                gap, reason = pos, f"{bad}, {len(bad.pieces)} records recovered" if bad.pieces else str(bad)
            pos = starts.after(pos + 1)
            continue
        if gap is not None:
            yield Piece(gap, pos, reason=reason)
            gap = None
        yield from pieces
        pos = end
    if gap is not None:
        yield Piece(gap, len(data), reason=reason)


ROWS = "archive string, start long, stop long, reason string, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string"


def _rows(name: str, data: bytes) -> Iterator[tuple]:
    for p in salvage(data):
        if p.reason is not None:
            yield (name, p.start, p.end, p.reason, None, None, None, None, None, None)
            continue
        h = p.headers
        kind = h.get("warc-type")
        if kind == "revisit":  # the payload is elsewhere; its digest and this writer's extension field tell of it
            digest, size = h.get("warc-payload-digest", "").partition(":")[2], h.get("warc-payload-length", "")
            size = int(size) if size.isdigit() else None
        else:
            digest, size = base32_sha1(p.payload), len(p.payload)
        yield (name, p.start, p.end, None, h.get("warc-record-id"), kind, h.get("warc-target-uri"), digest, size, h.get("warc-refers-to"))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in ROWS.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (reason set) of all archives under `path`, in any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                yield from _batches(_rows(name.as_py(), data.as_py()), _ARROW)

    return files.mapInArrow(run, ROWS)


def open_folder(uri: str):
    """The file system and path of a shared folder, inside a task."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, refers_to, revisit) as archives in `folder`; returns (archive, records) of the files that count.

    A task names its files anew at each attempt, and only an attempt that Spark accepts gets into the returned table,
    so files of lost executors are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root)
        out, path, size, count = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(k) for k in range(5))):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(path, compression=None), 0, 0
                member = gzip_member(record_bytes(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py(), revisit.as_py()))
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([count], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([count], pa.int64())})

    return pages.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "archive string, records long")


def read_written(archives: DataFrame, folder: str) -> DataFrame:
    """Records and gaps of the archives that `write_archives` returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(name) as f:
                    data = f.read()
                yield from _batches(_rows(name, data), _ARROW)

    return archives.select("archive").repartition(task_count(archives.sparkSession)).mapInArrow(run, ROWS)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: of equal payloads the largest page_id is written whole.

    Only payloads that occur twice are joined back: by broadcast while they are few (counted), else by a shuffle on
    the digest that Spark can split where one payload is very common.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    repeated = own.where(F.octet_length("payload") >= least_bytes).groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "repeated")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = own.withColumn("digest", F.sha1("payload")).join(repeated, "digest", "left")
    revisit = F.coalesce(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.lit(False)) & (F.octet_length("payload") >= least_bytes)
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("kept")).alias("refers_to"), revisit.alias("revisit"))


def page_number(urn: str):
    digits = F.regexp_extract(urn, r"^<urn:x-page:(-?\d+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def records_and_gaps(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, and the log of quarantined bytes (archive, start, stop, reason), of what a reader returned."""
    records = read.where("reason IS NULL").drop("reason")
    return records, read.where("reason IS NOT NULL").select("archive", "start", "stop", "reason")


def round_trip(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write `pages` as archives in `folder` and read them back: records and gaps.

    Own archives are whole, so a gap in them, or a count of records other than was written, is an error.
    """
    archives = materialize(write_archives(with_revisits(pages), folder), "archives")
    records, gaps = records_and_gaps(materialize(read_written(archives, folder), "read"))
    written, got, lost = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count(), gaps.count()
    if lost or written != got:
        raise RuntimeError(f"{written} records were written and {got} read back, with {lost} gaps")
    return records, gaps


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return records.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
