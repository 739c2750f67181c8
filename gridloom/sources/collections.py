"""Map collections in .npz files as a Spark data source, read by ranges of maps.

The driver reads the headers only: a collection is cut into ranges of `rows` maps, each range is a partition, and its task
reads these maps and no others (of a compressed member the bytes before them pass through, but are not kept). Bounds on
original_index in a query's filter drop whole ranges before any task starts.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .arrays import LABEL_KEYS, MAP_KEYS, SCHEMA

#: Maps of a partition, and of an Arrow batch.
ROWS, BATCH = 4096, 512
NAME = "map_collections"


@dataclass
class Range(InputPartition):
    """Maps `begin` to `end` of a file."""

    path: str
    begin: int
    end: int


def _open(path: str):
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return store.open_input_file(own)


def _files(path: str) -> list[str]:
    """The .npz files at or under a path, in order."""
    from pyarrow import fs

    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    store, own = fs.FileSystem.from_uri(uri)
    info = store.get_file_info(own)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(own, recursive=True))
    prefix = uri[: len(uri) - len(own)]
    return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".npz"))


def _member(archive: zipfile.ZipFile, keys: tuple[str, ...]):
    """(open member, shape, type) at its first value, for the first of the keys that the archive has."""
    names = set(archive.namelist())
    for key in keys:
        if f"{key}.npy" in names:
            member = archive.open(f"{key}.npy")
            version = np.lib.format.read_magic(member)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, by_column, kind = read(member)
            if by_column or kind.hasobject:
                raise ValueError(f"{key} is not a plain row-major array")
            return member, shape, kind
    raise KeyError(f"none of {', '.join(keys)} in the file")


def read_range(path: str, keys: tuple[str, ...], begin: int, end: int) -> np.ndarray:
    """Rows `begin` to `end` of an array of a file."""
    with _open(path) as f, zipfile.ZipFile(f) as archive:
        member, shape, kind = _member(archive, keys)
        with member:
            size = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
            member.seek(member.tell() + begin * size)
            end = min(end, shape[0])
            return np.frombuffer(member.read((end - begin) * size), kind).reshape(end - begin, *shape[1:])


class CollectionReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("original_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f  # Spark filters by these

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            with _open(path) as f, zipfile.ZipFile(f) as archive:
                member, shape, _ = _member(archive, MAP_KEYS)
                member.close()
            end = shape[0] if self.high is None else min(shape[0], self.high)
            out += [Range(path, at, min(at + self.rows, end)) for at in range(self.low, end, self.rows)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for at in range(partition.begin, partition.end, BATCH):
            end = min(at + BATCH, partition.end)
            maps, labels = read_range(partition.path, MAP_KEYS, at, end), read_range(partition.path, LABEL_KEYS, at, end)
            n, h, w = maps.shape
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).reshape(-1)), x[0].size).cast(pa.list_(pa.int32()))
            columns = [pa.array([partition.path] * n), pa.array(np.arange(at, end)), pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)), lists(maps), lists(labels)]
            yield pa.RecordBatch.from_arrays(columns, ["path", "original_index", "h", "w", "bins", "labels"])


class Collections(DataSource):
    """spark.read.format("map_collections").option("rows", n).load(path)"""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CollectionReader:
        return CollectionReader(self.options["path"], int(self.options.get("rows", ROWS)))


def read_collections(spark: SparkSession, path: str, rows: int = ROWS, valid_only: bool = True) -> DataFrame:
    """One row per map of all .npz files under a path, read by ranges; with `valid_only` maps without a label are left out.

    Filters reach the source where the session lets Python sources have them (spark.sql.python.filterPushdown.enabled, as
    `gridloom.session` sets it); without it Spark filters the rows itself.
    """
    spark.dataSource.register(Collections)
    found = spark.read.format(NAME).option("rows", rows).load(path)
    return found.where(F.exists("labels", lambda v: v > 0)) if valid_only else found
