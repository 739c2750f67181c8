"""Map collections in .npz files, read in tasks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which collections keep maps and labels, in the order they are tried.
MAP_KEYS = ("maps", "x", "X", "images", "arr_0")
LABEL_KEYS = ("labels", "y", "Y", "targets", "arr_1")
SCHEMA = "path string, original_index long, h int, w int, bins array<int>, labels array<int>"


def _first(archive, keys: tuple[str, ...]) -> np.ndarray:
    for k in keys:
        if k in archive:
            return archive[k]
    raise KeyError(f"none of {', '.join(keys)} in the file")


def read_npz(spark: SparkSession, path: str, valid_only: bool = True) -> DataFrame:
    """One row per map of all .npz files under a path; with `valid_only` maps without a label are left out, and the rest keep their index."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    maps, labels = _first(archive, MAP_KEYS), _first(archive, LABEL_KEYS)
                for at in range(0, len(maps), 512):
                    own = maps[at : at + 512]
                    yield pd.DataFrame({"path": name, "original_index": np.arange(at, at + len(own)), "h": own.shape[1], "w": own.shape[2], "bins": [m.ravel().astype(int).tolist() for m in own], "labels": [y.astype(int).tolist() for y in labels[at : at + 512]]})

    rows = files.mapInPandas(run, SCHEMA)
    return rows.where(F.exists("labels", lambda v: v > 0)) if valid_only else rows
