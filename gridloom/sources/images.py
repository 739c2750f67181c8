"""Grey PNG images as grids: a decoder for 8-bit grey with all five filters, and an encoder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def shape(data: bytes) -> tuple[int, int]:
    """(rows, columns) from the header alone."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    width, height = struct.unpack(">II", data[16:24])
    return height, width


def decode_grey(data: bytes) -> np.ndarray:
    h, w = shape(data)
    if data[24] != 8 or data[25] != 0 or data[28] != 0:
        raise ValueError("only 8-bit grey images without interlace are read")
    packed, at = b"", 8
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, w + 1)
    out = np.zeros((h, w), np.int32)
    above = np.zeros(w, np.int32)
    for r in range(h):
        how, line = raw[r, 0], raw[r, 1:].astype(np.int32)
        if how == 0:
            own = line
        elif how == 1:
            own = np.cumsum(line)
        elif how == 2:
            own = line + above
        elif how in (3, 4):
            own, left, corner = np.zeros(w, np.int32), 0, 0
            for c in range(w):
                up = above[c]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    near = left + up - corner
                    guess = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
                left, corner = (line[c] + guess) % 256, up
                own[c] = left
        else:
            raise ValueError(f"unknown filter {how}")
        out[r] = above = own % 256
    return out.astype(np.uint8)


def encode_grey(image: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = image.shape
    raw = np.hstack([np.zeros((h, 1), np.uint8), image.astype(np.uint8)]).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def status_of(grey: np.ndarray) -> np.ndarray:
    """255 is a defect (2), 127 a good die (1), anything else background (0)."""
    return np.where(grey == 255, 2, np.where(grey == 127, 1, 0))


def decode_images(images: DataFrame) -> DataFrame:
    """key, h, w, status (row-major) of (key, content) rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            grids = [status_of(decode_grey(c)) for c in part["content"]]
            yield pd.DataFrame({"key": part["key"], "h": [g.shape[0] for g in grids], "w": [g.shape[1] for g in grids], "status": [g.ravel().tolist() for g in grids]})

    return images.select(F.col("key").cast("string").alias("key"), "content").mapInPandas(run, "key string, h int, w int, status array<int>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Images under a path with `label`, the name of the folder they are in."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("key"), "content")
    return decode_images(files).withColumn("label", F.regexp_extract("key", r"([^/]+)/[^/]+$", 1))


def encode_images(grids: DataFrame, h: int, w: int) -> DataFrame:
    """(key, content) of (key, grey) rows, grey row-major."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "content": [encode_grey(np.asarray(g, np.uint8).reshape(h, w)) for g in part["grey"]]})

    return grids.select(F.col("key").cast("string").alias("key"), "grey").mapInPandas(run, "key string, content binary")
