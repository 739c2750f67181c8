"""Connected regions of grids held as arrays, and circles of angles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grid as G


def label_grids(masks: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Labels of grids (maps, h, w), all at once: in each round every cell takes the least label that its neighbours reach
    and then follows it once; grids that are settled drop out.
    """
    n, h, w = masks.shape
    far = h * w + 1
    labels = np.where(masks > 0, np.arange(1, far).reshape(h, w), far).astype(np.int32)
    reach = max((max(abs(dr), abs(dc)) for dr, dc in offsets), default=0)
    live = np.arange(n)
    while len(live):
        own = labels[live]
        wide = np.pad(own, ((0, 0), (reach, reach), (reach, reach)), constant_values=far)
        new = own.copy()
        for dr, dc in offsets:
            np.minimum(new, wide[:, reach + dr : reach + dr + h, reach + dc : reach + dc + w], out=new)
        new[own == far] = far
        flat = np.concatenate([new.reshape(len(live), -1), np.full((len(live), 1), far, np.int32)], axis=1)
        new = np.take_along_axis(flat, flat - 1, axis=1)[:, :-1].reshape(new.shape)
        moved = (new != own).any(axis=(1, 2))
        labels[live] = new
        live = live[moved]
    return np.where(labels == far, 0, labels)


def with_components(maps: DataFrame, name: str, mask: str, h: int, w: int, offsets: list[tuple[int, int]] = G.NEIGHBOURS_8) -> DataFrame:
    """Add `name`: for every cell the smallest cell number of its region plus one; 0 where `mask` is not set. A null mask stays null.

    Offsets must hold the opposite of each of them. The maps of an Arrow batch are labelled together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column(batch.schema.names.index(mask))
            there = np.flatnonzero(np.asarray(masks.is_valid()))
            found = np.zeros((0, h * w), np.int32)
            if len(there):
                found = label_grids(np.asarray(masks.flatten()).reshape(len(there), h, w), offsets).reshape(len(there), h * w)
            sizes = np.where(np.isin(np.arange(batch.num_rows), there), h * w, 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            labels = pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1), pa.int32()), mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, labels], [*batch.schema.names, name])

    return maps.mapInArrow(run, T.StructType([*maps.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def exposed_edges(labels: Column, h: int, w: int) -> Column:
    """How many of a cell's four sides do not touch its own region; 0 outside regions."""
    return G.stencil(labels, h, w, [(0, 0), *G.NEIGHBOURS_4], lambda v: F.when(v[0] == 0, 0).otherwise(G.total([(n != v[0]).cast("int") for n in v[1:]])), F.lit(-1))


def longest_run(bits: Column) -> Column:
    """The longest run of true values on a circle."""
    n = F.size(bits)
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    twice = F.concat(bits, bits)
    run = F.aggregate(twice, state, lambda s, b: F.when(b, F.struct((s["now"] + 1).alias("now"), F.greatest(s["best"], s["now"] + 1).alias("best"))).otherwise(F.struct(F.lit(0).alias("now"), s["best"].alias("best"))))
    return F.least(run["best"], n)


def bridged(bits: Column, gap: int) -> Column:
    """The circle with gaps of up to `gap` false values between true ones filled."""
    n = F.size(bits)
    reach = F.sequence(F.lit(1), F.lit(gap + 1))

    def near(i: Column, sign: int) -> Column:
        return F.coalesce(F.array_min(F.filter(reach, lambda d: F.get(bits, F.pmod(i + sign * d, n)))), F.lit(gap + 99))

    return F.transform(bits, lambda b, i: b | (near(i, 1) + near(i, -1) <= gap + 1))


def angle_bins(cells: Column, centre_r: float, centre_c: float, bins: int = 72) -> Column:
    """Which of `bins` equal angles around the centre have a cell of the array of (r, c)."""
    number = lambda p: F.least(F.floor(F.pmod(F.degrees(F.atan2(p["r"] - F.lit(centre_r), p["c"] - F.lit(centre_c))), F.lit(360.0)) / (360.0 / bins)), F.lit(bins - 1)).cast("int")
    return G.let(F.array_distinct(F.transform(cells, number)), lambda hit: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.array_contains(hit, k)))
