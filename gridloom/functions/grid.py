"""Column functions over grids held as row-major arrays.

A map's grid has a size set by its raster, not by the data, so it is one array in one row, and everything that looks at
neighbours stays inside the row: no join, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEIGHBOURS_8 = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
NEIGHBOURS_4 = [(-1, 0), (0, -1), (0, 1), (1, 0)]
SQUARE_3 = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
SQUARE_5 = [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3)]


def cells_of(h: int, w: int) -> Column:
    return F.sequence(F.lit(0), F.lit(h * w - 1))


def row_of(cell: Column, w: int) -> Column:
    return F.floor(cell / w).cast("int")


def column_of(cell: Column, w: int) -> Column:
    return F.pmod(cell, F.lit(w)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def dense(entries: Column, h: int, w: int, default) -> Column:
    """The full array of a map from cell number to value."""
    return let(entries, lambda m: F.transform(cells_of(h, w), lambda i: F.coalesce(F.element_at(m, i), default)))


def packed(mask: Column, h: int, w: int) -> Column:
    """A grid of 0 and 1 as an array of longs of 64 cells each."""
    part = lambda k: F.aggregate(F.slice(mask, 64 * k + 1, min(64, h * w - 64 * k)), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("bigint")))
    return F.array(*[part(k) for k in range(-(-h * w // 64))])


def stencil(grid: Column, h: int, w: int, offsets: list[tuple[int, int]], combine: Callable[[list[Column]], Column], outside=None, clamp: bool = False) -> Column:
    """combine(values at the offsets) for every cell. Cells beyond the edge read as `outside`, or with `clamp` as the nearest edge cell."""

    def body(g: Column) -> Column:
        def at(i: Column) -> Column:
            r, c = row_of(i, w), column_of(i, w)
            values = []
            for dr, dc in offsets:
                rr, cc = r + dr, c + dc
                if clamp:
                    rr, cc = F.least(F.greatest(rr, F.lit(0)), F.lit(h - 1)), F.least(F.greatest(cc, F.lit(0)), F.lit(w - 1))
                    values.append(F.get(g, rr * w + cc))
                else:
                    inside = (rr >= 0) & (rr < h) & (cc >= 0) & (cc < w)
                    values.append(F.when(inside, F.get(g, rr * w + cc)).otherwise(outside))
            return combine(values)

        return F.transform(cells_of(h, w), at)

    return let(grid, body)


def total(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def largest(values: list[Column]) -> Column:
    return F.greatest(*values)


def smallest(values: list[Column]) -> Column:
    return F.least(*values)


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def gaussian_taps(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def density(counts: Column) -> Column:
    """Counts over their sum; all zero stays all zero."""
    return let(array_total(F.transform(counts, lambda x: x.cast("double"))), lambda s: F.transform(counts, lambda x: F.when(s > 0, x / s).otherwise(x.cast("double"))))


def blur(grid: Column, h: int, w: int, sigma: float = 1.0, edge: bool = True) -> Column:
    """Separable Gaussian of radius max(1, round(3 sigma)); beyond the edge the edge's own values, or zero."""
    radius = max(1, round(3 * sigma))
    taps = gaussian_taps(sigma, radius)
    weigh = lambda values: total([v * t for v, t in zip(values, taps)])
    down = stencil(grid, h, w, [(d, 0) for d in range(-radius, radius + 1)], weigh, F.lit(0.0), clamp=edge)
    return stencil(down, h, w, [(0, d) for d in range(-radius, radius + 1)], weigh, F.lit(0.0), clamp=edge)


def three_value_counts(counts: Column, h: int, w: int) -> Column:
    """2 or more: 1.0; one: 0.5; none beside a defect: 0.5; else 0."""

    def rate(values: list[Column]) -> Column:
        own, near = values[0], values[1:]
        return F.when(own >= 2, 1.0).when(own >= 1, 0.5).when(F.greatest(*near) > 0, 0.5).otherwise(0.0)

    return stencil(counts, h, w, [(0, 0), *NEIGHBOURS_8], rate, F.lit(0))


def three_value_mask(mask: Column, h: int, w: int) -> Column:
    """A defect: 1.0; beside one: 0.5; else 0. `mask` holds 0 and 1."""
    return stencil(mask, h, w, [(0, 0), *NEIGHBOURS_8], lambda v: F.when(v[0] > 0, 1.0).when(F.greatest(*v[1:]) > 0, 0.5).otherwise(0.0), F.lit(0))


def mountain(counts: Column, h: int, w: int, sigma: float = 1.5) -> Column:
    """The sum over defective cells of Gaussian hills, over its own sum."""

    def body(g: Column) -> Column:
        peaks = F.filter(cells_of(h, w), lambda i: F.get(g, i) > 0)

        def hills(p: Column) -> Column:
            def height(i: Column) -> Column:
                r, c = row_of(i, w), column_of(i, w)
                return F.aggregate(p, F.lit(0.0), lambda s, k: s + F.exp(-((row_of(k, w) - r) * (row_of(k, w) - r) + (column_of(k, w) - c) * (column_of(k, w) - c)) / (2 * sigma * sigma)))

            return F.transform(cells_of(h, w), height)

        return let(hills(peaks), lambda raw: let(array_total(raw), lambda s: F.transform(raw, lambda x: F.when(s > 0, x / s).otherwise(x))))

    return let(counts, body)


def dilate(mask: Column, h: int, w: int, offsets: list[tuple[int, int]] = SQUARE_3) -> Column:
    return stencil(mask, h, w, offsets, largest, F.lit(0))


def erode(mask: Column, h: int, w: int, offsets: list[tuple[int, int]] = SQUARE_3, outside: int = 0) -> Column:
    """outside: what cells beyond the edge count as; 1 leaves the edge alone."""
    return stencil(mask, h, w, offsets, smallest, F.lit(outside))


def close_within(mask: Column, valid: Column, h: int, w: int, offsets: list[tuple[int, int]] = SQUARE_3) -> Column:
    """Closing inside a valid area: dilation cut to it, then erosion for which cells outside it count as set."""
    grown = F.zip_with(dilate(mask, h, w, offsets), valid, lambda d, v: d * v)
    filled = F.zip_with(grown, valid, lambda d, v: F.when(v == 0, 1).otherwise(d))
    return F.zip_with(erode(filled, h, w, offsets, outside=1), valid, lambda d, v: d * v)


def diamond(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dr, dc) for dr in span for dc in span if abs(dr) + abs(dc) <= radius]


def neighbour_counts(mask: Column, h: int, w: int, offsets: list[tuple[int, int]] = NEIGHBOURS_8) -> Column:
    return stencil(mask, h, w, offsets, total, F.lit(0))


def drop_sparse(mask: Column, h: int, w: int, least: int = 2, rounds: int = 3) -> Column:
    """Clear cells with under `least` set neighbours, all at once, up to `rounds` times."""
    for _ in range(rounds):
        mask = let(mask, lambda m: F.zip_with(m, neighbour_counts(m, h, w), lambda x, n: F.when((x > 0) & (n >= least), 1).otherwise(0)))
    return mask


def spatial_filter(mask: Column, h: int, w: int) -> Column:
    """3 or more set cells of 3x3: 1.0; else 5 or more of 5x5: 0.5; else 0. Both counts include the cell."""
    near = [SQUARE_5.index(o) for o in SQUARE_3]
    return stencil(mask, h, w, SQUARE_5, lambda v: F.when(total([v[k] for k in near]) >= 3, 1.0).when(total(v) >= 5, 0.5).otherwise(0.0), F.lit(0))


def resize_nearest(grid: Column, h: int, w: int, new_h: int, new_w: int) -> Column:
    """Each new cell reads the cell at floor(new index * old size / new size)."""
    return let(grid, lambda g: F.transform(cells_of(new_h, new_w), lambda i: F.get(g, F.floor(row_of(i, new_w) * h / new_h).cast("int") * w + F.floor(column_of(i, new_w) * w / new_w).cast("int"))))


def pad_centred(grid: Column, h: int, w: int, new_h: int, new_w: int) -> Column:
    top, left = (new_h - h) // 2, (new_w - w) // 2

    def body(g: Column) -> Column:
        def at(i: Column) -> Column:
            r, c = row_of(i, new_w) - top, column_of(i, new_w) - left
            return F.when((r >= 0) & (r < h) & (c >= 0) & (c < w), F.get(g, r * w + c)).otherwise(0)

        return F.transform(cells_of(new_h, new_w), at)

    return let(grid, body)


def fit(grid: Column, h: int, w: int, new_h: int, new_w: int) -> Column:
    """Zero-padded around if it fits, else nearest cells."""
    return pad_centred(grid, h, w, new_h, new_w) if h <= new_h and w <= new_w else resize_nearest(grid, h, w, new_h, new_w)


def pool(grid: Column, h: int, w: int, size: int, how: str) -> Column:
    """One value for each size x size block, row-major: max, min, mean, white_priority (any 255: 255, else any 127: 127, else 0), zero_dominant (zeros in over half: 0, else the maximum)."""

    def rate(v: Column) -> Column:
        if how == "max":
            return F.array_max(v)
        if how == "min":
            return F.array_min(v)
        if how == "mean":
            return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
        if how == "white_priority":
            return F.when(F.array_contains(v, 255), 255).when(F.array_contains(v, 127), 127).otherwise(0)
        if how == "zero_dominant":
            return F.when(2 * F.size(F.filter(v, lambda x: x == 0)) > F.size(v), 0).otherwise(F.array_max(v))
        raise ValueError(f"unknown pooling {how}")

    rows, columns = -(-h // size), -(-w // size)

    def body(g: Column) -> Column:
        def block(i: Column) -> Column:
            r0, c0 = row_of(i, columns) * size, column_of(i, columns) * size
            inner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda dr: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda dc: F.when((r0 + dr < h) & (c0 + dc < w), F.get(g, (r0 + dr) * w + c0 + dc)))))
            return let(F.filter(inner, lambda x: x.isNotNull()), rate)

        return F.transform(cells_of(rows, columns), block)

    return let(grid, body)


def decouple(bins: Column) -> Column:
    """struct(defect, valid): min(max(v - 1, 0), 1) and v > 0 for every cell."""
    return F.struct(F.transform(bins, lambda v: F.least(F.greatest(v - 1, F.lit(0)), F.lit(1))).alias("defect"), F.transform(bins, lambda v: (v > 0).cast("int")).alias("valid"))


def by_policy(bins: Column, bin3: str = "ignore") -> Column:
    """Statuses with bin 3 as told: "ignore" makes it 0 (not inspected), "as_defect" makes values from 3 on 2."""
    if bin3 == "ignore":
        return F.transform(bins, lambda v: F.when(v >= 3, 0).otherwise(v))
    if bin3 == "as_defect":
        return F.transform(bins, lambda v: F.when(v >= 3, 2).otherwise(v))
    raise ValueError("bin3 must be 'ignore' or 'as_defect'")


def transform_cells(grid: Column, h: int, w: int, how: str) -> Column:
    """Exact moves of a grid: identity, rot90 (counter-clockwise), rot180, flip, or "shift:dr:dc" with zeros moved in."""
    if how.startswith("shift"):
        dr, dc = map(int, how.split(":")[1:])
        return stencil(grid, h, w, [(-dr, -dc)], lambda v: v[0], F.lit(0))
    source = {
        "identity": lambda r, c: r * w + c,
        "rot90": lambda r, c: c * w + (w - 1 - r),
        "rot180": lambda r, c: (h - 1 - r) * w + (w - 1 - c),
        "flip": lambda r, c: r * w + (w - 1 - c),
    }[how]
    if how == "rot90" and h != w:
        raise ValueError("rot90 needs a square grid")
    return let(grid, lambda g: F.transform(cells_of(h, w), lambda i: F.get(g, source(row_of(i, w), column_of(i, w)))))


def otsu(values: Column) -> Column:
    """The value that parts an array best: the first with the largest variance between those up to it and those above."""

    def spread(v: Column) -> Column:
        n = F.size(v)
        mean = lambda own: F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)

        def rate(t: Column) -> Column:
            low, high = F.filter(v, lambda x: x <= t), F.filter(v, lambda x: x > t)
            gap = mean(low) - mean(high)
            return F.when((F.size(low) > 0) & (F.size(high) > 0), F.size(low) * F.size(high) * gap * gap / (n * n)).otherwise(0.0)

        return F.transform(F.array_sort(F.array_distinct(v)), lambda t: F.struct(rate(t).alias("rate"), (-t).alias("minus")))

    return let(values, lambda v: -F.array_max(spread(v))["minus"])


def pseudo_bins(mask: Column, valid: Column, h: int, w: int, size: int = 4, sigma: float = 2.0) -> Column:
    """A coarse bin map of a fine one: closed, blurred, averaged over blocks, parted by Otsu, and spread out again (0, 1, 2)."""
    smooth = blur(F.transform(close_within(mask, valid, h, w), lambda x: x.cast("double")), h, w, sigma)
    coarse = pool(smooth, h, w, size, "mean")

    def parted(c: Column) -> Column:
        return let(otsu(c), lambda t: F.transform(c, lambda x: (x > t).cast("int")))

    fine = resize_nearest(let(coarse, parted), -(-h // size), -(-w // size), h, w)
    return F.zip_with(fine, valid, lambda x, v: F.when(v == 0, 0).otherwise(1 + x))


def hashed_share(key: Column, cell: Column, seed: int) -> Column:
    """(key * 65536 + cell) * 2654435761 + seed modulo 2^32, over 2^32: a number in [0, 1) for a map and a cell.

    Remainders are taken on the way, and the factor less 2^32 stands for it, so no product passes a long, whatever the key.
    """
    base = F.pmod(F.pmod(key, F.lit(65536)) * 65536 + cell, F.lit(4294967296))
    return F.pmod(base * (2654435761 - 4294967296) + seed, F.lit(4294967296)) / 4294967296.0


def dropout(mask: Column, key: Column, share: float, seed: int) -> Column:
    """Clear about a share of the set cells, by hash."""
    return F.transform(mask, lambda x, i: F.when(hashed_share(key, i.cast("bigint"), seed) < share, 0).otherwise(x))


def noise(mask: Column, valid: Column, key: Column, share: float, seed: int) -> Column:
    """Set about a share of the valid cells, by hash."""
    set_ = F.zip_with(mask, valid, lambda x, v: F.struct(x.alias("x"), v.alias("v")))
    return F.transform(set_, lambda p, i: F.when((p["v"] > 0) & (hashed_share(key, i.cast("bigint"), seed) < share), 1).otherwise(p["x"]))


#: Grids that can be derived from a map's arrays, by name: (counts, mask, h, w) -> array. More can be added.
REPRESENTATIONS: dict[str, Callable[[Column, Column, int, int], Column]] = {
    "binary": lambda n, m, h, w: m,
    "count": lambda n, m, h, w: n,
    "density": lambda n, m, h, w: density(n),
    "soft": lambda n, m, h, w: blur(density(n), h, w),
    "three-value": lambda n, m, h, w: three_value_counts(n, h, w),
    "mountain": lambda n, m, h, w: mountain(n, h, w),
}
