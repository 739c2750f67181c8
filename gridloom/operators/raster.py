"""From defect lists and test rows to grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that mean pass; any other non-empty text means fail.
PASS_TEXTS = ("P", "PASS", "1", "TRUE", "Y", "YES", "OK")
MISSING_TEXTS = ("", "N/A", "NA", "NONE", "NULL")


#: Rows that a task groups at once.
TASK_ROWS = 1 << 19


def with_bounds(rows: DataFrame, keys: list[str], **bounds: Column) -> DataFrame:
    """Add aggregates over each group of `keys`, whose rows come to lie in one partition; rows without a key are left out.

    There are as many partitions as the counted rows ask for, so what a task sorts and groups does not grow with the input, and
    grouping by the keys and more needs no other shuffle.
    """
    known = rows.dropna(subset=keys)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    own = Window.partitionBy(*keys)
    return known.repartition(parts, *keys).select("*", *[b.over(own).alias(name) for name, b in bounds.items()])


def index_cell(value: Column, low: Column, high: Column, size: int, inverted: bool = False) -> Column:
    """The cell of a value between low and high: its share of the range times size, floored and cut to the grid.

    An inverted axis is turned before flooring; a range without width, and a missing value in it, falls into cell 0.
    """
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    share = 1.0 - share if inverted else share
    return F.least(F.greatest(F.floor(share * size), F.lit(0)), F.lit(size - 1)).cast("int")


def map_by_range(defects: DataFrame, key: str, x: str, y: str, h: int, w: int) -> DataFrame:
    """key, r, c of every defect with both coordinates, by the range of its own wafer; the row axis points down."""
    own = defects.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    bounds = own.groupBy(key).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    joined = own.join(bounds, key)
    return joined.select(key, index_cell(F.col(y), F.col("_y0"), F.col("_y1"), h, inverted=True).alias("r"), index_cell(F.col(x), F.col("_x0"), F.col("_x1"), w).alias("c"))


def map_physical(defects: DataFrame, key: str, h: int, w: int, pitch_x: float, pitch_y: float) -> DataFrame:
    """key, r, c by die index and place in the die; defects that fall off the grid are dropped, and so are wafers of one die."""
    own = with_bounds(defects.select(key, "xindex", "yindex", "xrel", "yrel"), [key], _x0=F.min("xindex"), _x1=F.max("xindex"), _y0=F.min("yindex"), _y1=F.max("yindex")).where("NOT (_x0 = _x1 AND _y0 = _y1)")
    xn = (F.col("xindex") - F.col("_x0") + F.col("xrel") / pitch_x) / (F.col("_x1") - F.col("_x0") + 1)
    yn = (F.col("yindex") - F.col("_y0") + F.col("yrel") / pitch_y) / (F.col("_y1") - F.col("_y0") + 1)
    placed = own.select(key, F.floor((1 - yn) * h).cast("int").alias("r"), F.floor(xn * w).cast("int").alias("c"))
    return placed.where(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))


def outside_circle(r: Column, c: Column, h: int, w: int) -> Column:
    """Whether a cell's middle is outside the circle inscribed in the grid."""
    mr, mc, radius = (h - 1) / 2, (w - 1) / 2, min(h, w) / 2
    return (r - mr) * (r - mr) + (c - mc) * (c - mc) > radius * radius


def rasterize(placed: DataFrame, key: str) -> DataFrame:
    """key, r, c, n: how many defects each cell has. Counts add up, so parts can be rasterized apart and summed."""
    return placed.groupBy(key, "r", "c").agg(F.count("*").alias("n"))


def pass_fail(text: Column) -> Column:
    """1 pass, 2 fail, 0 missing; text that is none of the known words means fail."""
    own = F.upper(F.trim(text))
    return F.when(text.isNull() | own.isin(*MISSING_TEXTS), 0).when(own.isin(*PASS_TEXTS), 1).otherwise(2)


def die_grid(rows: DataFrame) -> DataFrame:
    """lot_id, wafer_number, r, c, and the status of each test row; rows count down from the highest y."""
    own = with_bounds(rows.select("lot_id", "wafer_number", "die_x", "die_y", "pf", "hardbin"), ["lot_id", "wafer_number"], _x0=F.min("die_x"), _y1=F.max("die_y"))
    return own.select("lot_id", "wafer_number", (F.col("_y1") - F.col("die_y")).alias("r"), (F.col("die_x") - F.col("_x0")).alias("c"), pass_fail(F.col("pf")).alias("status"), "hardbin")


def worst_status(dies: DataFrame) -> DataFrame:
    """One status for each die that was tested several times: fail if any test failed."""
    return dies.groupBy("lot_id", "wafer_number", "r", "c").agg(F.max("status").cast("bigint").alias("status"), F.count("*").alias("tests"))


def actual_locations(defects: DataFrame, pitch_x: float, pitch_y: float, centre_x: float = 0.0, centre_y: float = 0.0) -> DataFrame:
    """Add x_actual and y_actual, the place on the wafer as seen from its centre."""
    return defects.withColumn("x_actual", F.col("xindex") * pitch_x + F.col("xrel") - centre_x).withColumn("y_actual", F.col("yindex") * pitch_y + F.col("yrel") - centre_y)


def regrid(located: DataFrame, pitch_x: float, pitch_y: float) -> DataFrame:
    """Die indices and places in the die for another pitch, from x_actual and y_actual."""
    for axis, pitch in (("x", pitch_x), ("y", pitch_y)):
        located = located.withColumn(f"{axis}index", F.floor(F.col(f"{axis}_actual") / pitch).cast("double"))
        located = located.withColumn(f"{axis}rel", F.col(f"{axis}_actual") - F.col(f"{axis}index") * pitch)
    return located


def die_bounds(radius: float, pitch: Column, centre: Column) -> tuple[Column, Column]:
    """The lowest and highest die index on a wafer of this radius."""
    return F.floor((centre - radius) / pitch), F.ceil((centre + radius) / pitch)
