"""Raster summaries over a long cell table ``raster_id, cell_row, cell_col, value``.

A raster's description is a row of ``rasters``: ``raster_id, left, cell_width,
top, cell_height, cols, rows, nodata``.  Values are compared as 32-bit floats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_close
from ..session import broadcast_if_small, stored


def _with_nodata(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    facts = rasters.select("raster_id", F.col("nodata").cast("float").alias("nodata"))
    return cells.select("raster_id", F.col("value").cast("float").alias("v")).join(
        broadcast_if_small(facts), "raster_id", "left"
    )


def valid_cells(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """Cells that hold a number other than the raster's no-data value: ``raster_id, v``."""
    kept = F.col("nodata").isNull() | (F.col("v") != F.col("nodata"))
    return _with_nodata(cells, rasters).where(F.col("v").isNotNull() & ~F.isnan("v") & kept).select("raster_id", "v")


def raster_categories(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """Valid cells per whole value (truncated toward zero)."""
    return (
        valid_cells(cells, rasters)
        .groupBy("raster_id", F.col("v").cast("bigint").cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("cell_count"))
    )


def raster_summary(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """Smallest and largest valid value and the number of valid cells."""
    return valid_cells(cells, rasters).groupBy("raster_id").agg(
        F.min("v").cast("double").alias("min"),
        F.max("v").cast("double").alias("max"),
        F.count(F.lit(1)).alias("value_count"),
    )


#: Bins of a histogram that one row may hold on the way.
BIN_BLOCK = 1_000_000


def raster_histogram(cells: DataFrame, rasters: DataFrame, bin_size: int = 100) -> DataFrame:
    """Valid cells per bin from the floor of the minimum to the ceiling of the maximum.

    Bin edges are multiples of the size, so each cell knows its bin without the
    raster's range: one aggregation counts the bins, and everything after works
    on bins.  The last bin is closed on the right, empty bins are kept, and a
    raster whose only value is a bin edge has no bins.
    """
    index = F.floor(F.col("v").cast("double") / F.lit(float(bin_size)))
    counted = (
        valid_cells(cells, rasters)
        .select("raster_id", "v", index.alias("i"))
        .groupBy("raster_id", "i")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    return filled_bins(counted, bin_size)


def filled_bins(counted: DataFrame, bin_size: int) -> DataFrame:
    """All bins of each raster from the counts of those that hold cells: ``raster_id, i, n`` and the ends ``lo, hi``."""
    ranges = counted.groupBy("raster_id").agg(
        F.floor(F.min("lo").cast("double") / bin_size).alias("first"),
        F.ceil(F.max("hi").cast("double") / bin_size).alias("stop"),
    )
    # Bins in two steps, so that no row ever holds more than a block of them.
    block = F.lit(BIN_BLOCK)
    blocks = ranges.where("stop > first").select(
        "raster_id",
        "first",
        "stop",
        F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("stop") - 1) / block))).alias("b"),
    )
    inside = F.sequence(F.greatest("first", F.col("b") * block), F.least(F.col("stop"), (F.col("b") + 1) * block) - 1)
    bins = blocks.select("raster_id", F.explode(inside).alias("i"))
    closed = (
        counted.join(ranges, "raster_id")
        .select("raster_id", F.least(F.col("i"), F.col("stop") - 1).alias("i"), "n")
        .groupBy("raster_id", "i")
        .agg(F.sum("n").alias("n"))
    )
    return bins.join(closed, ["raster_id", "i"], "left").select(
        "raster_id", (F.col("i") * bin_size).alias("bin"), F.coalesce("n", F.lit(0)).cast("bigint").alias("cell_count")
    )


def raster_stats(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """Range of the unmasked cells, and how many are masked.

    Masked are NaN and the no-data value.  Where the raster's own minimum lies
    within a thousandth of the stated no-data value, that minimum is the real one.
    """
    numbers = _with_nodata(cells, rasters)
    value = F.when(~F.isnan("v"), F.col("v"))
    # Stored, so that proving its size and joining it do not scan the cells again.
    lowest = stored(numbers.groupBy("raster_id").agg(F.min(value).alias("lowest")), "lowest")
    low, stated = F.col("lowest").cast("double"), F.col("nodata").cast("double")
    marker = F.when(is_close(low, stated, relative=1e-3), F.col("lowest")).otherwise(F.col("nodata"))
    masked = F.isnan("v") | F.coalesce(F.col("v") == marker, F.lit(False))
    return (
        numbers.where("v IS NOT NULL")
        .join(broadcast_if_small(lowest), "raster_id")
        .select("raster_id", "v", masked.alias("masked"))
        .groupBy("raster_id")
        .agg(
            F.min(F.when(~F.col("masked"), F.col("v"))).cast("double").alias("min"),
            F.max(F.when(~F.col("masked"), F.col("v"))).cast("double").alias("max"),
            F.count(F.when(~F.col("masked"), F.lit(1))).alias("valid_cells"),
            F.count(F.when(F.col("masked"), F.lit(1))).alias("masked_cells"),
        )
    )


def _toward_zero(value: Column) -> Column:
    return value.try_cast("bigint")


def cell_under(points: DataFrame, rasters: DataFrame) -> DataFrame:
    """Points with ``nodata`` of their raster and the place of the cell under them, ``cell_row`` and ``cell_col``.

    The cell index truncates toward zero, so a point less than one cell left of
    or above the raster still meets its first column or row.
    """
    facts = rasters.select("raster_id", "left", "cell_width", "top", "cell_height", "nodata")
    return points.join(broadcast_if_small(facts), "raster_id", "left").withColumns(
        {
            "cell_col": _toward_zero((F.col("x") - F.col("left")) / F.col("cell_width")),
            "cell_row": _toward_zero((F.col("y") - F.col("top")) / F.col("cell_height")),
        }
    )


def void_value(value: Column) -> Column:
    """Is a value NaN, or the raster's no-data value as nearly as it may be stored?"""
    return F.isnan(value) | F.coalesce(is_close(value, F.col("nodata"), relative=1e-7), F.lit(False))


def raster_sample(points: DataFrame, cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """Value of the cell under each point; no data, NaN and points outside give null.

    ``points`` has ``raster_id, x, y`` and any other columns, which are kept.
    """
    placed = cell_under(points, rasters)
    grid = cells.select(
        "raster_id", F.col("cell_row").cast("bigint"), F.col("cell_col").cast("bigint"), F.col("value").alias("v")
    )
    value = F.col("v").cast("double")
    return placed.join(grid, ["raster_id", "cell_row", "cell_col"], "left").select(
        *points.columns, F.when(~void_value(value), value).alias("value")
    )


def raster_extent(rasters: DataFrame) -> DataFrame:
    """Right and bottom edge, width, height and boundary ring of each raster."""
    right = F.col("left") + F.col("cell_width") * F.col("cols")
    bottom = F.col("top") + F.col("cell_height") * F.col("rows")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    left, top = F.col("left"), F.col("top")
    return rasters.select(
        "*",
        right.alias("right"),
        bottom.alias("bottom"),
        (right - left).alias("width"),
        (top - bottom).alias("height"),
        F.array(
            corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom), corner(left, top)
        ).alias("boundary"),
    )


def in_bounds(x: Column, y: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Is the point strictly inside the box?"""
    return (west < x) & (south < y) & (east > x) & (north > y)
