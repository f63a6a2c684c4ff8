"""Rasters as tiles: a block of cells in one row, with its range, so that summaries decode only the blocks they must.

A tile is ``raster_id, tile_row, tile_col``, the number of its cells that hold a
number (``n``) or NaN (``n_nan``), the least and largest number as 32-bit floats
(``lo``, ``hi``), and its cells: ``data``, 64-bit floats row by row, and
``held``, a bit for each cell that has a value.  The operators give what those
of ``operators.raster`` give over single cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_close
from ..session import broadcast_if_small
from .raster import cell_under, filled_bins, void_value

#: Cells along an edge of a tile.
SIDE = 256
#: Points of a tile that one task looks up at a time.
POINTS = 100_000

TILE = "raster_id {0}, tile_row long, tile_col long, n long, n_nan long, lo float, hi float, data binary, held binary"


def tiles_of(cells: DataFrame) -> DataFrame:
    """Tiles of a long cell table ``raster_id, cell_row, cell_col, value``; a cell that is given twice fails the job.

    A tile gathers at most ``SIDE`` squared cells.  Cells without a value, and
    those that aren't listed, are not held.
    """
    kind = cells.schema["raster_id"].dataType.simpleString()
    row, col = F.col("cell_row").cast("long"), F.col("cell_col").cast("long")
    placed = cells.select(
        "raster_id", F.floor(row / SIDE).alias("tile_row"), F.floor(col / SIDE).alias("tile_col"),
        (F.pmod(row, F.lit(SIDE)) * SIDE + F.pmod(col, F.lit(SIDE))).cast("int").alias("at"), F.col("value").cast("double").alias("value"),
    ).where("raster_id IS NOT NULL AND at IS NOT NULL AND value IS NOT NULL")

    def build(keys: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at, values = rows.column("at").to_numpy(), rows.column("value").to_numpy()
        data, held = np.zeros(SIDE * SIDE), np.zeros(SIDE * SIDE, bool)
        data[at], held[at] = values, True
        if held.sum() != len(at):
            raise ValueError(f"raster {keys[0]} has a cell twice")
        numbers = values.astype(np.float32)
        numbers = numbers[~np.isnan(numbers)]
        ends = (numbers.min(), numbers.max()) if len(numbers) else (None, None)
        columns = [pa.array([k.as_py()], k.type) for k in keys]
        columns += [pa.array([len(numbers)]), pa.array([len(at) - len(numbers)]), *(pa.array([e], pa.float32()) for e in ends)]
        columns += [pa.array([data.tobytes()]), pa.array([np.packbits(held).tobytes()])]
        return pa.table(columns, names)

    names = [part.split()[0] for part in TILE.split(", ")]
    return placed.groupBy("raster_id", "tile_row", "tile_col").applyInArrow(build, TILE.format(kind))


def write_tiles(cells: DataFrame, path: str) -> None:
    """Store tiles, those of a raster together, so that ranges and places prune files."""
    tiles_of(cells).sortWithinPartitions("raster_id", "tile_row", "tile_col").write.parquet(path)


def _decoded(data: bytes, held: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a tile's cells."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8)))
    return at, np.frombuffer(data, np.float64)[at]


def _with_nodata(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    facts = rasters.select("raster_id", F.col("nodata").cast("float").alias("nodata"))
    return tiles.join(broadcast_if_small(facts), "raster_id", "left")


def _touched(marker: str = "nodata") -> Column:
    """May a tile hold the marker?  Only then does what it holds depend on single cells."""
    return F.coalesce(F.col(marker).between(F.col("lo"), F.col("hi")), F.lit(False))


def _per_tile(tiles: DataFrame, columns: str, function: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Rows that ``function`` makes of each tile's valid values, with the raster's id."""
    kind = tiles.schema["raster_id"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row].as_py() for c in ("data", "held", "nodata")}
                values = _decoded(cell["data"], cell["held"])[1].astype(np.float32)
                values = values[~np.isnan(values)]
                made = function(values if cell["nodata"] is None else values[values != np.float32(cell["nodata"])])
                size = len(made[names[0]])
                if size:
                    ids = batch.column("raster_id").take(pa.array(np.full(size, row)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(made[c]) for c in names)], ["raster_id", *names])

    return tiles.select("raster_id", "data", "held", "nodata").mapInArrow(run, f"raster_id {kind}, {columns}")


def tile_categories(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Valid cells per whole value (truncated toward zero).  Tiles whose numbers share one are not decoded."""
    tagged = _with_nodata(tiles.where("n > 0"), rasters)
    whole = lambda c: F.col(c).cast("bigint")
    flat = ~_touched() & (whole("lo") == whole("hi"))

    def counted(values: np.ndarray) -> dict[str, np.ndarray]:
        found, n = np.unique(np.trunc(values).astype(np.int64), return_counts=True)
        return {"category": found, "cell_count": n.astype(np.int64)}

    parts = _per_tile(tagged.where(~flat), "category long, cell_count long", counted)
    alike = tagged.where(flat).select("raster_id", whole("lo").alias("category"), F.col("n").alias("cell_count"))
    every = parts.unionByName(alike).groupBy("raster_id", "category").agg(F.sum("cell_count").alias("cell_count"))
    return every.withColumn("category", F.col("category").cast("string"))


def tile_summary(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Smallest and largest valid value and the number of valid cells; decoded are tiles that may hold no-data cells."""
    tagged = _with_nodata(tiles.where("n > 0"), rasters)

    def ends(values: np.ndarray) -> dict[str, np.ndarray]:
        some = values[:1]
        return {"lo": np.minimum.reduce(values, keepdims=True) if len(some) else some, "hi": np.maximum.reduce(values, keepdims=True) if len(some) else some,
                "n": np.full(len(some), len(values), np.int64)}

    parts = _per_tile(tagged.where(_touched()), "lo float, hi float, n long", ends)
    clear = tagged.where(~_touched()).select("raster_id", "lo", "hi", "n")
    return parts.unionByName(clear).groupBy("raster_id").agg(
        F.min("lo").cast("double").alias("min"), F.max("hi").cast("double").alias("max"), F.sum("n").alias("value_count")
    )


def tile_histogram(tiles: DataFrame, rasters: DataFrame, bin_size: int = 100) -> DataFrame:
    """Valid cells per bin, as ``raster.raster_histogram`` has them.  Tiles that lie in one bin are not decoded."""
    tagged = _with_nodata(tiles.where("n > 0"), rasters)
    place = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(bin_size)))
    flat = ~_touched() & (place("lo") == place("hi"))

    def counted(values: np.ndarray) -> dict[str, np.ndarray]:
        bins, which, n = np.unique(np.floor(values.astype(np.float64) / bin_size).astype(np.int64), return_inverse=True, return_counts=True)
        low, high = np.full(len(bins), np.inf, np.float32), np.full(len(bins), -np.inf, np.float32)
        np.minimum.at(low, which.ravel(), values)
        np.maximum.at(high, which.ravel(), values)
        return {"i": bins, "n": n.astype(np.int64), "lo": low, "hi": high}

    parts = _per_tile(tagged.where(~flat), "i long, n long, lo float, hi float", counted)
    alike = tagged.where(flat).select("raster_id", place("lo").alias("i"), "n", "lo", "hi")
    summed = parts.unionByName(alike).groupBy("raster_id", "i").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return filled_bins(summed, bin_size)


def tile_stats(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Range of the unmasked cells, and how many are masked, as ``raster.raster_stats`` has them."""
    lowest = tiles.groupBy("raster_id").agg(F.min("lo").alias("lowest"))
    tagged = _with_nodata(lowest, rasters)
    close = is_close(F.col("lowest").cast("double"), F.col("nodata").cast("double"), relative=1e-3)
    marker = tagged.select("raster_id", F.when(close, F.col("lowest")).otherwise(F.col("nodata")).alias("nodata"))
    marked = tiles.join(broadcast_if_small(marker), "raster_id", "left")

    def ends(values: np.ndarray) -> dict[str, np.ndarray]:
        few = np.array([np.nan], np.float32) if not len(values) else values
        return {"lo": few.min(keepdims=True), "hi": few.max(keepdims=True), "valid": np.array([len(values)])}

    # a row per tile comes back in any case, so that its masked cells are counted
    parts = _per_tile(marked.where(_touched()), "lo float, hi float, valid long", ends)
    numbers = F.when(F.col("valid") > 0, F.col("lo")), F.when(F.col("valid") > 0, F.col("hi"))
    decoded = parts.select("raster_id", numbers[0].alias("lo"), numbers[1].alias("hi"), "valid", F.lit(0).cast("long").alias("cells"))
    clear = marked.where(~_touched()).select("raster_id", "lo", "hi", F.col("n").alias("valid"), F.lit(0).cast("long").alias("cells"))
    totals = tiles.select("raster_id", F.lit(None).cast("float").alias("lo"), F.lit(None).cast("float").alias("hi"),
                          F.lit(0).cast("long").alias("valid"), (F.col("n") + F.col("n_nan")).alias("cells"))
    return decoded.unionByName(clear).unionByName(totals).groupBy("raster_id").agg(
        F.min("lo").cast("double").alias("min"), F.max("hi").cast("double").alias("max"),
        F.sum("valid").alias("valid_cells"), (F.sum("cells") - F.sum("valid")).alias("masked_cells"),
    )


def tile_sample(points: DataFrame, tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Value of the cell under each point, as ``raster.raster_sample`` has it; points meet tiles, not cells.

    A tile with very many points is copied to several tasks, each with a share
    of them.
    """
    placed = cell_under(points, rasters)
    tile = lambda c: F.floor(F.col(c) / SIDE)
    at = F.pmod(F.col("cell_row"), F.lit(SIDE)) * SIDE + F.pmod(F.col("cell_col"), F.lit(SIDE))
    placed = placed.withColumns({"tile_row": tile("cell_row"), "tile_col": tile("cell_col"), "at": at.cast("int")})
    keys = ["raster_id", "tile_row", "tile_col"]
    counts = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(POINTS)).alias("shares"))
    named = counts.select(*[F.col(k).alias(f"of_{k}") for k in keys], "shares")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    dealt = placed.join(named, same[0] & same[1] & same[2])
    # by the point's own columns, so a task that is repeated deals alike
    plain = [f.name for f in points.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    share = F.pmod(F.xxhash64(*plain), F.col("shares"))
    dealt = dealt.select(*placed.columns, share.alias("share"))
    copies = tiles.join(counts, keys).select(*keys, "data", "held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    kept = [f for f in placed.schema.fields if f.name in points.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", nodata double, v double"

    def look(asked: pa.Table, found: pa.Table) -> pa.Table:
        values = np.full(asked.num_rows, np.nan)
        held = np.zeros(asked.num_rows, bool)
        if found.num_rows and asked.num_rows:
            cells, filled = np.frombuffer(found.column("data")[0].as_py(), np.float64), np.unpackbits(np.frombuffer(found.column("held")[0].as_py(), np.uint8))
            place = asked.column("at").to_numpy()
            values, held = cells[place], filled[place].astype(bool)
        columns = [asked.column(f.name) for f in kept] + [asked.column("nodata"), pa.array(values, mask=~held)]
        return pa.table(columns, [*(f.name for f in kept), "nodata", "v"])

    met = dealt.groupBy(*keys, "share").cogroup(copies.groupBy(*keys, "share")).applyInArrow(look, schema)
    value = F.col("v")
    return met.select(*[f.name for f in kept], F.when(~void_value(value), value).alias("value"))


def tile_cells(tiles: DataFrame, low: float, high: float) -> DataFrame:
    """Cells whose value lies from ``low`` to ``high``: ``raster_id, cell_row, cell_col, value``; other tiles aren't read."""
    kind = tiles.schema["raster_id"].dataType.simpleString()
    # ends as 32-bit floats may lie a little inside the values they stand for
    reach = lambda x, to: float(np.nextafter(np.float32(x), np.float32(to)))
    near = tiles.where((F.col("lo") <= reach(high, np.inf)) & (F.col("hi") >= reach(low, -np.inf)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, values = _decoded(batch.column("data")[row].as_py(), batch.column("held")[row].as_py())
                inside = (values >= low) & (values <= high)
                at, values = at[inside], values[inside]
                if len(at):
                    corner = [batch.column(c)[row].as_py() * SIDE for c in ("tile_row", "tile_col")]
                    ids = batch.column("raster_id").take(pa.array(np.full(len(at), row)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(corner[0] + at // SIDE), pa.array(corner[1] + at % SIDE), pa.array(values)], ["raster_id", "cell_row", "cell_col", "value"])

    return near.select("raster_id", "tile_row", "tile_col", "data", "held").mapInArrow(run, f"raster_id {kind}, cell_row long, cell_col long, value double")
