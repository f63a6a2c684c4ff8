"""Bounds of layers, and clipping of flowlines to watersheds."""

from __future__ import annotations

import math
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clip import PIECES, Polygons, rebuilt
from ..functions.wkb import LINE, parts_of, wkb_box
from ..session import stored
from .grid import LEAST, overlapping


def layer_bounds(layer: DataFrame, *by: str, geometry: str = "geom") -> DataFrame:
    """Total bounds of a layer, or of each group, and their centre."""
    boxes = layer.select(*by, wkb_box(geometry).alias("box"))
    total = boxes.groupBy(*by).agg(
        F.min("box.min_x").alias("min_x"),
        F.min("box.min_y").alias("min_y"),
        F.max("box.max_x").alias("max_x"),
        F.max("box.max_y").alias("max_y"),
    )
    return total.withColumns(
        {"center_x": (F.col("min_x") + F.col("max_x")) / 2, "center_y": (F.col("min_y") + F.col("max_y")) / 2}
    )


#: A straight piece of a line: its part of the geometry, its place there, its ends.
SEGMENT = "part int, seq int, x1 double, y1 double, x2 double, y2 double"


def line_segments(lines: DataFrame, geometry: str = "geom") -> DataFrame:
    """Straight pieces of line geometries, in order: the other columns, and those of ``SEGMENT``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [f for f in lines.schema.fields if f.name != geometry]
    schema = T.StructType([*others, *T.StructType.fromDDL(SEGMENT)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, part, seq, ends = [], [], [], []
            for row, blob in enumerate(batch.column(geometry)):
                blob = blob.as_py()
                for at, (kind, shape) in enumerate(parts_of(blob) if blob is not None else []):
                    n = len(shape[0]) - 1
                    if kind == LINE and n > 0:
                        owner.append(np.full(n, row))
                        part.append(np.full(n, at, np.int32))
                        seq.append(np.arange(n, dtype=np.int32))
                        ends.append(np.c_[shape[0][:-1], shape[0][1:]])
            if owner:
                taken = batch.take(pa.array(np.concatenate(owner)))
                columns = [taken.column(f.name) for f in others]
                columns += [pa.array(np.concatenate(part)), pa.array(np.concatenate(seq))]
                columns += [pa.array(c) for c in np.concatenate(ends).T.copy()]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return lines.mapInArrow(run, schema)


#: Segments that are cut at a polygon at one time, at most.
CHUNK = 8000
#: Long segments meet polygons in stretches this many times as long as the mean distance between polygons.
STRETCH = 4.0
#: Stretches of one segment, at most.
MOST_STRETCHES = 1_000_000
#: Bytes of polygons that a task holds at one time, at most, unless a single one has more.
BLOCK_BYTES = 40_000_000
#: What a unit of work is worth sending a block's polygons for: bytes of polygons that lines meet, at least so many and
#: so many times the block's own; no more lines than the third.
UNIT_BYTES, UNIT_TIMES, UNIT_LINES = 48_000_000, 40, 100_000
#: Units of a block, and tasks, at most.
MOST_PARTS, MOST_TASKS = 4096, 8192


def _stretch_width(shapes: DataFrame) -> float | None:
    """How long a stretch of a segment is: about the distance between polygons, but no less than their size."""
    wide, high = F.col("p.max_x") - F.col("p.min_x"), F.col("p.max_y") - F.col("p.min_y")
    seen = shapes.agg(
        F.count("p.min_x").alias("n"), F.avg(F.greatest(wide, high)).alias("size"),
        (F.max("p.max_x") - F.min("p.min_x")).alias("w"), (F.max("p.max_y") - F.min("p.min_y")).alias("h"),
    ).first()
    if not seen["n"]:
        return None
    w, h = seen["w"], seen["h"]
    apart = math.sqrt(w * h / seen["n"]) if w and h else max(w, h) / seen["n"]
    width = max(STRETCH * apart, seen["size"])
    return width if 0 < width < math.inf else None


def _stretches(segments: DataFrame, width: float | None) -> DataFrame:
    """Segments as equal stretches up to ``width`` long, with their boxes and those of the stretches before (null: none).

    Boxes are a little too large, and those of one segment go one way along either axis.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*segments.schema, *(T.StructField(c, T.DoubleType()) for c in (*_BOX, *_BOX_BEFORE))])
    arrow, at_once = to_arrow_schema(schema), 100_000

    def boxes(ends: np.ndarray, stretch: np.ndarray, many: np.ndarray) -> np.ndarray:
        slack = np.abs(ends[:, 2:] - ends[:, :2]).max(axis=1) * 1e-9
        low, high = [], []
        for a, b in ((ends[:, 0], ends[:, 2]), (ends[:, 1], ends[:, 3])):
            sides = [np.where(i >= many, b, np.clip(a + (b - a) * (i / many), np.minimum(a, b), np.maximum(a, b))) for i in (stretch, stretch + 1)]
            low.append(np.minimum(*sides) - slack)
            high.append(np.maximum(*sides) + slack)
        return np.array([*low, *high])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")])
            long = np.abs(ends[:, 2:] - ends[:, :2]).max(axis=1)
            many = np.ones(len(ends), np.int64)
            if width:
                known = np.isfinite(long)
                many[known] = np.clip(np.ceil(long[known] / width), 1, MOST_STRETCHES)
            stop = np.cumsum(many)
            for first in range(0, int(stop[-1]) if len(stop) else 0, at_once):
                number = np.arange(first, min(first + at_once, int(stop[-1])))
                row = np.searchsorted(stop, number, side="right")
                stretch = number - (stop - many)[row]
                own, before = (boxes(ends[row], at, many[row]) for at in (stretch, stretch - 1))
                columns = [*batch.take(pa.array(row)).columns, *map(pa.array, own), *(pa.array(c, mask=stretch == 0) for c in before)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return segments.mapInArrow(run, schema)


_BOX, _BOX_BEFORE = ("sx0", "sy0", "sx1", "sy1"), ("bx0", "by0", "bx1", "by1")


def _crossing(segments: DataFrame, shapes: DataFrame, width: float | None, least: float) -> DataFrame:
    """Segments ``x1, y1, x2, y2`` with the polygons whose box ``min_x, ...`` they cross or touch, each pair once.

    The box of a long slanting segment overlaps far more polygons than the
    segment meets, so its stretches look for them: a pair is kept by the first
    stretch that finds it.  Boxes of stretches are a little too large and the
    last test a little too kind: only cutting decides.
    """
    sides = ("min_x", "min_y", "max_x", "max_y")
    met = overlapping(_stretches(segments, width), shapes.select("g", "pid", "parts", "p.*"), _BOX, sides, least)
    b = [F.col(c) for c in sides]
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))

    def touch(box: list[Column]) -> Column:
        return (box[0] <= b[2]) & (box[2] >= b[0]) & (box[1] <= b[3]) & (box[3] >= b[1])

    whole = [F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)]
    found_before = F.coalesce(touch([F.col(c) for c in _BOX_BEFORE]), F.lit(False))
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    off_x, off_y = (b[0] + b[2]) / 2 - x1, (b[1] + b[3]) / 2 - y1
    reach = (dx * (b[3] - b[1]) + dy * (b[2] - b[0])) / 2
    beside = F.abs((x2 - x1) * off_y - (y2 - y1) * off_x) > reach + (reach + dx * F.abs(off_y) + dy * F.abs(off_x)) * 1e-9
    return met.where(touch(whole) & ~found_before & ~beside).drop(*_BOX, *_BOX_BEFORE)


def _blocks(shapes: DataFrame, limit: int) -> tuple[DataFrame, list[Row]]:
    """Polygons with the block they belong to, and the blocks: their polygons, bytes and bounds.

    Polygons of a block lie near each other, large ones apart from small ones,
    and a block has at most ``limit`` bytes or one polygon.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    sides = ("min_x", "min_y", "max_x", "max_y")
    wide, high = F.col("p.max_x") - F.col("p.min_x"), F.col("p.max_y") - F.col("p.min_y")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("polygon")).alias("bytes"), F.avg(F.greatest(wide, high)).alias("size")]
    sums += [(F.min if c.startswith("min") else F.max)(f"p.{c}").alias(c) for c in sides]
    whole = shapes.agg(F.lit(0).cast("bigint").alias("block"), *sums).first()
    if whole["n"] and not all(math.isfinite(whole[c]) for c in sides):
        raise ValueError("a polygon has an infinite coordinate")
    if not whole["n"] or whole["bytes"] <= limit:
        return shapes.withColumn("block", F.lit(0).cast("bigint")), [whole] if whole["n"] else []
    many = math.ceil(whole["bytes"] / limit)
    w, h = whole["max_x"] - whole["min_x"], whole["max_y"] - whole["min_y"]
    large = F.greatest(wide, high) > math.sqrt(w * h / many) / 4
    code = F.lit(0).cast("bigint")
    for low, span, c in ((whole["min_x"], w, "x"), (whole["min_y"], h, "y")):
        place = F.floor(((F.col(f"p.min_{c}") + F.col(f"p.max_{c}")) / 2 - low) / (span or 1.0) * 65535).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            place = place.bitwiseOR(F.shiftleft(place, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        code = F.shiftleft(code, 1).bitwiseOR(place)
    dealt = (
        shapes.withColumns({"large": large, "code": code})
        .repartitionByRange(many, "large", "code")
        .sortWithinPartitions("large", "code")
        .withColumn("block", F.shiftleft(F.spark_partition_id().cast("bigint"), 32))
    )
    schema = dealt.schema
    arrow = to_arrow_schema(schema)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, before = 0, 0, None
        for batch in batches:
            numbers = []
            sizes = pc.binary_length(batch.column("polygon")).to_pylist()
            for size, kind in zip(sizes, batch.column("large").to_pylist()):
                if before is not None and (held + size > limit or kind != before):
                    number, held = number + 1, 0
                held, before = held + size, kind
                numbers.append(number)
            block = pc.add(batch.column("block"), pa.array(numbers, pa.int64()))
            columns = [block if f.name == "block" else batch.column(f.name).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    shapes = stored(dealt.mapInArrow(numbered, schema).drop("large", "code"), "blocks")
    return shapes, shapes.groupBy("block").agg(*sums).collect()


def _apart(block: Row) -> float:
    """The mean distance between polygons of a block."""
    w, h = block["max_x"] - block["min_x"], block["max_y"] - block["min_y"]
    return (math.sqrt(w * h / block["n"]) if w and h else max(w, h) / block["n"]) or 1.0


def _units(blocks: list[Row], work: list[Row]) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """A function that gives rows the first unit of their block and how many it has, and the number of all units.

    A unit is what one task does at a time: the polygons of a block and some of
    the lines that meet it.  A block with much work gives its polygons to several.
    """
    known, rows, first = {b["block"]: b for b in blocks}, [], 0
    for w in work:
        block = known[w["block"]]
        size = (w["met"] or 0.0) * block["bytes"] / block["n"]
        parts = max(size / max(UNIT_BYTES, UNIT_TIMES * block["bytes"]), w["lines"] / UNIT_LINES)
        rows.append((w["block"], first, min(MOST_PARTS, max(1, math.ceil(parts)))))
        first += rows[-1][2]

    def with_units(df: DataFrame) -> DataFrame:
        if len(rows) == 1:
            block, start, parts = (F.lit(v).cast("bigint") for v in rows[0])
            return df.where(F.col("block") == block).withColumns({"first": start, "parts": parts})
        units = df.sparkSession.createDataFrame(rows, "block bigint, first bigint, parts bigint")
        return df.join(F.broadcast(units), "block")

    return with_units, first


def _sent(shapes: DataFrame, lines: DataFrame, blocks: list[Row], work: list[Row]) -> DataFrame:
    """Units in streams: the polygons of each ahead of its lines."""
    with_units, many = _units(blocks, work)
    ahead = with_units(shapes).select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("unit"), "g", "polygon"
    )
    dealt = F.col("first") + F.pmod(F.xxhash64("comid", "line"), F.col("parts"))
    behind = with_units(lines).select(dealt.alias("unit"), "comid", "line", "copies", "geom")
    tasks = min(many, MOST_TASKS)
    together = ahead.unionByName(behind, allowMissingColumns=True)
    dealt = together.repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("unit", F.col("polygon").isNull())


def _cutter(least: float, chunk: int, made: Callable) -> Callable:
    """A function over a stream of units, that gives ``made`` the stretches of some lines at a time."""

    def segments_of(lines: pa.Array) -> tuple[np.ndarray, ...]:
        owner, part, seq, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, 4))]
        for row, blob in enumerate(lines):
            for at, (kind, shape) in enumerate(parts_of(blob.as_py())):
                n = len(shape[0]) - 1
                if kind == LINE and n > 0:
                    owner.append(np.full(n, row))
                    part.append(np.full(n, at))
                    seq.append(np.arange(n))
                    ends.append(np.c_[shape[0][:-1], shape[0][1:]])
        owner, part, seq, ends = (np.concatenate(c) for c in (owner, part, seq, ends))
        sound = np.isfinite(ends).all(axis=1)
        return owner[sound], part[sound], seq[sound], ends[sound]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, blobs, groups, polygons, codes, names = None, [], [], None, None, None
        for batch in batches:
            ahead = batch.column("polygon").is_valid().to_numpy(zero_copy_only=False)
            units = batch.column("unit").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((units[1:] != units[:-1]) | (ahead[1:] != ahead[:-1])) + 1
            for first, last in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                some = batch.slice(first, last - first)
                if not some.num_rows:
                    continue
                if ahead[first]:
                    if units[first] != unit:
                        unit, blobs, groups, polygons = units[first], [], [], None
                    blobs.append(some.column("polygon"))
                    groups.append(some.column("g"))
                    continue
                if polygons is None:
                    polygons = Polygons(pa.chunked_array(blobs), least)
                    coded = pa.chunked_array(groups).combine_chunks().dictionary_encode("encode")
                    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                    blobs, groups = [], []
                owner, part, seq, ends = segments_of(some.column("geom"))
                if not len(owner):
                    continue
                # lines are cut some at a time, so that their pieces fit in memory
                weight = np.cumsum(np.bincount(owner, polygons.weights(ends), some.num_rows))
                start = 0
                while start < some.num_rows:
                    full = (weight[start - 1] if start else 0.0) + PIECES
                    stop = max(start + 1, int(np.searchsorted(weight, full, side="right")))
                    a, b = np.searchsorted(owner, start), np.searchsorted(owner, stop)
                    index, polygon, t0, t1 = polygons.inside(ends[a:b], chunk)
                    code = codes[polygon]
                    # a single line may have very many pieces
                    for c in np.unique(code).tolist() if len(index) > 10 * PIECES else [None]:
                        own = slice(None) if c is None else code == c
                        if len(index):
                            yield made(some, names, index[own], code[own], t0[own], t1[own], owner[a:b], part[a:b], seq[a:b], ends[a:b])
                    start = stop

    return cut


def clip_flowlines(
    flowlines: DataFrame, catchments: DataFrame, cell_size: float | None = None, group: str = "HUC12"
) -> DataFrame:
    """Flowlines cut to the union of the catchments of each group: ``group, comid, length, geom``.

    Catchments tile their watershed, so a line is cut at each catchment and the
    pieces are put together again per group; overlapping catchments do not
    count twice.  A task holds the catchments of a block in grids by size (see
    ``functions.clip``) and cuts the lines that pass behind them;
    ``cell_size`` is the width of the smallest cells, which otherwise suit the
    shapes.  Most lines meet one block and are finished there; the pieces of
    others are gathered by line.  Copies of a line are cut once and given back
    as often as they came; copies of a catchment are dropped.
    """
    spark, least = flowlines.sparkSession, cell_size or LEAST
    shapes = stored(
        catchments.where(F.col("geom").isNotNull())
        .select(F.col(group).alias("g"), F.col("geom").alias("polygon"))
        .distinct()
        .select("g", "polygon", wkb_box("polygon").alias("p")),
        "catchments",
    )
    known = F.lit(True)
    for c in ("min_x", "min_y", "max_x", "max_y"):
        known = known & F.col(f"p.{c}").isNotNull() & ~F.isnan(f"p.{c}")
    shapes, blocks = _blocks(shapes.where(known), BLOCK_BYTES)
    kinds = {"g": shapes.schema["g"].dataType.simpleString(), "comid": flowlines.schema["comid"].dataType.simpleString()}
    result = f"`{group}` {kinds['g']}, comid {kinds['comid']}, copies bigint, length double, geom binary"
    if not blocks:
        return spark.createDataFrame([], result).drop("copies")
    lines = (
        flowlines.where(F.col("geom").isNotNull())
        .groupBy("comid", "geom")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("comid", F.unhex(F.md5("geom")).alias("line"), "copies", "geom")
    )
    if len(blocks) == 1:
        lines = lines.withColumns({"block": F.lit(blocks[0]["block"]), "blocks": F.lit(1)})
    else:
        lines = stored(lines, "lines")
        bounds = shapes.groupBy(F.col("block").alias("pid")).agg(
            F.struct(*[(F.min if c.startswith("min") else F.max)(f"p.{c}").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]).alias("p")
        )
        bounds = stored(bounds.select("pid", "p", F.lit(0).alias("g"), F.lit(1).alias("parts")), "bounds")
        met = _crossing(line_segments(lines.select("comid", "line", "geom")), bounds, _stretch_width(bounds), least)
        met = met.groupBy(F.col("comid").alias("c"), F.col("line").alias("l")).agg(F.collect_set("pid").alias("met"))
        lines = lines.join(met, F.col("comid").eqNullSafe(F.col("c")) & (F.col("line") == F.col("l")))
        lines = lines.select("comid", "line", "copies", "geom", F.explode("met").alias("block"), F.size("met").alias("blocks"))
    apart = sum(map(_apart, blocks)) / len(blocks)

    @F.pandas_udf("double")
    def about(blobs: pd.Series) -> pd.Series:
        """About how many polygons a line meets."""
        found = []
        for blob in blobs:
            steps = [np.abs(np.diff(shape[0], axis=0)) for kind, shape in parts_of(bytes(blob)) if kind == LINE]
            found.append(sum(len(s) + float(np.where(np.isfinite(s), s, 0).sum()) / apart for s in steps))
        return pd.Series(found, dtype="float64")

    lines = stored(lines.withColumn("met", about("geom") / F.col("blocks")), "lines")
    alone = F.col("blocks") == 1
    work = lines.groupBy("block", alone.alias("alone")).agg(F.sum("met").alias("met"), F.count(F.lit(1)).alias("lines")).collect()
    if not work:
        return spark.createDataFrame([], result).drop("copies")
    place = lambda part, seq: part * (int(seq.max()) + 2) + seq
    names = [group, "comid", "copies", "length", "geom"]

    def finished(lines, groups, index, code, t0, t1, owner, part, seq, ends) -> pa.RecordBatch:
        key, lengths, geoms = rebuilt(owner[index] * len(groups) + code, index, t0, t1, place(part, seq), ends)
        row, g = pa.array(key // len(groups)), groups.take(pa.array(key % len(groups)))
        kept = [lines.column("comid").take(row), lines.column("copies").take(row)]
        return pa.RecordBatch.from_arrays([g, *kept, pa.array(lengths), geoms], names)

    def packed(lines, groups, index, code, t0, t1, owner, part, seq, ends) -> pa.RecordBatch:
        key = owner[index] * len(groups) + code
        order = np.argsort(key, kind="stable")
        pieces = np.column_stack([part[index], seq[index], t0, t1, ends[index]])[order].astype("<f8")
        key, heads = np.unique(key[order], return_index=True)
        offsets = np.array([*heads, len(order)]) * pieces.shape[1] * 8
        row, g = pa.array(key // len(groups)), groups.take(pa.array(key % len(groups)))
        kept = [lines.column(c).take(row) for c in ("comid", "line", "copies")]
        data = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pieces))]
        return pa.RecordBatch.from_arrays([g, *kept, pa.Array.from_buffers(pa.binary(), len(key), data)], ["g", "comid", "line", "copies", "pieces"])

    whole = ("g", "comid", "line")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(rows: list[pa.RecordBatch], heads: np.ndarray) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            number = np.searchsorted(heads, np.arange(table.num_rows), side="right") - 1
            blobs = [np.frombuffer(b.as_buffer(), "<f8").reshape(-1, 8) for b in table.column("pieces")]
            pieces = np.concatenate(blobs)
            part, seq = pieces[:, 0].astype(np.int64), pieces[:, 1].astype(np.int64)
            key, lengths, geoms = rebuilt(
                np.repeat(number, [len(b) for b in blobs]), np.arange(len(pieces)), pieces[:, 2], pieces[:, 3], place(part, seq), pieces[:, 4:]
            )
            first = table.take(pa.array(heads[key]))
            kept = [first.column(c).combine_chunks() for c in ("g", "comid", "copies")]
            return pa.RecordBatch.from_arrays([*kept, pa.array(lengths), geoms], names)

        def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
            return all(a.column(c)[i].as_py() == b.column(c)[j].as_py() for c in whole)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for c in whole:
                codes = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            heads = np.flatnonzero(new)
            if held and not same(held[0], 0, batch, 0):
                yield made(held, np.array([0]))
                held = []
            # the last line of a batch may go on in the next
            ends, sizes = [*heads[1:].tolist(), batch.num_rows], pc.binary_length(batch.column("pieces")).to_numpy(zero_copy_only=False)
            first = 0
            while first < len(heads) - 1:
                bytes_so_far, last = 0, first
                while last < len(heads) - 1 and (last == first or bytes_so_far < 64 * PIECES):
                    bytes_so_far += int(sizes[heads[last] : ends[last]].sum())
                    last += 1
                rows = [*held, batch.slice(heads[first], ends[last - 1] - heads[first])]
                more = sum(b.num_rows for b in held)
                starts = heads[first:last] - heads[first] + more
                starts[0] = 0
                yield made(rows, starts)
                held, first = [], last
            held.append(batch.slice(heads[-1]))
        if held:
            yield made(held, np.array([0]))

    chunk, branches = CHUNK, []
    some = [w for w in work if w["alone"]]
    if some:
        sent = _sent(shapes, lines.where(alone), blocks, some)
        branches.append(sent.mapInArrow(_cutter(least, chunk, finished), result))
    some = [w for w in work if not w["alone"]]
    if some:
        sent = _sent(shapes, lines.where(~alone), blocks, some)
        pieces = f"g {kinds['g']}, comid {kinds['comid']}, line binary, copies bigint, pieces binary"
        pieces = sent.mapInArrow(_cutter(least, chunk, packed), pieces)
        branches.append(pieces.repartition(*whole).sortWithinPartitions(*whole).mapInArrow(gathered, result))
    rebuilt_lines = branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return rebuilt_lines.select("*", again.alias("copy")).drop("copies", "copy")
