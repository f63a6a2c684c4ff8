import math
import random

import numpy as np
import pyarrow as pa
import pytest

from thalweg.functions import clip
from thalweg.functions.wkb import line_wkb, multi_line_wkb, parts_of, polygon_wkb
from thalweg.operators import grid, spatial


def square(x, y, size=1.0):
    return polygon_wkb([[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]])


def star(r, x, y, size, n):
    turns = sorted(r.random() * 2 * math.pi for _ in range(n))
    ring = [(x + size * math.cos(t) * r.uniform(0.5, 1), y + size * math.sin(t) * r.uniform(0.5, 1)) for t in turns]
    return polygon_wkb([[*ring, ring[0]]])


def shapes_and_ends(seed):
    r = random.Random(seed)
    shapes = [square(float(x), float(y)) for x in range(12) for y in range(12)]
    shapes += [star(r, r.uniform(-5, 15), r.uniform(-5, 15), 4 ** r.uniform(-4, 2), r.randint(3, 40)) for _ in range(150)]
    ends = [[r.uniform(-10, 20) for _ in range(4)] for _ in range(150)]
    ends += [[3.0, -2.0, 3.0, 14.0], [-4.0, 5.0, 20.0, 5.0], [2.5, 2.5, 2.5, 2.5], [11.0, 11.0, -1.0, -1.0], [1e7, 1e7, -1e7, -1e7 + 3]]
    return shapes, np.array(ends)


@pytest.mark.parametrize("least", [1e-9, 3.0])
def test_each_polygon_that_a_segment_meets_is_found_once(least):
    shapes, ends = shapes_and_ends(1)
    polygons = clip.Polygons(pa.chunked_array([pa.array(shapes[:100], pa.binary()), pa.array(shapes[100:], pa.binary())]), least)
    found = [(int(s), int(polygons.owner[p])) for a, b in polygons._pairs(ends) for s, p in zip(a, b)]
    boxes = [np.concatenate(parts_of(b)[0][1]) for b in shapes]
    want = set()
    for p, ring in enumerate(boxes):
        (x0, y0), (x1, y1) = ring.min(axis=0), ring.max(axis=0)
        for s, (ax, ay, bx, by) in enumerate(ends):
            reach = (abs(bx - ax) * (y1 - y0) + abs(by - ay) * (x1 - x0)) / 2
            off = abs((bx - ax) * ((y0 + y1) / 2 - ay) - (by - ay) * ((x0 + x1) / 2 - ax))
            if min(ax, bx) <= x1 and max(ax, bx) >= x0 and min(ay, by) <= y1 and max(ay, by) >= y0 and off <= reach:
                want.add((s, p))
    assert len(found) == len(set(found)) and want <= set(found) and len(found) < len(want) * 1.01 + 10


def test_stretches_by_many_points():
    shapes, ends = shapes_and_ends(2)
    ends = ends[np.abs(ends).max(axis=1) < 1e6]
    polygons = clip.Polygons(pa.chunked_array([pa.array(shapes, pa.binary())]), 1e-9)
    segment, polygon, t0, t1 = polygons.inside(ends, 8000)
    assert (t1 > t0).all()
    got = np.zeros((len(ends), len(shapes)))
    np.add.at(got, (segment, polygon), t1 - t0)
    middles = (np.arange(2000) + 0.5) / 2000
    for p, blob in enumerate(shapes):
        ring = parts_of(blob)[0][1][0]
        (ax, ay), (bx, by) = ring[:-1].T, ring[1:].T
        for s in range(0, len(ends), 7):
            x = (ends[s, 0] + (ends[s, 2] - ends[s, 0]) * middles)[:, None]
            y = (ends[s, 1] + (ends[s, 3] - ends[s, 1]) * middles)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                odd = (((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))).sum(axis=1) % 2 == 1
            on_edge = ends[s, 0] == ends[s, 2] or ends[s, 1] == ends[s, 3]
            assert on_edge or abs(got[s, p] - odd.mean()) < 0.01


def test_lines_meet_in_keys_places_and_order():
    ends = np.array([[0.0, 0.0, 4.0, 0.0], [4.0, 0.0, 4.0, 4.0], [9.0, 9.0, 9.0, 8.0]])
    places = np.array([0, 1, 5])
    rows = [(7, 0, 0.5, 1.0), (7, 1, 0.0, 0.25), (7, 0, 0.0, 0.25), (3, 2, 0.0, 1.0), (7, 0, 0.25, 0.3), (7, 1, 0.1, 0.2), (7, 1, 0.2, 0.5)]
    key, segment, t0, t1 = (np.array(c) for c in zip(*rows))
    keys, lengths, geoms = clip.rebuilt(key, segment, t0.astype(float), t1.astype(float), places, ends)
    assert keys.tolist() == [3, 7] and lengths.tolist() == pytest.approx([1.0, 1.2 + 2.0 + 2.0])
    assert geoms[0].as_py() == multi_line_wkb([[(9.0, 9.0), (9.0, 8.0)]])
    assert geoms[1].as_py() == multi_line_wkb([[(0.0, 0.0), (1.2, 0.0)], [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0)]])


def result(lines, areas):
    return sorted((str(r.HUC12), str(r.comid), round(r.length, 9), bytes(r.geom)) for r in spatial.clip_flowlines(lines, areas).collect())


def tables(spark, folder):
    r = random.Random(3)
    areas = [(r.choice(["a", "b", None]), bytearray(b)) for b in shapes_and_ends(3)[0]] + [("c", bytearray(square(-20.0, -20.0, 60.0))), ("c", None)]
    lines = []
    for i in range(60):
        points = [(r.uniform(-8, 18), r.uniform(-8, 18)) for _ in range(r.randint(2, 9))]
        lines.append((i % 40 or None, bytearray(line_wkb(points) if i % 5 else multi_line_wkb([points, points[::-1], points[:1]]))))
    for name, rows, schema in (("areas", areas + areas[:9], "HUC12 string, geom binary"), ("lines", lines + lines[:7] + [(1, None)], "comid bigint, geom binary")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/lines"), spark.read.parquet(f"{folder}/areas")


def test_blocks_and_steps_of_any_size_give_the_same_lines(spark, tmp_path, monkeypatch):
    lines, areas = tables(spark, tmp_path)
    whole = result(lines, areas)
    assert len({(c, g) for g, c, *_ in whole}) > 100 and len(whole) > len({(c, g) for g, c, *_ in whole})
    monkeypatch.setattr(spatial, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(spatial, "UNIT_LINES", 7)
    monkeypatch.setattr(spatial, "PIECES", 50)
    assert result(lines, areas) == whole


def test_a_block_holds_no_more_bytes_than_it_may(spark, tmp_path):
    areas = tables(spark, tmp_path)[1].where("geom IS NOT NULL").selectExpr("HUC12 AS g", "geom AS polygon")
    shapes, blocks = spatial._blocks(areas.withColumn("p", spatial.wkb_box("polygon")), 5_000)
    assert sum(b["n"] for b in blocks) == areas.count() == shapes.count()
    assert len(blocks) > 4 and all(b["bytes"] <= 5_000 or b["n"] == 1 for b in blocks)


def test_rows_listed_in_cells_are_not_broadcast(spark, tmp_path):
    """The planner takes them for as few as the rows they come from: at 360 000 suppliers the broadcast failed."""
    lines, areas = tables(spark, tmp_path)
    assert "cx#" not in spatial.clip_flowlines(lines, areas)._jdf.queryExecution().toString()
    sides = [("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1")]
    for side, name in zip(sides, "ab"):
        rows = spark.createDataFrame([(float(i), 0.0, i + 5.0, 1.0) for i in range(50)], [f"{c}" for c in side])
        rows.write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    met = grid.overlapping(a, b, *sides)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().toString()
    assert met.count() == sum(abs(i - j) <= 5 for i in range(50) for j in range(50))


def test_nothing_to_clip_or_to_clip_with(spark):
    areas = spark.createDataFrame([("a", bytearray(square(0.0, 0.0)))], "HUC12 string, geom binary")
    lines = spark.createDataFrame([(1, bytearray(line_wkb([(0.5, 0.5), (0.5, 3.0)])))], "comid bigint, geom binary")
    open_ended = bytearray(polygon_wkb([[(0.0, 0.0), (math.inf, 0.0), (1.0, 1.0), (0.0, 0.0)]]))
    unknown = bytearray(polygon_wkb([[(0.0, 0.0), (math.nan, 0.0), (1.0, 1.0), (0.0, 0.0)]]))
    far = spark.createDataFrame([("a", unknown), ("b", bytearray(square(5.0, 5.0)))], "HUC12 string, geom binary")
    with pytest.raises(ValueError):
        spatial.clip_flowlines(lines, spark.createDataFrame([("a", open_ended)], "HUC12 string, geom binary"))
    for got in (spatial.clip_flowlines(lines.limit(0), areas), spatial.clip_flowlines(lines, areas.limit(0)), spatial.clip_flowlines(lines, far)):
        assert got.columns == ["HUC12", "comid", "length", "geom"] and got.count() == 0
    assert [r.length for r in spatial.clip_flowlines(lines, areas).collect()] == [0.5]
