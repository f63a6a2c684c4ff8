"""Tiles give what single cells give, and decode no more than they must."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import raster, raster_tiles

CELL = "raster_id int, cell_row int, cell_col int, value double"
FACTS = "raster_id int, left double, cell_width double, top double, cell_height double, cols bigint, rows bigint, nodata double"


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(raster_tiles, "SIDE", 8)
    monkeypatch.setattr(raster_tiles, "POINTS", 20)


def data(spark):
    rng = random.Random(3)
    rows = []
    for r in range(4):
        for y in range(-3, 30):
            for x in range(25):
                kind = rng.random()
                flat = (y // 8 + x // 8) % 3 == 0  # whole tiles of one value
                value = 4.25 if flat else -9999.0 if kind < 0.1 and r != 3 else float("nan") if kind < 0.2 else None if kind < 0.25 else rng.uniform(-30, 60) + 0.1
                if kind < 0.97 and not (r == 2 and x > 15):
                    rows.append((r, y, x, -9998.5 if r == 1 and value == -9999.0 else value))
    rows += [(9, 0, i, float("nan")) for i in range(5)]
    facts = [(r, 100.0 * r, 10.0, 500.0, -10.0, 25, 30, n) for r, n in ((0, -9999.0), (1, -9999.0), (2, 4.25), (3, None), (9, 1.0))]
    return spark.createDataFrame(rows, CELL).repartition(5), spark.createDataFrame(facts, FACTS)


def same(a, b):
    rows = lambda df: sorted(map(repr, df.select(sorted(b.columns)).collect()))
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_summaries_equal_those_of_cells(spark, tmp_path):
    cells, facts = data(spark)
    raster_tiles.write_tiles(cells, str(tmp_path / "t"))
    tiles = spark.read.parquet(str(tmp_path / "t"))
    same(raster_tiles.tile_categories(tiles, facts), raster.raster_categories(cells, facts))
    same(raster_tiles.tile_summary(tiles, facts), raster.raster_summary(cells, facts))
    for size in (7, 100):
        same(raster_tiles.tile_histogram(tiles, facts, size), raster.raster_histogram(cells, facts, size))
    same(raster_tiles.tile_stats(tiles, facts), raster.raster_stats(cells, facts))


def test_samples_equal_those_of_cells(spark):
    cells, facts = data(spark)
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 2, 3, 9, 77]), rng.uniform(-60, 500), rng.uniform(150, 560), "kept") for i in range(400)]
    rows += [(1000 + i, 0, 55.0, 455.0, None) for i in range(100)] + [(2000, None, 1.0, 1.0, ""), (2001, 0, None, 1.0, ""), (2002, 0, float("nan"), 455.0, "")]
    points = spark.createDataFrame(rows, "point long, raster_id int, x double, y double, note string")
    same(raster_tiles.tile_sample(points, raster_tiles.tiles_of(cells), facts), raster.raster_sample(points, cells, facts))


def test_tiles_are_pruned_by_their_range(spark, tmp_path):
    cells, facts = data(spark)
    raster_tiles.write_tiles(cells, str(tmp_path / "t"))
    tiles = spark.read.parquet(str(tmp_path / "t"))
    found = raster_tiles.tile_cells(tiles, 55.0, 58.5)
    want = cells.where("value >= 55 AND value <= 58.5 AND NOT isnan(value)")
    assert sorted(map(tuple, found.collect())) == sorted((r[0], r[1], r[2], r[3]) for r in want.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(lo" in plan or "PushedFilters: [IsNotNull(lo" in plan
    assert tiles.where("hi < 55").count() > 10
    # what no-data can't touch is summed up without reading the cells
    clear = raster_tiles.tile_summary(tiles, facts)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in clear.splitlines() if "FileScan" in line]
    assert any("data" not in line.split("[")[1].split("]")[0] for line in scans)


def test_a_cell_given_twice_fails(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 0, 1.0)], CELL)
    with pytest.raises(Exception, match="cell twice"):
        raster_tiles.tiles_of(cells).collect()
    assert raster_tiles.tiles_of(cells.limit(0)).count() == 0
