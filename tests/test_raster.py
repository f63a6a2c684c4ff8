import random

import numpy as np
import pytest

from thalweg.operators import raster

CELL = "raster_id int, cell_row int, cell_col int, value double"
FACTS = "raster_id int, left double, cell_width double, top double, cell_height double, cols bigint, rows bigint, nodata double"


def cells(spark, values, raster_id=1):
    return spark.createDataFrame([(raster_id, i // 10, i % 10, v) for i, v in enumerate(values)], CELL)


def facts(spark, nodata, raster_id=1):
    return spark.createDataFrame([(raster_id, 100.0, 10.0, 500.0, -10.0, 10, 3, nodata)], FACTS)


@pytest.mark.parametrize("size", [100, 7])
def test_histogram_equals_numpy(spark, size):
    rng = random.Random(size)
    values = [rng.uniform(-350, 900) for _ in range(500)] + [100.0, 200.0, 900.0, -9999.0]
    got = {r.bin: r.cell_count for r in raster.raster_histogram(cells(spark, values), facts(spark, -9999.0), size).collect()}
    valid = np.array([v for v in values if v != -9999.0], dtype="f4")
    low, high = int(np.floor(valid.min() / size) * size), int(np.ceil(valid.max() / size) * size)
    counts, edges = np.histogram(valid, bins=np.arange(low, high + size, size))
    assert got == dict(zip(edges[:-1].tolist(), counts.tolist())) and sum(got.values()) == len(valid)


def test_histogram_edges(spark):
    bins = lambda *v: {r.bin: r.cell_count for r in raster.raster_histogram(cells(spark, v), facts(spark, None), 10).collect()}
    assert bins(0.0, 10.0, 20.0) == {0: 1, 10: 2}
    assert bins(20.0, 20.0) == {} and bins(25.0) == {20: 1} and bins(0.0, 35.0) == {0: 1, 10: 0, 20: 0, 30: 1}
    assert bins() == {}


def test_categories(spark):
    got = raster.raster_categories(cells(spark, [1.0, 1.0, 2.9, -2.9, 255.0, None, float("nan")]), facts(spark, 255.0)).collect()
    assert {r.category: r.cell_count for r in got} == {"1": 2, "2": 1, "-2": 1}


def test_stats_mask_imprecise_nodata(spark):
    stats = lambda nodata, *v: tuple(raster.raster_stats(cells(spark, v), facts(spark, nodata)).first())[1:]
    assert stats(-9999.0, -9998.5, -9998.5, 3.0, 8.0, float("nan")) == (3.0, 8.0, 2, 3)
    assert stats(-9999.0, 3.0, 8.0) == (3.0, 8.0, 2, 0)
    assert stats(5.0, 3.0, 5.0, 8.0) == (3.0, 8.0, 2, 1)
    assert stats(None, 3.0, 5.0) == (3.0, 5.0, 2, 0)


def test_sample_truncates_toward_zero(spark):
    grid = cells(spark, [float(i) for i in range(30)])
    points = spark.createDataFrame(
        [("first", 1, 100.0, 500.0), ("just left", 1, 95.0, 499.0), ("outside", 1, 80.0, 499.0), ("row one", 1, 125.0, 485.0),
         ("below", 1, 100.0, 400.0), ("void", 1, 171.0, 499.0), ("other", 2, 100.0, 500.0)],
        "name string, raster_id int, x double, y double")
    got = {r.name: r.value for r in raster.raster_sample(points, grid, facts(spark, 7.0)).collect()}
    assert got == {"first": 0.0, "just left": 0.0, "outside": None, "row one": 12.0, "below": None, "void": None, "other": None}


def test_extent(spark):
    row = raster.raster_extent(facts(spark, None)).first()
    assert (row.right, row.bottom, row.width, row.height, len(row.boundary)) == (200.0, 470.0, 100.0, 30.0, 5)
