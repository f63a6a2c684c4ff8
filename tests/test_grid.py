"""Boxes of unlike sizes meet through a hierarchy of grids."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import grid

LEFT, RIGHT = ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")


def boxes(rng, count, sizes):
    out = []
    for i in range(count):
        w, h = rng.choice(sizes) * rng.random(), rng.choice(sizes) * rng.random()
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        out.append((i, x, y, x + w, y + h))
    return out


def frame(spark, rows, names, key):
    return spark.createDataFrame(rows, f"{key} long, " + ", ".join(f"{n} double" for n in names))


def brute(a, b):
    return sorted((p[0], q[0]) for p in a for q in b if None not in p and None not in q and p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])


@pytest.mark.parametrize("sizes", [(1.0,), (0.1, 1000.0), (0.0,), (0.1, 3.0, 40.0, 1000.0)])
def test_pairs_against_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    a, b = boxes(rng, 150, sizes), boxes(rng, 120, sizes[::-1] + (5.0,))
    a += [(900, None, 0.0, 1.0, 1.0), (901, float("nan"), 0.0, 1.0, 1.0), (902, 0.0, 0.0, 0.0, 0.0), (903, -1e9, -1e9, 1e9, 1e9), (904, 7e5, 0.0, 7e5, 1.0)]
    b += [(800, None, None, None, None), (801, 0.0, 0.0, 4.0, 4.0), (802, 4.0, 4.0, 4.0, 4.0)]
    got = grid.overlapping(frame(spark, a, LEFT, "i"), frame(spark, b, RIGHT, "j"), LEFT, RIGHT)
    clean = [p for p in a if p[1] == p[1]]
    assert sorted((r.i, r.j) for r in got.collect()) == brute(clean, b)


def test_a_box_lists_four_cells_a_level_whatever_its_size(spark):
    rng = random.Random(5)
    a, b = boxes(rng, 60, (0.1, 1000.0)), boxes(rng, 60, (0.1, 1000.0))
    a += [(70, -500.0, -500.0, 500.0, 500.0)]
    b += [(71, -500.0, -500.0, 500.0, 500.0), (72, 3.0, 3.0, 3.1, 3.1)]
    for rows, key in zip(grid.cell_rows(frame(spark, a, LEFT, "i"), frame(spark, b, RIGHT, "j"), LEFT, RIGHT), "ij"):
        listed = rows.groupBy(key, "level", "kind").agg(F.count(F.lit(1)).alias("cells"))
        assert listed.agg(F.max("cells")).first()[0] <= 4
        own = rows.where(f"kind = {grid.OWN}").groupBy(key).agg(F.countDistinct("level").alias("levels"))
        assert rows.select(key).distinct().count() > 50 and own.agg(F.max("levels")).first()[0] <= 9


def test_no_boxes(spark):
    a, b = frame(spark, [(1, 0.0, 0.0, 1.0, 1.0)], LEFT, "i"), frame(spark, [], RIGHT, "j")
    assert grid.overlapping(a, b, LEFT, RIGHT).count() == 0
    assert grid.overlapping(a.limit(0), frame(spark, [(1, 0.0, 0.0, 1.0, 1.0)], RIGHT, "j"), LEFT, RIGHT).count() == 0
    plan = grid.overlapping(a, frame(spark, [(1, 0.0, 0.0, 1.0, 1.0)], RIGHT, "j"), LEFT, RIGHT)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
