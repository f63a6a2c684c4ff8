"""Labelled networks against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import network, reach_labels


def edges(spark, rows):
    return spark.createDataFrame(rows, "comid bigint, tocomid bigint, length_km double")


def search(rows, start, limit):
    best, todo = {start: 0.0}, [start]
    while todo:
        at = todo.pop()
        for c, t, km in rows:
            km = km or 0.0
            if t == at and c is not None and best[at] + km <= limit and best[at] + km < best.get(c, 1e9):
                best[c] = best[at] + km
                todo.append(c)
    return best


def found(labels, spark, starts, limit):
    got = {s: {} for s in starts}
    for r in network.upstream_many(labels, spark.createDataFrame([(s,) for s in starts] * 2, "comid bigint"), limit).collect():
        assert r.comid not in got[r.start]
        got[r.start][r.comid] = r.distance_km
    return got


def test_ranges_of_a_forest(spark):
    rows = [(k, (k - 1) // 2 if k else None, 1.0 + k % 3) for k in range(200)] + [(1000 + k, 999, 0.5) for k in range(30)]
    labels = network.label_network(edges(spark, rows))
    assert labels.gates is None
    by = {r.comid: r for r in labels.reaches.collect()}
    children = {}
    for c, t, _ in rows:
        children.setdefault(t, []).append(c)

    def above(c):
        return {c}.union(*(above(k) for k in children.get(c, [])))

    for c, r in by.items():
        assert {k for k, x in by.items() if x.tree == r.tree and r.first <= x.first <= r.last} == above(c)
    for start in (0, 1, 57, 199, 999, 1007, 5555):
        for limit in (999.0, 4.0):
            got = {r.comid: r.distance_km for r in network.upstream(labels, start, limit).collect()}
            assert got == search(rows, start, limit)
    assert found(labels, spark, [0, 3, 3000, 999], 5.0) == {s: search(rows, s, 5.0) for s in (0, 3, 3000, 999)}


def test_one_start_is_one_filtered_scan(spark):
    labels = network.label_network(edges(spark, [(k, (k - 1) // 2 if k else None, 1.0) for k in range(100)]))
    plan = network.upstream(labels, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    pushed = plan.split("PushedFilters:")[1]
    assert "EqualTo(tree" in pushed and "GreaterThanOrEqual(" in pushed


@pytest.mark.parametrize("seed", range(2))
def test_side_arms_and_circles(spark, seed):
    rng = random.Random(seed)
    n = 60
    rows = [(k, rng.randrange(k), rng.choice([0.0, 0.5, 1.0, 2.0])) for k in range(1, n)]
    rows += [(rng.randrange(1, n), rng.randrange(n), rng.choice([0.0, 0.25, 1.0, 4.0])) for _ in range(25)]
    rows += [(5, None, 1.0), (None, 3, 1.0), (7, 7, 1.0), (0, None, None)]
    if seed % 2:
        rows += [(0, n - 1, 1.0), (200, 201, 1.0), (201, 202, 1.0), (202, 200, 1.0), (203, 201, 0.5), (204, 203, 0.0)]
    labels = network.label_network(edges(spark, rows))
    assert labels.gates is not None
    starts = [0, 1, 2, 5, 17, 30, 59, 200, 203]
    for limit in (999.0, 2.5):
        got = found(labels, spark, starts, limit)
        for s in starts:
            assert got[s] == pytest.approx(search(rows, s, limit)), s
    assert {r.comid: r.distance_km for r in network.upstream(labels, 2).collect()} == pytest.approx(search(rows, 2, 999.0))


def test_long_rivers_many_children_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(reach_labels, "SIBLINGS", 7)
    rows = [(k + 1, k, 0.5) for k in range(300)] + [(1000 + k, 10, None) for k in range(50)] + [(2000, 299, float("nan"))]
    labels = network.label_network(edges(spark, rows))
    for start in (0, 10, 299, 1003):
        assert {r.comid: r.distance_km for r in network.upstream(labels, start).collect()} == search([(c, t, 0.0 if km != km else km) for c, t, km in rows], start, 999.0)
    with pytest.raises(Exception, match="negative length_km"):
        network.label_network(edges(spark, [(1, 0, -1.0)]))


def test_empty_network(spark):
    labels = network.label_network(edges(spark, []))
    assert [tuple(r) for r in network.upstream(labels, 4).collect()] == [(4, 0.0)]
    assert network.upstream_many(labels, spark.range(0).select(F.col("id").alias("comid"))).count() == 0
