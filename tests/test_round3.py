"""Geopackages read by their own engine, listings by tasks, batches that are committed once."""

import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_rollup import frames, make_data
from thalweg.functions.wkb import polygon_wkb
from thalweg.operators import rollup
from thalweg.sources import geopackage, paths, sinks
from thalweg.sources.geopackage import PUSHDOWN, read_gpkg_layer
from thalweg.sources.readings import list_files


def square(x, y):
    return polygon_wkb([[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]])


def make_gpkg(path, count, columns="featureid INTEGER, HUC12 TEXT", tree=True):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    db = sqlite3.connect(path)
    db.execute(f"CREATE TABLE area (fid INTEGER PRIMARY KEY, geom POLYGON, {columns})")
    names = [c.split()[0] for c in columns.split(", ")]
    for i in range(count):
        given = {"featureid": i, "HUC12": None if i % 4 == 0 else f"h{i % 3}", "length": i / 2}
        db.execute(f"INSERT INTO area (fid, geom, {', '.join(names)}) VALUES (?, ?, {', '.join('?' * len(names))})",
                   (i + 1, b"GP" + struct.pack("<BBi", 0, 1, 4326) + square(i, i), *[given[n] for n in names]))
    if tree:
        db.execute("CREATE VIRTUAL TABLE rtree_area_geom USING rtree(id, minx, maxx, miny, maxy)")
        db.executemany("INSERT INTO rtree_area_geom VALUES (?, ?, ?, ?, ?)", [(i + 1, i, i + 1, i, i + 1) for i in range(count)])
    db.commit()
    db.close()


@pytest.fixture
def pushing(spark):
    spark.conf.set(PUSHDOWN, "true")
    yield spark
    spark.conf.unset(PUSHDOWN)


FILTERS = [
    "featureid = 5", "featureid >= 90", "featureid < 3 AND HUC12 = 'h1'", "HUC12 IS NULL", "HUC12 > 'h0'", "featureid IN (1, 2, 77)", "length <= 1.5", "length IS NULL AND featureid > 95",
    "HUC12 IS NOT NULL AND featureid % 2 = 0", "geom IS NULL", "featureid = 5 OR HUC12 = 'h2'", "length > 'NaN'", "HUC12 = \"h1' OR 1\"",
]


def test_filters_give_the_same_rows_with_and_without_pushdown(spark, tmp_path):
    root = str(tmp_path / "tree")
    make_gpkg(f"{root}/a/one.gpkg", 100)
    make_gpkg(f"{root}/b/c/two.gpkg", 40, "featureid INTEGER, HUC12 TEXT, length REAL", tree=False)
    plain = read_gpkg_layer(spark, root, "area", split_bytes=8000)
    assert plain.columns == ["fid", "geom", "featureid", "HUC12", "length", "source_path"] and plain.count() == 140
    rows = lambda df, f: sorted(map(repr, df.where(f).drop("geom").collect()))
    spark.conf.set(PUSHDOWN, "true")
    try:
        pushed = read_gpkg_layer(spark, root, "area", split_bytes=8000)
        for f in FILTERS:
            want = rows(plain.persist(), f)
            assert rows(pushed, f) == want, f
    finally:
        spark.conf.unset(PUSHDOWN)
        plain.unpersist()


def test_filters_reach_the_file(pushing, tmp_path):
    make_gpkg(str(tmp_path / "one.gpkg"), 100)
    reader = geopackage._PushingReader([(f"file://{tmp_path}/one.gpkg", 1)], "area", read_gpkg_layer(pushing, str(tmp_path), "area").schema, 10**9, "error", None)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    filters = [GreaterThan(("featureid",), 96), EqualTo(("source_path",), "x")]
    assert list(reader.pushFilters(filters)) == filters
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    plan = read_gpkg_layer(pushing, str(tmp_path), "area").where("featureid > 96")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan


def test_a_box_goes_by_the_tree(spark, tmp_path):
    make_gpkg(str(tmp_path / "one.gpkg"), 100)
    make_gpkg(str(tmp_path / "two.gpkg"), 10, tree=False)
    found = read_gpkg_layer(spark, str(tmp_path), "area", box=(20.5, 0.0, 22.5, 100.0)).collect()
    by = {name: [r.featureid for r in found if r.source_path.endswith(name)] for name in ("one.gpkg", "two.gpkg")}
    assert sorted(by["one.gpkg"]) == [20, 21, 22] and len(by["two.gpkg"]) == 10


def test_unlike_types_are_refused(spark, tmp_path):
    make_gpkg(str(tmp_path / "one.gpkg"), 2)
    make_gpkg(str(tmp_path / "two.gpkg"), 2, "featureid TEXT, HUC12 TEXT")
    with pytest.raises(ValueError, match="featureid"):
        read_gpkg_layer(spark, str(tmp_path), "area")
    with pytest.raises(ValueError, match="no geopackage"):
        read_gpkg_layer(spark, str(tmp_path), "other")


def test_listing_by_tasks(spark, tmp_path, monkeypatch):
    names = ["a.txt", "p/x.txt", "p/q/r/s/t/u/deep.txt", "p/q/empty.txt", "z/.hidden.txt", "_skip/y.txt", "z/.dir/y.txt", "z/_old.txt", "z/k=_1/y.txt", "z/_k=1/y.txt", "z/y.csv"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    want = {(f"file:{tmp_path}/{n}", 0 if "empty" in n else len(n)) for n in ("a.txt", "p/x.txt", "p/q/r/s/t/u/deep.txt", "p/q/empty.txt", "z/k=_1/y.txt", "z/_k=1/y.txt")}
    for levels in (0, 1, 9):
        monkeypatch.setattr(paths, "LEVELS", levels)
        assert {tuple(r) for r in paths.listed_files(spark, str(tmp_path), "*.txt").collect()} == want
    assert {r.project for r in list_files(spark, str(tmp_path), "*.txt").collect()} == {"a.txt", "p", "z"}
    assert paths.listed_files(spark, str(tmp_path / "a.txt")).count() == 1 and paths.listed_files(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_counts_once_and_whole(spark, tmp_path, monkeypatch):
    d, e, *lookups = frames(spark, *make_data())
    table = rollup.dgo_rollup(d, e, *lookups)
    metrics, ledger = str(tmp_path / "m"), str(tmp_path / "l")
    read = lambda: (sinks.read_committed(spark, metrics, metrics, table.schema).count(), sinks.read_committed(spark, ledger, metrics, "huc10 string").count())
    assert read() == (0, 0)

    class Failed(Exception):
        pass

    class Half:
        """A rollup whose second table can't be written."""

        def __init__(self, session):
            self.session = session

        def __getattr__(self, name):
            if name == "read":
                raise Failed
            return getattr(self.session, name)

    class Rollup:
        sparkSession, write, schema = Half(spark), table.write, table.schema

    with pytest.raises(Failed):
        sinks.write_metrics(Rollup, metrics, ledger, "one")
    assert os.listdir(metrics) == ["batch=one"] and read() == (0, 0)
    assert sinks.write_metrics(table, metrics, ledger, "one")
    once = read()
    assert once == (table.count(), 1)
    assert not sinks.write_metrics(table, metrics, ledger, "one") and read() == once
    assert sinks.write_metrics(table, metrics, ledger) and read() == (2 * once[0], 2)
    assert sinks.read_committed(spark, metrics, metrics, table.schema).columns == table.columns
    with pytest.raises(ValueError):
        sinks.write_metrics(table, metrics, ledger, "../x")


def test_lookup_codes_meet_each_carried_code_once(spark, folder):
    from thalweg.plans import all_queries

    found = all_queries()["lookup_bridge"](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("LeftSemi")[1]
    assert found.count() == 7
