"""The rollup against the same question asked of an embedded database, one lookup row at a time."""

import itertools
import random
import sqlite3

import pytest

from thalweg.operators import rollup
from thalweg.operators.filters import skip_processed
from thalweg.sources.sinks import write_metrics

DEFS = [rollup.MetricDef(m, method, f"{method}_{m}") for m in (3, 4) for method in rollup.METHODS]
SQL = {
    rollup.LENGTH_WEIGHTED_AVG: "SUM(v.metric_value * d.len) / SUM(d.len)",
    rollup.AREA_WEIGHTED_AVG: "SUM(v.metric_value * d.area) / SUM(d.area)",
    rollup.SUM_METRIC: "SUM(v.metric_value)",
    rollup.MULTIPLIED_BY_LENGTH: "SUM(v.metric_value * d.len)",
    rollup.MULTIPLIED_BY_AREA: "SUM(v.metric_value * d.area)",
    rollup.SUM_AREA_ZERO_COUNT: "COALESCE(SUM(CASE WHEN v.metric_value = 0 THEN d.area ELSE 0 END), 0)",
}
STATES = [(1, "one", "1,2,2"), (2, "two", "2,03"), (3, "none", "77")]
FLOWS = [(1, "a", "A,B"), (2, "b", "B, A")]
OWNERS = [(1, "x", "5"), (2, "y", "5,6")]


def make_data():
    rng = random.Random(3)
    dgos = [(i, rng.choice(["A", "B", " A", "C"]), rng.choice([None, 0.0, 1.5, 2.0, 7.25]), rng.choice([0.0, 2.0, 3.5]), "h1")
            for i in range(60)]
    eav = []
    for i in range(60):
        for _ in range(rng.randint(0, 3)):
            eav.append((i, 2, float(rng.choice([1, 2, 3, 9]))))
        for _ in range(rng.randint(0, 2)):
            eav.append((i, 1, float(rng.choice([5, 6, 8]))))
        for m in (3, 4):
            for _ in range(rng.randint(0, 2)):
                eav.append((i, m, rng.choice([None, 0.0, 1.25, 4.0])))
    return dgos, eav


def expected(dgos, eav):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE d (fid, fcode TEXT, len REAL, area REAL, huc)")
    db.execute("CREATE TABLE e (dgo_id, metric_id, metric_value REAL)")
    db.executemany("INSERT INTO d VALUES (?,?,?,?,?)", dgos)
    db.executemany("INSERT INTO e VALUES (?,?,?)", eav)
    quoted = lambda codes: ",".join(f"'{c}'" for c in codes.split(","))
    out = {}
    for s, f, o in itertools.product(STATES, FLOWS, [None, *OWNERS]):
        joins = "JOIN e s ON s.dgo_id = d.fid AND s.metric_id = 2"
        where = f"s.metric_value IN ({quoted(s[2])}) AND d.fcode IN ({quoted(f[2])})"
        if o:
            joins += " JOIN e o ON o.dgo_id = d.fid AND o.metric_id = 1"
            where += f" AND o.metric_value IN ({quoted(o[2])})"
        base = db.execute(f"SELECT count(*), coalesce(sum(d.len), 0), coalesce(sum(d.area), 0) FROM d {joins} WHERE {where}").fetchone()
        if base[0] == 0:
            continue
        metrics = [
            db.execute(f"SELECT {SQL[x.method]} FROM d JOIN e v ON v.dgo_id = d.fid AND v.metric_id = {x.metric_id} {joins} WHERE {where}").fetchone()[0]
            for x in DEFS
        ]
        out[s[0], f[0], o[0] if o else None] = (*base, *metrics)
    return out


def frames(spark, dgos, eav):
    lookup = lambda rows: spark.createDataFrame(rows, "id int, name string, where_clause string")
    return (
        spark.createDataFrame(dgos, "fid bigint, FCode string, centerline_length double, segment_area double, huc10 string"),
        spark.createDataFrame(eav, "dgo_id bigint, metric_id int, metric_value double"),
        lookup(STATES), lookup(FLOWS), lookup(OWNERS),
    )


@pytest.mark.parametrize("partitions", [1, 5])
def test_rollup(spark, partitions):
    dgos, eav = make_data()
    d, e, *lookups = frames(spark, dgos, eav)
    table = rollup.dgo_rollup(d.repartition(partitions), e.repartition(partitions), *lookups, DEFS)
    got = {
        (r.state_id, r.flow_id, r.owner_id): (r.dgo_count, r.riverscape_length, r.riverscape_area, *[r[x.output] for x in DEFS])
        for r in table.collect()
    }
    want = expected(dgos, eav)
    assert set(got) == set(want)
    for key, values in want.items():
        assert [None if v is None else round(v, 9) for v in got[key]] == [None if v is None else round(v, 9) for v in values], key


def test_empty_rollup_is_empty(spark):
    d, e, *lookups = frames(spark, [], [])
    assert rollup.dgo_rollup(d, e, *lookups).count() == 0


def test_secondary_metrics_guard_zero(spark):
    names = ["riparian_area", "riparian_departure", "channel_length", "riverscape_length", "riverscape_area",
             "road_length", "rail_length", "riparian_ag_conv_area", "riparian_developed_area"]
    df = spark.createDataFrame([(6.0, 0.5, 4.0, 2.0, 8.0, 1.0, 3.0, 2.0, 4.0), (1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], names)
    first, second = rollup.secondary_metrics(df).collect()
    assert first.hist_riparian_area == 12.0 and first.relative_flow_length == 2.0 and first.road_density == 0.5
    assert first.acres_vb_per_mile == pytest.approx((8 * 0.000247105) / (2 * 0.000621371))
    assert second.hist_riparian_area is None and second.rail_density is None and second.riparian_developed_proportion is None


def test_ledger_skips_processed(spark, tmp_path):
    d, e, *lookups = frames(spark, *make_data())
    metrics, ledger = str(tmp_path / "m"), str(tmp_path / "l")
    write_metrics(rollup.dgo_rollup(d, e, *lookups), metrics, ledger)
    done = spark.read.parquet(ledger)
    assert skip_processed(d, done).count() == 0
    assert len(rollup.METRIC_DEFS) == 16
