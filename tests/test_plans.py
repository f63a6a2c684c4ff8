"""Physical plans: what reaches the scan, and what must not appear."""

import pytest

import __spark_entry__ as entry
from thalweg.functions.growth import RED_BAND_TROUT
from thalweg.operators import reach_stats, seasonal
from thalweg.plans.inputs import Inputs
from thalweg.session import broadcast_if_small, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_no_slow_operators(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_bounds_reach_the_scan(spark, folder):
    readings = Inputs(spark, folder).daily_temp
    text = plan(seasonal.seasonal_growth_reach(readings, 1995, RED_BAND_TROUT))
    assert "GreaterThanOrEqual(l_shipdate,1995-09-21" in text
    columns = text.split("ReadSchema: struct<")[1].split(">")[0].split(",")
    assert {c.split(":")[0] for c in columns} == {"l_suppkey", "l_shipdate", "l_linenumber", "l_quantity"}
    assert text.count("Exchange hashpartitioning") == 1


def test_both_ways_of_selecting_agree(spark, folder, monkeypatch):
    """A selection too long to broadcast gives the same rows by another plan."""
    i = Inputs(spark, folder)
    reaches = i.contributing_area.selectExpr("featureid AS comid").where("comid > 1")
    export = lambda: sorted(map(str, seasonal.feature_export(i.daily_temp, i.contributing_area, "000000000018", 1995, RED_BAND_TROUT).collect()))
    stats = lambda: sorted(map(str, reach_stats.reach_growth_stats(i.daily_temp, reaches, 1996, RED_BAND_TROUT).collect()))
    few = export(), stats()
    for module in (seasonal, reach_stats):
        monkeypatch.setattr(module, "is_small", lambda df: False)
    assert (export(), stats()) == few and all(few)


def test_broadcast_is_checked(spark):
    big, tiny = spark.range(50), spark.range(5)
    joined = big.join(broadcast_if_small(tiny, 10), "id")
    assert "BroadcastHashJoin" in plan(joined)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(tiny, 5)) and not hinted(broadcast_if_small(tiny, 4))


def test_stored_tables_cut_the_plan(spark):
    df = stored(spark.range(10).selectExpr("id * 2 AS x"))
    assert df.count() == 10 and "Range" not in plan(df) and "FileScan parquet" in plan(df)
