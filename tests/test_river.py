from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from thalweg.functions.calendar import season, window_bounds, DECADE, ONE_YEAR
from thalweg.functions.growth import RED_BAND_TROUT
from thalweg.functions.numeric import is_close, label_or_na, parse_id
from thalweg.operators import filters, network, reach_stats, seasonal


def readings(spark, rows, kind="date"):
    df = spark.createDataFrame(rows, "project string, comid bigint, date string, stream_temp double")
    return df.withColumn("date", F.col("date").cast(kind))


AREA = "project string, featureid bigint, HUC12 string"


def test_seasons(spark):
    days = {
        "2000-03-19": "winter", "2001-03-20": "winter", "2001-03-21": "spring", "2001-06-20": "spring",
        "2001-06-21": "summer", "2001-09-20": "summer", "2001-09-21": "autumn", "2001-12-20": "autumn",
        "2001-12-21": "winter", "2000-12-20": "winter", "2000-12-19": "autumn", "2001-01-01": "winter",
    }
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("day", F.col("d").cast("date"))
    assert {r.d: r.s for r in df.select("d", season("day").alias("s")).collect()} == days


def test_windows():
    assert window_bounds(1981, DECADE) == (date(1981, 9, 21), date(1991, 9, 9))
    assert window_bounds(2010, DECADE)[1] == date(2020, 9, 8)
    assert window_bounds(1981, ONE_YEAR) == (date(1981, 9, 21), date(1982, 9, 21))


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_window_edges_are_included(spark, kind):
    df = readings(spark, [("p", i, d, 1.0) for i, d in enumerate(
        ["1981-09-20", "1981-09-21", "1982-09-21", "1982-09-22", "1991-09-09", "1991-09-10"])], kind)
    ids = lambda found: sorted(r.comid for r in found.collect())
    assert ids(filters.decade_window(df, 1981)) == [1, 2, 3, 4]
    assert ids(filters.water_year_window(df, 1981)) == [1, 2]


@pytest.mark.parametrize("year", [1978, 2022])
def test_decade_years_are_checked(spark, year):
    with pytest.raises(ValueError):
        filters.decade_window(readings(spark, []), year)


def test_nodata_modes(spark):
    df = readings(spark, [("p", i, "2000-01-01", t) for i, t in enumerate([-999.0, -998.0, -50.0, -49.0, 3.0])])
    ids = lambda mode: sorted(r.comid for r in filters.drop_nodata(df, mode).collect())
    assert ids("sentinel") == [1, 2, 3, 4] and ids("floor") == [3, 4]


def test_season_means_by_project(spark):
    df = readings(spark, [
        ("a", 1, "2000-01-05", 2.0), ("a", 1, "2000-02-05", 4.0), ("a", 1, "2000-05-05", 9.0),
        ("b", 1, "2000-01-05", 10.0), ("a", 2, "2000-08-01", float("nan")), ("a", 2, "2000-08-02", 5.0),
    ])
    got = {(r.project, r.comid): r for r in seasonal.seasonal_means(df).collect()}
    assert got["a", 1].winter_avg == 3.0 and got["a", 1].spring_avg == 9.0 and got["a", 1].autumn_avg is None
    assert got["b", 1].winter_avg == 10.0
    assert got["a", 2].summer_avg != got["a", 2].summer_avg


def test_huc12_means_weigh_readings_and_copies(spark):
    """Row weighted; an unlisted reach forms the null group; a reach listed twice counts twice."""
    df = readings(spark, [
        ("a", 1, "2000-01-05", 2.0), ("a", 1, "2000-01-06", 4.0), ("a", 2, "2000-01-05", 12.0),
        ("a", 9, "2000-01-05", 7.0), ("b", 1, "2000-01-05", 1.0),
    ])
    area = spark.createDataFrame([("a", 1, "H"), ("a", 1, "H"), ("a", 2, "H"), ("b", 1, "H"), ("a", 3, "K")], AREA)
    got = {(r.project, r.HUC12): r.winter_avg for r in seasonal.seasonal_means_huc12(df, area).collect()}
    assert got == {("a", "H"): pytest.approx((2 + 4 + 2 + 4 + 12) / 5), ("a", None): 7.0, ("b", "H"): 1.0}
    tagged = seasonal.huc12_tagged(df, area)
    assert tagged.count() == 7


def test_null_boundary_meets_null_group(spark):
    bounds = spark.createDataFrame([("a", None, "none"), ("a", "H", "h"), ("b", "H", "h")],
                                   "project string, HUC12 string, name string")
    stats = spark.createDataFrame([("a", None, 1.0), ("a", "H", 2.0)], "project string, HUC12 string, winter_avg double")
    got = {(r.project, r.HUC12): r.winter_avg for r in seasonal.huc12_map_table(bounds, stats).collect()}
    assert got == {("a", None): 1.0, ("a", "H"): 2.0, ("b", "H"): None}


def test_growth_of_mean_is_not_mean_of_growth(spark):
    df = readings(spark, [("a", 1, "2000-01-05", 0.0), ("a", 1, "2000-01-06", 30.0)])
    decade = seasonal.seasonal_growth_reach(df, 1999, RED_BAND_TROUT).first()
    yearly = reach_stats.reach_growth_stats(df, df.select("comid"), 1999, RED_BAND_TROUT).first()
    assert decade.winter_fish_avg == pytest.approx(4.359797, abs=1e-6)
    assert yearly.Growth_Mean == pytest.approx((-2.440113 - 15) / 2, abs=1e-6)


def test_empty_and_all_nodata(spark):
    for rows in ([], [("a", 1, "2000-01-05", -999.0)]):
        table = seasonal.seasonal_growth_reach(readings(spark, rows), 1999, RED_BAND_TROUT)
        assert table.count() == 0 and "winter_fish_avg" in table.columns


def test_selection_prefers_watershed_per_project(spark):
    area = spark.createDataFrame(
        [("a", 7, " 12 "), ("a", 12, "99"), ("b", 12, "98"), ("b", 13, "12x"), ("c", 5, None)], AREA)
    got = {(r.project, r.comid) for r in filters.selected_reaches(area, "12").collect()}
    assert got == {("a", 7), ("b", 12)}
    assert filters.selected_reaches(area, "nothing").count() == 0
    strict = {(r.project, r.comid) for r in filters.selected_reaches(area, "12", strip=False).collect()}
    assert strict == {("a", 12), ("b", 12)}


def test_huc_column_choice():
    assert filters.huc_column(["id", "My_HUC12", "huc"]) == "My_HUC12"
    assert filters.huc_column(["id", "huc8"]) == "huc8"
    assert filters.huc_column(["id", "x"]) == "id"


def test_parse_ids(spark):
    rows = [("12",), ("12.9",), (" 7 ",), ("-3.5",), ("abc",), ("",), (None,), ("nan",), ("1e3",), ("inf",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(parse_id("s")).collect()] == [12, 12, 7, -3, None, None, None, None, 1000, None]


def test_labels(spark):
    df = spark.createDataFrame([(3.0230049,), (3.0,), (None,), (float("nan"),), (-0.5,)], "v double")
    assert [r[0] for r in df.select(label_or_na(F.col("v"))).collect()] == ["3.023", "3.0", "N/A", "N/A", "-0.5"]


def test_is_close(spark):
    test = lambda a, b, **k: spark.range(1).select(is_close(F.lit(a), F.lit(b), **k)).first()[0]
    assert test(1.0, 1.0 + 1e-10) and not test(1.0, 1.1) and test(0.0, 1e-9, absolute=1e-8)


def edges(spark, rows):
    return spark.createDataFrame(rows, "comid bigint, tocomid bigint, length_km double")


def test_upstream_of_a_tree(spark):
    tree = edges(spark, [(k, (k - 1) // 2 if k else None, 1.0) for k in range(100)])
    assert network.upstream(tree, 1).count() == 63
    assert network.upstream(tree, 0).count() == 100
    assert {r.comid for r in network.upstream(tree, 99).collect()} == {99}
    assert {r.comid for r in network.upstream(tree, 12345).collect()} == {12345}


def test_upstream_shortest_way_and_limit(spark):
    """Parallel channels, a long line, and a circle, against a plain search."""
    rows = [(k + 1, k, 0.5 + k % 3) for k in range(40)] + [(60, 3, 9.0), (61, 60, 1.0), (10, 61, 0.25), (0, 35, 2.0)]

    def search(start, limit):
        best = {start: 0.0}
        todo = [start]
        while todo:
            at = todo.pop()
            for c, t, km in rows:
                if t == at and best[at] + km <= limit and best[at] + km < best.get(c, 1e9):
                    best[c] = best[at] + km
                    todo.append(c)
        return best

    starts = spark.createDataFrame([(0,), (3,), (20,), (20,), (61,)], "comid bigint")
    for limit in (999.0, 12.0):
        got: dict = {}
        for r in network.upstream_many(edges(spark, rows), starts, limit).collect():
            assert r.comid not in got.setdefault(r.start, {})
            got[r.start][r.comid] = r.distance_km
        assert got == {s: pytest.approx(search(s, limit)) for s in (0, 3, 20, 61)}


def test_scope_and_roles(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "comid bigint")
    scope = {r.comid: r.is_upstream for r in network.network_scope(ids(1), ids(1, 2, 3), ids(3, 4, 4)).collect()}
    assert scope == {1: True, 2: True, 3: True, 4: False}
    roles = {r.comid: r.role for r in network.network_role(ids(1, 2, 4), ids(1), ids(1, 2)).collect()}
    assert roles == {1: "selected", 2: "upstream", 4: "other"}


def test_network_summary_defaults(spark):
    kind = "is_upstream boolean, date date, daily_fish_growth double"
    one = spark.createDataFrame([(True, datetime(2000, 1, 1), 4.0)], kind)
    got = {r.is_upstream: (r.growth_mean, r.growth_var) for r in reach_stats.network_growth_summary(one).collect()}
    assert got == {True: (4.0, 0.0), False: (0.0, 0.0)}
    assert reach_stats.network_growth_summary(one.where("false")).count() == 2


def test_reach_stats_of_one_day(spark):
    df = readings(spark, [("a", 1, "2000-01-05", 10.0), ("a", 2, "2000-01-05", -999.0)])
    ids = df.select("comid").distinct()
    table = reach_stats.reach_stats_table(ids, reach_stats.reach_growth_stats(df, ids, 1999, RED_BAND_TROUT))
    got = {r.comid: (r.Growth_Mean_text, r.Growth_Var_text) for r in table.collect()}
    assert got == {1: ("3.02323", "N/A"), 2: ("N/A", "N/A")}


def test_season_metric_long_and_pick(spark):
    df = readings(spark, [("a", 1, "2000-01-05", 10.0)])
    table = seasonal.seasonal_growth_reach(df, 1999, RED_BAND_TROUT)
    long = {(r.season, r.metric): r.value for r in seasonal.season_metric_long(table).collect()}
    assert len(long) == 8 and long["Winter", "Temperature"] == 10.0 and long["Summer", "Growth"] is None
    assert seasonal.pick_season_metric(table, "Winter", fish=False).first().value == 10.0
