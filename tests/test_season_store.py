"""Decades from a store of yearly sums, against a scan of the readings."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from thalweg.functions.growth import RED_BAND_TROUT
from thalweg.operators import season_store, seasonal

DECADES = (1980, 1983, 1984, 2021)


def readings(spark, kind="timestamp", count=4000, seed=1):
    rng = random.Random(seed)
    edges = [datetime.datetime(y, m, d, h) for y in (1981, 1989, 1990, 1991, 1992, 1993, 1994, 2020, 2031) for m, d in ((9, 7), (9, 8), (9, 9), (9, 10), (9, 20), (9, 21), (12, 20), (12, 31)) for h in (0, 12)]
    days = edges + [datetime.datetime(1979, 9, 21) + datetime.timedelta(days=rng.randrange(19000), hours=12 * rng.randrange(2)) for _ in range(count)]
    rows = [(f"p{rng.randrange(2)}", rng.randrange(6), d, rng.choice([-999.0, None, *[x / 8 for x in range(200)]])) for d in days] + [("p0", 1, None, 4.0)]
    return spark.createDataFrame(rows, "project string, comid long, date timestamp, stream_temp double").withColumn("date", F.col("date").cast(kind))


def same(a, b):
    rows = lambda df: sorted(map(repr, df.select(sorted(b.columns)).collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("kind", ["timestamp", "date"])
def test_decades_equal_a_scan(spark, tmp_path, kind):
    given = readings(spark, kind).persist()
    season_store.write_season_store(given, str(tmp_path / "s"))
    store = season_store.read_season_store(spark, str(tmp_path / "s")).persist()
    area = spark.createDataFrame([("p0", 1, "h"), ("p0", 1, "h"), ("p1", 2, None), ("p1", 3, "k")], "project string, featureid long, HUC12 string")
    for year in DECADES:
        same(season_store.stored_growth_reach(store, year, RED_BAND_TROUT), seasonal.seasonal_growth_reach(given, year, RED_BAND_TROUT))
    same(season_store.stored_growth_huc12(store, area, 1984, RED_BAND_TROUT), seasonal.seasonal_growth_huc12(given, area, 1984, RED_BAND_TROUT))


def test_a_decade_reads_ten_years(spark, tmp_path):
    season_store.write_season_store(readings(spark), str(tmp_path / "s"))
    found = season_store.decade_sums(season_store.read_season_store(spark, str(tmp_path / "s")), 1990)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(water_year" in plan and plan.count("FileScan") >= 1


def test_an_update_touches_its_years_alone(spark, tmp_path):
    import os

    given, path = readings(spark).persist(), str(tmp_path / "s")
    season_store.write_season_store(given, path)
    year = lambda y: sorted(os.listdir(f"{path}/water_year={y}"))
    before = {y: year(y) for y in (1989, 1990, 1991, 1992)}
    gone = F.col("date").between("1992-09-21", "1993-09-20 23:59:59")
    new = given.where(~gone | F.col("date").isNull()).union(spark.createDataFrame([("p9", 77, datetime.datetime(1991, 9, 8), 3.0)], given.schema)).persist()
    season_store.update_season_store(new, path, [1990, 1992])
    assert year(1989) == before[1989] and year(1991) == before[1991] and year(1990) != before[1990] and not os.path.exists(f"{path}/water_year=1992")
    store = season_store.read_season_store(spark, path)
    for y in (1981, 1984, 1992):
        same(season_store.stored_means(store, y), seasonal.seasonal_means(seasonal.decade_readings(new, y)))
