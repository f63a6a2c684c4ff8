"""Season sums by reach and water year, stored once: any decade's means are a sum over a few of their rows.

A decade ends some days before its tenth water year does, on 8 or 9 September
depending on leap days, so a water year is kept in three parts: what every
decade that ends in it holds, what only those ending on the 9th hold, and the
rest.  Sums and counts are exact parts of the same totals that a scan of the
readings gives.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import DECADE, SEASONS, WINDOW_DAY, WINDOW_MONTH, window_bounds, within_days
from ..functions.growth import Curve
from .filters import drop_nodata
from .seasonal import REACH_KEYS, means_of_sums, means_of_sums_huc12, season_sums, with_seasonal_growth

#: Last days of a decade, in September, in leap-year order: the parts of a water year end on them.
_LAST_DAYS = (8, 9)


def _water_year(day: Column) -> Column:
    """The year whose 21 September begins the water year of a day."""
    early = F.month(day) * 100 + F.dayofmonth(day) < WINDOW_MONTH * 100 + WINDOW_DAY
    return F.year(day) - F.when(early, 1).otherwise(0)


def _part(readings: DataFrame, column: str) -> Column:
    """Which part of its water year a reading lies in; bounds have the column's own type, as those of a window have."""
    kind = readings.schema[column].dataType
    last = lambda day: F.make_date(F.col("water_year") + 1, F.lit(WINDOW_MONTH), F.lit(day)).cast(kind)
    return F.when(F.col(column) <= last(_LAST_DAYS[0]), 0).when(F.col(column) <= last(_LAST_DAYS[1]), 1).otherwise(2)


def yearly_sums(readings: DataFrame, column: str = "date") -> DataFrame:
    """``project, comid, part, <season>_sum, <season>_n, water_year`` of all valid readings, in one scan."""
    valid = drop_nodata(readings, "sentinel").where(F.col(column).isNotNull())
    dated = valid.withColumn("water_year", _water_year(F.col(column)))
    dated = dated.withColumn("part", _part(readings, column))
    return season_sums(dated, (*REACH_KEYS, "part", "water_year"), column)


def write_season_store(readings: DataFrame, path: str) -> None:
    """Store the sums of all readings, by water year."""
    yearly_sums(readings).write.partitionBy("water_year").parquet(path)


def update_season_store(readings: DataFrame, path: str, years: Iterable[int], column: str = "date") -> None:
    """Replace the named water years by what the readings, old and new, now give for them; no other year is touched.

    Only the readings of those years are scanned.  A year without readings any
    more keeps no rows.
    """
    years = sorted(set(map(int, years)))
    spark = readings.sparkSession
    near = F.lit(False)
    for year in years:
        near = near | within_days(readings, column, window_bounds(year, DECADE)[0], window_bounds(year + 1, DECADE)[0])
    sums = yearly_sums(readings.where(near), column).where(F.col("water_year").isin(years))
    held = {r["water_year"] for r in sums.select("water_year").distinct().collect()}
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("water_year").parquet(path)
    for year in set(years) - held:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/water_year={year}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def decade_sums(store: DataFrame, year: int) -> DataFrame:
    """Sums and counts per reach over the decade that starts in the water year: reads ten years' files."""
    last = window_bounds(year, DECADE)[1]
    part = _LAST_DAYS.index(last.day)
    end = F.col("water_year") == year + 9
    rows = store.where(F.col("water_year").between(year, year + 9) & (~end | (F.col("part") <= part)))
    return rows.groupBy(*REACH_KEYS).agg(*[F.sum(f"{s}_{c}").alias(f"{s}_{c}") for c in ("sum", "n") for s in SEASONS])


def stored_means(store: DataFrame, year: int) -> DataFrame:
    """Decade season means per reach."""
    return means_of_sums(decade_sums(store, year))


def stored_growth_reach(store: DataFrame, year: int, curve: Curve) -> DataFrame:
    """Decade season means and growth per reach."""
    return with_seasonal_growth(stored_means(store, year), curve)


def stored_growth_huc12(store: DataFrame, area: DataFrame, year: int, curve: Curve) -> DataFrame:
    """Decade season means and growth per sub-watershed."""
    return with_seasonal_growth(means_of_sums_huc12(decade_sums(store, year), area), curve)


def read_season_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
