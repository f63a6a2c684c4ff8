"""Row filters over daily readings and feature tables.

Readings have ``project, comid, date, stream_temp``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import DECADE, DECADE_YEARS, ONE_YEAR, window_bounds, within_days
from ..functions.numeric import parse_id
from ..session import broadcast_if_small

# The no-data marker, and the floor below which a reading is no data.
NODATA = -999
NODATA_FLOOR = -50


def decade_window(df: DataFrame, year: int, column: str = "date") -> DataFrame:
    """Rows from 21 September of ``year`` to 520 weeks later, both days included."""
    if int(year) not in DECADE_YEARS:
        raise ValueError(f"decade start must lie in {DECADE_YEARS[0]}..{DECADE_YEARS[-1]}, not {year}")
    return df.where(within_days(df, column, *window_bounds(year, DECADE)))


def water_year_window(df: DataFrame, year: int, column: str = "date") -> DataFrame:
    """Rows from 21 September of ``year`` to 365 days later, both days included."""
    return df.where(within_days(df, column, *window_bounds(year, ONE_YEAR)))


def drop_nodata(df: DataFrame, mode: str = "sentinel", column: str = "stream_temp") -> DataFrame:
    """Drop no-data readings: ``sentinel`` drops -999, ``floor`` drops everything up to -50."""
    if mode == "sentinel":
        return df.where(F.col(column) != NODATA)
    if mode == "floor":
        return df.where(F.col(column) > NODATA_FLOOR)
    raise ValueError(f"unknown no-data mode {mode!r}")


def standardise_ids(df: DataFrame, old: str = "featureid", new: str = "comid") -> DataFrame:
    """Rename the feature id and make it a long."""
    named = df.withColumnRenamed(old, new) if old in df.columns else df
    return named.withColumn(new, F.col(new).cast("bigint"))


def parsed_ids(df: DataFrame, column: str, name: str = "comid") -> DataFrame:
    """Ids parsed from text; rows that hold no number are dropped."""
    return df.withColumn(name, parse_id(column)).where(F.col(name).isNotNull())


def huc_column(columns: list[str]) -> str:
    """The watershed column: first name with ``huc12`` in it, else with ``huc``, else the first."""
    for part in ("huc12", "huc"):
        for name in columns:
            if part in name.lower():
                return name
    return columns[0]


def filter_huc12(df: DataFrame, huc12: str) -> DataFrame:
    """Rows of one watershed, whatever the watershed column is called."""
    return df.where(F.col(huc_column(df.columns)).cast("string") == str(huc12).strip())


def selected_reaches(area: DataFrame, selected_id: str, strip: bool = True) -> DataFrame:
    """Distinct ``project, comid`` that an id selects.

    Within each project the id is tried as a watershed first; only where the
    project has no such watershed is it tried as a reach.
    """
    wanted = str(selected_id).strip()
    text = lambda name: F.trim(F.col(name).cast("string")) if strip else F.col(name).cast("string")
    by_huc: Column = F.coalesce(text("HUC12") == wanted, F.lit(False))
    by_reach: Column = F.coalesce(text("featureid") == wanted, F.lit(False))
    hits = (
        area.select("project", F.col("featureid").cast("bigint").alias("comid"), by_huc.alias("by_huc"),
                    by_reach.alias("by_reach"))
        .where("by_huc OR by_reach")
        .groupBy("project", "comid")
        .agg(F.max("by_huc").alias("by_huc"))
    )
    # Projects with a hit are few next to the reaches of the area table.
    grain = hits.groupBy("project").agg(F.max("by_huc").alias("huc_wins"))
    return (
        hits.join(grain, "project")
        .where("by_huc OR NOT huc_wins")
        .select("project", "comid")
    )


def select_feature(df: DataFrame, area: DataFrame, selected_id: str, strip: bool = True) -> DataFrame:
    """Readings of the selected watershed or reach."""
    selected = broadcast_if_small(selected_reaches(area, selected_id, strip))
    return df.join(selected, ["project", "comid"], "left_semi")


def skip_processed(df: DataFrame, ledger: DataFrame, key: str = "huc10") -> DataFrame:
    """Rows whose watershed is not yet in the ledger."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")
