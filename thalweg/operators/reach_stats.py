"""Yearly growth statistics: per reach, and for a river network against the rest.

A reach may lie in several projects, each with readings of its own: statistics
are kept apart by project throughout.  Tables of one project may go without the
column; reaches listed without it are meant in every project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.growth import Curve, growth
from ..functions.numeric import label_or_na
from ..session import broadcast_if_small, is_small
from .filters import drop_nodata, water_year_window


KEYS = ("project", "comid")


def _shared(*frames: DataFrame) -> list[str]:
    """The keys that all tables have."""
    return [k for k in KEYS if all(k in f.columns for f in frames)]


def reach_semi(readings: DataFrame, reaches: DataFrame) -> DataFrame:
    """Readings of the listed reaches of each project, each reading once."""
    keys = _shared(readings, reaches)
    return readings.join(broadcast_if_small(reaches.select(*keys)), keys, "left_semi")


def reach_growth_stats(readings: DataFrame, reaches: DataFrame, year: int, curve: Curve) -> DataFrame:
    """Mean and sample variance of daily growth per project and reach over one water year.

    A short list of reaches is broadcast and filters the readings as they are
    read.  A long one meets the finished statistics instead: either way no
    reading is shuffled for the sake of the list.
    """
    daily = drop_nodata(water_year_window(readings, year), "sentinel")
    own, keys = _shared(readings), _shared(readings, reaches)
    listed = reaches.select(*keys)
    few = is_small(listed)
    if few:
        daily = daily.join(F.broadcast(listed), keys, "left_semi")
    rate = growth("stream_temp", curve)
    stats = (
        daily.select(*own, rate.alias("fish_growth"))
        .groupBy(*own)
        .agg(F.avg("fish_growth").alias("Growth_Mean"), F.var_samp("fish_growth").alias("Growth_Var"))
    )
    return stats if few else stats.join(listed, keys, "left_semi").select(stats.columns)


def reach_stats_table(catchments: DataFrame, stats: DataFrame) -> DataFrame:
    """Every catchment with its reach's statistics in its project and their display text."""
    return catchments.join(stats, _shared(catchments, stats), "left").withColumns(
        {
            "Growth_Mean_text": label_or_na(F.col("Growth_Mean")),
            "Growth_Var_text": label_or_na(F.col("Growth_Var")),
        }
    )


def network_daily_growth(readings: DataFrame, scope: DataFrame, year: int, curve: Curve) -> DataFrame:
    """Mean growth per project and day, for upstream reaches and for the others.

    ``scope`` has one row per reach: ``comid, is_upstream``; the river is the
    same for every project.
    """
    apart = [c for c in ("project",) if c in readings.columns]
    daily = drop_nodata(water_year_window(readings, year), "floor").join(
        broadcast_if_small(scope.select("comid", "is_upstream")), "comid"
    )
    return (
        daily.select(*apart, "is_upstream", "date", growth("stream_temp", curve).alias("fish_growth"))
        .groupBy(*apart, "is_upstream", "date")
        .agg(F.avg("fish_growth").alias("daily_fish_growth"))
    )


def network_growth_summary(daily: DataFrame) -> DataFrame:
    """Mean and variance of the daily means of each project; always one row upstream and one for the rest."""
    sides = []
    for flag in (True, False):
        value = F.when(F.col("is_upstream") == flag, F.col("daily_fish_growth"))
        sides.append(
            F.struct(
                F.lit(flag).alias("is_upstream"),
                F.coalesce(F.avg(value), F.lit(0.0)).alias("growth_mean"),
                # One day alone has no sample variance, which reads as zero here.
                F.coalesce(F.var_samp(value), F.lit(0.0)).alias("growth_var"),
            )
        )
    apart = [c for c in ("project",) if c in daily.columns]
    return daily.groupBy(*apart).agg(F.array(*sides).alias("sides")).select(*apart, F.inline("sides"))
