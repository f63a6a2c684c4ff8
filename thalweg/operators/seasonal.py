"""Season means and growth over a decade, per reach and per sub-watershed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import SEASONS, in_season
from ..functions.growth import Curve, growth
from ..session import broadcast_if_small, is_small
from .filters import decade_window, drop_nodata, selected_reaches

REACH_KEYS = ("project", "comid")
HUC12_KEYS = ("project", "HUC12")

SEASON_COLUMNS = {name.capitalize(): f"{name}_avg" for name in SEASONS}
GROWTH_COLUMNS = {name.capitalize(): f"{name}_fish_avg" for name in SEASONS}


def decade_readings(readings: DataFrame, year: int) -> DataFrame:
    """Valid readings of the decade that starts in the water year."""
    return drop_nodata(decade_window(readings, year), "sentinel")


def _in_season_temp(season: str) -> Column:
    return F.when(in_season(F.col("day_of_year"), season), F.col("stream_temp"))


def seasonal_means(readings: DataFrame, by: tuple[str, ...] = REACH_KEYS) -> DataFrame:
    """Four season means per group, in one pass with map-side partial sums."""
    dated = readings.select(*by, "stream_temp", F.dayofyear("date").alias("day_of_year"))
    return dated.groupBy(*by).agg(*[F.avg(_in_season_temp(s)).alias(f"{s}_avg") for s in SEASONS])


def season_sums(readings: DataFrame, by: tuple[str, ...] = REACH_KEYS, column: str = "date") -> DataFrame:
    """Sum and number of readings per group and season."""
    dated = readings.select(*by, "stream_temp", F.dayofyear(column).alias("day_of_year"))
    return dated.groupBy(*by).agg(
        *[F.sum(_in_season_temp(s)).alias(f"{s}_sum") for s in SEASONS],
        *[F.count(_in_season_temp(s)).alias(f"{s}_n") for s in SEASONS],
    )


def means_of_sums(partial: DataFrame) -> DataFrame:
    """Season means per reach from its sums and counts."""
    return partial.select(*REACH_KEYS, *[F.try_divide(f"{s}_sum", f"{s}_n").alias(f"{s}_avg") for s in SEASONS])


def reach_weights(area: DataFrame) -> DataFrame:
    """How often each reach is listed under each sub-watershed of its project."""
    return area.groupBy("project", F.col("featureid").cast("bigint").alias("comid"), "HUC12").agg(
        F.count(F.lit(1)).alias("copies")
    )


def means_of_sums_huc12(partial: DataFrame, area: DataFrame) -> DataFrame:
    """Season means per project and sub-watershed from sums and counts per reach, weighted by readings.

    A reach without a catchment keeps a null sub-watershed; one that is listed
    several times counts that many times.
    """
    tagged = partial.join(reach_weights(area), list(REACH_KEYS), "left").withColumn(
        "copies", F.coalesce("copies", F.lit(1))
    )
    return tagged.groupBy(*HUC12_KEYS).agg(
        *[
            F.try_divide(
                F.sum(F.col(f"{s}_sum") * F.col("copies")), F.sum(F.col(f"{s}_n") * F.col("copies"))
            ).alias(f"{s}_avg")
            for s in SEASONS
        ]
    )


def seasonal_means_huc12(readings: DataFrame, area: DataFrame) -> DataFrame:
    """Season means per project and sub-watershed.

    Readings are reduced to sums and counts per reach before they meet the
    area table, so the join carries reaches rather than days.
    """
    return means_of_sums_huc12(season_sums(readings), area)


def with_seasonal_growth(means: DataFrame, curve: Curve) -> DataFrame:
    """Add the growth of each season's mean temperature."""
    return means.select("*", *[growth(f"{s}_avg", curve).alias(f"{s}_fish_avg") for s in SEASONS])


def seasonal_growth_reach(readings: DataFrame, year: int, curve: Curve) -> DataFrame:
    """Decade season means and growth per reach."""
    return with_seasonal_growth(seasonal_means(decade_readings(readings, year)), curve)


def seasonal_growth_huc12(readings: DataFrame, area: DataFrame, year: int, curve: Curve) -> DataFrame:
    """Decade season means and growth per sub-watershed."""
    return with_seasonal_growth(seasonal_means_huc12(decade_readings(readings, year), area), curve)


def feature_export(readings: DataFrame, area: DataFrame, selected_id: str, year: int, curve: Curve) -> DataFrame:
    """Season means and growth of the reaches that an id selects, without geometry.

    A short selection filters the readings as they are read; a long one
    filters the finished means, which are far fewer than the readings.
    """
    chosen = selected_reaches(area, selected_id)
    picked = decade_readings(readings, year)
    few = is_small(chosen)
    if few:
        picked = picked.join(F.broadcast(chosen), list(REACH_KEYS), "left_semi")
    means = seasonal_means(picked)
    if not few:
        means = means.join(chosen, list(REACH_KEYS), "left_semi")
    return with_seasonal_growth(means, curve)


def huc12_tagged(readings: DataFrame, area: DataFrame) -> DataFrame:
    """Readings with the sub-watershed of their reach; repeated catchments repeat readings."""
    catchments = area.select("project", F.col("featureid").cast("bigint").alias("comid"), "HUC12")
    return readings.join(broadcast_if_small(catchments), list(REACH_KEYS), "left")


def reach_map_table(area: DataFrame, stats: DataFrame) -> DataFrame:
    """Every catchment with its reach's statistics, null where nothing was read."""
    catchments = area.withColumnRenamed("featureid", "comid").withColumn("comid", F.col("comid").cast("bigint"))
    return catchments.join(stats, list(REACH_KEYS), "left")


def huc12_map_table(boundaries: DataFrame, stats: DataFrame) -> DataFrame:
    """Every sub-watershed boundary with its statistics; a null code meets the null group."""
    b, s = boundaries.alias("b"), stats.alias("s")
    matched = (F.col("b.project") == F.col("s.project")) & F.col("b.HUC12").eqNullSafe(F.col("s.HUC12"))
    values = [c for c in stats.columns if c not in HUC12_KEYS]
    return b.join(s, matched, "left").select("b.*", *[F.col(f"s.{c}") for c in values])


def union_projects(*frames: DataFrame) -> DataFrame:
    """All rows of all project tables, columns matched by name."""
    total = frames[0]
    for frame in frames[1:]:
        total = total.unionByName(frame, allowMissingColumns=True)
    return total


def pick_season_metric(table: DataFrame, season: str, fish: bool) -> DataFrame:
    """Rename the season's temperature or growth column to ``value``."""
    column = (GROWTH_COLUMNS if fish else SEASON_COLUMNS)[season]
    keep = [c for c in table.columns if c not in {*SEASON_COLUMNS.values(), *GROWTH_COLUMNS.values()}]
    return table.select(*keep, F.col(column).alias("value"))


def season_metric_long(table: DataFrame, ids: tuple[str, ...] = REACH_KEYS) -> DataFrame:
    """One row per id, season and metric; seasons without a value keep a null row."""
    cells = [
        F.struct(F.lit(season).alias("season"), F.lit(metric).alias("metric"), F.col(columns[season]).alias("value"))
        for metric, columns in (("Temperature", SEASON_COLUMNS), ("Growth", GROWTH_COLUMNS))
        for season in SEASON_COLUMNS
    ]
    return table.select(*ids, F.inline(F.array(*cells)))
