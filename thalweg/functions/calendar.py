"""Water-year windows and seasons."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASONS = ("winter", "spring", "summer", "autumn")

# First and last day of year of the three bounded seasons
# (winter runs from day 355 over the new year to day 79).
WINTER_FIRST, WINTER_LAST = 355, 79
SPRING_FIRST, SPRING_LAST = 80, 171
SUMMER_FIRST, SUMMER_LAST = 172, 263

# A water year starts on 21 September; a decade is 520 weeks.
WINDOW_MONTH, WINDOW_DAY = 9, 21
DECADE = timedelta(weeks=520)
ONE_YEAR = timedelta(days=365)
DECADE_YEARS = range(1979, 2022)


def in_season(day_of_year: Column, season: str) -> Column:
    """Is the day (1-based, leap aware) in the season?"""
    if season == "winter":
        return (day_of_year >= WINTER_FIRST) | (day_of_year <= WINTER_LAST)
    if season == "spring":
        return day_of_year.between(SPRING_FIRST, SPRING_LAST)
    if season == "summer":
        return day_of_year.between(SUMMER_FIRST, SUMMER_LAST)
    if season == "autumn":
        return day_of_year.between(SUMMER_LAST + 1, WINTER_FIRST - 1)
    raise ValueError(f"unknown season {season!r}")


def season(day: Column | str) -> Column:
    """Name of the season of a date."""
    number = F.dayofyear(day)
    named = F.when(in_season(number, "winter"), "winter")
    for name in ("spring", "summer"):
        named = named.when(in_season(number, name), name)
    # A missing date falls through to autumn, as every unmatched day does.
    return named.otherwise("autumn")


def window_bounds(year: int, length: timedelta) -> tuple[date, date]:
    """First and last day of a window; both belong to it."""
    first = date(int(year), WINDOW_MONTH, WINDOW_DAY)
    return first, first + length


def within_days(df: DataFrame, column: str, first: date, last: date) -> Column:
    """Inclusive range test whose bounds have the column's own type.

    Equal types keep the comparison free of casts on the column, which is what
    lets it reach the parquet scan.
    """
    kind = df.schema[column].dataType
    return F.col(column).between(F.lit(first.isoformat()).cast(kind), F.lit(last.isoformat()).cast(kind))
