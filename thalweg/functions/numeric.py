"""Numeric helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Equal within a tolerance relative to the larger magnitude, or an absolute one."""
    room = F.greatest(F.greatest(F.abs(a), F.abs(b)) * F.lit(relative), F.lit(absolute))
    return F.abs(a - b) <= room


def label_or_na(value: Column, digits: int = 5) -> Column:
    """Rounded text without padding zeros, or ``N/A`` for a missing number."""
    text = F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")
    short = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")
    return F.when(value.isNull() | F.isnan(value), F.lit("N/A")).otherwise(short)


def parse_id(text: Column | str) -> Column:
    """Whole id from text such as ``123`` or ``123.0``; null where it is no number."""
    column = F.col(text) if isinstance(text, str) else text
    number = F.trim(column.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("bigint"))
