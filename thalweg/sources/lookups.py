"""Lookup tables whose rows carry a comma list of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lookup(spark: SparkSession, table: str) -> DataFrame:
    """``name, id, where_clause`` of a registered lookup table."""
    return spark.table(table).select("name", "id", "where_clause")


def explode_codes(lookup: DataFrame) -> DataFrame:
    """One row per lookup row and code, codes as written."""
    return lookup.select("id", "name", F.explode(F.split("where_clause", ",")).alias("code"))
