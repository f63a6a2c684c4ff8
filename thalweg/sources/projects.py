"""Catalog documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT = """
    id STRING, name STRING, summary STRING, description STRING, tags ARRAY<STRING>,
    archived BOOLEAN, visibility STRING, totalSize BIGINT,
    bounds STRUCT<id: STRING, bbox: ARRAY<DOUBLE>, centroid: ARRAY<DOUBLE>, area: DOUBLE, geoHash: STRING>,
    meta ARRAY<STRUCT<key: STRING, value: STRING, type: STRING>>,
    projectType STRUCT<id: STRING>, createdOn TIMESTAMP, updatedOn TIMESTAMP,
    ownedBy STRUCT<id: STRING, name: STRING, __typename: STRING>,
    collections ARRAY<STRUCT<id: STRING>>,
    attribution ARRAY<STRUCT<organization: STRUCT<id: STRING>, roles: ARRAY<STRING>>>
"""


def document_schema() -> StructType:
    return StructType.fromDDL(DOCUMENT)


def read_projects_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Catalog documents from JSON files, one per line or one array per file."""
    return spark.read.schema(document_schema()).option("multiLine", multi_line).json(path)


def parse_projects(df: DataFrame, column: Column | str) -> DataFrame:
    """Catalog documents from a column of JSON text."""
    return df.select(F.from_json(column, document_schema()).alias("d")).select("d.*")
