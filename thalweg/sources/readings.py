"""Daily readings of a project tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import listed_files


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme and authority, as Spark names files below it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")


def project_of(spark: SparkSession, root: str, path: Column, encoded: bool = False) -> Column:
    """Name of the folder right under ``root`` that holds the file; null for a file elsewhere.

    ``encoded`` says that the path is written as in ``_metadata.file_path``,
    with percent signs for special characters; others are taken literally.
    """
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    # one slash after the scheme or several: both spellings name the same file
    tidy = F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")
    top = re.sub("^([A-Za-z][A-Za-z0-9+.-]*:)/+", r"\1/", qualified(spark, root)) + "/"
    below = F.when(F.startswith(tidy, F.lit(top)), F.substring(tidy, F.lit(len(top) + 1), F.length(tidy)))
    return F.substring_index(below, "/", 1)


def read_daily_temp(spark: SparkSession, root: str, pattern: str = "*.gz") -> DataFrame:
    """All readings under a tree of project folders: ``project, comid, date, stream_temp``.

    Files are found by name at any depth and read in one scan.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(root)
    return files.select(
        project_of(spark, root, F.col("_metadata.file_path"), encoded=True).alias("project"),
        F.col("comid").cast("bigint").alias("comid"),
        "date",
        F.col("stream_temp").cast("double").alias("stream_temp"),
    )


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file under a tree: ``project, path, length``; contents are not read, and folders are listed by tasks."""
    found = listed_files(spark, root, pattern)
    return found.select(project_of(spark, root, F.col("path")).alias("project"), "path", "length")
