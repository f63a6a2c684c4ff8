"""Numbered pages of a sorted table: stored by range with each file's first row number, so a page reads its file alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file: what a page costs at most, however far it lies.
ROWS_PER_FILE = 500_000
#: Rows of a range: what a task sorts, about.  Bounds of ranges are found on the driver from a sample, a hundred rows a range.
ROWS_PER_RANGE = 500_000
_ROWS, _INDEX = "rows", "index"
#: A file's place within its range, as Spark names the files of a task that writes several.
_NUMBER = r"\.c(\d+)\."


def write_paged(table: DataFrame, path: str, order: tuple[str, ...] = ("project_id", "localPath"), rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store a table in the order of its keys, full files within ranges of keys, with an index of first row numbers by range.

    The table is counted, dealt by ranges of all its columns from the keys on,
    and sorted within each; no task holds more than a range.  A range has as
    many files as its rows fill, so small files make no more ranges, whose
    bounds pass through the driver.  Rows of equal keys follow each other in
    the order of the other columns, so equal rows alone are interchangeable.
    """
    spark = table.sparkSession
    others = [f.name for f in table.schema.fields if f.name not in order and f.dataType.typeName() not in ("map", "variant")]
    keys = [*order, *others]
    count = table.count()
    # small tables still use every core
    ranges = min(math.ceil(count / rows_per_file), max(math.ceil(count / max(rows_per_file, ROWS_PER_RANGE)), spark.sparkContext.defaultParallelism))
    if ranges:
        dealt = table.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("file", F.spark_partition_id())
        dealt.write.option("maxRecordsPerFile", str(rows_per_file)).partitionBy("file").parquet(f"{path}/{_ROWS}")
    else:  # folders by range would leave nothing to read the columns from
        table.limit(0).withColumn("file", F.lit(0)).write.parquet(f"{path}/{_ROWS}")
    counts = spark.read.parquet(f"{path}/{_ROWS}").groupBy("file").count()
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: a table of a billion rows has two thousand
    counts.select("file", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"), F.lit(rows_per_file).alias("rows_per_file")).coalesce(1).write.parquet(
        f"{path}/{_INDEX}"
    )


def read_page(spark: SparkSession, path: str, page: int, page_size: int = 500) -> DataFrame:
    """A numbered page, from 0, in order; pages past the end are empty.

    The index tells the ranges that hold the page's rows: one, or two at the
    border of ranges; their files that hold none are left unread.  A row's
    number is its range's first, the full files before its own, and its place there.
    """
    start, stop = page * page_size, (page + 1) * page_size
    index = spark.read.parquet(f"{path}/{_INDEX}")
    hit = (F.col("first") < stop) & (F.col("first") + F.col("count") > start)
    hits = {r["file"]: r for r in index.where(hit).collect()}
    rows = spark.read.parquet(f"{path}/{_ROWS}")
    first, per = F.lit(None).cast("long"), F.lit(None).cast("long")
    for file, r in hits.items():
        first = F.when(F.col("file") == file, r["first"]).otherwise(first)
        per = F.when(F.col("file") == file, r["rows_per_file"]).otherwise(per)
    before = first + per * F.regexp_extract(F.col("_metadata.file_name"), _NUMBER, 1).cast("long")
    near = rows.where(F.col("file").isin(list(hits))).where((before < stop) & (before + per > start))
    numbered = near.withColumn("row_number_", before + F.col("_metadata.row_index"))
    return numbered.where(F.col("row_number_").between(start, stop - 1)).orderBy("row_number_").drop("file", "row_number_")
