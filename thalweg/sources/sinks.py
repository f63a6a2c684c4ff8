"""Writers, and saved SQL over registered tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import fresh_folder


def write_csv(df: DataFrame, path: str) -> None:
    """Feature export with a header line per file; geometry stays behind."""
    df.drop("geom").write.option("header", "true").csv(path)


_COMMITS = "_commits"


def _commit_path(spark: SparkSession, metrics_path: str, batch: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{metrics_path.rstrip('/')}/{_COMMITS}/{batch}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_metrics(rollup: DataFrame, metrics_path: str, ledger_path: str, batch: str | None = None) -> bool:
    """Append a rollup, partitioned by watershed, and note its watersheds as processed, both or neither.

    A batch lies in folders of its own, which a repeated attempt replaces; it
    counts from the moment its commit file is there, which is written last.  A
    batch that is committed is left as it is, so a job that is repeated under
    its ``batch`` name changes nothing (the result tells whether it wrote).
    Without a name each call is a new batch.  The rollup is computed once.
    Readers that must not see unfinished batches use ``read_committed``.
    """
    spark = rollup.sparkSession
    batch = uuid.uuid4().hex if batch is None else batch
    if not re.fullmatch(r"[A-Za-z0-9.-]+", batch) or batch.startswith("."):
        raise ValueError(f"a batch is named by letters, digits, dots and dashes, not {batch!r}")
    system, commit = _commit_path(spark, metrics_path, batch)
    if system.exists(commit):
        return False
    folder = f"{metrics_path.rstrip('/')}/batch={batch}"
    rollup.write.mode("overwrite").partitionBy("huc10").parquet(folder)
    written = spark.read.schema(rollup.schema).parquet(folder)
    written.select("huc10").distinct().write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}/batch={batch}")
    system.create(commit, True).close()
    return True


def read_committed(spark: SparkSession, path: str, metrics_path: str, schema: StructType | str) -> DataFrame:
    """The committed batches of the metrics, or of the ledger beside them; ``schema`` is that of one batch."""
    system, commit = _commit_path(spark, metrics_path, "x")
    names = [f.getPath().getName() for f in system.listStatus(commit.getParent())] if system.exists(commit.getParent()) else []
    empty = spark.createDataFrame([], schema)
    if not names:
        return empty
    folders = [f"{path.rstrip('/')}/batch={n}" for n in names]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*empty.columns)


def sql_report(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Saved SQL text over registered tables, or over tables passed by name.

    Errors in the text surface to the caller.
    """
    return spark.sql(query, **tables) if tables else spark.sql(query)


def unload(spark: SparkSession, query: str, folder: str | None = None, **tables: DataFrame) -> str:
    """Result of SQL text as Parquet in a new folder, whose path is returned."""
    path = f"{folder.rstrip('/')}/{fresh_folder(spark, 'unload').rsplit('/', 1)[1]}" if folder else fresh_folder(spark, "unload")
    sql_report(spark, query, **tables).write.parquet(path)
    return path
