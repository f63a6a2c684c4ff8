"""Helpers around the caller's session: shared scratch space, lineage cuts, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}
_OWN_FOLDERS: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, and only for a
    local master: executors on other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if "root" not in _LOCAL_ROOT:
        _LOCAL_ROOT["root"] = tempfile.mkdtemp(prefix="thalweg-")
    return _LOCAL_ROOT["root"]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing else uses, in the application's own folder under the scratch root.

    The application's folder goes when its driver ends.
    """
    own = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _OWN_FOLDERS.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint does, survives the loss of
    executors, and gives the planner real file sizes for the next join.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Does the table have at most ``max_rows`` rows?  Counts no further than that.

    Meant for lookups, id lists and stored tables: a costly plan would run twice.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a lookup whose row count is proven to be small.

    Beyond ``max_rows`` the table is returned without a hint, so the planner
    uses a shuffled join and adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def broadcast_all_if_small(*tables: DataFrame, max_rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """``broadcast_if_small`` for several lookups, whose rows one job counts."""
    marked = [t.limit(max_rows + 1).select(F.lit(i).alias("which")) for i, t in enumerate(tables)]
    every = marked[0]
    for more in marked[1:]:
        every = every.unionByName(more)
    counts = {r["which"]: r["count"] for r in every.groupBy("which").count().collect()}
    return [F.broadcast(t) if counts.get(i, 0) <= max_rows else t for i, t in enumerate(tables)]
