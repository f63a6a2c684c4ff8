"""File manifests: filters, sync plans, sidecar files."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_any, without_extension


def file_filter(files: DataFrame, patterns: Sequence[str] | None) -> DataFrame:
    """Files whose path matches any pattern; files without a path are dropped."""
    named = files.where("localPath IS NOT NULL")
    return named.where(matches_any("localPath", patterns)) if patterns else named


def pick_project_files(files: DataFrame) -> DataFrame:
    """First geopackage and first readings file of each folder; folders lacking either are dropped.

    ``files`` has ``project, path``.
    """
    pick = lambda ending: F.min(F.when(F.endswith("path", F.lit(ending)), F.col("path")))
    return (
        files.groupBy("project")
        .agg(pick(".gpkg").alias("gpkg_file"), pick(".gz").alias("parquet_file"))
        .where("gpkg_file IS NOT NULL AND parquet_file IS NOT NULL")
    )


def file_sync_plan(
    local: DataFrame, remote: DataFrame, direction: str = "download", force: bool = False, no_delete: bool = False
) -> DataFrame:
    """What to do with each file of each project: ``project_id, localPath, action``.

    Download copies remote files here: absent ones are downloaded, different
    ones updated, equal ones skipped, or updated too with ``force``; files that
    are only here are left alone.  Upload copies local files there: new ones
    are created, different ones updated, and files that are only there are
    deleted unless ``no_delete``.
    """
    if direction not in ("download", "upload"):
        raise ValueError(f"unknown direction {direction!r}")
    keys = ["project_id", "localPath"]
    here = local.where("localPath IS NOT NULL").select(*keys, F.col("etag").alias("local_etag"), F.lit(True).alias("here"))
    there = remote.where("localPath IS NOT NULL").select(
        *keys, F.col("etag").alias("remote_etag"), F.lit(True).alias("there")
    )
    both = here.join(there, keys, "full_outer")
    same = F.coalesce(F.col("local_etag") == F.col("remote_etag"), F.lit(False))
    if direction == "download":
        action = (
            F.when(F.col("there").isNull(), "skip")
            .when(F.col("here").isNull(), "download")
            .when(F.lit(force) | ~same, "update")
            .otherwise("skip")
        )
    else:
        action = (
            F.when(F.col("here").isNull(), "keep" if no_delete else "delete")
            .when(F.col("there").isNull(), "create")
            .when(F.lit(force) | ~same, "update")
            .otherwise("skip")
        )
    return both.select(*keys, "local_etag", "remote_etag", action.alias("action"))


def sidecar_files(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """Files that share a dataset's base name, followed by one or more short extensions.

    Each file lists the base names it could belong to (one per trailing
    extension of one to three word characters); bases then meet by equality.
    """
    run = F.regexp_extract("localPath", r"(?U)((?:\.\w{1,3})+)$", 1)
    parts = F.split(F.substring(F.col("run"), F.lit(2), F.length("run")), r"\.")
    bases = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.substring(
            F.col("localPath"),
            F.lit(1),
            F.length("localPath")
            - F.length(F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
            - 1,
        ),
    )
    candidates = (
        files.withColumn("run", run).where("run <> ''").select("project_id", "localPath", F.explode(bases).alias("base"))
    )
    wanted = datasets.select("project_id", "dataset_path", without_extension("dataset_path").alias("base"))
    return candidates.join(wanted, ["project_id", "base"]).select("project_id", "dataset_path", "localPath")


def file_audit(
    referenced: DataFrame, present: DataFrame, manifest_name: str = "project.rs.xml"
) -> DataFrame:
    """Files on disk that no manifest names, and named files that are not on disk.

    Both inputs have ``project_id, path``.  The manifest itself and hidden
    files are no one's business.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    visible = present.where((name != manifest_name) & ~F.startswith(name, F.lit("."))).select("project_id", "path")
    wanted = referenced.where("path IS NOT NULL").select("project_id", "path").distinct()
    keys = ["project_id", "path"]
    unreferenced = visible.join(wanted, keys, "left_anti").select(*keys, F.lit("unreferenced").alias("finding"))
    missing = wanted.join(present.select(*keys), keys, "left_anti").select(*keys, F.lit("missing").alias("finding"))
    return unreferenced.unionByName(missing)


