"""Search, paging, reports and incremental mirror of a project catalog.

``documents`` are typed rows as read by ``sources.projects``; ``projects`` and
``meta`` are the flat mirror tables made by ``project_rows`` and ``meta_rows``.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import bbox_overlaps, geohash
from ..functions.metadata import HUC_KEYS, VERSION_KEYS, first_key, meta_map
from ..functions.text import huc_prefix, matches_any, tags_to_text, ts_to_epoch_ms, version_parts

SEARCH_KEYS = (
    "keywords",
    "name",
    "exclude_archived",
    "created_from",
    "created_to",
    "created_within",
    "updated_from",
    "updated_to",
    "collection",
    "bbox",
    "bounds_id",
    "attributed_org_id",
    "project_type_id",
    "meta",
    "tags",
    "owned_by",
    "visibility",
)
# The named periods of ``created_within``.
PERIODS = {
    "ONE_DAY": "INTERVAL 1 DAY",
    "ONE_WEEK": "INTERVAL 7 DAYS",
    "ONE_MONTH": "INTERVAL 1 MONTH",
    "SIX_MONTHS": "INTERVAL 6 MONTHS",
}


def _contains(column: Column, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))


def catalog_filter(documents: DataFrame, params: Mapping[str, Any], now: datetime | None = None) -> DataFrame:
    """Documents that meet every given condition.

    Text conditions are plain substrings whatever the case.  Archived projects
    are left out unless ``exclude_archived`` is false.
    """
    unknown = set(params) - set(SEARCH_KEYS)
    if unknown:
        raise ValueError(f"unknown search parameters: {sorted(unknown)}")
    if params.get("created_within") and (params.get("created_from") or params.get("created_to")):
        raise ValueError("created_within cannot be used with created_from or created_to")
    tests: list[Column] = []
    if params.get("exclude_archived", True):
        tests.append(~F.coalesce("archived", F.lit(False)))
    if params.get("project_type_id"):
        tests.append(F.lower("projectType.id") == params["project_type_id"].lower())
    for tag in params.get("tags") or ():
        tests.append(F.array_contains("tags", tag))
    for key, value in (params.get("meta") or {}).items():
        tests.append(F.exists("meta", lambda m: (m["key"] == key) & (m["value"] == value)))  # noqa: B023
    if params.get("owned_by"):
        owner = params["owned_by"]
        tests.append(F.col("ownedBy.id") == owner["id"])
        if owner.get("type"):
            tests.append(F.upper("ownedBy.__typename") == owner["type"].upper())
    if params.get("collection"):
        tests.append(F.exists("collections", lambda c: c["id"] == params["collection"]))
    if params.get("attributed_org_id"):
        tests.append(F.exists("attribution", lambda a: a["organization"]["id"] == params["attributed_org_id"]))
    if params.get("bounds_id"):
        tests.append(F.col("bounds.id") == params["bounds_id"])
    if params.get("bbox"):
        west, south, east, north = params["bbox"]
        if west >= east or south >= north:
            raise ValueError("bbox must be [minLng, minLat, maxLng, maxLat]")
        tests.append(bbox_overlaps(F.col("bounds.bbox"), (west, south, east, north)))
    for name, column in (("created", "createdOn"), ("updated", "updatedOn")):
        if params.get(f"{name}_from"):
            tests.append(F.col(column) >= F.lit(params[f"{name}_from"]))
        if params.get(f"{name}_to"):
            tests.append(F.col(column) <= F.lit(params[f"{name}_to"]))
    if params.get("created_within"):
        moment = F.lit(now) if now else F.current_timestamp()
        tests.append(F.col("createdOn") >= moment - F.expr(PERIODS[params["created_within"]]))
    if params.get("visibility"):
        tests.append(F.col("visibility") == params["visibility"])
    if params.get("name"):
        tests.append(_contains(F.col("name"), params["name"]))
    if params.get("keywords"):
        words = params["keywords"]
        fields = [F.col(c) for c in ("id", "name", "summary", "description")]
        hit = F.exists("tags", lambda t: _contains(t, words)) | F.exists(
            "meta", lambda m: _contains(m["key"], words) | _contains(m["value"], words)
        )
        hit = F.coalesce(hit, F.lit(False))
        for field in fields:
            hit = hit | _contains(field, words)
        tests.append(hit)
    found = documents
    for test in tests:
        found = found.where(test)
    return found


def _document_version() -> Column:
    return version_parts(F.element_at(meta_map("meta", normalised=True), "modelversion"))


def catalog_sort(documents: DataFrame, orders: Sequence[str], user_id: str | None = None) -> DataFrame:
    """Sort by the named orders; ties end on the id so that the order is total."""
    keys: dict[str, Column] = {}
    directions: list[Column] = []
    for number, order in enumerate(orders):
        descending = not order.endswith("_ASC")
        if order == "AREA_DESC":
            value = F.col("bounds.area")
        elif order == "MINE":
            if user_id is None:
                raise ValueError("MINE needs the id of the user")
            value = F.col("ownedBy.id") == user_id
        else:
            value = {
                "DATE_CREATED": F.col("createdOn"),
                "DATE_UPDATED": F.col("updatedOn"),
                "MODEL_VERSION": _document_version(),
                "NAME": F.col("name"),
            }[order.rsplit("_", 1)[0]]
        key = f"_order_{number}"
        keys[key] = value
        directions.append(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last())
    # Keys are columns, computed once per row rather than at every comparison.
    return documents.withColumns(keys).orderBy(*directions, F.col("id").asc()).drop(*keys)


def catalog_page(
    documents: DataFrame, page_size: int = 500, after: tuple[datetime, str] | None = None
) -> DataFrame:
    """Next page, newest first; ``after`` is the ``(createdOn, id)`` of the last row seen.

    The pair is a total order, so rows that share a millisecond with the page
    edge are neither lost nor repeated.
    """
    rows = documents
    if after is not None:
        created, last_id = F.lit(after[0]), F.lit(after[1])
        rows = rows.where(
            (F.col("createdOn") < created) | ((F.col("createdOn") == created) & (F.col("id") > last_id))
        )
    return rows.orderBy(F.col("createdOn").desc(), F.col("id").asc()).limit(page_size)


def files_page(files: DataFrame, page: int, page_size: int = 500) -> DataFrame:
    """A numbered page of a file manifest in path order."""
    return files.orderBy("project_id", "localPath").offset(page * page_size).limit(page_size)


# --- mirror -----------------------------------------------------------------


def project_rows(documents: DataFrame) -> DataFrame:
    """Documents as flat mirror rows."""
    mapped = documents.withColumn("_meta", meta_map("meta"))
    return mapped.select(
        F.col("id").alias("project_id"),
        "name",
        tags_to_text("tags").alias("tags"),
        first_key("_meta", HUC_KEYS).alias("huc10"),
        first_key("_meta", VERSION_KEYS).alias("model_version"),
        F.col("projectType.id").alias("project_type_id"),
        ts_to_epoch_ms("createdOn").alias("created_on"),
        F.col("ownedBy.id").alias("owned_by_id"),
        F.col("ownedBy.name").alias("owned_by_name"),
        F.col("ownedBy.__typename").alias("owned_by_type"),
    )


def meta_rows(documents: DataFrame) -> DataFrame:
    """One mirror row per project and metadata key."""
    return documents.select(F.col("id").alias("project_id"), F.explode(meta_map("meta")).alias("key", "value"))


def latest_created(projects: DataFrame) -> DataFrame:
    """High-water mark of the mirror: one row, null while it is empty."""
    return projects.agg(F.max("created_on").alias("latest"))


def mirror_increment(existing: DataFrame, incoming: DataFrame, since_latest: bool = True) -> DataFrame:
    """Incoming projects to append: not older than the mark and not yet present.

    A project that arrives several times is taken once, in its newest form.
    """
    fresh = incoming
    if since_latest:
        mark = latest_created(existing).scalar()
        fresh = fresh.where(mark.isNull() | (F.col("created_on") >= mark))
    others = [c for c in incoming.columns if c != "project_id"]
    ordered = ["created_on", *[c for c in others if c != "created_on"]]
    once = fresh.groupBy("project_id").agg(F.max(F.struct(*ordered)).alias("row"))
    new = once.join(existing.select("project_id"), "project_id", "left_anti")
    return new.select("project_id", *[F.col(f"row.{c}").alias(c) for c in others]).select(*incoming.columns)


def mirror_meta_increment(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming metadata to append: keys that the project does not have yet."""
    once = incoming.groupBy("project_id", "key").agg(F.max("value").alias("value"))
    return once.join(existing.select("project_id", "key"), ["project_id", "key"], "left_anti")


# --- reports ----------------------------------------------------------------


def projects_with_huc(projects: DataFrame, hucs: DataFrame) -> DataFrame:
    """Projects whose watershed is known, with its name and states."""
    known = hucs.select("huc10", F.col("name").alias("huc_name"), "states", *_geometry(hucs))
    return projects.join(known, "huc10")


def _geometry(df: DataFrame) -> list[str]:
    return ["geom"] if "geom" in df.columns else []


def huc4_coverage(covered: DataFrame, huc4s: DataFrame) -> DataFrame:
    """Projects per type, version and HUC4, with whole percent of its HUC10s and a row number.

    Rows are numbered in order of type, HUC4 and version without gathering
    them: within each type and HUC4 by a window, plus the number of rows in
    earlier groups.
    """
    grouped = covered.groupBy("project_type_id", huc_prefix("huc10", 4).alias("huc4"), "model_version").agg(
        F.count(F.lit(1)).alias("count_project")
    )
    rows = huc4s.join(grouped, "huc4", "left").select(
        "project_type_id",
        "huc4",
        "model_version",
        "count_project",
        "h10count",
        F.expr("CASE WHEN h10count <> 0 THEN (100 * coalesce(count_project, 0)) div h10count END")
        .cast("double")
        .alias("projectpc"),
        *_geometry(huc4s),
    )
    sizes = rows.groupBy("project_type_id", "huc4").agg(F.count(F.lit(1)).alias("size"))
    types = rows.groupBy("project_type_id").agg(F.count(F.lit(1)).alias("size"))
    # One row per project type: the only window without partitions, over that short list.
    first_of_type = types.select(
        "project_type_id",
        (F.sum("size").over(Window.orderBy(F.col("project_type_id").asc_nulls_first())) - F.col("size")).alias("base"),
    )
    in_type = Window.partitionBy("project_type_id").orderBy(F.col("huc4").asc_nulls_first())
    offsets = sizes.select(
        F.col("project_type_id"), "huc4", (F.sum("size").over(in_type) - F.col("size")).alias("offset")
    )
    o, t = offsets.alias("o"), first_of_type.alias("t")
    starts = o.join(t, F.col("o.project_type_id").eqNullSafe(F.col("t.project_type_id"))).select(
        "o.project_type_id", "o.huc4", (F.col("o.offset") + F.col("t.base")).alias("start")
    )
    in_cell = Window.partitionBy("project_type_id", "huc4").orderBy(F.col("model_version").asc_nulls_first())
    numbered = rows.withColumn("_n", F.row_number().over(in_cell)).alias("r")
    s = starts.alias("s")
    cell = F.col("r.project_type_id").eqNullSafe(F.col("s.project_type_id")) & F.col("r.huc4").eqNullSafe(
        F.col("s.huc4")
    )
    return numbered.join(s, cell).select(
        (F.col("s.start") + F.col("r._n")).cast("bigint").alias("row_number"),
        *[F.col(f"r.{c}") for c in rows.columns],
    )


def processing_time(projects: DataFrame, meta: DataFrame, key: str = "ProcTimeS") -> DataFrame:
    """Longest, shortest and mean minutes by owner and type; text that is no number is skipped."""
    minutes = meta.where(F.col("key") == key).select(
        "project_id", (F.col("value").try_cast("double") / 60.0).alias("minutes")
    )
    joined = minutes.join(
        projects.select(F.col("id").alias("project_id"), "owned_by_name", "project_type_id"), "project_id"
    )
    return joined.groupBy("owned_by_name", "project_type_id").agg(
        F.round(F.max("minutes"), 1).alias("max_ProcTimeM"),
        F.round(F.min("minutes"), 1).alias("min_ProcTimeM"),
        F.round(F.avg("minutes"), 1).alias("avg_ProcTimeM"),
    )


def catalog_stats(documents: DataFrame) -> DataFrame:
    """Totals of a search in long form: ``stat, key, value, amount``.

    Total count, summed area (overlaps counted), the box around everything, and
    counts by project type and by metadata key and value.
    """
    box = lambda i: F.get("bounds.bbox", F.lit(i))
    totals = documents.agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        F.sum("bounds.area").alias("area"),
        F.min(box(0)).alias("min_lng"),
        F.min(box(1)).alias("min_lat"),
        F.max(box(2)).alias("max_lng"),
        F.max(box(3)).alias("max_lat"),
    )
    nothing = F.lit(None).cast("string")
    long = totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("stat"), nothing.alias("key"), nothing.alias("value"),
                             F.col(c).alias("amount"))
                    for c in totals.columns
                ]
            )
        )
    )
    of_type = F.array(F.struct(F.lit("project_type").alias("stat"), nothing.alias("key"),
                               F.col("projectType.id").alias("value")))
    of_meta = F.transform(
        F.coalesce("meta", F.array().cast(documents.schema["meta"].dataType)),
        lambda m: F.struct(F.lit("meta").alias("stat"), m["key"].alias("key"), m["value"].alias("value")),
    )
    buckets = (
        documents.select(F.inline(F.concat(of_type, of_meta)))
        .groupBy("stat", "key", "value")
        .agg(F.count(F.lit(1)).cast("double").alias("amount"))
    )
    return long.unionByName(buckets)


def _top_with_remaining(groups: DataFrame, count: str, limit: int, tie: str) -> DataFrame:
    """Largest groups with the number of rows that fell outside them."""
    top = groups.orderBy(F.col(count).desc(), F.col(tie).asc()).limit(limit)
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).scalar()
    shown = top.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).scalar()
    return top.select("*", (total - shown).cast("bigint").alias("remaining"))


def map_clusters(documents: DataFrame, precision: int, limit: int) -> DataFrame:
    """Projects per geohash cell, largest first; the cluster sits at its members' mean centroid."""
    lng, lat = F.get("bounds.centroid", F.lit(0)), F.get("bounds.centroid", F.lit(1))
    groups = (
        documents.select(geohash(lng, lat, precision).alias("hash"), lng.alias("lng"), lat.alias("lat"))
        .where("hash IS NOT NULL")
        .groupBy("hash")
        .agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("count"))
    )
    return _top_with_remaining(groups, "count", limit, "hash")


def bounds_groups(documents: DataFrame, limit: int) -> DataFrame:
    """Projects per identical boundary, largest first."""
    groups = (
        documents.select(F.col("bounds.id").alias("bounds_id"))
        .where("bounds_id IS NOT NULL")
        .groupBy("bounds_id")
        .agg(F.count(F.lit(1)).alias("project_count"))
    )
    return _top_with_remaining(groups, "project_count", limit, "bounds_id")


def suggest_terms(documents: DataFrame, prefix: str) -> DataFrame:
    """How many projects use each tag, metadata key and metadata value with the prefix."""
    meta = F.coalesce("meta", F.array().cast(documents.schema["meta"].dataType))
    terms = F.concat(
        F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                    lambda t: F.struct(F.lit("tags").alias("kind"), t.alias("text"))),
        F.transform(meta, lambda m: F.struct(F.lit("metaKey").alias("kind"), m["key"].alias("text"))),
        F.transform(meta, lambda m: F.struct(F.lit("metaValues").alias("kind"), m["value"].alias("text"))),
    )
    # Distinct within the document, so the counts are projects.
    return (
        documents.select(F.inline(F.array_distinct(terms)))
        .where(F.startswith(F.lower("text"), F.lit(prefix.lower())))
        .groupBy("kind", "text")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def duplicate_projects(projects: DataFrame, meta: DataFrame) -> DataFrame:
    """Mark all but the newest project of each owner, type, HUC and model version for deletion.

    The newest is found by aggregation and joined back on the group and the
    project id; no group is ever sorted or held in one task.  A project with
    several HUC values is judged in each group on its own.  Equal times keep
    the lowest id.
    """
    valued = lambda key, name: (
        meta.where(F.col("key") == key).select(F.col("project_id").alias("id"), F.col("value").alias(name))
    )
    tagged = projects.join(valued("HUC", "HUC"), "id").join(valued("Model Version", "model_version_meta"), "id")
    group = ["owned_by_name", "project_type_id", "HUC", "model_version_meta"]
    newest = tagged.groupBy(*group).agg(
        F.max(F.struct(F.col("created_on"), (-F.col("id")).alias("minus_id"))).alias("top")
    )
    keep = newest.select(
        (-F.col("top.minus_id")).alias("kept_id"), *[F.col(c).alias(f"kept_{c}") for c in group], F.lit("KEEP").alias("kept")
    )
    same = F.col("id") == F.col("kept_id")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    return (
        tagged.join(keep, same, "left")
        .select(
            "id",
            F.date_format(F.timestamp_millis("created_on"), "yyyy-MM-dd HH:mm:ss").alias("createdDate"),
            "owned_by_name",
            "project_type_id",
            "HUC",
            F.col("model_version_meta").alias("Model Version"),
            F.coalesce("kept", F.lit("DELETE")).alias("status"),
            "created_on",
        )
        .orderBy("HUC", "project_type_id", F.col("created_on").desc())
        .drop("created_on")
    )


def hucs_with_project(hucs: DataFrame, projects: DataFrame, meta: DataFrame, project_type: str) -> DataFrame:
    """Watersheds named by the HUC metadata of a project of the type."""
    named = meta.where(F.col("key") == "HUC").select("project_id", "key", "value")
    typed = projects.where(F.col("project_type_id") == project_type).select(
        F.col("id").alias("project_id"), "project_type_id", "owned_by_name"
    )
    used = named.join(typed, "project_id")
    return hucs.select("huc10").join(used, F.col("huc10") == F.col("value")).select(
        "huc10", "key", "value", "project_type_id", F.col("project_id").alias("id"), "owned_by_name",
        F.lit(1).alias("has_corresponding_row"),
    )


# Price per vCPU hour (1024 units) and per gigabyte hour.
CPU_HOUR = 0.04048
MEMORY_HOUR = 0.004445


def task_costs(jobs: DataFrame, tasks: DataFrame, script: str | None = None, definition: str | None = None) -> DataFrame:
    """Duration and estimated cost of each task; filters name the job's script and definition."""
    if script is not None:
        jobs = jobs.where(F.col("task_script_id") == script)
    if definition is not None:
        jobs = jobs.where(F.col("task_def_id") == definition)
    elapsed = F.col("ended_on") - F.col("started_on")
    price = F.col("cpu") / 1024.0 * CPU_HOUR + F.col("memory") / 1000.0 * MEMORY_HOUR
    return tasks.withColumnRenamed("name", "task_name").join(
        jobs.select("jid", F.col("name").alias("job_name")), "jid"
    ).select(
        "job_name",
        "cpu",
        "memory",
        "task_name",
        "status",
        F.round(elapsed / 1000.0, 0).alias("durationS"),
        F.round(price * (elapsed / 3600000.0), 2).alias("estimated_cost"),
    )


def download_plan(
    documents: DataFrame,
    files: DataFrame,
    huc: str,
    root: str,
    project_type: str = "streamtemp",
    patterns: Sequence[str] = (r".*\.gpkg$", r".*daily_stream_temperature.parquet\.gz"),
) -> DataFrame:
    """Files to fetch for a watershed prefix, with the folder that each belongs in."""
    found = catalog_filter(documents, {"project_type_id": project_type})
    located = found.select(
        F.col("id").alias("project_id"), F.element_at(meta_map("meta", normalised=True), "huc").alias("huc")
    ).where(F.startswith("huc", F.lit(str(huc))))
    wanted = files.where(matches_any("localPath", patterns))
    return wanted.join(located, "project_id").withColumn("target_dir", F.concat(F.lit(root + "/"), F.col("huc")))
