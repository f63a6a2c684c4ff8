"""Queries: project catalog, files, digests, manifests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.digest import etag
from ..functions.metadata import HUC_KEYS, VERSION_KEYS, first_key, meta_map
from ..functions.text import (
    epoch_ms_to_ts,
    huc_folder,
    huc_prefix,
    normalise_meta_key,
    sanitize_version,
    tags_to_text,
    text_to_tags,
    ts_to_epoch_ms,
    version_parts,
)
from ..operators import batch, catalog, filesync, manifest, page_index
from ..session import fresh_folder
from ..sources.files import file_digests
from ..sources.manifests import parse_project_xml
from ..sources.projects import parse_projects
from ..sources.readings import list_files
from ..sources.sinks import sql_report, unload
from .inputs import HUC10, Inputs
from .registry import query

HUC = HUC10.format("o_custkey")
VERSION = "concat('1.0', CAST(o_custkey % 3 AS STRING), '.00')"
P = "concat('p', CAST(o_orderkey AS STRING))"
NOT_ARCHIVED = "o_orderstatus <> 'P'"
OWNER = "concat('owner', CAST(o_custkey % 9 AS STRING))"


# --- documents ---------------------------------------------------------------


@query(
    "catalog_projects",
    f"""SELECT {P} AS id, concat('Project ', CAST(o_orderkey % 97 AS STRING)) AS name, o_orderstatus = 'P' AS archived,
    o_custkey * 10 AS totalSize, o_orderpriority AS project_type, {OWNER} AS owner, o_totalprice AS area,
    concat('b', CAST(o_custkey % 50 AS STRING)) AS bounds_id, {{order_ms}} AS created_on, 4 AS meta_items,
    concat('r', CAST(o_custkey % 6 AS STRING)) AS runner FROM orders""".replace(
        "{order_ms}", "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000"
    ),
)
def catalog_projects(spark, folder):
    documents = parse_projects(Inputs(spark, folder).documents_json, "json")
    return documents.select(
        "id", "name", "archived", "totalSize", F.col("projectType.id").alias("project_type"),
        F.col("ownedBy.name").alias("owner"), F.col("bounds.area").alias("area"), F.col("bounds.id").alias("bounds_id"),
        ts_to_epoch_ms("createdOn").alias("created_on"), F.size("meta").alias("meta_items"),
        F.element_at("meta", -1)["value"].alias("runner"),
    )


@query(
    "catalog_filter",
    f"""SELECT 1 AS search, {P} AS id FROM orders WHERE {NOT_ARCHIVED} AND o_orderpriority = '1-URGENT'
        AND (o_custkey % 4 = 2 OR o_custkey % 3 + 2 = 2) AND o_custkey % 6 = 2
    UNION ALL SELECT 2, {P} FROM orders WHERE {NOT_ARCHIVED} AND o_custkey % 9 = 3
        AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'
    UNION ALL SELECT 3, {P} FROM orders WHERE o_custkey % 120 - 150 <= -120 AND o_custkey % 120 - 149 >= -130.5
        AND o_custkey % 40 + 10 <= 30 AND o_custkey % 40 + 11 >= 20 AND o_orderkey % 12 = 4
    UNION ALL SELECT 4, {P} FROM orders WHERE {NOT_ARCHIVED} AND o_orderstatus = 'O' AND o_custkey % 50 = 7
    UNION ALL SELECT 5, {P} FROM orders WHERE {NOT_ARCHIVED} AND o_custkey % 8 = 5 AND
        (o_custkey % 4 = 3 OR {P} LIKE '%t3%' OR o_custkey % 3 + 2 = 3)
    UNION ALL SELECT 6, {P} FROM orders WHERE {NOT_ARCHIVED} AND o_orderdate >= TIMESTAMP '1997-07-01'""",
)
def catalog_filter(spark, folder):
    docs = Inputs(spark, folder).catalog
    searches = [
        {"project_type_id": "1-urgent", "tags": ["t2"], "meta": {"Runner": "r2"}},
        {"owned_by": {"id": "u3", "type": "USER"}, "created_from": datetime(1995, 1, 1), "created_to": datetime(1996, 12, 31)},
        {"exclude_archived": False, "bbox": [-130.5, 20, -120, 30], "collection": "c4"},
        {"visibility": "PUBLIC", "bounds_id": "b7"},
        {"attributed_org_id": "org5", "keywords": "T3"},
        {"created_within": "SIX_MONTHS"},
    ]
    total = None
    for number, params in enumerate(searches, 1):
        found = catalog.catalog_filter(docs, params, now=datetime(1998, 1, 1)).select(F.lit(number).alias("search"), "id")
        total = found if total is None else total.unionByName(found)
    return total


@query(
    "catalog_sort",
    f"SELECT {P} AS id, concat('Project ', CAST(o_orderkey % 97 AS STRING)) AS name, o_totalprice AS area FROM orders",
)
def catalog_sort(spark, folder):
    ordered = catalog.catalog_sort(
        Inputs(spark, folder).catalog, ["MINE", "MODEL_VERSION_DESC", "NAME_ASC", "AREA_DESC", "DATE_UPDATED_ASC"], "u3"
    )
    return ordered.select("id", "name", F.col("bounds.area").alias("area"))


@query(
    "catalog_page",
    f"""SELECT id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM (SELECT *, {P} AS id FROM orders)
    WHERE o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND id > 'p5')
    ORDER BY o_orderdate DESC, id LIMIT 500""",
)
def catalog_page(spark, folder):
    docs = Inputs(spark, folder).catalog
    page = catalog.catalog_page(docs, 500, after=(datetime(1997, 6, 1), "p5"))
    return page.select("id", F.date_format("createdOn", "yyyy-MM-dd").alias("created"))


@query(
    "files_page",
    "SELECT project_id, localPath, etag FROM project_files WHERE localPath IS NOT NULL"
    " ORDER BY project_id, localPath LIMIT 500 OFFSET 500",
)
def files_page(spark, folder):
    files = filesync.file_filter(Inputs(spark, folder).project_files, None)
    return catalog.files_page(files, page=1).select("project_id", "localPath", "etag")


@query(
    "files_page_indexed",
    "SELECT project_id, localPath, etag FROM project_files WHERE localPath IS NOT NULL"
    " ORDER BY project_id, localPath LIMIT 300 OFFSET 600",
)
def files_page_indexed(spark, folder):
    """A page of a manifest that is stored by ranges."""
    path = fresh_folder(spark, "paged")
    page_index.write_paged(filesync.file_filter(Inputs(spark, folder).project_files, None), path, rows_per_file=500)
    return page_index.read_page(spark, path, 2, 300).select("project_id", "localPath", "etag")


@query(
    "meta_normalised",
    f"""SELECT {P} AS id, 'huc' AS key, {HUC} AS value FROM orders UNION ALL
    SELECT {P}, 'modelversion', {VERSION} FROM orders UNION ALL
    SELECT {P}, 'runner', 'first' FROM orders UNION ALL
    SELECT {P}, 'runner', concat('r', CAST(o_custkey % 6 AS STRING)) FROM orders""",
)
def meta_normalised(spark, folder):
    items = Inputs(spark, folder).catalog.select("id", F.inline("meta"))
    return items.select("id", normalise_meta_key("key").alias("key"), "value")


@query(
    "meta_map",
    f"""SELECT {P} AS id, 3 AS keys, {HUC} AS huc, {VERSION} AS version,
    concat('r', CAST(o_custkey % 6 AS STRING)) AS runner FROM orders""",
)
def meta_map_query(spark, folder):
    mapped = Inputs(spark, folder).catalog.select("id", meta_map("meta").alias("m"))
    return mapped.select(
        "id", F.size("m").alias("keys"), F.col("m")["HUC"].alias("huc"), F.col("m")["Model Version"].alias("version"),
        F.col("m")["Runner"].alias("runner"),
    )


@query("meta_priority", f"SELECT {P} AS id, {HUC} AS huc10, {VERSION} AS model_version FROM orders")
def meta_priority(spark, folder):
    mapped = Inputs(spark, folder).catalog.select("id", meta_map("meta").alias("m"))
    return mapped.select(
        "id", first_key("m", HUC_KEYS).alias("huc10"), first_key("m", VERSION_KEYS).alias("model_version")
    )


@query(
    "version_parts",
    f"""SELECT id, model_version, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('1.', CAST(o_custkey % 3 AS STRING),
        '.0', CASE WHEN o_orderstatus = 'F' THEN '-beta' ELSE '' END) END AS parsed FROM
    (SELECT *, {P} AS id, concat({VERSION}, CASE o_orderstatus WHEN 'F' THEN '-beta' WHEN 'P' THEN '.1' ELSE '' END)
        AS model_version FROM orders)""",
)
def version_parts_query(spark, folder):
    """Versions as stored, parsed and written again; text with a fourth number is no version."""
    tail = "CASE o_orderstatus WHEN 'F' THEN '-beta' WHEN 'P' THEN '.1' ELSE '' END"
    texts = Inputs(spark, folder).orders.selectExpr(f"{P} AS id", f"concat({VERSION}, {tail}) AS model_version")
    parts = texts.withColumn("v", version_parts("model_version"))
    dash = F.when(F.col("v.prerelease") != "", F.concat(F.lit("-"), "v.prerelease")).otherwise("")
    written = F.concat(F.concat_ws(".", *[F.col(f"v.{n}").cast("string") for n in ("major", "minor", "patch")]), dash)
    return parts.select("id", "model_version", F.when(F.col("v").isNotNull(), written).alias("parsed"))


@query(
    "sanitize_version",
    f"SELECT {P} AS id, concat('1.', CAST(o_custkey % 3 AS STRING), '.0') AS version FROM orders",
)
def sanitize_version_query(spark, folder):
    return Inputs(spark, folder).orders.selectExpr(f"{P} AS id", f"{VERSION} AS v").select(
        "id", sanitize_version("v").alias("version")
    )


@query(
    "epoch_ts",
    "SELECT id, created_on, strftime(make_timestamp(created_on * 1000), '%Y-%m-%d %H:%M:%S') AS created, created_on AS again"
    " FROM projects",
)
def epoch_ts(spark, folder):
    rows = Inputs(spark, folder).projects.withColumn("ts", epoch_ms_to_ts("created_on"))
    return rows.select(
        "id", "created_on", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"), ts_to_epoch_ms("ts").alias("again")
    )


@query(
    "huc_prefix",
    "SELECT id, " + ", ".join(f"substr(huc10, 1, {n}) AS huc{n}" for n in (2, 4, 6, 8)) +
    ", concat('HUC_', huc10) AS folder FROM projects",
)
def huc_prefix_query(spark, folder):
    rows = Inputs(spark, folder).projects
    return rows.select(
        "id", *[huc_prefix("huc10", n).alias(f"huc{n}") for n in (2, 4, 6, 8)], huc_folder("huc10").alias("folder")
    )


@query(
    "tags_text",
    f"""SELECT {P} AS id, concat('t', CAST(o_custkey % 4 AS STRING), ',t', CAST(o_custkey % 3 + 2 AS STRING)) AS tags,
    concat('t', CAST(o_custkey % 3 + 2 AS STRING)) AS second FROM orders""",
)
def tags_text(spark, folder):
    rows = Inputs(spark, folder).catalog.select("id", tags_to_text("tags").alias("tags"))
    spaced = F.replace("tags", F.lit(","), F.lit(" , "))
    return rows.select("id", "tags", F.get(text_to_tags(spaced), F.lit(1)).alias("second"))


# --- reports -----------------------------------------------------------------


@query(
    "projects_with_huc",
    "SELECT p.id, p.project_id, p.project_type_id, p.huc10, h.name AS huc_name, h.states, p.model_version, p.created_on"
    " FROM projects p JOIN conus_hucs h ON p.huc10 = h.huc10",
)
def projects_with_huc(spark, folder):
    i = Inputs(spark, folder)
    return catalog.projects_with_huc(i.projects, i.conus_hucs).select(
        "id", "project_id", "project_type_id", "huc10", "huc_name", "states", "model_version", "created_on"
    )


@query(
    "huc4_coverage",
    """WITH c AS (SELECT p.project_type_id, substr(p.huc10, 1, 4) AS huc4, p.model_version, count(*) AS count_project
        FROM projects p JOIN conus_hucs h ON p.huc10 = h.huc10 GROUP BY 1, 2, 3)
    SELECT row_number() OVER (ORDER BY c.project_type_id NULLS FIRST, w.huc4 NULLS FIRST, c.model_version NULLS FIRST) AS row_number,
        c.project_type_id, w.huc4, c.model_version, c.count_project, w.h10count,
        CAST((100 * coalesce(c.count_project, 0)) // w.h10count AS DOUBLE) AS projectpc
    FROM huc4_counts w LEFT JOIN c ON w.huc4 = c.huc4""",
)
def huc4_coverage(spark, folder):
    i = Inputs(spark, folder)
    return catalog.huc4_coverage(catalog.projects_with_huc(i.projects, i.conus_hucs), i.huc4_counts)


@query(
    "processing_time",
    """SELECT owned_by_name, project_type_id, round(max(m), 1) AS max_ProcTimeM, round(min(m), 1) AS min_ProcTimeM,
        round(avg(m), 1) AS avg_ProcTimeM FROM (SELECT p.*, TRY_CAST(e.value AS DOUBLE) / 60 AS m
        FROM projects p JOIN project_meta e ON e.project_id = p.id WHERE e.key = 'ProcTimeS') GROUP BY 1, 2""",
)
def processing_time(spark, folder):
    i = Inputs(spark, folder)
    return catalog.processing_time(i.projects, i.project_meta)


@query(
    "catalog_stats",
    f"""WITH d AS (SELECT *, CAST(o_custkey % 120 - 150 AS DOUBLE) AS w, CAST(o_custkey % 40 + 10 AS DOUBLE) AS s
        FROM orders WHERE {NOT_ARCHIVED}),
    m AS (SELECT 'HUC' AS key, {HUC} AS value FROM d UNION ALL SELECT 'Model Version', {VERSION} FROM d
        UNION ALL SELECT 'Runner', 'first' FROM d UNION ALL SELECT 'Runner', concat('r', CAST(o_custkey % 6 AS STRING)) FROM d)
    SELECT 'total' AS stat, NULL AS key, NULL AS value, CAST(count(*) AS DOUBLE) AS amount FROM d
    UNION ALL SELECT 'area', NULL, NULL, round(sum(o_totalprice), 2) FROM d
    UNION ALL SELECT 'min_lng', NULL, NULL, min(w) FROM d UNION ALL SELECT 'min_lat', NULL, NULL, min(s) FROM d
    UNION ALL SELECT 'max_lng', NULL, NULL, max(w) + 1 FROM d UNION ALL SELECT 'max_lat', NULL, NULL, max(s) + 1 FROM d
    UNION ALL SELECT 'project_type', NULL, o_orderpriority, CAST(count(*) AS DOUBLE) FROM d GROUP BY 3
    UNION ALL SELECT 'meta', key, value, CAST(count(*) AS DOUBLE) FROM m GROUP BY 2, 3""",
)
def catalog_stats(spark, folder):
    found = catalog.catalog_filter(Inputs(spark, folder).catalog, {})
    return catalog.catalog_stats(found).withColumn("amount", F.round("amount", 2))


def _geohash_sql(lng: str, lat: str, precision: int) -> str:
    bits = 5 * precision
    xb, yb = (bits + 1) // 2, bits // 2
    x = f"CAST(floor(({lng} + 180) / (360.0 / {1 << xb})) AS BIGINT)"
    y = f"CAST(floor(({lat} + 90) / (180.0 / {1 << yb})) AS BIGINT)"
    letters = []
    for letter in range(precision):
        terms = []
        for place, bit in enumerate(range(5 * letter, 5 * letter + 5)):
            source, shift = (x, xb - 1 - bit // 2) if bit % 2 == 0 else (y, yb - 1 - bit // 2)
            terms.append(f"(({source} >> {shift}) % 2) * {1 << (4 - place)}")
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + {' + '.join(terms)}, 1)")
    return f"concat({', '.join(letters)})"


@query(
    "map_clusters",
    f"""WITH d AS (SELECT o_custkey % 120 - 149.7 AS lng, o_custkey % 40 + 10.7 AS lat FROM orders),
    g AS (SELECT {_geohash_sql('lng', 'lat', 2)} AS hash, round(avg(CAST(lng AS DOUBLE)), 6) AS lng, round(avg(CAST(lat AS DOUBLE)), 6) AS lat,
        count(*) AS count FROM d GROUP BY 1),
    t AS (SELECT * FROM g ORDER BY count DESC, hash LIMIT 12)
    SELECT *, CAST((SELECT sum(count) FROM g) - (SELECT sum(count) FROM t) AS BIGINT) AS remaining FROM t""",
)
def map_clusters(spark, folder):
    found = catalog.map_clusters(Inputs(spark, folder).catalog, precision=2, limit=12)
    return found.withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


@query(
    "bounds_groups",
    """WITH g AS (SELECT concat('b', CAST(o_custkey % 50 AS STRING)) AS bounds_id, count(*) AS project_count FROM orders GROUP BY 1),
    t AS (SELECT * FROM g ORDER BY project_count DESC, bounds_id LIMIT 20)
    SELECT *, CAST((SELECT sum(project_count) FROM g) - (SELECT sum(project_count) FROM t) AS BIGINT) AS remaining FROM t""",
)
def bounds_groups(spark, folder):
    return catalog.bounds_groups(Inputs(spark, folder).catalog, limit=20)


@query(
    "suggest_terms",
    """WITH t AS (SELECT DISTINCT o_orderkey, kind, text FROM (
        SELECT o_orderkey, 'tags' AS kind, concat('t', CAST(o_custkey % 4 AS STRING)) AS text FROM orders UNION ALL
        SELECT o_orderkey, 'tags', concat('t', CAST(o_custkey % 3 + 2 AS STRING)) FROM orders UNION ALL
        SELECT o_orderkey, 'metaKey', 'Runner' FROM orders UNION ALL
        SELECT o_orderkey, 'metaValues', concat('r', CAST(o_custkey % 6 AS STRING)) FROM orders))
    SELECT kind, text, count(*) AS freq FROM t WHERE lower(text) LIKE 'r%' GROUP BY 1, 2""",
)
def suggest_terms(spark, folder):
    return catalog.suggest_terms(Inputs(spark, folder).catalog, "R")


@query(
    "duplicate_projects",
    f"""WITH d AS (SELECT p.id, p.created_on, p.owned_by_name, p.project_type_id, h.value AS "HUC", v.value AS "Model Version",
        row_number() OVER (PARTITION BY p.owned_by_name, p.project_type_id, h.value, v.value
                           ORDER BY p.created_on DESC, p.id) AS n
        FROM projects p JOIN project_meta h ON h.project_id = p.id AND h.key = 'HUC'
        JOIN project_meta v ON v.project_id = p.id AND v.key = 'Model Version')
    SELECT id, strftime(make_timestamp(created_on * 1000), '%Y-%m-%d %H:%M:%S') AS "createdDate", owned_by_name, project_type_id,
        "HUC", "Model Version", CASE WHEN n = 1 THEN 'KEEP' ELSE 'DELETE' END AS status FROM d""",
)
def duplicate_projects(spark, folder):
    i = Inputs(spark, folder)
    return catalog.duplicate_projects(i.projects, i.project_meta)


@query(
    "hucs_with_project",
    """SELECT h.huc10, m.key, m.value, p.project_type_id, p.id, p.owned_by_name, 1 AS has_corresponding_row
    FROM conus_hucs h JOIN project_meta m ON m.value = h.huc10 JOIN projects p ON m.project_id = p.id
    WHERE m.key = 'HUC' AND p.project_type_id = '2-HIGH'""",
)
def hucs_with_project(spark, folder):
    i = Inputs(spark, folder)
    return catalog.hucs_with_project(i.conus_hucs, i.projects, i.project_meta, "2-HIGH")


@query(
    "task_costs",
    """WITH prices AS (SELECT CAST(0.04048 AS DOUBLE) AS core_hour, CAST(0.004445 AS DOUBLE) AS gigabyte_hour),
    wanted AS (SELECT jid, name AS job_name FROM cc_jobs WHERE task_def_id = 'O' AND task_script_id = '1-URGENT'),
    used AS (SELECT jid, name AS task_name, status, cpu, memory, (ended_on - started_on) / CAST(1000 AS DOUBLE) AS seconds,
        CAST(cpu AS DOUBLE) / 1024 AS cores, CAST(memory AS DOUBLE) / 1000 AS gigabytes FROM cc_tasks),
    priced AS (SELECT used.*, seconds / 3600 AS hours, cores * core_hour + gigabytes * gigabyte_hour AS per_hour FROM used, prices)
    SELECT job_name, task_name, status, cpu, memory, round(seconds, 0) AS "durationS", round(per_hour * hours, 2) AS estimated_cost
    FROM priced JOIN wanted USING (jid)""",
)
def task_costs(spark, folder):
    i = Inputs(spark, folder)
    return catalog.task_costs(i.cc_jobs, i.cc_tasks, "1-URGENT", "O")


REPORT = """SELECT {0}owned_by_name, project_type_id, count(*) AS projects FROM {1} GROUP BY owned_by_name, project_type_id"""


@query("sql_report", REPORT.format("", "projects"))
def sql_report_query(spark, folder):
    return sql_report(spark, REPORT.format("", "{p}"), p=Inputs(spark, folder).projects)


@query("unload", REPORT.format("", "projects"))
def unload_query(spark, folder):
    return spark.read.parquet(unload(spark, REPORT.format("", "{p}"), p=Inputs(spark, folder).projects))


# --- mirror ------------------------------------------------------------------

ROW_SQL = f"""SELECT {P} AS project_id, concat('Project ', CAST(o_orderkey % 97 AS STRING)) AS name,
    concat('t', CAST(o_custkey % 4 AS STRING), ',t', CAST(o_custkey % 3 + 2 AS STRING)) AS tags, {HUC} AS huc10,
    {VERSION} AS model_version, o_orderpriority AS project_type_id,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000 AS created_on,
    concat('u', CAST(o_custkey % 9 AS STRING)) AS owned_by_id, {OWNER} AS owned_by_name,
    CASE WHEN o_custkey % 9 < 4 THEN 'User' ELSE 'Organization' END AS owned_by_type FROM orders"""


@query("project_rows", ROW_SQL)
def project_rows(spark, folder):
    return catalog.project_rows(Inputs(spark, folder).catalog)


@query(
    "mirror_increment",
    f"""WITH r AS ({ROW_SQL}), have AS (SELECT * FROM r WHERE project_type_id < '3' AND created_on < 852076800000)
    SELECT project_id, name, created_on FROM r WHERE created_on >= (SELECT max(created_on) FROM have)
    AND project_id NOT IN (SELECT project_id FROM have)""",
)
def mirror_increment(spark, folder):
    """The mirror holds two types up to 1996; every document arrives again, twice."""
    rows = catalog.project_rows(Inputs(spark, folder).catalog)
    have = rows.where("project_type_id < '3' AND created_on < 852076800000")
    return catalog.mirror_increment(have, rows.unionByName(rows)).select("project_id", "name", "created_on")


@query(
    "mirror_meta_increment",
    f"""SELECT {P} AS project_id, 'HUC' AS key, {HUC} AS value FROM orders WHERE o_orderpriority >= '3' UNION ALL
    SELECT {P}, 'Model Version', {VERSION} FROM orders UNION ALL
    SELECT {P}, 'Runner', concat('r', CAST(o_custkey % 6 AS STRING)) FROM orders""",
)
def mirror_meta_increment(spark, folder):
    docs = Inputs(spark, folder).catalog
    have = catalog.meta_rows(docs.where(F.col("projectType.id") < "3")).where(F.col("key") == "HUC")
    return catalog.mirror_meta_increment(have, catalog.meta_rows(docs))


@query(
    "download_plan",
    f"""WITH d AS (SELECT {P} AS project_id, {HUC} AS huc FROM orders WHERE {NOT_ARCHIVED} AND o_orderpriority = '1-URGENT')
    SELECT f.project_id, f.localPath, f.size, concat('/data/', d.huc) AS target_dir
    FROM project_files f JOIN d ON f.project_id = d.project_id WHERE d.huc LIKE '000%'
    AND (lower(f.localPath) LIKE '%.gpkg' OR lower(f.localPath) LIKE '%daily_stream_temperature.parquet.gz%')""",
)
def download_plan(spark, folder):
    i = Inputs(spark, folder)
    plan = catalog.download_plan(i.catalog, i.project_files, "000", "/data", project_type="1-Urgent")
    return plan.select("project_id", "localPath", "size", "target_dir")


@query(
    "batch_projects",
    f"""SELECT {P} AS project_id, CASE WHEN o_orderstatus <> 'P' THEN upper(o_orderpriority) END AS label,
    CASE WHEN o_orderstatus = 'P' THEN concat('ValueError: pending ', CAST(o_orderkey AS STRING)) END AS error FROM orders""",
)
def batch_projects(spark, folder):
    """A user function over every project that fails for part of them."""

    def work(row):
        if row["o_orderstatus"] == "P":
            raise ValueError(f"pending {row['o_orderkey']}")
        return {"label": row["o_orderpriority"].upper()}

    rows = Inputs(spark, folder).orders.withColumn("project_id", F.concat(F.lit("p"), F.col("o_orderkey").cast("string")))
    return batch.batch_projects(rows, work, StructType([StructField("label", StringType())]))


# --- files -------------------------------------------------------------------


@query(
    "pick_files",
    """SELECT project_id AS project, min(CASE WHEN localPath LIKE '%.gpkg' THEN localPath END) AS gpkg_file,
        min(CASE WHEN localPath LIKE '%.gz' THEN localPath END) AS parquet_file
    FROM (SELECT project_id, replace(localPath, '.GZ', '.gz') AS localPath FROM local_files) GROUP BY 1
    HAVING gpkg_file IS NOT NULL AND parquet_file IS NOT NULL""",
)
def pick_files(spark, folder):
    files = Inputs(spark, folder).local_files
    paths = files.select(F.col("project_id").alias("project"), F.replace("localPath", F.lit(".GZ"), F.lit(".gz")).alias("path"))
    return filesync.pick_project_files(paths)


@query("list_files", "SELECT project, count(*) AS files FROM (SELECT DISTINCT project, floor(featureid / 500) AS slice"
       " FROM contributing_area) GROUP BY project")
def list_files_query(spark, folder):
    root = Inputs(spark, folder).written_geopackages()
    return list_files(spark, root, "*.gpkg").groupBy("project").agg(F.count(F.lit(1)).alias("files"))


@query(
    "file_filter",
    """SELECT project_id, localPath, etag FROM project_files WHERE lower(localPath) LIKE '%.gpkg'
    OR lower(localPath) LIKE 'data/en/%'""",
)
def file_filter(spark, folder):
    found = filesync.file_filter(Inputs(spark, folder).project_files, [r".*\.gpkg$", r"DATA/en/"])
    return found.select("project_id", "localPath", "etag")


def _etag_sql(chunk: int, threshold: int) -> str:
    data = "encode(text)"
    return f"""SELECT doc_id, octet_length({data}) AS length,
    concat('"', CASE WHEN octet_length({data}) < {threshold} THEN md5({data}) ELSE concat(md5(unhex(array_to_string(
        list_transform(range(0, CAST(ceil(octet_length({data}) / {chunk}.0) AS BIGINT)),
            lambda i: md5(unhex(substr(hex({data}), i * {2 * chunk} + 1, {2 * chunk})))), ''))),
        '-', CAST(CAST(ceil(octet_length({data}) / {chunk}.0) AS BIGINT) AS VARCHAR)) END, '"') AS etag FROM documents"""


@query("etag_column", _etag_sql(1000, 3000))
def etag_column(spark, folder):
    """Entity tags of whole document texts, with small parts so that many have several."""
    docs = Inputs(spark, folder).documents
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("length"), etag(F.col("text").cast("binary"), 1000, 3000).alias("etag"))


#: Files of a bounded number of documents, so that files and the tasks that write them grow with the rows; every fiftieth alone.
SHELF = "CASE WHEN doc_id % 50 = 0 THEN -1 - doc_id ELSE CAST(floor(doc_id / 40.0) AS BIGINT) END"


@query(
    "file_etag",
    f"""WITH f AS (SELECT {SHELF} AS shelf, encode(string_agg(text || chr(10), '' ORDER BY doc_id)) AS data FROM documents GROUP BY 1),
    n AS (SELECT shelf, data, octet_length(data) AS length, CAST(ceil(octet_length(data) / 4096.0) AS BIGINT) AS parts FROM f)
    SELECT shelf, length, concat('"', CASE WHEN length < 65536 THEN md5(data) ELSE concat(md5(unhex(array_to_string(
        list_transform(range(0, parts), lambda i: md5(unhex(substr(hex(data), i * 8192 + 1, 8192)))), ''))), '-', CAST(parts AS VARCHAR)) END,
        '"') AS etag FROM n""",
)
def file_etag(spark, folder):
    """Entity tags of files written from the documents, large ones digested part by part."""
    root = fresh_folder(spark, "texts")
    shelved = Inputs(spark, folder).documents.selectExpr(f"{SHELF} AS shelf", "doc_id", "text")
    shelved.repartition("shelf").sortWithinPartitions("shelf", "doc_id").select("shelf", "text").write.partitionBy("shelf").text(root)
    found = file_digests(spark, root, part_bytes=4096, threshold=65536, pattern="*.txt")
    return found.select(F.regexp_extract("path", "shelf=(-?[0-9]+)/", 1).cast("bigint").alias("shelf"), "length", "etag")


@query(
    "file_sync_plan",
    """WITH l AS (SELECT * FROM local_files WHERE localPath IS NOT NULL), r AS (SELECT * FROM project_files WHERE localPath IS NOT NULL),
    b AS (SELECT coalesce(l.project_id, r.project_id) AS project_id, coalesce(l.localPath, r.localPath) AS "localPath",
        l.etag AS local_etag, r.etag AS remote_etag
        FROM l FULL JOIN r ON l.project_id = r.project_id AND l.localPath = r.localPath)
    SELECT 'download' AS direction, *, CASE WHEN remote_etag IS NULL THEN 'skip' WHEN local_etag IS NULL THEN 'download'
        WHEN local_etag <> remote_etag THEN 'update' ELSE 'skip' END AS action FROM b
    UNION ALL SELECT 'upload', *, CASE WHEN local_etag IS NULL THEN 'delete' WHEN remote_etag IS NULL THEN 'create'
        WHEN local_etag <> remote_etag THEN 'update' ELSE 'skip' END FROM b""",
)
def file_sync_plan(spark, folder):
    i = Inputs(spark, folder)
    plans = [
        filesync.file_sync_plan(i.local_files, i.project_files, direction).withColumn("direction", F.lit(direction))
        for direction in ("download", "upload")
    ]
    return plans[0].unionByName(plans[1])


@query(
    "sidecar_files",
    """SELECT d.project_id, d.localPath AS dataset_path, f.localPath AS "localPath" FROM project_files d JOIN project_files f
    ON d.project_id = f.project_id WHERE d.localPath LIKE '%.tif' AND (f.localPath LIKE '%.tif' OR f.localPath LIKE '%.tif.aux.xml')""",
)
def sidecar_files(spark, folder):
    files = Inputs(spark, folder).project_files
    datasets = files.where("localPath LIKE '%.tif'").select("project_id", F.col("localPath").alias("dataset_path"))
    return filesync.sidecar_files(files.where("localPath IS NOT NULL"), datasets)


@query(
    "xml_file_audit",
    """WITH w AS (SELECT DISTINCT project_id, localPath AS path FROM project_files WHERE localPath IS NOT NULL),
    h AS (SELECT project_id, localPath AS path FROM local_files WHERE localPath IS NOT NULL)
    SELECT project_id, path, 'missing' AS finding FROM w WHERE NOT EXISTS
        (SELECT 1 FROM h WHERE h.project_id = w.project_id AND h.path = w.path)
    UNION ALL SELECT project_id, path, 'unreferenced' FROM h WHERE path NOT LIKE '%/.hidden%' AND NOT EXISTS
        (SELECT 1 FROM w WHERE h.project_id = w.project_id AND h.path = w.path)""",
)
def xml_file_audit(spark, folder):
    i = Inputs(spark, folder)
    named = lambda df: df.where("localPath IS NOT NULL").select("project_id", F.col("localPath").alias("path"))
    return filesync.file_audit(named(i.project_files), named(i.local_files))


# --- manifests ---------------------------------------------------------------

C = "concat('c', CAST(o_orderkey AS STRING))"
R = "concat('r', CAST(o_orderkey AS STRING))"
REF = f"CASE WHEN o_orderstatus = 'P' THEN 'nowhere' ELSE {C} END"


@query(
    "xml_projects",
    f"""SELECT {P} AS project_id, concat('Project ', CAST(o_orderkey % 97 AS STRING)) AS name, o_orderpriority AS project_type,
    concat('w', CAST(o_orderkey AS STRING)) AS warehouse_id, 1 AS realizations, 1 AS events FROM orders""",
)
def xml_projects(spark, folder):
    p = "project"
    parsed = parse_project_xml(Inputs(spark, folder).manifests, datasets=False, meta=False, bounds=False)
    return parsed.select(
        "project_id", F.col(f"{p}.Name").alias("name"), F.col(f"{p}.ProjectType").alias("project_type"),
        F.col(f"{p}.Warehouse._id").alias("warehouse_id"), F.size(f"{p}.Realizations.Realization").alias("realizations"),
        F.size(f"{p}.QAQCEvents.QAQCEvent").alias("events"),
    )


@query(
    "xml_datasets",
    f"""SELECT {P} AS project_id, 'CommonDatasets' AS container, NULL AS realization_id, NULL AS analysis_id, 'Raster' AS tag,
        0 AS position, {C} AS dataset_id, 'Terrain' AS name, 'inputs/dem.tif' AS path, NULL AS ref FROM orders
    UNION ALL SELECT {P}, 'Inputs', {R}, NULL, 'CommonDatasetRef', 0, NULL, NULL, NULL, {REF} FROM orders
    UNION ALL SELECT {P}, 'Outputs', {R}, NULL, 'Vector', 0, 'v1', 'First', concat('outputs/a', CAST(o_custkey AS STRING), '.shp'), NULL FROM orders
    UNION ALL SELECT {P}, 'Outputs', {R}, NULL, 'Vector', 1, 'v2', 'Second', 'outputs/b.shp', NULL FROM orders
    UNION ALL SELECT {P}, 'Outputs', {R}, NULL, 'Geopackage', 0, 'g1', 'Results', 'outputs/g.gpkg', NULL FROM orders
    UNION ALL SELECT {P}, 'Products', {R}, 'a1', 'CommonDatasetRef', 0, NULL, NULL, NULL, {C} FROM orders
    UNION ALL SELECT {P}, 'Products', {R}, 'a1', 'CSV', 0, 't1', 'Table', 'outputs/t.csv', NULL FROM orders""",
)
def xml_datasets(spark, folder):
    return manifest.xml_datasets(Inputs(spark, folder).manifests).select(
        "project_id", "container", "realization_id", "analysis_id", "tag", "position", "dataset_id", "name", "path", "ref"
    )


@query(
    "xml_layers",
    f"""SELECT {P} AS project_id, 'g1' AS dataset_id, 'outputs/g.gpkg' AS path, 'Vector' AS layer_type,
        concat('lines', CAST(o_custkey % 7 AS STRING)) AS layer_name, 'Lines' AS name FROM orders
    UNION ALL SELECT {P}, 'g1', 'outputs/g.gpkg', 'DataTable', 'facts', 'Facts' FROM orders""",
)
def xml_layers(spark, folder):
    return manifest.xml_layers(Inputs(spark, folder).manifests).select(
        "project_id", "dataset_id", "path", "layer_type", "layer_name", "name"
    )


@query(
    "xml_metadata",
    f"""SELECT {P} AS project_id, 'project' AS level, NULL AS owner, 'ModelVersion' AS name, '1.0.0' AS value, NULL AS type, FALSE AS locked
        FROM orders WHERE o_orderstatus <> 'O'
    UNION ALL SELECT {P}, 'project', NULL, 'HUC', CAST(o_custkey % 40 AS STRING),
        CASE WHEN o_orderstatus = 'P' THEN 'number' ELSE 'int' END, TRUE FROM orders
    UNION ALL SELECT {P}, 'project', NULL, 'Empty', '', NULL, FALSE FROM orders
    UNION ALL SELECT {P}, 'dataset', 'g1', 'Rows', CAST(o_custkey AS STRING), NULL, FALSE FROM orders
    UNION ALL SELECT {P}, 'metric', 'a1', 'price', CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS VARCHAR), 'float', FALSE
        FROM orders""",
)
def xml_metadata(spark, folder):
    rows = manifest.xml_metadata(Inputs(spark, folder).manifests)
    # The engines write prices differently: they are compared as numbers of two decimals.
    price = F.round(F.col("value").try_cast("double"), 2).cast("decimal(18,2)").cast("string")
    value = F.when(F.col("level") == "metric", price).otherwise(F.col("value"))
    return rows.select("project_id", "level", "owner", "name", value.alias("value"), "type", "locked")


@query(
    "xml_bounds",
    f"""SELECT {P} AS project_id, -(o_custkey % 170 + CAST(0.5 AS DOUBLE)) AS centroid_lng, o_custkey % 80 + CAST(0.25 AS DOUBLE) AS centroid_lat,
    CAST(-(o_custkey % 170) - 1 AS DOUBLE) AS min_lng, CAST(o_custkey % 80 AS DOUBLE) AS min_lat, CAST(-(o_custkey % 170) AS DOUBLE) AS max_lng,
    CAST(o_custkey % 80 + 1 AS DOUBLE) AS max_lat, 'bounds.geojson' AS path FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def xml_bounds(spark, folder):
    return manifest.xml_bounds(Inputs(spark, folder).manifests)


@query(
    "xml_qaqc",
    f"""SELECT {P} AS project_id, 'Review' AS name, '2024-01-05T10:00:00' AS date_performed,
    CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' ELSE 'unsure' END AS state,
    concat('owner', CAST(o_custkey % 5 AS STRING)) AS performed_by, o_orderstatus <> 'P' AS valid_state,
    concat('https://example.org/', CAST(o_orderkey AS STRING)) AS report FROM orders""",
)
def xml_qaqc(spark, folder):
    return manifest.xml_qaqc(Inputs(spark, folder).manifests).select(
        "project_id", "name", "date_performed", "state", "performed_by", "valid_state", F.col("links")["report"].alias("report")
    )


@query(
    "xml_resolve_refs",
    f"""SELECT {P} AS project_id, 'Inputs' AS container, {REF} AS ref, CASE WHEN o_orderstatus <> 'P' THEN 'inputs/dem.tif' END AS path,
        o_orderstatus = 'P' AS unresolved FROM orders
    UNION ALL SELECT {P}, 'Products', {C}, 'inputs/dem.tif', FALSE FROM orders""",
)
def xml_resolve_refs(spark, folder):
    return manifest.xml_resolve_refs(Inputs(spark, folder).manifests).select(
        "project_id", "container", "ref", "path", "unresolved"
    )


@query(
    "xml_audit",
    f"""SELECT {P} AS project_id, 'warning' AS severity, 'project bounds missing' AS rule, '' AS location FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT {P}, 'warning', 'model version missing', '' FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT {P}, 'error', 'realization date invalid', {R} FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT {P}, 'error', 'realization version invalid', {R} FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT {P}, 'error', 'common dataset not found', 'nowhere' FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT {P}, 'error', 'meta type invalid', 'HUC' FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT {P}, 'error', 'event state invalid', 'Review' FROM orders WHERE o_orderstatus = 'P'""",
)
def xml_audit(spark, folder):
    return manifest.xml_audit(Inputs(spark, folder).manifests)


@query(
    "manifest_diff",
    f"""SELECT {P} AS project_id, 'dataset' AS kind, concat({R}, '#0//Outputs/Vector/1') AS address, 'changed' AS status
    FROM orders WHERE o_orderstatus = 'F'""",
)
def manifest_diff(spark, folder):
    i = Inputs(spark, folder)
    return manifest.manifest_diff(i.manifests, i.manifest_text(revised=True)).select("project_id", "kind", "address", "status")
