"""Inputs of the registered queries, derived from the shared test tables.

``VIEWS`` holds SQL that Spark and the checking engine both understand;
``{...}`` marks the few expressions that they spell differently.  Temperatures
are multiples of an eighth, so their sums are exact whatever the order of rows.
"""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wkb import line_wkb, polygon_wkb
from ..session import fresh_folder
from ..sources.projects import document_schema

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPARK = {
    "order_ms": "CAST(unix_date(CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000",
    "ship_ms": "CAST(unix_date(CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000",
}
DUCK = {
    "order_ms": "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000",
    "ship_ms": "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000",
}

HUC10 = (
    "concat(lpad(CAST({0} % 8 AS STRING), 4, '0'), lpad(CAST({0} % 40 AS STRING), 6, '0'))"
)

VIEWS = {
    "daily_temp": """
        SELECT concat('p', CAST(l_suppkey % 3 AS STRING)) AS project, l_suppkey AS comid, l_shipdate AS date,
               CASE WHEN l_linenumber = 7 THEN CAST(-999 AS DOUBLE) ELSE l_quantity * CAST(0.625 AS DOUBLE) END
                   AS stream_temp
        FROM lineitem
        UNION ALL
        SELECT concat('p', CAST((l_suppkey + 1) % 3 AS STRING)), l_suppkey, l_shipdate, l_quantity * CAST(0.25 AS DOUBLE)
        FROM lineitem WHERE l_suppkey % 4 = 0""",
    "contributing_area": """
        SELECT concat('p', CAST(s_suppkey % 3 AS STRING)) AS project, s_suppkey AS featureid,
               CASE WHEN s_nationkey = 0 THEN NULL ELSE lpad(CAST(s_nationkey AS STRING), 12, '0') END AS HUC12
        FROM supplier""",
    "huc12_boundaries": """
        SELECT a.project, a.HUC12, n.n_name AS name
        FROM (SELECT DISTINCT project, HUC12 FROM contributing_area) a
        LEFT JOIN nation n ON a.HUC12 = lpad(CAST(n.n_nationkey AS STRING), 12, '0')""",
    "flow_edges": """
        SELECT s_suppkey AS comid,
               CASE WHEN s_suppkey = 0 THEN NULL ELSE CAST(floor((s_suppkey - 1) / 2) AS BIGINT) END AS tocomid,
               CASE WHEN s_suppkey % 17 = 5 THEN NULL ELSE CAST(1 + s_nationkey AS DOUBLE) END AS length_km
        FROM supplier""",
    "dgos": """
        SELECT o_orderkey AS fid, o_orderpriority AS FCode, o_totalprice AS centerline_length,
               CAST(o_custkey AS DOUBLE) AS segment_area, lpad(CAST(o_custkey % 10 AS STRING), 10, '0') AS huc10
        FROM orders""",
    "dgo_metric_values": """
        SELECT l_orderkey AS dgo_id, l_linenumber AS metric_id, l_quantity AS metric_value FROM lineitem""",
    "us_states": """
        SELECT * FROM (VALUES (1, 'low', '1,2,3,4,5,6,7,8,9,10'), (2, 'high', '41,42,43,44,45'), (3, 'none', '9999'))
            AS t(id, name, where_clause)""",
    "flows": """
        SELECT * FROM (VALUES (1, 'fast', '1-URGENT,2-HIGH'),
                              (2, 'all', '1-URGENT,2-HIGH,3-MEDIUM,4-NOT SPECIFIED,5-LOW'))
            AS t(id, name, where_clause)""",
    "owners": """
        SELECT * FROM (VALUES (1, 'a', '1,2,3,4,5'), (2, 'b', '5,6,7,8,9,10')) AS t(id, name, where_clause)""",
    "projects": f"""
        SELECT o_orderkey AS id, concat('p', CAST(o_orderkey AS STRING)) AS project_id,
               o_orderpriority AS project_type_id, {HUC10.format("o_custkey")} AS huc10,
               concat('1.0', CAST(o_custkey % 3 AS STRING), '.00') AS model_version, {{order_ms}} AS created_on,
               concat('owner', CAST(o_custkey % 5 AS STRING)) AS owned_by_name
        FROM orders""",
    "project_meta": f"""
        SELECT o_orderkey AS project_id, 'HUC' AS key, {HUC10.format("o_custkey")} AS value FROM orders
        UNION ALL
        SELECT o_orderkey, 'Model Version', concat('1.0', CAST(o_custkey % 3 AS STRING), '.00') FROM orders
        UNION ALL
        SELECT o_orderkey, 'ProcTimeS', CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE CAST(o_custkey AS STRING) END
        FROM orders""",
    "conus_hucs": f"""
        SELECT {HUC10.format("n_nationkey")} AS huc10, n_name AS name, r_name AS states
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "huc4_counts": """
        SELECT lpad(CAST(n_nationkey % 10 AS STRING), 4, '0') AS huc4, CAST(count(*) AS BIGINT) AS h10count
        FROM nation GROUP BY 1""",
    "cc_jobs": """
        SELECT o_orderkey AS jid, concat('job', CAST(o_custkey AS STRING)) AS name, o_orderpriority AS task_script_id,
               o_orderstatus AS task_def_id
        FROM orders""",
    "cc_tasks": """
        SELECT l_orderkey AS jid, concat('task', CAST(l_linenumber AS STRING)) AS name, l_partkey * 2 AS cpu,
               l_partkey * 8 AS memory, l_returnflag AS status, {ship_ms} AS started_on,
               {ship_ms} + CAST(l_quantity AS BIGINT) * 61500 AS ended_on
        FROM lineitem""",
    "project_files": """
        SELECT concat('p', CAST(doc_id AS STRING)) AS project_id,
               concat('data/', lang, '/d', CAST(doc_id AS STRING), '.gpkg') AS localPath, md5(text) AS etag,
               n_chars AS size
        FROM documents
        UNION ALL
        SELECT concat('p', CAST(doc_id AS STRING)), concat('data/', lang, '/d', CAST(doc_id AS STRING), '.tif'),
               md5(concat(text, 'tif')), n_chars
        FROM documents
        UNION ALL
        SELECT concat('p', CAST(doc_id AS STRING)), concat('data/', lang, '/d', CAST(doc_id AS STRING), '.tif.aux.xml'),
               md5(concat(text, 'aux')), n_chars
        FROM documents
        UNION ALL
        SELECT concat('p', CAST(doc_id AS STRING)), concat('outputs/daily_Stream_temperature.parquet.GZ'),
               md5(concat(text, 'gz')), n_chars
        FROM documents
        UNION ALL
        SELECT concat('p', CAST(doc_id AS STRING)), CAST(NULL AS STRING), md5(concat(text, 'none')), n_chars
        FROM documents""",
    "local_files": """
        SELECT project_id, localPath,
               CASE WHEN localPath LIKE '%.tif' THEN md5(etag) ELSE etag END AS etag
        FROM project_files WHERE localPath NOT LIKE 'data/fr/%'
        UNION ALL
        SELECT concat('p', CAST(doc_id AS STRING)), 'notes/.hidden.txt', md5(CAST(quality AS STRING)) FROM labels
        UNION ALL
        SELECT concat('p', CAST(doc_id AS STRING)), 'notes/labels.txt', md5(CAST(toxic AS STRING)) FROM labels""",
    "raster_cells": """
        SELECT CAST(p_size % 3 AS INT) AS raster_id, CAST(floor(p_partkey / 64) AS INT) AS cell_row,
               CAST(p_partkey % 64 AS INT) AS cell_col, p_retailprice AS value
        FROM part""",
    "rasters": """
        SELECT raster_id, CAST(raster_id * 100 AS DOUBLE) AS "left", CAST(10 AS DOUBLE) AS cell_width,
               CAST(5000 AS DOUBLE) AS top, CAST(-10 AS DOUBLE) AS cell_height, CAST(64 AS BIGINT) AS cols,
               CAST(max(cell_row) + 1 AS BIGINT) AS "rows", CAST(900 + raster_id AS DOUBLE) AS nodata
        FROM raster_cells GROUP BY raster_id""",
    "sample_points": """
        SELECT c_custkey AS point_id, CAST(c_nationkey % 3 AS INT) AS raster_id,
               CAST((c_nationkey % 3) * 100 + (c_custkey % 70) * 10 - 17 AS DOUBLE) AS x,
               CAST(4998 - (c_custkey % 40) * 10 AS DOUBLE) AS y
        FROM customer""",
}


def render(sql: str, words: dict[str, str]) -> str:
    for name, text in words.items():
        sql = sql.replace("{" + name + "}", text)
    return sql


class Inputs:
    """The views over one folder of test tables, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self._view(name)
        raise AttributeError(name)

    def _view(self, name: str) -> DataFrame:
        text = render(VIEWS[name], SPARK).replace('"', "`")
        parts = {}
        for word in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
            if word in TABLES or word in VIEWS:
                parts[word] = getattr(self, word)
                text = re.sub(rf"(FROM|JOIN)\s+{word}\b", rf"\1 {{{word}}}", text)
        return self.spark.sql(text, **parts) if parts else self.spark.sql(text)

    # --- inputs that need more than SQL ---------------------------------

    def _spread_orders(self) -> DataFrame:
        """Orders over all cores: parsing a document costs far more per byte than reading it."""
        return self.orders.repartition(self.spark.sparkContext.defaultParallelism, "o_orderkey")

    @property
    def catalog(self) -> DataFrame:
        """One catalog document per order, typed as read from JSON."""
        stamp = "timestamp_seconds((CAST(unix_date(CAST(o_orderdate AS DATE)) AS BIGINT) + {}) * 86400)"
        typed = self.orders.selectExpr(
            "concat('p', o_orderkey) AS id",
            "concat('Project ', o_orderkey % 97) AS name",
            "concat('summary ', o_orderpriority) AS summary",
            "o_orderpriority AS description",
            "array(concat('t', o_custkey % 4), concat('t', o_custkey % 3 + 2)) AS tags",
            "o_orderstatus = 'P' AS archived",
            "CASE o_orderstatus WHEN 'O' THEN 'PUBLIC' WHEN 'F' THEN 'SECRET' ELSE 'PRIVATE' END AS visibility",
            "o_custkey * 10 AS totalSize",
            """named_struct(
                'id', concat('b', o_custkey % 50),
                'bbox', array(o_custkey % 120 - 150D, o_custkey % 40 + 10D, o_custkey % 120 - 149D, o_custkey % 40 + 11D),
                'centroid', array(o_custkey % 120 - 149.7D, o_custkey % 40 + 10.7D),
                'area', o_totalprice, 'geoHash', CAST(NULL AS STRING)) AS bounds""",
            f"""array(
                named_struct('key', 'HUC', 'value', {HUC10.format("o_custkey")}, 'type', CAST(NULL AS STRING)),
                named_struct('key', 'Model Version', 'value', concat('1.0', o_custkey % 3, '.00'), 'type', CAST(NULL AS STRING)),
                named_struct('key', 'Runner', 'value', 'first', 'type', CAST(NULL AS STRING)),
                named_struct('key', 'Runner', 'value', concat('r', o_custkey % 6), 'type', CAST(NULL AS STRING))) AS meta""",
            "named_struct('id', o_orderpriority) AS projectType",
            stamp.format("0") + " AS createdOn",
            stamp.format("o_custkey % 30") + " AS updatedOn",
            "named_struct('id', concat('u', o_custkey % 9), 'name', concat('owner', o_custkey % 9), '__typename',"
            " CASE WHEN o_custkey % 9 < 4 THEN 'User' ELSE 'Organization' END) AS ownedBy",
            "array(named_struct('id', concat('c', o_orderkey % 12))) AS collections",
            "array(named_struct('organization', named_struct('id', concat('org', o_custkey % 8)),"
            " 'roles', array('OWNER'))) AS attribution",
        )
        return typed.select(*[F.col(f.name).cast(f.dataType) if f.name in typed.columns else F.lit(None).cast(f.dataType).alias(f.name)
                              for f in document_schema().fields])

    @property
    def documents_json(self) -> DataFrame:
        """The catalog documents as JSON text."""
        stamped = self.catalog.withColumns(
            {
                c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
                for c in ("createdOn", "updatedOn")
            }
        )
        spread = stamped.repartition(self.spark.sparkContext.defaultParallelism, "id")
        return spread.select(F.to_json(F.struct(*stamped.columns)).alias("json"))

    @property
    def manifests(self) -> DataFrame:
        """One project manifest per order, as XML text."""
        return self.manifest_text()

    def manifest_text(self, revised: bool = False) -> DataFrame:
        """Manifest text per order; the revision renames one dataset of part of the projects."""
        second = "CASE WHEN o_orderstatus = 'F' THEN 'Second revised' ELSE 'Second' END" if revised else "'Second'"
        body = f"""concat(
            '<?xml version="1.0" ?><Project xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"',
            ' xsi:noNamespaceSchemaLocation="project.xsd"><Name> Project ', o_orderkey % 97, '</Name>',
            '<ProjectType>', o_orderpriority, '</ProjectType>',
            '<Warehouse id="w', o_orderkey, '" apiUrl="https://example.org"/>',
            '<MetaData>', CASE WHEN o_orderstatus = 'O' THEN '' ELSE '<Meta name="ModelVersion">1.0.0</Meta>' END,
            '<Meta name="HUC" type="', CASE WHEN o_orderstatus = 'P' THEN 'number' ELSE 'int' END, '" locked="true">',
            o_custkey % 40, '</Meta><Meta name="Empty"/></MetaData>',
            CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE concat(
                '<ProjectBounds><Centroid><Lat>', o_custkey % 80, '.25</Lat><Lng>-', o_custkey % 170, '.5</Lng></Centroid>',
                '<BoundingBox><MinLat>', o_custkey % 80, '</MinLat><MinLng>-', o_custkey % 170 + 1, '</MinLng><MaxLat>',
                o_custkey % 80 + 1, '</MaxLat><MaxLng>-', o_custkey % 170, '</MaxLng></BoundingBox>',
                '<Path>bounds.geojson</Path></ProjectBounds>') END,
            '<CommonDatasets><Raster id="c', o_orderkey, '"><Name>Terrain</Name><Path>inputs/dem.tif</Path></Raster>',
            '</CommonDatasets><Realizations><Realization id="r', o_orderkey, '" dateCreated="',
            CASE WHEN o_orderpriority = '1-URGENT' THEN 'yesterday' ELSE CAST(o_orderdate AS STRING) END,
            '" productVersion="', CASE WHEN o_orderstatus = 'F' THEN 'v1' ELSE '1.0.0' END, '"><Name>Run</Name>',
            '<Inputs><CommonDatasetRef ref="', CASE WHEN o_orderstatus = 'P' THEN 'nowhere' ELSE concat('c', o_orderkey) END,
            '"/></Inputs><Outputs><Vector id="v1"><Name>First</Name><Path>outputs/a', o_custkey, '.shp</Path></Vector>',
            '<Vector id="v2"><Name>', {second}, '</Name><Path>outputs/b.shp</Path></Vector>',
            '<Geopackage id="g1"><Name>Results</Name><Path>outputs/g.gpkg</Path><MetaData><Meta name="Rows">', o_custkey,
            '</Meta></MetaData><Layers><Vector lyrName="lines', o_custkey % 7, '"><Name>Lines</Name></Vector>',
            '<DataTable lyrName="facts"><Name>Facts</Name></DataTable></Layers></Geopackage></Outputs>',
            '<Analyses><Analysis id="a1"><Name>Totals</Name><Metrics><Metric name="price" type="float">', o_totalprice,
            '</Metric></Metrics><Configuration/><Products><CommonDatasetRef ref="c', o_orderkey, '"/>',
            '<CSV id="t1"><Name>Table</Name><Path>outputs/t.csv</Path></CSV></Products></Analysis></Analyses>',
            '</Realization></Realizations><QAQCEvents><QAQCEvent datePerformed="2024-01-05T10:00:00" state="',
            CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' ELSE 'unsure' END,
            '"><Name>Review</Name><PerformedBy>owner', o_custkey % 5, '</PerformedBy><Links><URL text="report">',
            'https://example.org/', o_orderkey, '</URL></Links></QAQCEvent></QAQCEvents></Project>') AS xml"""
        return self._spread_orders().selectExpr("concat('p', o_orderkey) AS project_id", body)

    @property
    def catchments(self) -> DataFrame:
        """The contributing areas as unit squares on a grid ten wide."""

        @F.pandas_udf("binary")
        def square(k: pd.Series) -> pd.Series:
            def one(k: int) -> bytes:
                x, y = float(k % 10), float(k // 10)
                return polygon_wkb([[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]])

            return k.map(one)

        return self.contributing_area.withColumn("geom", square("featureid"))

    @property
    def flowlines(self) -> DataFrame:
        """One bent line per edge, from the middle of its square to that of the next reach."""

        @F.pandas_udf("binary")
        def bent(a: pd.Series, b: pd.Series) -> pd.Series:
            def one(a: int, b: int) -> bytes:
                start, end = (a % 10 + 0.5, a // 10 + 0.25), (b % 10 + 0.375, b // 10 + 0.5)
                return line_wkb([start, ((start[0] + end[0]) / 2, (start[1] + end[1]) / 2), end])

            return pd.Series([one(x, y) for x, y in zip(a, b)])

        edges = self.flow_edges.where("tocomid IS NOT NULL")
        return edges.select("comid", bent("comid", "tocomid").alias("geom"))

    def written_geopackages(self) -> str:
        """Folder of geopackages, one per project and slice of reaches, with the catchment layer."""
        root = fresh_folder(self.spark, "geopackages")
        # Reach ids are unique, so a slice of ids bounds the rows of a file.
        rows = self.catchments.withColumn("slice", F.floor(F.col("featureid") / 500))

        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            import sqlite3
            import struct

            from pyarrow import fs

            memory = sqlite3.connect(":memory:")
            memory.execute(
                "CREATE TABLE contributing_area (fid INTEGER PRIMARY KEY, geom POLYGON, featureid INTEGER, HUC12 TEXT)"
            )
            header = b"GP" + struct.pack("<BBi", 0, 1, 4326)
            memory.executemany(
                "INSERT INTO contributing_area (geom, featureid, HUC12) VALUES (?, ?, ?)",
                [(header + bytes(r.geom), int(r.featureid), r.HUC12) for r in pdf.itertuples()],
            )
            memory.commit()
            first = pdf.iloc[0]
            target = f"{root if ':' in root else 'file://' + root}/{first.project}/area_{first.slice}.gpkg"
            system, path = fs.FileSystem.from_uri(target)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(memory.serialize())
            return pd.DataFrame({"path": [path]})

        written = rows.groupBy("project", "slice").applyInPandas(write, "path string")
        written.count()
        return root

    def __iter__(self) -> Iterator[str]:
        return iter((*TABLES, *VIEWS))
