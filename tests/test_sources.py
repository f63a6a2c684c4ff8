import hashlib
import sqlite3
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from thalweg.functions.digest import etag
from thalweg.functions.wkb import line_wkb, multi_line_wkb, parts_of, polygon_wkb, strip_gp_header, wkb_box
from thalweg.operators import manifest, spatial
from thalweg.sources.files import file_digests
from thalweg.sources.geopackage import read_gpkg_layer, with_project
from thalweg.sources.manifests import read_project_xml
from thalweg.sources.readings import list_files, read_daily_temp
from thalweg.sources.sinks import sql_report, unload, write_csv


def reference_etag(data, part, threshold, single=False):
    if len(data) < threshold or single:
        return f'"{hashlib.md5(data).hexdigest()}"'
    parts = [data[i : i + part] for i in range(0, len(data), part)]
    return f'"{hashlib.md5(b"".join(hashlib.md5(p).digest() for p in parts)).hexdigest()}-{len(parts)}"'


@pytest.mark.parametrize("single", [False, True])
def test_digests_of_column_and_files(spark, tmp_path, single):
    contents = {f"sub dir/f{n}.bin": bytes(i % 251 for i in range(n)) for n in (0, 1, 99, 100, 101, 250, 300)}
    for name, data in contents.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    want = {name.split("/")[1]: reference_etag(data, 50, 100, single) for name, data in contents.items()}
    found = file_digests(spark, str(tmp_path), part_bytes=50, threshold=100, single_part=single)
    assert {r.path.rsplit("/", 1)[1]: r.etag for r in found.collect()} == want
    column = spark.createDataFrame(list(contents.items()), "name string, data binary")
    got = column.select("name", etag("data", 50, 100, single).alias("e")).collect()
    assert {r.name.split("/")[1]: r.e for r in got} == want


def test_readings_tree(spark, tmp_path):
    for project in ("HUC_01", "HUC 02"):
        inner = tmp_path / "root" / project / "deep"
        inner.mkdir(parents=True)
        for n in (1, 2):
            pd.DataFrame({"comid": [n], "date": pd.to_datetime(["2000-01-01"]).astype("datetime64[us]"), "stream_temp": [1.5]}).to_parquet(
                inner / f"daily_{n}.parquet.gz")
        (inner / "other.txt").write_text("x")
    df = read_daily_temp(spark, str(tmp_path / "root"))
    assert sorted((r.project, r.comid) for r in df.collect()) == [("HUC 02", 1), ("HUC 02", 2), ("HUC_01", 1), ("HUC_01", 2)]
    listed = list_files(spark, str(tmp_path / "root"))
    assert listed.count() == 6 and {r.project for r in listed.select("project").distinct().collect()} == {"HUC_01", "HUC 02"}


SQUARE = polygon_wkb([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]])


def make_gpkg(path, rows, table="contributing_area", extra=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    db.execute(f"CREATE TABLE {table} (fid INTEGER PRIMARY KEY, geom POLYGON, featureid MEDIUMINT, HUC12 TEXT(12){extra})")
    header = b"GP" + struct.pack("<BBi", 0, 0b11, 4326) + struct.pack("<4d", 0, 2, 0, 2)
    for fid, feature, huc in rows:
        db.execute(f"INSERT INTO {table} (fid, geom, featureid, HUC12) VALUES (?, ?, ?, ?)", (fid, header + SQUARE, feature, huc))
    db.commit()
    db.close()


def test_geopackage_layers(spark, tmp_path):
    root = tmp_path / "tree"
    make_gpkg(root / "a" / "one.gpkg", [(1, 10, "x"), (5000, 11, None)])
    make_gpkg(root / "b" / "sub" / "two.gpkg", [(i, i, "y") for i in range(1, 9001)], extra=", name TEXT")
    make_gpkg(root / "c" / "three.gpkg", [], table="flowlines")
    with pytest.raises(Exception, match="no layer"):
        read_gpkg_layer(spark, str(root), "contributing_area").count()
    layer = read_gpkg_layer(spark, str(root), "contributing_area", missing_layer="skip", split_bytes=20_000)
    assert layer.rdd.getNumPartitions() > 3
    rows = with_project(layer, str(root))
    assert {r.project: r.n for r in rows.groupBy("project").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 9000}
    assert rows.select("featureid").distinct().count() == 9000
    box = rows.where("featureid = 11 and project = 'a'").select(wkb_box("geom").alias("b")).first().b
    assert tuple(box) == (0.0, 0.0, 2.0, 2.0)
    named = read_gpkg_layer(spark, str(root), "contributing_area", "featureid bigint, name string", missing_layer="skip")
    assert named.columns == ["featureid", "name"] and named.count() == 9002


def test_wkb_shapes(spark):
    kinds = lambda blob: [(k, [len(r) for r in rings]) for k, rings in parts_of(blob)]
    assert kinds(SQUARE) == [(3, [5])]
    assert kinds(multi_line_wkb([[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]])) == [(2, [2]), (2, [3])]
    point_z = struct.pack(">BIddd", 0, 1001, 1.0, 2.0, 3.0)
    assert parts_of(point_z)[0][1][0].tolist() == [[1.0, 2.0]]
    assert strip_gp_header(b"GP\x00\x10" + b"\x00" * 8) is None and strip_gp_header(None) is None
    layer = spark.createDataFrame([(bytearray(SQUARE),), (bytearray(line_wkb([(-1.0, 1.0), (1.0, 5.0)])),), (None,)], "geom binary")
    row = spatial.layer_bounds(layer).first()
    assert (row.min_x, row.min_y, row.max_x, row.max_y, row.center_x, row.center_y) == (-1.0, 0.0, 2.0, 5.0, 0.5, 2.5)


def ring(*points):
    return [*points, points[0]]


def test_clip_to_tiles_and_holes(spark):
    hole = polygon_wkb([ring((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)), ring((1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0))])
    right = polygon_wkb([ring((4.0, 0.0), (8.0, 0.0), (6.0, 4.0), (4.0, 4.0))])
    far = polygon_wkb([ring((100.0, 100.0), (140.0, 100.0), (140.0, 140.0))])
    areas = spark.createDataFrame([("H", bytearray(hole)), ("H", bytearray(right)), ("K", bytearray(hole)), ("H", bytearray(hole)), ("F", bytearray(far))],
                                  "HUC12 string, geom binary")
    lines = spark.createDataFrame(
        [(1, bytearray(line_wkb([(-1.0, 2.0), (9.0, 2.0)]))), (2, bytearray(line_wkb([(0.5, 0.5), (0.5, 3.5), (-2.0, 3.5)]))),
         (3, bytearray(line_wkb([(50.0, 50.0), (60.0, 60.0)]))), (4, bytearray(line_wkb([(4.0, -1.0), (4.0, 5.0)]))), (5, None)],
        "comid bigint, geom binary")
    for size in (None, 0.7, 50.0):
        got = {(r.HUC12, r.comid): (round(r.length, 9), bytes(r.geom)) for r in spatial.clip_flowlines(lines, areas, size).collect()}
        assert {k: v[0] for k, v in got.items()} == {("H", 1): 5.0, ("K", 1): 2.0, ("H", 2): 3.5, ("K", 2): 3.5, ("H", 4): 4.0, ("K", 4): 4.0}
        parts = [p[1][0].tolist() for p in parts_of(got["H", 1][1])]
        assert parts == [[[0.0, 2.0], [1.0, 2.0]], [[3.0, 2.0], [7.0, 2.0]]]
        assert [p[1][0].tolist() for p in parts_of(got["K", 2][1])] == [[[0.5, 0.5], [0.5, 3.5], [0.0, 3.5]]]


def test_clip_gives_copies_back(spark):
    square = spark.createDataFrame([("H", bytearray(SQUARE))] * 2, "HUC12 string, geom binary")
    line, other = bytearray(line_wkb([(-1.0, 1.0), (1.0, 1.0)])), bytearray(line_wkb([(1.0, 1.0), (1.0, 1.5)]))
    lines = spark.createDataFrame([(1, line)] * 3 + [(1, other), (2, line)], "comid bigint, geom binary")
    got = sorted((r.comid, r.length) for r in spatial.clip_flowlines(lines, square).collect())
    assert got == [(1, 0.5), (1, 1.0), (1, 1.0), (1, 1.0), (2, 1.0)]


MANIFEST = """<?xml version="1.0" ?>
<Project xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:noNamespaceSchemaLocation="p.xsd">
  <Name>Test</Name><ProjectType>vbet</ProjectType>
  <MetaData><Meta name="A" type="wrong">1</Meta><Meta name="A" ext="project" locked="true"> 2 </Meta></MetaData>
  <ProjectBounds><Centroid><Lat>43.5</Lat><Lng>-105</Lng></Centroid>
    <BoundingBox><MinLat>38</MinLat><MinLng>-115</MinLng><MaxLat>46</MaxLat><MaxLng>-96</MaxLng></BoundingBox><Path>b.json</Path></ProjectBounds>
  <CommonDatasets><Raster id="dem"><Name>DEM</Name><Path>in/dem.tif</Path></Raster><Raster id="dem"><Name>Twin</Name><Path>in/t.tif</Path></Raster></CommonDatasets>
  <Realizations><Realization id="r1" dateCreated="2024-02-30T00:00:00"><Name>One</Name>
    <Logs><LogFile id="log"><Name>Log</Name><Path>l.log</Path></LogFile></Logs>
    <Inputs><CommonDatasetRef ref="dem"/><Vector id="v" extRef="short:Project/x"><Name>V</Name><Path>/abs.shp</Path></Vector></Inputs>
    <Outputs><Geopackage id="g"><Name>G</Name><Path>o/g.gpkg</Path><Layers><Vector lyrName="a"><Name>A</Name><MetaData><Meta name="k">v</Meta></MetaData></Vector>
      <Oddity lyrName="odd"><Name>O</Name></Oddity></Layers></Geopackage></Outputs>
    <Analyses><Analysis id="an"><Name>An</Name><Metrics><Metric name="m" type="int">3</Metric></Metrics>
      <Products><CommonDatasetRef ref="nope"/></Products></Analysis></Analyses>
  </Realization></Realizations>
  <QAQCEvents><QAQCEvent state="maybe" datePerformed="2024-01-01"><Name>Q</Name><PerformedBy>me</PerformedBy>
    <Links><URL text="x">http://a</URL><URL text="x">http://b</URL></Links></QAQCEvent></QAQCEvents>
</Project>"""
BARE = "<Project><ProjectType>x</ProjectType></Project>"


@pytest.fixture(scope="module")
def manifests(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("manifests")
    for name, text in (("one", MANIFEST), ("two", BARE)):
        (root / name).mkdir()
        (root / name / "project.rs.xml").write_text(text)
    df = read_project_xml(spark, str(root))
    return df.withColumn("project_id", F.regexp_extract("project_id", "([^/]+)/project.rs.xml$", 1))


def test_manifest_rows(manifests):
    assert {r.project_id: r.Name for r in manifests.select("project_id", "project.Name").collect()} == {"one": "Test", "two": None}
    got = {(r.container, r.tag, r.position, r.dataset_id, r.ref) for r in manifest.xml_datasets(manifests).collect()}
    assert got == {
        ("CommonDatasets", "Raster", 0, "dem", None), ("CommonDatasets", "Raster", 1, "dem", None), ("Logs", "LogFile", 0, "log", None),
        ("Inputs", "CommonDatasetRef", 0, None, "dem"), ("Inputs", "Vector", 0, "v", None), ("Outputs", "Geopackage", 0, "g", None),
        ("Products", "CommonDatasetRef", 0, None, "nope"),
    }
    assert [(r.layer_name, r.layer_type) for r in manifest.xml_layers(manifests).collect()] == [("a", "Vector")]
    meta = {(r.level, r.owner, r.name, r.value, r.locked) for r in manifest.xml_metadata(manifests).collect()}
    assert meta == {("project", None, "A", "1", False), ("project", None, "A", "2", True), ("layer", "a", "k", "v", False), ("metric", "an", "m", "3", False)}
    bounds = manifest.xml_bounds(manifests).first()
    assert (bounds.centroid_lng, bounds.centroid_lat, bounds.min_lng, bounds.max_lat) == (-105.0, 43.5, -115.0, 46.0)
    event = manifest.xml_qaqc(manifests).first()
    assert event.links == {"x": "http://b"} and not event.valid_state
    refs = {(r.container, r.ref, r.name, r.unresolved) for r in manifest.xml_resolve_refs(manifests).collect()}
    assert refs == {("Inputs", "dem", "DEM", False), ("Products", "nope", None, True)}


def test_manifest_audit(manifests):
    got = {(r.project_id, r.severity, r.rule, r.location) for r in manifest.xml_audit(manifests).collect()}
    assert got == {
        ("one", "error", "meta name repeated", ""), ("one", "error", "meta type invalid", "A"), ("one", "warning", "model version missing", ""),
        ("one", "error", "realization date invalid", "r1"), ("one", "error", "dataset path invalid", "v"),
        ("one", "error", "dataset reference invalid", "v"), ("one", "error", "common dataset not found", "nope"),
        ("one", "error", "layer type invalid", "odd"), ("one", "error", "event state invalid", "Q"),
        ("two", "error", "project name missing", ""), ("two", "warning", "project bounds missing", ""), ("two", "warning", "model version missing", ""),
    }


def test_manifest_diff(manifests):
    assert manifest.manifest_diff(manifests, manifests).count() == 0
    other = manifests.withColumn("xml", F.replace(F.replace("xml", F.lit("<Meta name=\"k\">v"), F.lit("<Meta name=\"k\">w")), F.lit('id="log"'), F.lit('id="lag"')))
    got = {(r.kind, r.status) for r in manifest.manifest_diff(manifests, other).collect()}
    assert got == {("meta", "changed"), ("dataset", "changed")}


def test_reports_and_exports(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", bytearray(b"x"))], "comid bigint, name string, geom binary")
    table.createOrReplaceTempView("report_input")
    assert sql_report(spark, "SELECT count(*) AS n FROM report_input").first().n == 1
    with pytest.raises(Exception):
        sql_report(spark, "SELECT nothing FROM report_input").collect()
    first, second = (unload(spark, "SELECT comid FROM report_input", str(tmp_path)) for _ in range(2))
    assert first != second and spark.read.parquet(first).first().comid == 1
    write_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["comid", "name"]


def test_long_lines_look_for_polygons_by_stretches(spark):
    size = 40
    tiles = [(f"H{(x + y) % 3}", bytearray(polygon_wkb([ring((float(x), float(y)), (x + 1.0, float(y)), (x + 1.0, y + 1.0), (float(x), y + 1.0))])))
             for x in range(size) for y in range(size)]
    tiles.append(("W", bytearray(polygon_wkb([ring((-10.0, -10.0), (90.0, -10.0), (90.0, 90.0), (-10.0, 90.0))]))))
    areas = spark.createDataFrame(tiles, "HUC12 string, geom binary")
    ends = [(-3.0, -2.5, 43.0, 41.75), (0.25, 0.5, 39.5, 39.0), (7.0, 50.0, 7.0, -5.0), (38.9, 1.1, 2.3, 17.0)]
    lines = spark.createDataFrame([(i, bytearray(line_wkb([e[:2], e[2:]]))) for i, e in enumerate(ends)], "comid bigint, geom binary")
    shapes = areas.selectExpr("HUC12 AS g", "geom AS polygon", "unhex(md5(geom)) AS pid", "1 AS parts").withColumn("p", spatial.wkb_box("polygon"))
    segments = spatial.line_segments(lines)
    assert spatial._stretch_width(shapes) < 15
    found = spatial._crossing(segments, shapes, spatial._stretch_width(shapes), 1e-9).select("comid", "pid").collect()
    whole = spatial._crossing(segments, shapes, None, 1e-9).select("comid", "pid").collect()
    assert len(found) == len(set(map(repr, found))) < 600
    assert sorted(map(repr, found)) == sorted(map(repr, whole))
    # a stretch lists few polygons: the boxes of whole segments overlap some thousands
    boxes = spatial._stretches(segments, spatial._stretch_width(shapes)).collect()
    overlaps = sum((min(r.sx1, size) - max(r.sx0, 0) + 2) * (min(r.sy1, size) - max(r.sy0, 0) + 2) for r in boxes)
    assert overlaps < 2000
    got = {}
    for r in spatial.clip_flowlines(lines, areas).collect():
        got.setdefault(r.comid, {})[r.HUC12] = r.length
    for i, (x1, y1, x2, y2) in enumerate(ends):
        want = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        assert abs(got[i]["W"] - want) < 1e-9
    assert abs(sum(v for k, v in got[1].items() if k != "W") - got[1]["W"]) < 1e-9
    assert abs(sum(v for k, v in got[3].items() if k != "W") - got[3]["W"]) < 1e-9
