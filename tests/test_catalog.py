import json
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from thalweg.functions.geo import geohash
from thalweg.functions.metadata import first_key, meta_map, unique_map
from thalweg.functions.text import sanitize_version, version_parts, without_extension
from thalweg.operators import batch, catalog, filesync
from thalweg.sources.projects import read_projects_json
from pyspark.sql.types import LongType, StructField, StructType


def document(number, **changes):
    base = {
        "id": f"p{number}", "name": f"Name {number}", "tags": ["a", "b"], "archived": False, "visibility": "PUBLIC",
        "meta": [{"key": "HUC", "value": "1709000101"}, {"key": "Model Version", "value": "03.02.010"}],
        "projectType": {"id": "VBET"}, "createdOn": f"2024-01-0{number}T00:00:00.000Z",
        "ownedBy": {"id": "u", "name": "owner", "__typename": "User"},
        "bounds": {"id": "b", "bbox": [-120.0, 40.0, -119.0, 41.0], "centroid": [-119.5, 40.5], "area": 2.0},
    }
    return {**base, **changes}


@pytest.fixture
def documents(spark, tmp_path):
    def build(*docs):
        path = tmp_path / "docs.json"
        path.write_text("\n".join(json.dumps(d) for d in docs))
        return read_projects_json(spark, str(path))

    return build


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filter_conditions(documents):
    docs = documents(
        document(1), document(2, archived=True), document(3, projectType={"id": "rme"}, tags=["a"]),
        document(4, meta=None, tags=None, bounds=None, ownedBy={"id": "o", "name": "org", "__typename": "Organization"}),
    )
    search = lambda **p: ids(catalog.catalog_filter(docs, p))
    assert search() == ["p1", "p3", "p4"]
    assert search(exclude_archived=False) == ["p1", "p2", "p3", "p4"]
    assert search(project_type_id="vbet") == ["p1", "p4"]
    assert search(tags=["a", "b"]) == ["p1"]
    assert search(meta={"HUC": "1709000101"}) == ["p1", "p3"]
    assert search(owned_by={"id": "o", "type": "ORGANIZATION"}) == ["p4"]
    assert search(bbox=[-119.5, 40.5, -100, 50]) == ["p1", "p3"]
    assert search(bbox=[-110, 40.5, -100, 50]) == []
    assert search(name="AME 3") == ["p3"] and search(keywords="17090") == ["p1", "p3"]
    assert search(created_from=datetime(2024, 1, 2), created_to=datetime(2024, 1, 3)) == ["p3"]
    with pytest.raises(ValueError):
        search(colour="red")
    with pytest.raises(ValueError):
        search(bbox=[1, 1, 0, 2])
    with pytest.raises(ValueError):
        search(created_within="ONE_DAY", created_from=datetime(2024, 1, 1))


def test_sort_and_pages(documents):
    same = "2024-01-05T00:00:00.001Z"
    docs = documents(*[document(i, createdOn=same if i < 6 else "2024-01-01T00:00:00Z", name="n",
                                meta=[{"key": "modelVersion", "value": v}])
                       for i, v in zip(range(1, 8), ["1.10.0", "1.9.0", "bad", "01.2.0", "2.0.0", "1.9.1", "1.0.0"])])
    order = lambda *o: [r.id for r in catalog.catalog_sort(docs, o, "u").collect()]
    assert order("MODEL_VERSION_DESC") == ["p5", "p1", "p6", "p2", "p4", "p7", "p3"]
    assert order("MINE", "NAME_ASC")[0] == "p1"
    with pytest.raises(ValueError):
        catalog.catalog_sort(docs, ["MINE"])
    seen, after = [], None
    while page := catalog.catalog_page(docs, 2, after).select("id", "createdOn").collect():
        seen += [r.id for r in page]
        after = (page[-1].createdOn, page[-1].id)
    assert seen == [f"p{i}" for i in range(1, 8)]


def test_meta_maps(spark):
    df = spark.createDataFrame(
        [Row(meta=[Row(key="A b", value="1"), Row(key="z", value="0"), Row(key="A b", value=None), Row(key="a-B", value="3")])],
        "meta array<struct<key string, value string>>",
    )
    row = df.select(meta_map("meta").alias("m"), meta_map("meta", normalised=True).alias("n")).first()
    assert row.m == {"A b": None, "z": "0", "a-B": "3"} and row.n == {"ab": "3", "z": "0"}
    first = df.select(unique_map(F.col("meta"), keep="first").alias("m")).first().m
    assert first == {"A b": "1", "z": "0", "a-B": "3"}
    keyed = df.select(meta_map("meta").alias("m"))
    assert keyed.select(first_key("m", ["A b", "z"])).first()[0] is None
    assert keyed.select(first_key("m", ["none", "z"])).first()[0] == "0"


def test_versions(spark):
    texts = ["03.02.010", "1.2.3-rc.1", "1.2", "v1.0.0", " 0.0.0 ", "1.2.3.4", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(sanitize_version("t")).first()[0] == "3.2.10"
    got = [r.v and (r.v.major, r.v.minor, r.v.patch, r.v.prerelease) for r in df.select(version_parts("t").alias("v")).collect()]
    assert got == [(3, 2, 10, ""), (1, 2, 3, "rc.1"), None, None, (0, 0, 0, ""), None, None]


def test_mirror_runs_twice_without_change(documents):
    docs = documents(document(1), document(2), document(3))
    rows, meta = catalog.project_rows(docs), catalog.meta_rows(docs)
    first = catalog.mirror_increment(rows.where("false"), rows)
    assert sorted(r.project_id for r in first.collect()) == ["p1", "p2", "p3"]
    assert catalog.mirror_increment(rows, rows).count() == 0
    assert catalog.mirror_meta_increment(meta, meta).count() == 0
    later = catalog.mirror_increment(rows.where("project_id = 'p2'"), rows)
    assert [r.project_id for r in later.collect()] == ["p3"]
    row = rows.where("project_id = 'p1'").first()
    assert (row.huc10, row.model_version, row.tags, row.created_on) == ("1709000101", "03.02.010", "a,b", 1704067200000)


def test_duplicates_keep_one(spark):
    projects = spark.createDataFrame(
        [(1, 10, "o", "t"), (2, 20, "o", "t"), (3, 20, "o", "t"), (4, 5, "o", "u"), (5, 99, "o", "t")],
        "id bigint, created_on bigint, owned_by_name string, project_type_id string")
    meta = [(i, k, v) for i in (1, 2, 3, 4) for k, v in (("HUC", "h"), ("Model Version", "1"))] + [(5, "HUC", "h")]
    marks = {r.id: r.status for r in catalog.duplicate_projects(projects, spark.createDataFrame(meta, "project_id bigint, key string, value string")).collect()}
    assert marks == {1: "DELETE", 2: "KEEP", 3: "DELETE", 4: "KEEP"}


def test_geohash(spark):
    cases = [(-5.6, 42.6, 5, "ezs42"), (10.40744, 57.64911, 9, "u4pruydqq"), (-180.0, -90.0, 3, "000"), (180.0, 90.0, 3, "zzz")]
    for lng, lat, n, want in cases:
        assert spark.range(1).select(geohash(F.lit(lng), F.lit(lat), n)).first()[0] == want
    assert spark.range(1).select(geohash(F.lit(200.0), F.lit(0.0), 3)).first()[0] is None


def test_clusters_count_the_rest(documents):
    docs = documents(document(1), document(2), document(3, bounds={"id": "c", "bbox": [0.0, 0.0, 1.0, 1.0], "centroid": [0.5, 0.5], "area": 1.0}))
    top = catalog.map_clusters(docs, precision=3, limit=1).collect()
    assert [(r["count"], r.remaining) for r in top] == [(2, 1)]
    assert [(r.bounds_id, r.project_count, r.remaining) for r in catalog.bounds_groups(docs, 5).collect()] == [("b", 2, 0), ("c", 1, 0)]


def test_coverage_numbers_and_percent(spark):
    covered = spark.createDataFrame([("a", "0001xxxx", "1"), ("a", "0001yyyy", "1"), ("b", "0001xxxx", None)],
                                    "project_type_id string, huc10 string, model_version string")
    huc4s = spark.createDataFrame([("0001", 3), ("0002", 4), ("0003", 0)], "huc4 string, h10count int")
    rows = catalog.huc4_coverage(covered, huc4s).orderBy("row_number").collect()
    assert [(r.row_number, r.project_type_id, r.huc4, r.projectpc) for r in rows] == [
        (1, None, "0002", 0.0), (2, None, "0003", None), (3, "a", "0001", 66.0), (4, "b", "0001", 33.0)]


def test_processing_time_is_numeric(spark):
    projects = spark.createDataFrame([(1, "o", "t"), (2, "o", "t")], "id bigint, owned_by_name string, project_type_id string")
    meta = spark.createDataFrame([(1, "ProcTimeS", "900"), (2, "ProcTimeS", "1200"), (2, "ProcTimeS", "n/a"), (2, "x", "1")],
                                 "project_id bigint, key string, value string")
    row = catalog.processing_time(projects, meta).first()
    assert (row.max_ProcTimeM, row.min_ProcTimeM, row.avg_ProcTimeM) == (20.0, 15.0, 17.5)


def test_one_failure_does_not_stop_the_rest(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 4)], "project_id string, n bigint")
    out = batch.batch_projects(rows, lambda r: {"inverse": 100 // r["n"]}, StructType([StructField("inverse", LongType())]))
    got = {r.project_id: (r.inverse, r.error) for r in out.collect()}
    assert got["a"] == (100, None) and got["c"] == (25, None)
    assert got["b"][0] is None and got["b"][1].startswith("ZeroDivisionError")


def files(spark, rows):
    return spark.createDataFrame(rows, "project_id string, localPath string, etag string")


def test_file_filter_matches_from_start(spark):
    df = files(spark, [("p", "a/x.GPKG", "1"), ("p", "x.gpkg.bak", "1"), ("p", None, "1"), ("p", "b/a/x", "1")])
    assert [r.localPath for r in filesync.file_filter(df, [r".*\.gpkg$"]).collect()] == ["a/x.GPKG"]
    assert filesync.file_filter(df, ["a/"]).count() == 1 and filesync.file_filter(df, None).count() == 3


def test_sync_plans(spark):
    local = files(spark, [("p", "same", "1"), ("p", "diff", "1"), ("p", "mine", "1"), ("q", "same", None)])
    remote = files(spark, [("p", "same", "1"), ("p", "diff", "2"), ("p", "theirs", "1"), ("q", "same", None)])
    plan = lambda *a, **k: {(r.project_id, r.localPath): r.action for r in filesync.file_sync_plan(local, remote, *a, **k).collect()}
    assert plan() == {("p", "same"): "skip", ("p", "diff"): "update", ("p", "mine"): "skip", ("p", "theirs"): "download", ("q", "same"): "update"}
    assert plan(force=True)["p", "same"] == "update"
    assert plan("upload") == {("p", "same"): "skip", ("p", "diff"): "update", ("p", "mine"): "create", ("p", "theirs"): "delete", ("q", "same"): "update"}
    assert plan("upload", no_delete=True)["p", "theirs"] == "keep"


def test_sidecars(spark):
    names = ["a/b.tif", "a/b.tif.aux.xml", "a/b.tfw", "a/b.long", "a/bc.tif", "a/b", "a/b.c.tif", "x/.b.tif", "a/b.t f"]
    found = filesync.sidecar_files(files(spark, [("p", n, "") for n in names] + [("q", "a/b.tif", "")]),
                                   spark.createDataFrame([("p", "a/b.tif")], "project_id string, dataset_path string"))
    assert sorted(r.localPath for r in found.collect()) == ["a/b.c.tif", "a/b.tfw", "a/b.tif", "a/b.tif.aux.xml"]
    stems = {"a/b.tif": "a/b", "a.b/c": "a.b/c", ".rc": ".rc", "x/..a": "x/..a", "x/.a.b": "x/.a", "a.tar.gz": "a.tar", "a.": "a"}
    df = spark.createDataFrame([(k,) for k in stems], "p string")
    assert {r.p: r.s for r in df.select("p", without_extension("p").alias("s")).collect()} == stems


def test_pick_and_audit(spark):
    listed = spark.createDataFrame([("a", "z.gpkg"), ("a", "b.gpkg"), ("a", "t.gz"), ("b", "only.gpkg")], "project string, path string")
    assert [tuple(r) for r in filesync.pick_project_files(listed).collect()] == [("a", "b.gpkg", "t.gz")]
    named = spark.createDataFrame([("p", "x.tif"), ("p", "gone.tif"), ("p", None)], "project_id string, path string")
    disk = spark.createDataFrame([("p", "x.tif"), ("p", "extra.tif"), ("p", "d/.hidden"), ("p", "project.rs.xml")], "project_id string, path string")
    got = {(r.path, r.finding) for r in filesync.file_audit(named, disk).collect()}
    assert got == {("extra.tif", "unreferenced"), ("gone.tif", "missing")}
