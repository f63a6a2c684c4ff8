"""Manifests as rows: the walk, the store, and the operators over it."""

import pytest
from pyspark.sql import functions as F

from thalweg.operators import manifest
from thalweg.sources import manifest_nodes as nodes

TEXT = """<Project xmlns:xsi="x"><Name> P&amp;Q </Name><Name>Last</Name><ProjectType/><Odd><Name>no</Name><Meta name="no"/></Odd>
<MetaData><Meta name="ModelVersion">1</Meta><Meta/><Metric name="none"/></MetaData><MetaData><Meta name="ModelVersion"><![CDATA[ 2 ]]></Meta></MetaData>
<ProjectBounds><Centroid><Lat>1.5</Lat><Lng>east</Lng></Centroid><Path> b.json </Path></ProjectBounds>
<Realizations><Realization id="r"><Inputs><CommonDatasetRef ref="c"/><Raster id=" " type="t"><Layers><Vector lyrName="no"/></Layers></Raster></Inputs>
  <Outputs><Geopackage id="g"><Layers><Vector lyrName="v"><Name>V</Name><MetaData><Meta name="k">x</Meta></MetaData></Vector><Point lyrName="p"/></Layers><Path>late.gpkg</Path></Geopackage></Outputs>
  <Outputs><Geopackage id="h"/></Outputs></Realization><Realization/></Realizations>
<CommonDatasets><File id="c"><Name>First</Name><Path>f</Path></File><File id="c"><Name>Second</Name></File></CommonDatasets>
<QAQCEvents><QAQCEvent><MetaData><Meta name="m" locked="true">v</Meta></MetaData><Name>Ev</Name><Links><URL text="a">u</URL><URL>w</URL></Links></QAQCEvent></QAQCEvents></Project>"""


def by_kind(text):
    out = {}
    for n in nodes.walk(text):
        out.setdefault(n["kind"], []).append(n)
    return out


def test_walk():
    found = by_kind(TEXT)
    (project,), (bounds,), (event,) = found["project"], found["bounds"], found["event"]
    assert project["name"] == "Last" and project["project_type"] is None and project["meta_names"] == ["ModelVersion"] * 2
    assert bounds["box"] == {"Centroid.Lat": "1.5", "Centroid.Lng": "east"} and bounds["path"] == "b.json"
    assert [(m["level"], m["owner"], m.get("name"), m["value"], m["position"]) for m in found["meta"]] == [
        ("project", None, "ModelVersion", "1", 0), ("project", None, None, "", 1), ("project", None, "ModelVersion", "2", 2),
        ("layer", "v", "k", "x", 0), ("qaqc", "Ev", "m", "v", 0),
    ]
    datasets = [(d["place"], d.get("id"), d.get("path"), d.get("ref")) for d in found["dataset"]]
    assert datasets == [
        ("r#0//Inputs/CommonDatasetRef/0", None, None, "c"), ("r#0//Inputs/Raster/0", None, None, None), ("r#0//Outputs/Geopackage/0", "g", "late.gpkg", None),
        ("r#0//Outputs/Geopackage/1", "h", None, None), ("//CommonDatasets/File/0", "c", "f", None), ("//CommonDatasets/File/1", "c", None, None),
    ]
    assert found["dataset"][0]["target"] == {"name": "First", "path": "f", "tag": "File"}
    (layer,) = found["layer"]
    assert (layer["id"], layer["owner"], layer["path"], layer["name"]) == ("v", "g", "late.gpkg", "V")
    assert [o["id"] for o in found["odd_layer"]] == ["p"] and event["links"] == {"a": "u"}
    assert [r["place"] for r in found["realization"]] == ["r#0", "#1"]
    places = [(n["kind"], n["place"]) for n in nodes.walk(TEXT) if n["kind"] != "odd_layer"]
    assert len(set(places)) == len(places)


@pytest.mark.parametrize("text", [None, "", "no xml", TEXT[:-4], TEXT + "<x/>", "<a><b></a></b>", "\x00"])
def test_broken_documents_have_one_node(text):
    assert [n["kind"] for n in nodes.walk(text)] == ["unreadable"]


def test_deep_and_wide_documents():
    deep = "<Project>" + "<x>" * 20_000 + "</x>" * 20_000 + "</Project>"
    assert [n["kind"] for n in nodes.walk(deep)] == ["project"]
    wide = "<Project><MetaData>" + '<Meta name="a">1</Meta>' * 50_000 + "</MetaData></Project>"
    assert len(nodes.walk(wide)) == 50_001


def same(a, b):
    order = sorted(a.columns)
    rows = lambda df: sorted(map(repr, df.select(order).collect()))
    assert sorted(b.columns) == order and rows(a) == rows(b)


def test_operators_over_a_store_equal_those_over_documents(spark, tmp_path):
    rows = [("one", TEXT), ("two", "<Project/>"), ("bad", "<Project>"), ("none", None)]
    given = spark.createDataFrame(rows, "project_id string, xml string").withColumn("kind", F.lit("clash"))
    nodes.write_nodes(given, str(tmp_path / "store"))
    store = nodes.read_nodes(spark, str(tmp_path / "store"))
    for operator in ("xml_datasets", "xml_layers", "xml_metadata", "xml_bounds", "xml_qaqc", "xml_resolve_refs", "xml_audit", "manifest_parts"):
        same(getattr(manifest, operator)(given), getattr(manifest, operator)(store))
    bounds = manifest.xml_bounds(store).first()
    assert (bounds.centroid_lat, bounds.centroid_lng, bounds.min_lat) == (1.5, None, None)
    found = {(r.project_id, r.rule) for r in manifest.xml_audit(store).collect()}
    assert {p for p, rule in found if rule == "document unreadable"} == {"bad", "none"} and ("one", "meta name repeated") in found


def test_a_store_is_read_by_kind_and_column(spark, tmp_path):
    nodes.write_nodes(spark.createDataFrame([("one", TEXT)], "project_id string, xml string"), str(tmp_path / "store"))
    plan = manifest.xml_layers(nodes.read_nodes(spark, str(tmp_path / "store")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan or "kind#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "Exchange" not in plan and "box" not in plan and "Python" not in plan and "Arrow" not in plan


def test_audit_shuffles_nothing_and_reads_once(spark):
    given = spark.createDataFrame([("one", TEXT)], "project_id string, xml string")
    plan = manifest.xml_audit(given)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_diff_of_unreadable_missing_and_equal_documents(spark):
    left = spark.createDataFrame([("same", TEXT), ("cut", TEXT), ("gone", "<Project/>"), ("null", None)], "project_id string, xml string")
    right = spark.createDataFrame([("same", TEXT), ("cut", TEXT[:-3]), ("new", "<Project><Name>x</Name></Project>"), ("null", "<Project/>")], "project_id string, xml string")
    got = {}
    for r in manifest.manifest_diff(left, right).collect():
        got.setdefault(r.project_id, []).append((r.kind, r.address, r.status))
    assert set(got) == {"cut", "gone", "new", "null"}
    assert got["gone"] == [("project", "", "removed")] and got["new"] == got["null"] == [("project", "", "added")]
    assert ("project", "", "changed") in got["cut"] and len([x for x in got["cut"] if x[2] == "removed"]) == len(nodes.walk(TEXT)) - 4


def test_nodes_in_order_stay_in_the_walk_and_the_rules_judge_the_rest(spark, tmp_path):
    odd = [
        TEXT, "<Project/>", "", None, "<Project><MetaData><Meta name='a'/><Meta name='a'/></MetaData></Project>",
        "<Project><Name>n</Name><Realizations><Realization id=' ' dateCreated='2023-02-30' productVersion='1.0'/></Realizations>"
        "<QAQCEvents><QAQCEvent datePerformed='2024-02-29' state='odd'><Name>e</Name></QAQCEvent></QAQCEvents></Project>",
        "<Project><CommonDatasets><Raster id='r' extRef='x'><Path>/p</Path></Raster><Raster><Name>n</Name><Path>a/b.tif</Path></Raster>"
        "<Geopackage id='g'><Name>g</Name><Path>g.gpkg</Path><Layers><Vector lyrName='' /><Vector/><Shape lyrName='s'/></Layers></Geopackage>"
        "</CommonDatasets><Stray lyrName='t'/></Project>",
        "<!DOCTYPE Project [<!ATTLIST Stray lyrName CDATA 'given'>]><Project><Stray/></Project>",
    ]
    given = spark.createDataFrame(list(enumerate(odd)), "project_id long, xml string")
    every = nodes.shred(given, nodes.KINDS)
    listed = lambda df: sorted(map(repr, df.select("project_id", "severity", "rule", "location").collect()))
    found = listed(manifest.xml_audit(given))
    assert found == listed(manifest.xml_audit(every)) and len(found) > 30
    # what breaks no rule is not sent on, and texts for places are made only where asked for
    fine = [n for n in nodes.walk(TEXT, frozenset(nodes.KINDS), False)]
    assert all("place" not in n and "parent" not in n for n in fine)
    assert sum(map(manifest._doubtful, fine)) < len(fine)
    strip = lambda n: {k: v for k, v in n.items() if k not in ("place", "parent", "spot", "meta_place", "up", "counts")}
    assert [strip(n) for n in fine] == [strip(n) for n in nodes.walk(TEXT)]
    assert [n["kind"] for n in nodes.walk(TEXT, frozenset({nodes.EVENT}), False)].count("dataset") == 0
