"""Inputs that the shared fixtures never hold."""

import os

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from thalweg.functions.growth import RED_BAND_TROUT
from thalweg.operators import batch, catalog, fitting, manifest, network, reach_stats
from thalweg.sources.curves import read_growth_curves
from thalweg.sources.projects import document_schema
from thalweg.sources.readings import list_files, read_daily_temp


def test_terms_of_documents_without_metadata(spark):
    schema = document_schema()
    rows = []
    for meta in (None, [("k", "red", None)]):
        row = dict.fromkeys(schema.names)
        row.update(tags=["red"], meta=meta)
        rows.append(tuple(row[n] for n in schema.names))
    got = {(r.kind, r.text): r.freq for r in catalog.suggest_terms(spark.createDataFrame(rows, schema), "r").collect()}
    assert got[("tags", "red")] == 2 and got[("metaValues", "red")] == 1


def test_unknown_lengths_keep_the_river_above(spark):
    edges = spark.createDataFrame([(4, 3, 1.0), (3, 2, None), (2, 1, float("nan"))], "comid long, tocomid long, length_km double")
    got = {r.comid: r.distance_km for r in network.upstream(edges, 1).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_negative_lengths_fail(spark):
    edges = spark.createDataFrame([(2, 1, -1.0)], "comid long, tocomid long, length_km double")
    with pytest.raises(Exception, match="negative length_km"):
        network.upstream(edges, 1).collect()


def test_one_temperature_is_fitted(spark):
    points = spark.createDataFrame([("a", 10.0, 0.5), ("a", 10.0, 0.7)], "species string, temperature double, growth_rate double")
    row = fitting.fit_growth_curve(points, degree=1).first()
    assert (row.low, row.high) == (9.0, 11.0)
    assert row.coefficients[0] + 10 * row.coefficients[1] == pytest.approx(0.6)


def test_parabola_is_found_again(spark):
    points = spark.createDataFrame([("a", float(t), 1 - 2.0 * t + 0.5 * t * t) for t in range(9)], "species string, temperature double, growth_rate double")
    assert fitting.fit_growth_curve(points, degree=2).first().coefficients == pytest.approx([1, -2, 0.5])


def test_projects_are_named_by_the_root(spark, tmp_path):
    root = tmp_path / "geo packages"
    for project in ("p1/geo packages/a", "50%", "a+b c"):
        folder = root / project
        folder.mkdir(parents=True)
        rows = spark.createDataFrame([(1, "2000-01-01", 2.5)], "comid long, date string, stream_temp double").toPandas()
        rows.to_parquet(folder / "daily.gz")
    want = {"p1", "50%", "a+b c"}
    assert {r.project for r in read_daily_temp(spark, str(root)).collect()} == want
    assert {r.project for r in list_files(spark, str(root)).collect()} == want


def test_statistics_keep_projects_apart(spark):
    import datetime

    day = datetime.date(1990, 10, 5)
    readings = spark.createDataFrame([("a", 1, day, 10.0), ("b", 1, day, 20.0)], "project string, comid long, date date, stream_temp double")
    reaches = spark.createDataFrame([("a", 1), ("b", 1)], "project string, comid long")
    stats = reach_stats.reach_growth_stats(readings, reaches, 1991, RED_BAND_TROUT).collect()
    stats = stats or reach_stats.reach_growth_stats(readings, reaches, 1990, RED_BAND_TROUT).collect()
    assert len({r.Growth_Mean for r in stats}) == len(stats) == 2
    assert reach_stats.reach_semi(readings, reaches.where("project = 'a'")).count() == 1


def test_newest_is_kept_per_group(spark):
    projects = spark.createDataFrame([(1, "o", "t", 100), (2, "o", "t", 200)], "id long, owned_by_name string, project_type_id string, created_on long")
    meta = spark.createDataFrame(
        [(1, "HUC", "h1"), (1, "HUC", "h2"), (2, "HUC", "h1"), (1, "Model Version", "1"), (2, "Model Version", "1")], "project_id long, key string, value string"
    )
    got = {(r.id, r.HUC): r.status for r in catalog.duplicate_projects(projects, meta).collect()}
    assert got == {(1, "h1"): "DELETE", (1, "h2"): "KEEP", (2, "h1"): "KEEP"}


def test_batch_keeps_whole_numbers_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "project_id string, n long")
    output = StructType([StructField("seen", StringType()), StructField("n", LongType())])
    got = batch.batch_projects(rows, lambda r: {"seen": repr(r["n"]), "n": r["n"]}, output, slots=3)
    assert got.rdd.getNumPartitions() == 3
    assert {r.project_id: (r.seen, r.n, r.error) for r in got.collect()} == {"a": ("1", 1, None), "b": ("None", None, None)}
    bad = batch.batch_projects(rows, lambda r: {"n": "many"}, output).collect()
    assert all(r.error and r.n is None for r in bad)


DOCUMENT = """<Project><Name>x</Name><ProjectType>t</ProjectType><Realizations>
<Realization id="r"><Name>one</Name><MetaData><Meta name="k">1</Meta></MetaData><Analyses><Analysis id="a1"><Name>A</Name></Analysis></Analyses></Realization>
<Realization id="r"><Name>two</Name><MetaData><Meta name="k">2</Meta></MetaData><Analyses><Analysis id="a1"><Name>B</Name></Analysis></Analyses></Realization>
<Realization><Name>three</Name></Realization><Realization><Name>four</Name></Realization></Realizations></Project>"""


def test_a_document_equals_itself_and_repeated_ids_are_told_apart(spark):
    left = spark.createDataFrame([("p", DOCUMENT), ("q", DOCUMENT)], "project_id string, xml string")
    right = spark.createDataFrame([("p", DOCUMENT), ("q", DOCUMENT.replace(">B<", ">C<")), ("r", DOCUMENT)], "project_id string, xml string")
    assert manifest.manifest_diff(left, left).count() == 0
    spaced = spark.createDataFrame([("p", DOCUMENT + " ")], "project_id string, xml string")
    assert manifest.manifest_diff(left.where("project_id = 'p'"), spaced).count() == 0
    got = [(r.project_id, r.kind, r.status) for r in manifest.manifest_diff(left, right).collect()]
    assert [g for g in got if g[0] == "q"] == [("q", "analysis", "changed")]
    assert {g[2] for g in got if g[0] == "r"} == {"added"} and not [g for g in got if g[0] == "p"]


def test_unreadable_documents_are_reported(spark):
    rows = [("whole", DOCUMENT), ("cut", DOCUMENT[:-30]), ("none", None)]
    found = manifest.xml_audit(spark.createDataFrame(rows, "project_id string, xml string")).collect()
    by = {p: {r.rule for r in found if r.project_id == p} for p in ("whole", "cut", "none")}
    assert by["cut"] == by["none"] == {"document unreadable"} and "document unreadable" not in by["whole"]


def test_curve_files_have_their_own_columns(spark, tmp_path):
    one, two = tmp_path / "a b", tmp_path / "c%.csv"
    os.mkdir(one)
    (one / "x.csv").write_text('"","Temperature.C","Specific.Growth.Rate.g.g.d"\n"1",2,0.5\n')
    two.write_text("Specific.Growth.Rate.g.g.d,Temperature.C\r\n0.25,3\r\n")
    got = sorted(tuple(r) for r in read_growth_curves(spark, {"one": str(one), "two": str(two)}).collect())
    assert got == [("one", 2.0, 0.5), ("two", 3.0, 0.25)]


def test_rollup_reads_metric_rows_once(spark, folder, tmp_path):
    from thalweg.operators import rollup
    from thalweg.plans.inputs import Inputs

    i = Inputs(spark, folder)
    i.dgo_metric_values.write.parquet(str(tmp_path / "eav"))
    eav = spark.read.parquet(str(tmp_path / "eav"))
    table = rollup.dgo_rollup(i.dgos, eav, i.us_states, i.flows, i.owners, [rollup.MetricDef(3, rollup.SUM_METRIC, "x")])
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final or final.count("/eav") == 1
    assert final.count("metric_value") and final.count("FileScan parquet [dgo_id") <= 1


def test_ways_serve_many_searches(spark):
    edges = spark.createDataFrame([(i + 1, i, 1.0) for i in range(40)] + [(100, 7, 2.0)], "comid long, tocomid long, length_km double")
    ways = network.network_ways(edges, 50.0)
    starts = spark.createDataFrame([(0,), (5,), (500,)], "comid long")
    both = [{tuple(r) for r in network.upstream_many(e, starts, 12.0).collect()} for e in (edges, ways)]
    assert both[0] == both[1] and (0, 12, 12.0) in both[0] and (500, 500, 0.0) in both[0] and (0, 13, 13.0) not in both[0]
    assert {r.comid for r in network.upstream(ways, 35).collect()} == {35, 36, 37, 38, 39, 40}
    with pytest.raises(ValueError):
        network.upstream(ways, 1, 60.0)


def test_a_polygon_goes_to_python_once_per_chunk(spark, monkeypatch):
    import math

    from thalweg.functions.wkb import line_wkb, polygon_wkb
    from thalweg.operators import spatial

    ring = [(math.cos(2 * math.pi * k / 2000), math.sin(2 * math.pi * k / 2000)) for k in range(2000)]
    shapes = spark.createDataFrame([("h", bytearray(polygon_wkb([ring + ring[:1]])))], "HUC12 string, geom binary")
    lines = [(i, bytearray(line_wkb([(-2.0, -0.5 + i / 60), (2.0, -0.5 + i / 60)]))) for i in range(60)]
    lines = spark.createDataFrame(lines, "comid long, geom binary")
    monkeypatch.setattr(spatial, "CHUNK", 20)
    got = {r.comid: r.length for r in spatial.clip_flowlines(lines, shapes).collect()}
    assert set(got) == set(range(60))
    for i, length in got.items():
        assert length == pytest.approx(2 * math.sqrt(1 - (-0.5 + i / 60) ** 2), abs=1e-4)
