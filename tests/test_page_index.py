"""Pages of a stored table against sorting it whole."""

import random

from pyspark.sql import functions as F

from thalweg.operators import catalog, page_index


def manifest(spark, count=2500):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(30)}", rng.choice([None, f"f{rng.randrange(400)}"]), rng.randrange(3)) for _ in range(count)]
    return spark.createDataFrame(rows + rows[:20], "project_id string, localPath string, size long")


def test_pages_equal_a_whole_sort(spark, tmp_path):
    table = manifest(spark)
    page_index.write_paged(table.repartition(6), str(tmp_path / "t"), rows_per_file=300)
    whole = [tuple(r) for r in table.orderBy("project_id", "localPath", "size").collect()]
    for page in (0, 1, 2, 13, 25, 26):
        rows = [tuple(r) for r in page_index.read_page(spark, str(tmp_path / "t"), page, 100).collect()]
        assert rows == whole[page * 100 : page * 100 + 100]
    stored = spark.read.parquet(str(tmp_path / "t" / "rows")).drop("file")
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, table.collect()))
    keys = lambda df: [(r.project_id, r.localPath) for r in df.collect()]
    assert keys(page_index.read_page(spark, str(tmp_path / "t"), 7, 90)) == keys(catalog.files_page(table, 7, 90))


def test_a_page_reads_two_files_at_most(spark, tmp_path):
    page_index.write_paged(spark.range(20_000).select(F.col("id").alias("project_id"), (-F.col("id")).alias("localPath")), str(tmp_path / "t"), rows_per_file=1000)
    for page in (0, 7, 39, 150):
        found = page_index.read_page(spark, str(tmp_path / "t"), page, 130)
        assert len(found.inputFiles()) >= 1
        first = [r.project_id for r in found.collect()]
        assert first == list(range(page * 130, min(page * 130 + 130, 20_000)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        files = plan.split("PartitionFilters:")[1].split("]")[0]
        assert "file#" in files
    index = spark.read.parquet(str(tmp_path / "t" / "index"))
    assert max(sum(1 for r in index.collect() if r["first"] < (p + 1) * 130 and r["first"] + r["count"] > p * 130) for p in range(153)) <= 2
    assert page_index.read_page(spark, str(tmp_path / "t"), 10**6, 130).count() == 0


def test_empty_table(spark, tmp_path):
    page_index.write_paged(manifest(spark).limit(0), str(tmp_path / "t"))
    assert page_index.read_page(spark, str(tmp_path / "t"), 0).count() == 0


def test_small_files_make_few_ranges(spark, tmp_path):
    table = spark.range(9000).select((F.col("id") * 7919 % 9000).alias("project_id"), F.lit("x").alias("localPath"))
    path = str(tmp_path / "t")
    page_index.write_paged(table, path, rows_per_file=20)
    # bounds of ranges come from a sample on the driver: not one range for each of the 450 files
    assert spark.read.parquet(f"{path}/index").count() <= spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("_metadata.file_path").count().collect()]
    assert max(sizes) == 20 and len(sizes) >= 450
    for page in (0, 1, 44, 89):
        assert [r.project_id for r in page_index.read_page(spark, path, page, 100).collect()] == list(range(page * 100, page * 100 + 100))
    assert page_index.read_page(spark, path, 90, 100).count() == 0
