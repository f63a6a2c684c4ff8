import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import neighbours


def brute(rows, every=20):
    """Exact result: rows are (id, vector) that take part."""
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:20]]
    return out


def check(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i, w in want.items() if w}
    hits = total = 0
    for i, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(want[i]) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({r.vec_id for r in rows} & {j for j, _ in want[i]})
        total += len(want[i])
    assert hits >= least * total


def test_recall_on_the_table(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in given.collect()]
    check(neighbours.nearest(given).collect(), brute(rows), 0.95)


def test_recall_over_shards_with_lengths_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_LEAST", 500)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 2500)] + 0.3 * rng.normal(size=(2500, 24))) * rng.uniform(0.5, 2, (2500, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(neighbours.nearest(given).collect(), brute(rows), 0.9)


def test_equal_vectors_and_odd_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(100)] + [(200, [0.5, 0.5, 0.0]), (220, [2.0, 0.0])]
    nan, inf = float("nan"), float("inf")
    odd = [(None, same), (300, None), (320, []), (340, [0.0, 0.0, 0.0]), (360, [1.0, nan, 0.0]), (380, [inf, 0.0, 0.0]), (400, [1.0, None, 0.0]), (0, same)]
    given = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("shard", F.lit(1))
    got = neighbours.nearest(given).collect()
    want = brute(rows)
    for i, near in want.items():
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == near
    assert {r.query_id for r in got} == {i for i in want if want[i]}


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_rows(spark, count):
    given = spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(count)], "vec_id long, embedding array<float>")
    assert neighbours.nearest(given).count() == (2 if count == 2 else 0)


def test_doubles_are_scored_as_given(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(200, 5)) * (1 + 1e-9)).tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, brute(rows), 0.99)
    known = dict(rows)
    assert all(abs(r.score - float(np.dot(known[r.query_id], known[r.vec_id]))) < 1e-12 for r in got)


def test_shards_are_bounded_by_bytes_and_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_LEAST", 100)
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 60 * (20 * 6 + 8 * neighbours.DEGREE))
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(500, 6)).astype(np.float32).tolist())]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    check(found.collect(), brute(rows), 0.95)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # eight shards and more; the index is read once and passes through no generator
    union = plan[plan.index("Union") :]
    assert union.count("Relation [shard") == 1 and union.count("Generate explode") == 1
    shards = spark.createDataFrame(rows, "vec_id long, embedding array<float>").count() // 60
    assert shards >= 8
