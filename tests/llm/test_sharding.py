import hashlib
import math
import zlib
from collections import Counter

from thalweg.llm import sharding

ROWS = [(i, f"text {i % 7}") for i in range(400)] + [(5, "again")] * 50 + [(5, "text 5"), (None, None), (None, "x"), (1000, ""), (1001, "é" * 50_000)]


def bid(key, shard, weight=1.0):
    u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 1) / 16**13
    return math.log(u) / weight, -shard


def test_against_brute_force(spark):
    given = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot", "3 as size")
    got = sharding.shard_documents(given.repartition(7)).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.law == "key" and r.shard == -max(bid(key, s) for s in range(40))[1]
        assert r.grown_shard == -max(bid(key, s) for s in range(41))[1] and r.grown_shard in (r.shard, 40)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_weights_share_and_move_few(spark):
    ids = spark.range(4000)
    dealt = sharding.assign(ids, ids["id"], [1.0, 3.0], 1.0).collect()
    assert 0.71 < sum(r.shard == 1 for r in dealt) / 4000 < 0.79
    assert all(r.grown_shard in (r.shard, 2) for r in dealt)
    assert 0.16 < sum(r.grown_shard == 2 for r in dealt) / 4000 < 0.24


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_has_no_python(spark, folder):
    plan = sharding.shard_documents(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
