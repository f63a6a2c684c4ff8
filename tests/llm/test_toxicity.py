import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    bad = ["vilewort", "grubkin", "fouloaf"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(bad).title()
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    odd = [(1001, None), (1002, ""), (1003, "!!! 123"), (None, "vilewort grubkin"), (1004, "bada " * 40_000), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("score", F.lit(1))
    extra = [(None, 1, 1), (5, 1, None), (7777, 1, 1), (3, 0, 0)]
    return docs, spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int"), dict(rows), bad


def test_held_out_documents(corpus):
    docs, labels, texts, bad = corpus
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) + 6
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    judged = [(r.predicted, r.doc_id % 5 == 0) for r in got if r.held_out and r.doc_id < 1000]
    assert np.mean([a == b for a, b in judged]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[1001].score == by[1002].score == by[1003].score < 0.7
    assert by[None].predicted == 1


def test_labels_of_held_out_rows_do_not_matter(corpus):
    docs, labels, _, _ = corpus
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.toxicity(docs, labels).collect())
    assert a == sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.toxicity(docs, flipped).collect())


def test_counts_against_brute_force(corpus, spark):
    docs, labels, texts, bad = corpus
    sent, _ = toxicity.train(docs.where("doc_id > 0 and doc_id < 1000"), labels)
    model = sent.value
    for word in [w.lower() for w in bad] + ["nowhere"]:
        at = list(toxicity.cells_of(word))
        for y in (0, 1):
            want = sum(
                word in t.lower().split() for i, t in texts.items() if i > 0 and i != 5 and zlib.crc32(str(i).encode()) % 3 != 1 and (i % 5 == 0) == y
            )
            assert model.counts[y][at].min() == want


def test_stage_keeps_columns_and_clean_rows(corpus):
    docs, labels, _, _ = corpus
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    got = {r.doc_id for r in left.collect()}
    assert {1001, 1002, 1003, 1004} <= got and None not in got
    clean = [i for i in range(600) if i % 5]
    assert sum(i in got for i in clean) >= 0.98 * len(clean)


def test_no_labels_and_no_rows(corpus, spark):
    docs, labels, _, _ = corpus
    scores = {r.score for r in toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()}
    assert scores == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("known", [0, 40])
def test_words_beyond_the_broadcast_are_joined(corpus, known):
    docs, labels, _, _ = corpus
    whole = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.toxicity(docs, labels).collect())
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.toxicity(docs, labels, known_words=known).collect()) == whole
    left = sorted(str(r.doc_id) for r in toxicity.without_toxic(docs, labels).collect())
    assert sorted(str(r.doc_id) for r in toxicity.without_toxic(docs, labels, known_words=known).collect()) == left


def test_contexts_have_no_limit(spark):
    rows = [(i, f"left{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} common") for i in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    trained, _ = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows)
    got = trained.counted.where("word = 'common'").first()
    assert n > 1000 and (got.before, got.ordinary + got.toxic) == (n, n)
