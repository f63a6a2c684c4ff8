import random

import pytest
from pyspark.sql import functions as F

from thalweg.llm import decontamination as d


def held(words, item):
    """The rule, by brute force over every stretch of the document."""
    own = d.shingles(item)
    cut = len(own) - max(1, len(own) // 3)
    parts = [set(own), set(own[:cut]) or set(own), set(own[cut:])]
    size = min(5, len(item))  # a shorter item is one run of its own length
    got = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    share = [len(p & got) / len(p) for p in parts]
    return share[0] >= 0.8 and min(share[1:]) >= 0.5


def test_against_brute_force_on_the_tables(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    want = {
        (x.doc_id, i.item_id) for x in docs.collect() for i in items.collect() if held(d.words_of(x.text), d.words_of(i.text))
    }
    assert got == want and got
    left = d.without_leaks(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {x for x, _ in want}


@pytest.mark.parametrize("changed", [0, 1, 2, 3])
def test_edited_passages_in_long_documents(changed):
    rng = random.Random(changed)
    common = [f"c{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(300)}" for _ in range(rng.randrange(6, 60)))) for i in range(80)]
    index = d.Index(items)
    for number, text in items:
        words = text.split()
        for place in rng.sample(range(len(words)), min(changed, len(words))):
            words[place] = "other"
        around = [rng.choice(common) for _ in range(600)]
        at = rng.randrange(600)
        document = around[:at] + words + around[at:]
        found = index.leaks(" ".join(document))
        for other, t in items:
            assert (other in found) == held(document, t.split()), (number, other)


def test_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, "short one"), (2, ""), (3, None), (None, "a b c d e f g"), (4, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (5, "z " * 3000)], "item_id long, text string"
    ).withColumn("doc_id", F.lit(7))
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "x A, b c. D e f g h i j k l y"), (3, "x A, b c. D e f g h i j k l y"), (None, "a b c d e f g h i j k l"), (6, "w " * 50_000 + "short one"), (7, "a b c d e f g h"), (8, "z " * 5000), (9, "Short. ONE!")],
        "doc_id long, text string",
    ).withColumn("item_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()), key=str)
    assert got == [(3, 4), (3, 4), (6, 1), (8, 5), (9, 1), (None, 4)]
    assert d.leaks(docs, items.limit(0)).count() == 0 and d.leaks(docs.limit(0), items).count() == 0
    assert d.without_leaks(docs, items.limit(0)).count() == 9
    clashing = docs.withColumn("leak", F.lit("x")).withColumn("LEAK_", F.lit("y"))
    left = d.without_leaks(clashing, items)
    assert left.columns == clashing.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 7]
    assert d.without_leaks(docs.limit(0), items).count() == 0


def test_short_items_inside_documents(spark):
    items = spark.createDataFrame([(1, "short one here"), (2, "word"), (3, "a b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before short one here after it"), (2, "short one"), (3, "the word"), (4, "wording"), (5, "x " * 900 + "a b. C d"), (6, "a b d c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()) == [(1, 1), (3, 2), (5, 3)]


def test_several_indexes_find_the_same(spark, folder, monkeypatch):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    one = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    monkeypatch.setattr(d, "INDEX_CHARS", 3000)
    assert len(d.indexes(items)) > 1
    assert one == {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
