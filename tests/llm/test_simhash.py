import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from thalweg.llm import simhash
from thalweg.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints, limit=3):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                if x != y:
                    root[x] = y
    groups = {}
    for k in keys:
        groups.setdefault(find(k), set()).add(k)
    return {k: g for g in groups.values() for k in g}


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    joined = classes({p for _, p in prints})
    out = []
    for i, p in prints:
        ids = [j for j, q in prints if q in joined[p] and j is not None]
        out.append((i, f"{p:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "two words"), (5, "Two WORDS"), (6, "É é x y z\x1cw"),
    (7, "a b c d e f g h i j k " * 3000), (8, "a b c d e f g h i j k " * 3000 + "tail"), (None, None), (9, "x" * 200_000),
]


@pytest.mark.parametrize("group", [4096, 2])
def test_against_brute_force(spark, folder, group):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(None if i is None else i + 10_000, t) for i, t in ODD]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    got = sorted((tuple(r) for r in simhash.near_duplicates(given, group=group).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_every_link():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(30)})
    bits = np.array(prints, np.uint64)
    bits = bits[np.argsort(simhash.gray_rank(bits))]
    index = simhash.GrayIndex(np.zeros(len(bits), int), bits)
    a, b = index.search(np.arange(len(bits)), 3)
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (int(bits[i]) ^ int(bits[j])).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want


@pytest.mark.parametrize("group", [4096, 8])
def test_dense_cluster(spark, group):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    given = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    joined = {r.node: r.root for r in components(simhash.links(given, group=group)).collect()}
    want = classes(prints)
    got = {}
    for p in prints:
        got.setdefault(joined.get(simhash.signed(p), simhash.signed(p)), set()).add(p)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}


def test_large_nodes_are_searched_by_blocks(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(27) for _ in range(120)} | {5 ^ (1 << b) for b in range(20)}
    rows = spark.createDataFrame([(7, p, p) for p in prints], "node long, fp long, rest long")
    joined = {r.node: r.root for r in components(simhash._large_node_links(rows, 3, 16)).collect()}
    got = {}
    for p in prints:
        got.setdefault(joined.get(p, p), set()).add(p)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in classes(prints).values()}


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1200)}


def test_keep_one(spark):
    rows = [(3, "a b c d e", 1), (2, "a b c d e", 2), (2, "a b c d e", 2), (None, "a b c d e", 3), (None, "lone text of nobody", 4), (None, "lone text of nobody", 5), (9, "quite other words here", 6)]
    given = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = simhash.keep_one(given)
    assert got.columns == given.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(2, "a b c d e"), (9, "quite other words here")]
    assert [r.text for r in got.collect() if r.doc_id is None] == ["lone text of nobody"]


def test_keep_one_tells_texts_under_one_id_apart(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "wholly other words stand here"), (1, "alpha beta gamma delta"), (0, "wholly other words stand here"), (None, "alpha beta gamma delta"), (5, None), (4, ""), (6, " \t")]
    names = {c: F.lit("clash") for c in ("fp", "row", "FP_", "class", "least", "first", "member", "node", "bare")}
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumns(names)
    got = simhash.keep_one(given.repartition(3))
    assert got.columns == given.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(0, "wholly other words stand here"), (1, "alpha beta gamma delta"), (4, "")]
    assert simhash.keep_one(given.limit(0)).count() == 0
