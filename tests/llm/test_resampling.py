import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, target, longest=1):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, features(text, longest)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (S + 10000)) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for i, text in docs:
        words, found = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = Counter()
    drawn = [(*r[:4], k) for k, r in enumerate(able[: 10 * len(able) // 100], 1)]
    for r in drawn:
        rank[r[:4]] += 1
    rest = []
    for r in rows:
        if rank[r[:4]]:
            rank[r[:4]] -= 1
        else:
            rest.append((*r[:4], None))
    return Counter(drawn + rest)


def run(spark, docs, target, longest=1):
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "rank", "weight", "minus", "one", "slot", "bucket")})
    wanted = spark.createDataFrame([(t,) for t in target], "text string").withColumn("n", F.lit("clash"))
    return Counter(map(tuple, resampling.resampled(given.repartition(5), wanted, longest=longest).select("doc_id", "n_features", "weight", "score", "rank").collect()))


def corpus():
    rng = np.random.default_rng(2)
    words = ["Apple", "pear", "ÄPFEL", "äpfel", "x1", "don't", "naïve", "日本語", "_", "–"] + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 80)))) for i in range(150)]
    odd = [(500, None), (501, ""), (502, " .,-\n"), (503, "same " * 300_000), (504, "é" * 400_000 + " z"), (None, "null id " * 20), (7, docs[7][1]), (7, docs[7][1]), (8, "other text " * 15)]
    return docs + odd, [docs[3][1], docs[9][1], None, "", "apple ÄPFEL zebra"]


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, longest):
    docs, target = corpus()
    assert run(spark, docs, target, longest) == brute(docs, target, longest)


def test_empty_tables(spark):
    assert not run(spark, [], ["a"])
    docs = [(i, f"word{i} " * 25) for i in range(30)]
    assert run(spark, docs, []) == brute(docs, [])


def test_planes_sum_exactly():
    rng = np.random.default_rng(4)
    gains = rng.integers(-(2**40), 2**40, resampling.BUCKETS)
    gains[:5] = 0
    held = np.sort(rng.choice(resampling.BUCKETS, 900, replace=False))
    counts = rng.integers(1, 2**20, 900)
    want = sum(int(g) * int(c) for g, c in zip(gains[held], counts))
    assert resampling.Gains(gains).weight(held, counts) == want
    assert resampling.Gains(np.zeros(resampling.BUCKETS, np.int64)).weight(held, counts) == 0
    assert resampling.Gains(gains).weight(held[:0], counts[:0]) == 0


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = ("Abc déf,x " * 50 + "long" * 30).encode()
    whole = [w for words in resampling.word_lists(text) for w in words]
    monkeypatch.setattr(resampling, "_PIECE", 7)
    assert [w for words in resampling.word_lists(text) for w in words] == whole
    counts = resampling.bucket_counts(text, {}, 4)
    monkeypatch.undo()
    assert all(np.array_equal(a, b) for a, b in zip(counts, resampling.bucket_counts(text, {}, 4)))
