"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index gives every item a threshold that no passage with the required
overlap can miss: the item's score with itself, less what the words of the
shingles that may be missing can weigh at most.  Weights are divided by it, so
an item is retrieved from a sum of 1 on.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_and_texts, map_texts, slices, unused, whole_text

WORDS, OVERLAP = 5, 0.8
#: Least overlap of each part: the question's, and the answer's (the last third of the item).
PART_OVERLAP = 0.5
K1, B = 1.2, 0.75
#: Items of a block, which share an upper bound per word.
BLOCK = 16
#: Share of an item's threshold that its common words may reach together; passages without rarer words are never scored.
COMMON = 0.5
PASSAGE = 64
#: Characters of test items in one index; more items make further indexes, each queried by all passages.
INDEX_CHARS = 16_000_000

_WORD = re.compile(r"\w+")
_SLACK = 1e-9


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], size: int = WORDS) -> list[tuple[str, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Index:
    """Postings by word and block of items, with the block's largest weight for the word."""

    def __init__(self, items: list[tuple[int, str]]):
        read = [(i, words_of(t or "")) for i, t in items]
        self.ids = [i for i, w in read if w]
        self.items = [w for _, w in read if w]
        self.parts = []
        count = len(self.items)
        holding = Counter(w for words in self.items for w in set(words))
        mean = sum(map(len, self.items)) / max(count, 1)
        self.weights: list[dict[str, float]] = []
        self.common: list[float] = []
        postings: dict[str, dict[int, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
        for number, words in enumerate(self.items):
            weight = {
                w: math.log(1 + (count - holding[w] + 0.5) / (holding[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean))
                for w, f in Counter(words).items()
            }
            own = shingles(words)
            missing = math.floor((1 - OVERLAP) * len(set(own)) + _SLACK)
            # a shingle missing loses one place of a word at most, repeats of a shingle one each
            lost = missing * max(Counter(own).values())
            least = sum(sorted(weight.values())[: max(len(weight) - lost, 0)])
            least = max(least, min(weight.values()))
            weight = {w: x / least for w, x in weight.items()}
            self.weights.append(weight)
            cut = len(own) - max(1, len(own) // 3)
            self.parts.append((set(own), set(own[:cut]) or set(own), set(own[cut:])))
            sum_ = 0.0
            for w in sorted(weight, key=lambda w: (-holding[w], len(w), w)):
                if sum_ + weight[w] < COMMON:
                    sum_ += weight[w]
                else:
                    postings[w][number // BLOCK].append((number, weight[w]))
            self.common.append(sum_)
        self.rare = {
            w: [(block, max(x for _, x in rows), rows) for block, rows in blocks.items()] for w, blocks in postings.items()
        }
        self.block_common = [max(self.common[b : b + BLOCK]) for b in range(0, count, BLOCK)]
        self.span = max(PASSAGE, max(map(len, self.items), default=0))

    def retrieve(self, words: list[str]):
        """``(item, passage)`` pairs whose sum reaches 1; passages overlap by half, so one holds any item whole."""
        hits = [(at, w) for at, w in enumerate(words) if w in self.rare]
        if not hits:
            return
        low = high = 0
        start = 0
        while start < len(words):
            stop = start + 2 * self.span
            while low < len(hits) and hits[low][0] < start:
                low += 1
            if low == len(hits):
                return
            high = max(high, low)
            while high < len(hits) and hits[high][0] < stop:
                high += 1
            if high > low:
                for item in self._reached({w for _, w in hits[low:high]}):
                    full = self.weights[item]
                    present = full.keys() & set(words[start:stop])
                    score = sum(full[w] for w in present)
                    if score >= 1 - _SLACK:
                        yield item, start, score
            if stop >= len(words):
                return
            start += self.span

    def _reached(self, rare: set[str]) -> list[int]:
        """Items that the passage's rare words can bring to 1 with all common ones; blocks are left by their bounds."""
        bounds: dict[int, float] = {}
        for w in rare:
            for block, most, _ in self.rare[w]:
                bounds[block] = bounds.get(block, 0.0) + most
        open_ = {b for b, most in bounds.items() if most + self.block_common[b] >= 1 - _SLACK}
        if not open_:
            return []
        sums: dict[int, float] = {}
        for w in rare:
            for block, _, rows in self.rare[w]:
                if block in open_:
                    for item, x in rows:
                        sums[item] = sums.get(item, 0.0) + x
        return sorted(i for i, x in sums.items() if x + self.common[i] >= 1 - _SLACK)

    def leaks(self, text: str) -> dict[int, tuple[int, float, float, float]]:
        """By item: passage, score, question's and answer's overlap of the best passage that holds both."""
        words = words_of(text)
        found: dict[int, tuple[int, float, float, float]] = {}
        for item, start, score in self.retrieve(words):
            # an item of fewer words than a shingle is looked for among runs of its own length
            held = set(shingles(words[start : start + 2 * self.span], min(WORDS, len(self.items[item]))))
            whole, question, answer = self.parts[item]
            share = [len(part & held) / len(part) for part in (whole, question, answer)]
            if share[0] >= OVERLAP - _SLACK and min(share[1:]) >= PART_OVERLAP - _SLACK:
                best = found.get(item)
                if best is None or (share[1] + share[2], score) > (best[2] + best[3], best[1]):
                    found[item] = (start, score, share[1], share[2])
        return {self.ids[i]: x for i, x in found.items()}


def indexes(benchmark: DataFrame) -> list:
    """Broadcast indexes over the test items, each of a bounded number of characters; items without id or words are left out."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    size, least, most = items.agg(F.sum(F.char_length("text")), F.min("item_id"), F.max("item_id")).first()
    parts = max(1, math.ceil((size or 0) / INDEX_CHARS))
    made = []
    for part in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = sorted((r.item_id, r.text) for r in some.collect())
        if rows:
            made.append(spark.sparkContext.broadcast(Index(rows)))
    return made


LEAK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("bm25", T.DoubleType()),
        T.StructField("question_overlap", T.DoubleType()),
        T.StructField("answer_overlap", T.DoubleType()),
    ]
)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item whose question and answer stand in one passage of it.

    An item counts as held from four fifths of its five-word shingles on, with
    at least half of those of its question and of its answer.  ``bm25`` is the
    passage's score in units of the item's threshold.  An item of fewer words
    is one shingle, found wherever a document holds just these words in a row.
    Items and documents without words, or null, match nothing; items repeated
    under one id give one row, the better; repeated documents give their rows
    each; a text of any length is read whole, passage by passage.  An empty
    table gives no rows.  Of ``docs`` only id and text are read, of
    ``benchmark`` item_id and text, whatever other columns are called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows, arrow = ids_and_texts(docs), to_arrow_schema(LEAK)
    made = None
    for index in indexes(benchmark):

        def run(batches, index=index):
            for part in slices(batches):
                out = [
                    (doc, item, *values)
                    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                    for item, values in sorted(index.value.leaks(text).items())
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        found = rows.mapInArrow(run, LEAK)
        made = found if made is None else made.unionByName(found)
    return made if made is not None else docs.sparkSession.createDataFrame([], LEAK)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item (see ``leaks``); columns stay as they are, whatever their names.

    Null and empty texts stay, repeated rows are judged alike, an empty table
    on either side gives the documents as they are.
    """
    left, leak = docs, unused("leak", docs)
    for index in indexes(benchmark):

        def function(texts, index=index):
            return {leak: [bool(index.value.leaks(t or "")) for t in texts]}

        marked = map_texts(left, function, T.StructType([T.StructField(leak, T.BooleanType())]), tuple(docs.columns))
        left = marked.where(~F.col(leak)).drop(leak)
    return left
