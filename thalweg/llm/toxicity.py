"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

The models are unigram models of words that back off to one shared
distribution, which follows the number of different words a word comes after.
Counts are exact and kept in a stored table by word; every labelled training
row is counted.  The most frequent words of the table are broadcast, all of them
where they are few; a text's other words meet the table in a shuffled join.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import ids_and_texts, slices, whole_text

WORD = re.compile(r"[^\W\d_]+")
#: Words of the model that are broadcast, the most frequent ones; more are joined by a shuffle.
KNOWN_WORDS = 200_000
#: Different words and pairs of words a task holds before it hands its counts on.
HELD_WORDS = 400_000
#: Labelled rows that the final weights are fitted on, at most about.
FIT_ROWS = 20_000
#: A word counts as telling from this log-likelihood ratio on.
TELLING = 1.5
#: Words without evidence that every text is given, so that no short text looks extreme.
PRIOR_WORDS = 10
TOXIC_AT = 0.7


def cells_of(word: str) -> tuple[str, ...]:
    """Where a word's counts are kept: under the word itself."""
    return (word,)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(rows: DataFrame) -> DataFrame:
    """``word`` with the documents of either class that hold it and the number of different words before it."""
    schema = "word string, before string, ordinary long, toxic long"
    arrow = pa.schema([("word", pa.string()), ("before", pa.string()), ("ordinary", pa.int64()), ("toxic", pa.int64())])

    def emit(counts, pairs):
        ordinary, toxic = counts
        words = list(ordinary.keys() | toxic.keys())
        for start in range(0, len(words), 50_000):
            some = words[start : start + 50_000]
            columns = [some, [None] * len(some), [ordinary[w] for w in some], [toxic[w] for w in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        follows = sorted(pairs, key=lambda p: p[::-1])  # like words together: a smaller shuffle
        for start in range(0, len(follows), 50_000):
            before, some = zip(*follows[start : start + 50_000])
            columns = [some, before, [0] * len(some), [0] * len(some)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        counts, pairs = (Counter(), Counter()), set()
        for part in slices(batches):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = WORD.findall(text.lower())
                counts[toxic].update(set(words))
                pairs.update(zip(["", *words], words))
                if len(pairs) > HELD_WORDS or sum(map(len, counts)) > HELD_WORDS:
                    yield from emit(counts, pairs)
                    counts, pairs = (Counter(), Counter()), set()
        yield from emit(counts, pairs)

    made = rows.select("text", "toxic").mapInArrow(run, schema)
    sums = [F.sum(c).alias(c) for c in ("ordinary", "toxic")]
    # a word after very many others is first reduced to one row for each of them
    return made.groupBy("word", "before").agg(*sums).groupBy("word").agg(*sums, F.count("before").alias("before"))


def _figures(counted: DataFrame) -> dict:
    """What smoothing needs to know of the whole table: totals, and how many words have a count of 1, 2, 3, 4."""
    wanted = [F.count("*").alias("words"), F.sum("before").alias("shared")]
    for y, c in enumerate(("ordinary", "toxic")):
        wanted += [F.sum(c).alias(f"total{y}"), F.count_if(F.col(c) >= 3).alias(f"more{y}")]
        wanted += [F.count_if(F.col(c) == i).alias(f"n{y}{i}") for i in (1, 2, 3, 4)]
    return {k: v or 0 for k, v in counted.agg(*wanted).first().asDict().items()}


class Smoothing:
    """Log-likelihood ratios of counts, toxic against ordinary."""

    def __init__(self, figures: dict):
        self.shared = float(figures["shared"]) or 1.0
        self.totals, self.discounts, self.backoff = [], [], []
        for y in (0, 1):
            held = [figures[f"n{y}{i}"] for i in (1, 2, 3, 4)]
            n = [max(1, h) for h in held]
            flat = n[0] / (n[0] + 2 * n[1])
            # the modified discounts for counts of one, two, and three or more, kept within (0, count)
            off = [0.0] + [min(max(i - (i + 1) * flat * n[i] / n[i - 1], 0.3 * i), 0.95 * i) for i in (1, 2, 3)]
            total = max(1, figures[f"total{y}"])
            self.totals.append(total)
            self.discounts.append(np.array(off))
            self.backoff.append(max(off[1] * held[0] + off[2] * held[1] + off[3] * figures[f"more{y}"], 0.5) / total)

    def ratios(self, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The ratio of each word, and beside it those that leave out an ordinary or a toxic document that holds it."""
        made = []
        for own in (None, 0, 1):
            p = []
            for y in (0, 1):
                c = np.maximum(counts[y] - 1, 0) if own == y else counts[y]
                p.append(np.maximum(c - self.discounts[y][np.minimum(c, 3)], 0) / self.totals[y] + self.backoff[y] * (before / self.shared))
            some = np.minimum(*p) > 0
            if own is not None:  # a word of no other document: both models back off alike
                some &= (counts[own] > 1) | (counts[1 - own] > 0)
            made.append(np.log(np.where(some, p[1], 1) / np.where(some, p[0], 1)))
        return np.stack(made)


class ByWord:
    """Counts by word, none for words that are not there."""

    def __init__(self, place: dict[str, int], counts: np.ndarray):
        self.place, self.all = place, np.append(counts, 0)

    def __getitem__(self, words: list[str]) -> np.ndarray:
        return self.all[[self.place.get(w, -1) for w in words]]


class Model:
    """The ratios of the most frequent words; ``whole`` if these are all words."""

    def __init__(self, words: list[str], counts: np.ndarray, before: np.ndarray, smoothing: Smoothing, whole: bool):
        self.place = {w: i for i, w in enumerate(words)}
        self.counts = [ByWord(self.place, c) for c in counts]
        self.table, self.whole = smoothing.ratios(counts, before), whole

    def read(self, text: str, own: int | None = None) -> tuple[int, list[float], list[str]]:
        """A text's number of different words, what the known ones say, and the others.

        ``own`` leaves out one document of that class, the text itself.
        """
        words = set(WORD.findall(text.lower()))
        at = [i for i in map(self.place.get, words) if i is not None]
        said = summary(self.table[0 if own is None else own + 1][np.array(at, np.int64)])
        return len(words), said, [] if self.whole else [w for w in words if w not in self.place]


def summary(ratios: np.ndarray) -> list[float]:
    """The sum; what telling words have beyond the threshold; the three greatest.  Words with ratio 0 change nothing."""
    ratios = np.sort(ratios)[::-1]  # the same sum whatever order they come in
    top = np.maximum(ratios[:3], 0.0).tolist()
    return [float(ratios.sum()), float((ratios[ratios > TELLING] - TELLING).sum()), *top, *[0.0] * (3 - len(top))]


def both(a: list[float], b: list[float]) -> list[float]:
    return [a[0] + b[0], a[1] + b[1], *sorted([*a[2:], *b[2:]], reverse=True)[:3]]


def evidence(words: int, said: list[float]) -> list[float]:
    """What the two likelihoods say about a text, normalised by its length in different words.

    The mean ratio; the mean and the sum of what telling words have beyond
    the threshold; the three most telling words' ratios.
    """
    size = words + PRIOR_WORDS
    return [said[0] / size, math.log1p(100 * said[1] / size), math.log1p(said[1]), *said[2:]]


EVIDENCE = 6


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression with a little shrinkage: centre, scale and weights (the first is the constant)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(EVIDENCE), np.ones(EVIDENCE), np.r_[math.log(share / (1 - share)), np.zeros(EVIDENCE)]
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    shrink = np.diag([1e-6] + [1.0] * EVIDENCE)
    w = np.zeros(EVIDENCE + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + shrink, z.T @ (p - y) + shrink @ w)
    return centre, scale, w


class Trained:
    """The broadcast model, and the stored counts of all words."""

    def __init__(self, counted: DataFrame, known_words: int):
        figures = _figures(counted)
        whole = figures["words"] <= known_words
        most = counted if whole else counted.orderBy(F.desc(F.col("ordinary") + F.col("toxic")), "word").limit(known_words)
        word, ordinary, toxic, before = most.select("word", "ordinary", "toxic", "before").toArrow().columns
        self.smoothing, self.counted, self.whole = Smoothing(figures), counted, whole
        model = Model(word.to_pylist(), np.stack([ordinary.to_numpy(), toxic.to_numpy()]), before.to_numpy(), self.smoothing, whole)
        self.sent = counted.sparkSession.sparkContext.broadcast(model)

    @property
    def value(self) -> Model:
        return self.sent.value

    def rated(self) -> DataFrame:
        """``__word`` with its three ratios, for every word that is not broadcast."""
        sent, smoothing = self.sent, self.smoothing
        names = ["ordinary", "toxic", "before"]

        def run(batches):
            for batch in batches:
                batch = batch.filter(pa.array([w not in sent.value.place for w in batch.column("word").to_pylist()], pa.bool_()))
                ordinary, toxic, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
                made = smoothing.ratios(np.stack([ordinary, toxic]), before)
                yield pa.RecordBatch.from_arrays([batch.column("word"), *map(pa.array, made)], names=["__word", "r", "r0", "r1"])

        return self.counted.select("word", *names).mapInArrow(run, "__word string, r double, r0 double, r1 double")

    def evidence(self, docs: DataFrame, keep: tuple[str, ...], own: str | None = None) -> DataFrame:
        """The columns ``keep`` and ``__x``, the evidence of each text, without itself in the class that column ``own`` names."""
        sent = self.sent
        docs = docs.withColumn("__own", F.col(own).cast("int") if own else F.lit(-1))
        docs = docs.withColumn("__of", F.concat_ws(" ", "__own", whole_text()))
        array = T.ArrayType(T.DoubleType())

        def read(text):
            mark, _, text = text.partition(" ")
            return sent.value.read(text, None if mark == "-1" else int(mark))

        if self.whole:

            def function(texts):
                return {"__x": [evidence(*read(t)[:2]) for t in texts]}

            return _map(docs, function, T.StructType([T.StructField("__x", array)]), keep)

        def halves(texts):
            words, said, rest = zip(*map(read, texts)) if texts else ((), (), ())
            return {"__words": list(words), "__said": list(said), "__rest": list(rest)}

        fields = [T.StructField("__words", T.LongType()), T.StructField("__said", array), T.StructField("__rest", T.ArrayType(T.StringType()))]
        keyed = docs.withColumn("__key", F.unhex(F.md5(F.col("__of").cast("binary"))))
        parts = stored(_map(keyed, halves, T.StructType(fields), (*keep, "__key", "__own")), "parts")
        ratio = F.when(F.col("__own") == 0, F.col("r0")).when(F.col("__own") == 1, F.col("r1")).otherwise(F.col("r"))
        met = parts.select("__key", "__own", F.explode("__rest").alias("__word")).join(self.rated(), "__word")
        # a set: equal texts share a key and say the same of each word once
        rest = met.groupBy("__key").agg(F.collect_set(F.struct("__word", ratio.alias("r"))).alias("__met")).select("__key", F.col("__met.r").alias("__more"))
        whole = parts.drop("__rest", "__own").join(rest, "__key", "left")
        schema = T.StructType([parts.schema[c] for c in keep] + [T.StructField("__x", array)])

        def finish(batches):
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("__words", "__said", "__more")]
                x = [evidence(n, both(said, summary(np.array(more or [], float)))) for n, said, more in zip(*columns)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "__x"])

        return whole.select(*keep, "__words", "__said", "__more").mapInArrow(finish, schema)


def _map(docs: DataFrame, function, schema: T.StructType, keep: tuple[str, ...]) -> DataFrame:
    """``map_texts`` over ``__of``, a text behind its mark, in place of the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = T.StructType([docs.schema[c] for c in keep] + list(schema.fields))
    arrow, names = to_arrow_schema(whole), [f.name for f in schema.fields]

    def run(batches):
        for part in slices(batches, "__of"):
            made = function(part.column("__of").to_pylist())
            columns = [part.column(c).cast(arrow.field(c).type) for c in keep] + [pa.array(made[c], arrow.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*keep, "__of").mapInArrow(run, whole)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, few_labels: int = 1_000_000, known_words: int = KNOWN_WORDS):
    """Model and weights from the labelled documents that are not held out, all of which are counted.

    Labels are broadcast up to ``few_labels`` rows and joined by a shuffle
    beyond.  The driver receives the counts of the ``known_words`` most
    frequent words and the evidence of about ``fit_rows`` documents, each
    judged without itself.  A document with several labels counts as toxic if
    one says so; labels that are null or of no document don't count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    many = known.count()
    rows = ids_and_texts(docs)
    rows = rows.join(F.broadcast(known) if many <= few_labels else known, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")
    trained = Trained(stored(_counted(rows), "words"), known_words)
    share = min(1.0, fit_rows / max(many, 1))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    got = trained.evidence(some, ("toxic",), own="toxic").toPandas()
    x = np.array(got["__x"].to_list(), float).reshape(-1, EVIDENCE)
    y = got["toxic"].to_numpy(float)
    order = np.lexsort([y, *x.T])  # the same sum whatever order the rows come in
    return trained, fit_weights(x[order], y[order])


def scored(docs: DataFrame, model: Trained, weights, keep: tuple[str, ...], column: str) -> DataFrame:
    centre, scale, w = weights
    made = model.evidence(docs, keep)
    schema = T.StructType([made.schema[c] for c in keep] + [T.StructField(column, T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("__x").to_pylist(), float).reshape(-1, EVIDENCE)
            z = w[0] + ((x - centre) / scale) @ w[1:]
            made = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, column])

    return made.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, known_words: int = KNOWN_WORDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` in 0 to 1 and ``predicted`` (1 from 0.7 on) for every document.

    Only the text enters a score.  Null and empty texts score as a text
    without evidence; repeated rows score alike; a null id is never held out.
    Without labels of both kinds the score is near their share, one half if
    there are none.  An empty table gives no rows.
    """
    model, weights = train(docs, labels, known_words=known_words)
    made = scored(ids_and_texts(docs), model, weights, ("doc_id",), "score")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, known_words: int = KNOWN_WORDS) -> DataFrame:
    """The documents less those that score as toxic; columns stay as they are."""
    model, weights = train(docs, labels, known_words=known_words)
    if model.whole:
        return scored(docs, model, weights, tuple(docs.columns), "__toxic").where(F.col("__toxic") < TOXIC_AT).drop("__toxic")
    # texts don't go through the join of words, only their digests do
    digest = F.unhex(F.md5(whole_text().cast("binary")))
    told = scored(docs.select(whole_text().alias("text"), digest.alias("__text")), model, weights, ("__text",), "__toxic")
    toxic = stored(told.where(F.col("__toxic") >= TOXIC_AT).select("__text").distinct(), "toxic")
    return docs.withColumn("__digest", digest).join(toxic, F.col("__digest") == F.col("__text"), "left_anti").drop("__digest")
