"""Resampling of documents towards a target: weights from hashed features, summed bit by bit.

A document's counts over the buckets become planes, one per binary digit of a
count, each with a bit per bucket.  The buckets' gains become planes too, one
per digit and sign.  A weight is the sum over pairs of planes of a power of two
times the bits that both share: whole numbers throughout, so it is exact.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import ids_and_texts, slices, whole_text
from .sharding import slotted

BUCKETS = 10_000
#: Consecutive words of the longest feature.
LONGEST = 1
#: Words that a document needs to be drawn, and the percentage that is drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Bytes of a plane, whole 64-bit words of them.
_PLANE = -(-BUCKETS // 64) * 8
#: Digits, small letters and everything beyond ASCII, in UTF-8.
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: A long text is cut into words a few hundred kilobytes at a time; a task remembers the buckets of so many features.
_PIECE, _KNOWN = 1 << 18, 200_000


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text in order, in lists of bounded size (one huge word comes alone)."""
    start = 0
    while start < len(text):
        stop = start + _PIECE
        gap = _GAP.search(text, stop) if stop < len(text) else None
        stop = gap.start() if gap else len(text)
        yield _WORD.findall(text[start:stop].lower())  # of bytes, only A-Z have small forms
        start = stop


def _bucket(feature: bytes, known: dict[bytes, int]) -> int:
    if (found := known.get(feature)) is None:
        found = zlib.crc32(feature) % BUCKETS
        if len(known) < _KNOWN:
            known[feature] = found
    return found


def bucket_counts(text: bytes, known: dict[bytes, int], longest: int = LONGEST) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and the buckets of all features of a text with their counts."""
    total, tail = np.zeros(BUCKETS, np.int64), []
    words = 0
    for listed in word_lists(text):
        words += len(listed)
        found = Counter(listed)
        run = tail + listed
        for size in range(2, longest + 1):
            # runs that end in this list; those within the tail were counted before
            first = max(0, len(tail) - size + 1)
            found.update(b" ".join(run[i : i + size]) for i in range(first, len(run) - size + 1))
        tail = run[max(0, len(run) - longest + 1) :] if longest > 1 else []
        np.add.at(total, [_bucket(f, known) for f in found], list(found.values()))
    held = np.flatnonzero(total)
    return words, held, total[held]


def planes(buckets: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A row of 64-bit words per binary digit: bit b of row j is digit j of bucket b's number."""
    digits = int(numbers.max(initial=0)).bit_length()
    bits = np.zeros((digits, _PLANE * 8), bool)
    bits[:, buckets] = (numbers >> np.arange(digits)[:, None]) & 1
    return np.packbits(bits, axis=1).view(np.uint64)


class Gains:
    """Gains per bucket as signed planes."""

    def __init__(self, gains: np.ndarray):
        every = np.arange(len(gains))
        positive, negative = planes(every, np.maximum(gains, 0)), planes(every, np.maximum(-gains, 0))
        self.planes = np.concatenate([positive, negative])
        self.factors = [1 << k for k in range(len(positive))] + [-(1 << k) for k in range(len(negative))]

    def weight(self, buckets: np.ndarray, counts: np.ndarray) -> int:
        out = 0
        for j, plane in enumerate(planes(buckets, counts)):
            shared = np.bitwise_count(self.planes & plane).sum(1, dtype=np.int64)
            out += sum(f * s for f, s in zip(self.factors, shared.tolist())) << j
        return out


def totals(texts: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all rows of ``text``: summed per task, then by bucket."""

    def run(batches):
        known, out = {}, np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                _, held, counts = bucket_counts(text, known, longest)
                out[held] += counts
        held = np.flatnonzero(out).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held])], ["bucket", "n"])

    made = texts.select(whole_text().alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[made.column("bucket").to_numpy()] = made.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of a nat each: how much more often the target holds a bucket than the source, one added to both."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def luck(doc_id: int | None) -> int:
    """The document's own draw from the double-exponential distribution, in thousandths."""
    name = "null" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{SEED}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Weight and score of every document: gains come from all documents and all texts of ``target``."""
    plain = ids_and_texts(docs)
    signed = docs.sparkSession.sparkContext.broadcast(Gains(gains(totals(plain, longest), totals(target, longest))))

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
                words, held, counts = bucket_counts(text, known, longest)
                weight = signed.value.weight(held, counts)
                for column, value in zip(out, (words, int(counts.sum()), weight, weight + luck(doc_id))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)], names)

    names = [part.split()[0] for part in SCORED.split(", ")]
    return plain.mapInArrow(run, SCORED)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST) -> DataFrame:
    """Every document with its weight, score and rank; rank is null where the document is not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a
    hundred are drawn, by highest score, ties to the smaller id.  Scores carry
    a draw of their own per id, so taking the highest is sampling in
    proportion to the weights without putting back.  Null and empty texts have
    no features and weight 0; long texts are read whole, in pieces; repeated
    rows count, and are ranked, each on its own; a null id draws as the text
    ``null``.  An empty table gives no rows, an empty target gains below zero
    for every bucket that is held.  Only id and text are read.
    """
    rows = stored(scored(docs, target, longest), "scores")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    ordered = slotted(rows.where(able).withColumn("minus", -F.col("score")).withColumn("one", F.lit(0)), "one", ["minus", "doc_id"])
    rank = F.when(F.col("slot") < drawn, F.col("slot") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ordered.select(*columns, rank.alias("rank")).unionByName(rows.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
