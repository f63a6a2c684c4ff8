"""Token counts that follow edits: only what an edit touches is encoded again.

Every document has a segment tree.  Its leaves are stretches of whole
pre-tokens, its nodes sum the characters and tokens below.  An edit finds its
leaves by the character sums, encodes the text between them anew until the
pre-tokens fall on an old boundary again, and updates the sums on the way up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import coder_factory
from .common import map_texts, slices, whole_text

#: Pre-tokens of a leaf when a tree is made.
LEAF = 16
#: How far behind its end the rules for a pre-token look, in characters.
LOOK = 2


@dataclass
class Work:
    """What an operation has encoded."""

    pretokens: int = 0


class Tree:
    """Sums of characters and tokens over leaves, in heap order: node ``i`` has children ``2 i`` and ``2 i + 1``."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        leaves = max(len(chars), 1)
        self.first = 1 << (leaves - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.first), np.int64)
        self.sums[0, self.first : self.first + len(chars)] = chars
        self.sums[1, self.first : self.first + len(tokens)] = tokens
        low = self.first
        while low > 1:
            self.sums[:, low // 2 : low] = self.sums[:, low : 2 * low].reshape(2, -1, 2).sum(2)
            low //= 2
        self.leaves = len(chars)

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins; the last one for the text's end."""
        node, start = 1, 0
        while node < self.first:
            node *= 2
            left = int(self.sums[0, node])
            if place >= start + left and self.sums[0, node + 1]:
                start += left
                node += 1
        return node - self.first, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.first + leaf
        change = (chars - self.sums[0, node], tokens - self.sums[1, node])
        while node:
            self.sums[0, node] += change[0]
            self.sums[1, node] += change[1]
            node //= 2


def measure(text: str, coder, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf of a new tree."""
    words = coder.splitter.pattern(text).findall(text)
    if work:
        work.pretokens += len(words)
    starts = np.arange(0, len(words), LEAF)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.fromiter(map(len, words), np.int64, len(words))
    tokens = np.fromiter(map(len, map(coder.known.__getitem__, words)), np.int64, len(words))
    return np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)


def edit(text: str, tree: Tree, start: int, stop: int, new: str, coder, work: Work) -> str:
    """Replace ``text[start:stop]`` and bring the tree up to date; returns the new text.

    Places beyond the text mean its end.  Pre-tokens that end more than
    ``LOOK`` characters before the edit cannot change, so encoding begins at
    the leaf of the first other one; the leaves that were encoded anew leave
    their sums to the first of them.
    """
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    after = text[:start] + new + text[stop:]
    if not tree.leaves:
        fresh = Tree(*measure(after, coder, work))
        tree.__dict__.update(fresh.__dict__)
        return after
    first, begin = tree.leaf_at(max(start - LOOK - 1, 0))
    last, last_begin = tree.leaf_at(stop)
    # old boundaries at which a pre-token may begin again, by their place in the new text
    shift = len(new) - (stop - start)
    edge = last_begin + int(tree.sums[0, tree.first + last])
    at = begin
    tokens = 0
    pattern = coder.splitter.pattern(after)
    done = len(after)
    for match in pattern.finditer(after, begin):
        at = match.end()
        tokens += len(coder.known[match[0]])
        work.pretokens += 1
        while edge + shift < at and last + 1 < tree.leaves:
            last += 1
            edge += int(tree.sums[0, tree.first + last])
        if at == edge + shift and at >= start + len(new):
            done = at
            break
    else:
        last = tree.leaves - 1
    for leaf in range(first + 1, last + 1):
        tree.put(leaf, 0, 0)
    tree.put(first, done - begin, tokens)
    return after


INDEX = T.StructType([T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType()))])


def indexed(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Add the leaves of each text's tree, ``leaf_chars`` and ``leaf_tokens``; inner sums follow from them.

    Special tokens' strings count as ordinary text.  A null text has no leaves.
    """

    def function(texts, coder):
        made = [measure(t or "", coder) for t in texts]
        return {"leaf_chars": [c.tolist() for c, _ in made], "leaf_tokens": [t.tolist() for _, t in made]}

    return map_texts(docs, function, INDEX, keep, coder_factory(docs, vocabulary))


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_edits", T.LongType()),
        T.StructField("n_tokens_edited", T.LongType()),
        T.StructField("n_chars_edited", T.LongType()),
        T.StructField("reencoded_pretokens", T.LongType()),
    ]
)


def _recounted(docs: DataFrame, vocabulary: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, setup = to_arrow_schema(EDITED), coder_factory(docs, vocabulary)
    stored_trees = "leaf_chars" in docs.columns

    def run(batches):
        coder = setup()
        for part in slices(batches):
            out = []
            ids, texts, edits = (part.column(c).to_pylist() for c in ("doc_id", "text", "edits"))
            trees = zip(*(part.column(c).to_pylist() for c in ("leaf_chars", "leaf_tokens"))) if stored_trees else (measure(t or "", coder) for t in texts)
            for doc_id, text, changes, leaves in zip(ids, texts, edits, trees):
                text, tree, work = text or "", Tree(*(np.asarray(x if x is not None else [], np.int64) for x in leaves)), Work()
                before = tree.tokens
                for e in changes or []:
                    text = edit(text, tree, e["start"] or 0, e["stop"] or 0, e["text"] or "", coder, work)
                out.append((doc_id, before, len(changes or []), tree.tokens, tree.chars, work.pretokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.mapInArrow(run, EDITED)


def recounted(index: DataFrame, vocabulary: str) -> DataFrame:
    """Counts before and after the edits of each row of a stored index.

    ``edits`` is an array of ``start``, ``stop`` and ``text``, applied one after
    the other, each to the text that the ones before have left.
    """
    return _recounted(index.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits"), vocabulary)


def review_edits(size, key):
    """Edits as a reviewer might make them, placed by the document's id: a cut, an insertion, a correction, a note at the end."""
    place = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), size + 1).cast("int")
    one = lambda start, length, text: F.struct(start.alias("start"), (start + length).alias("stop"), F.lit(text).alias("text"))
    return F.array(
        one(place(1), 12, ""), one(place(2), 0, " [sic]"), one(place(3), 5, "naïve café’s 2024"), one(size.cast("int"), 0, "\n-- reviewed")
    )


def edited_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Every document's token count, and its count after a reviewer's four edits, found by its tree.

    Null texts count as empty; repeated rows and null ids are kept and edited
    alike; an empty table gives no rows.  Only id and text are read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    edits = review_edits(F.char_length("text"), F.coalesce("doc_id", F.lit(-1)))
    # trees are made and edited in one pass over the texts
    return _recounted(plain.withColumn("edits", edits), vocabulary)
