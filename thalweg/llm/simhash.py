"""Near duplicates by SimHash and a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import ids_and_texts, map_texts, unused
from .components import components
from .sharding import slotted

WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Most fingerprints that one task holds at a time; larger groups are divided.
GROUP = 4096
#: Children of a node of the index.
FAN = 8


def fingerprint(text: str, words: int = WORDS) -> int:
    """The text's fingerprint as an unsigned number; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks divide
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long), one row per document."""

    def function(texts):
        return {"fp": [signed(fingerprint(t)) for t in texts]}

    return map_texts(ids_and_texts(docs), function, T.StructType([T.StructField("fp", T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in Gray order, in which neighbours differ in one bit."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """A forest over patterns sorted by group and Gray rank, one tree for each group.

    A node holds the bits on which all patterns below agree.  Bits that its
    parent holds already are masked out, so the difference to a query adds up
    on the way down and a node is left, with everything below it, as soon as
    the sum passes the limit.
    """

    def __init__(self, group: np.ndarray, pattern: np.ndarray):
        self.pattern, n = pattern, len(pattern)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
        sizes = np.diff(np.r_[first, n])
        self.tree = np.repeat(np.arange(len(first)), sizes)
        place = np.arange(n) - np.repeat(first, sizes)
        ones, zeros, tree = pattern, ~pattern, self.tree
        last = np.arange(n)
        self.levels = [{"agree": ones | zeros, "bits": ones, "last": last}]
        while len(tree) > len(first):
            place = place // FAN
            start = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (tree[1:] != tree[:-1])])
            count = np.diff(np.r_[start, len(tree)])
            ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_and.reduceat(zeros, start)
            below = self.levels[-1]
            agree = ones | zeros
            below["own"] = below["agree"] & ~np.repeat(agree, count)
            last = last[start + count - 1]
            self.levels.append({"agree": agree, "bits": ones, "start": start, "count": count, "last": last})
            tree, place = tree[start], place[start]
        self.sizes = sizes

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (query, later member of its tree) at no more than ``limit`` differing bits."""
        who, node, acc = queries, self.tree[queries], np.zeros(len(queries), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            above, below = self.levels[level], self.levels[level - 1]
            count = above["count"][node]
            ends = np.cumsum(count)
            child = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(above["start"][node], count)
            who, acc = np.repeat(who, count), np.repeat(acc, count)
            ahead = below["last"][child] > who
            who, acc, child = who[ahead], acc[ahead], child[ahead]
            acc = acc + np.bitwise_count((self.pattern[who] ^ below["bits"][child]) & below["own"][child])
            near = acc <= limit
            who, acc, node = who[near], acc[near], child[near]
        return who, node

    def stars(self, limit: int, cells: int = 1 << 20) -> np.ndarray:
        """For each pattern the first one it reaches over links within its tree."""
        label = np.arange(len(self.pattern))
        if len(self.levels) == 1:
            return label
        work = np.cumsum(np.repeat(self.sizes, self.sizes))
        start = 0
        while start < len(label):
            stop = int(np.searchsorted(work, (work[start - 1] if start else 0) + cells, side="right"))
            stop = max(stop, start + 1)
            join(label, *self.search(np.arange(start, stop), limit))
            start = stop
        return label


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of ``a`` and ``b``; ``label`` names each class by its first member."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _tree_links(batches, limit):
    """Links of each node of the upper index; rows come sorted by node, and a node may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def made(node, bits):
        order = np.lexsort((gray_rank(bits), node))
        node, bits = node[order], bits[order]
        label = GrayIndex(node, bits).stars(limit)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(bits[linked].view(np.int64)), pa.array(bits[label[linked]].view(np.int64))], schema=schema)

    for batch in batches:
        node = batch.column("node").to_numpy(zero_copy_only=False)
        bits = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, (node, bits))] if held else [node, bits]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if whole:
            yield made(held[0][:whole], held[1][:whole])
            held = [x[whole:] for x in held]
    if held and len(held[0]):
        yield made(*held)


def _cut(rows: DataFrame, width: int, step: int) -> DataFrame:
    """The next level of upper nodes: four masks of a quarter of the open bits each.

    A pair within 3 bits agrees on at least one quarter, so in one of the four
    its accumulated difference at this node is none, and both go there.
    """
    quarter = width // 4
    choices = []
    for t in range(4):
        low = width - quarter * (t + 1)
        part = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << quarter) - 1))
        above = F.lit(0).cast("long") if t == 0 else F.shiftleft(F.shiftrightunsigned("rest", width - quarter * t), low)
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1)))
        node = F.shiftleft("node", quarter + 2).bitwiseOR(F.lit(t << quarter)).bitwiseOR(part)
        choices.append(F.struct(node.alias("node"), rest.alias("rest")))
    return rows.select("fp", F.explode(F.array(*choices)).alias("at")).select("fp", "at.node", "at.rest")


def _large_node_links(rows: DataFrame, limit: int, group: int) -> DataFrame:
    """Links within nodes that stay large when all masks are used up: blocks in Gray order, pair by pair.

    A pair of blocks whose common agreed bits differ in more than ``limit``
    places is left as a whole; the others are searched, one pair in a task.
    """
    rank = F.col("rest")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    placed = slotted(rows.withColumn("rank", rank), "node", ["rank"])
    blocks = stored(placed.select("node", "fp", F.floor(F.col("slot") / (group // 2)).alias("block")), "blocks")
    masks = blocks.groupBy("node", "block").agg(F.expr("bit_and(fp)").alias("ones"), F.expr("bit_and(~fp)").alias("zeros"))
    other = masks.select("node", F.col("block").alias("block2"), F.col("ones").alias("ones2"), F.col("zeros").alias("zeros2"))
    apart = F.bit_count(F.expr("((ones ^ ones2) & (ones | zeros) & (ones2 | zeros2))"))
    pairs = masks.join(other, "node").where((F.col("block") <= F.col("block2")) & (apart <= limit)).select("node", "block", "block2")
    ends = pairs.select("node", F.explode(F.array_distinct(F.array("block", "block2"))).alias("at"), F.xxhash64("node", "block", "block2").alias("pair"))
    work = blocks.join(ends.withColumnRenamed("at", "block"), ["node", "block"]).select(F.col("pair").alias("node"), "fp")
    return _searched(work, limit)


def _searched(rows: DataFrame, limit: int) -> DataFrame:
    dealt = rows.select("node", "fp").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(lambda batches: _tree_links(batches, limit), "a long, b long")


def links(prints: DataFrame, limit: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` whose closure joins all pairs within ``limit`` bits.

    Each level of upper nodes masks a quarter of the bits that are left: 16,
    then 12, then 9.  Only nodes with more than ``group`` members go down
    another level, so a node's rows fit in a task whatever the corpus holds.
    A chain of links within a node stands for all its pairs.
    """
    if not 0 <= limit <= 3:
        raise ValueError("the masks guarantee links up to 3 differing bits")
    rows = prints.select("fp", F.lit(0).cast("long").alias("node"), F.col("fp").alias("rest"))
    found, width = None, 64
    for step in range(3):
        rows = _cut(rows, width, step)
        width -= width // 4
        counts = rows.groupBy("node").count()
        large = stored(counts.where(F.col("count") > group).select("node"), "nodes")
        small = rows
        many = large.count()
        if many:
            small = rows.join(large, "node", "left_anti")
        made = _searched(small, limit)
        found = made if found is None else found.unionByName(made)
        if not many:
            return found
        rows = stored(rows.join(large, "node", "left_semi"), "nodes")
    return found.unionByName(_large_node_links(rows, limit, group))


def _classes(prints: DataFrame, limit: int, group: int) -> DataFrame:
    """The class of every fingerprint ``fp``: the closure of links within ``limit`` bits."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(links(distinct, limit, group))
    return distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("class"))


def near_duplicates(docs: DataFrame, limit: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for every document.

    The component is named by its smallest id.  Null and empty texts have
    fingerprint zero and link like any other; texts of any length are read
    whole; repeated rows are kept; a row with a null id takes part and its
    component is named by the others, null where none has an id.  An empty
    table gives no rows.  Only id and text are read.
    """
    prints = stored(fingerprints(docs), "prints")
    rooted = _classes(prints, limit, group)
    named = rooted.groupBy("class").agg(F.min("least").alias("component_id"))
    members = rooted.select("fp", "class").join(named, "class").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(members, F.col("fp") == F.col("__fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, limit: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """The documents less near copies: of each component one row stays, the one with its smallest id.

    Rows are told apart by themselves, not by their ids: rows that share an id
    and differ in text beyond ``limit`` bits are different documents, and each
    stays or goes with its own component.  Of repeated rows, and of near copies
    under one id, one stays; a row with a null id stays only where its
    component has no numbered one.  Null and empty texts are copies of each
    other.  Columns stay as they are, whatever their names; an empty table
    gives no rows.
    """
    fp, bare, known = (unused(name, docs) for name in ("fp", "bare", "known"))

    def function(texts):
        return {fp: [signed(fingerprint(t or "")) for t in texts]}

    marked = map_texts(docs, function, T.StructType([T.StructField(fp, T.LongType())]), tuple(docs.columns))
    number = F.col("doc_id").cast("long")
    # keys without nulls, so that rows meet their like, and are told apart, by one dealing out of the texts
    keyed = marked.withColumns({bare: number.isNull(), known: F.coalesce(number, F.lit(0))})
    prints = keyed.select(number.alias("doc_id"), F.col(fp).alias("fp"), F.col(bare).alias("bare"), F.col(known).alias("known"))
    prints = stored(prints, "prints")
    # copies are reduced to one key before they meet their class, so a large group stays small
    least = prints.groupBy("fp").agg(F.min(F.struct("bare", "known", "fp")).alias("first"))
    classes = _classes(prints, limit, group).select(F.col("fp").alias("member"), "class")
    kept = least.join(classes, F.col("fp") == F.col("member")).groupBy("class").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.fp").alias(fp), F.col("first.bare").alias(bare), F.col("first.known").alias(known))
    keys = [fp, bare, known]
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
