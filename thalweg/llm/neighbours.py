"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Largest inner product is smallest distance once each vector has one more
coordinate that brings all to the same length; the graph is built for that
distance.  Only products of the vectors as given are reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

NEAREST = 20
#: Out-edges of a node, breadth of the searches that propose them, breadth of a query's search, nodes opened at a time.
DEGREE, BUILD_BREADTH, BREADTH, OPENED = 32, 64, 96, 4
#: An edge is left out if a nearer neighbour is this much nearer to its end.
RELAXED = 1.2
#: Vectors of a shard: the least, and the most, and the bytes that a task holds of one, whichever is less.
SHARD_LEAST, SHARD_MOST, SHARD_BYTES = 4096, 262_144, 128 << 20
_FAR = np.float32(np.inf)


class Graph:
    """Edges between the rows of ``x``; row ``enter`` is where searches begin."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, enter: int | None = None):
        x = x.astype(np.float32)
        most = float((x * x).sum(1).max()) if len(x) else 0.0
        extra = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
        self.x = np.c_[x, extra].astype(np.float32)
        self.norm = (self.x * self.x).sum(1)
        mean = self.x.mean(0) if len(x) else np.zeros(self.x.shape[1], np.float32)
        self.enter = int(np.argmin(self.norm - 2 * self.x @ mean)) if enter is None and len(x) else enter
        self.edges = self._built() if edges is None else edges

    def _built(self) -> np.ndarray:
        n, rng = len(self.x), np.random.default_rng(7)
        edges = np.full((n, DEGREE), -1, np.int32)
        few = min(DEGREE // 2, n - 1)
        if few > 0:
            edges[:, :few] = (np.arange(n)[:, None] + rng.integers(1, n, (n, few))) % n
        self.edges = edges
        for relaxed in (1.0, RELAXED):
            for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
                found = self.search(self.x[batch], BUILD_BREADTH)[0]
                edges[batch] = self.pruned(batch, np.c_[found, edges[batch]], relaxed)
                self._answer(batch, relaxed)
        return edges

    def _answer(self, batch: np.ndarray, relaxed: float) -> None:
        """Let the new neighbours point back; those with too many edges are pruned."""
        ends = self.edges[batch].ravel()
        starts = np.repeat(batch, DEGREE)[ends >= 0]
        ends = ends[ends >= 0]
        order = np.argsort(ends, kind="stable")
        ends, starts = ends[order], starts[order]
        node, first, count = np.unique(ends, return_index=True, return_counts=True)
        for some in np.array_split(np.arange(len(node)), max(1, len(node) * int(count.max(initial=1)) // 20_000)):
            wide = int(count[some].max(initial=0))
            at = first[some][:, None] + np.arange(wide)
            more = np.where(np.arange(wide) < count[some][:, None], starts[np.minimum(at, len(starts) - 1)], -1)
            both = np.c_[self.edges[node[some]], more]
            full = (both >= 0).sum(1) > DEGREE
            if full.any():
                self.edges[node[some][full]] = self.pruned(node[some][full], both[full], relaxed)
            rest = both[~full]
            self.edges[node[some][~full]] = np.take_along_axis(rest, np.argsort(rest < 0, axis=1, kind="stable"), 1)[:, :DEGREE]

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distance less the query's own part, infinite where an id is missing."""
        d = self.norm[ids] - 2 * np.einsum("bcd,bd->bc", self.x[ids], q)
        return np.where(ids < 0, _FAR, d)

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray, relaxed: float) -> np.ndarray:
        """Robust pruning, a batch of nodes at a time: near and diverse out-edges."""
        candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        for start in range(0, len(nodes), 128):
            p, c = nodes[start : start + 128], candidates[start : start + 128]
            own = self.distances(self.x[p], c) + self.norm[p][:, None]
            order = np.argsort(own, axis=1, kind="stable")
            c, own = np.take_along_axis(c, order, 1), np.take_along_axis(own, order, 1)
            x = self.x[c]
            between = self.norm[c][:, :, None] + self.norm[c][:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
            alive, row = c >= 0, np.arange(len(p))
            for slot in range(DEGREE):
                best = alive.argmax(1)
                some = alive[row, best]
                if not some.any():
                    break
                out[start + row[some], slot] = c[row[some], best[some]]
                alive &= relaxed * relaxed * between[row, best] > own
                alive[row, best] = False
        return out

    def search(self, queries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search, a batch of queries at a time: ids and distances, nearest first, -1 where there are no more."""
        b, n = len(queries), len(self.x)
        ids = np.full((b, breadth), -1, np.int32)
        dist = np.full((b, breadth), _FAR, np.float32)
        ids[:, 0] = self.enter
        dist[:, 0] = self.distances(queries, ids[:, :1])[:, 0]
        open_ = ids >= 0
        seen = np.zeros((b, n + 1), bool)  # the last column stands for missing ids
        seen[:, self.enter] = seen[:, n] = True
        row = np.arange(b)[:, None]
        while open_.any():
            nearest = np.argsort(~open_, axis=1, kind="stable")[:, :OPENED]
            expand = np.where(np.take_along_axis(open_, nearest, 1), np.take_along_axis(ids, nearest, 1), -1)
            np.put_along_axis(open_, nearest, False, 1)
            new = np.where(expand[:, :, None] >= 0, self.edges[expand], -1).reshape(b, -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[row, new]] = -1
            seen[row, new] = True
            d = self.distances(queries, new)
            ids, dist, open_ = np.c_[ids, new], np.c_[dist, d], np.c_[open_, new >= 0]
            order = np.argsort(dist, axis=1, kind="stable")[:, :breadth]
            ids, dist, open_ = (np.take_along_axis(z, order, 1) for z in (ids, dist, open_))
        return ids, dist


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


#: Rows of the index, ``kind`` 0, and of the queries that stream past it, ``kind`` 1 with their own id alone.
ROW = "shard long, kind int, node int, enter int, ids array<long>, vector array<{0}>, edges array<int>"


def _index_shard(table: pa.Table) -> pa.Table:
    """One shard's graph.  Equal vectors are one node with their smallest ids, as many as a result can hold."""
    x = _matrix(table.column("vector"))
    ids = table.column("vec_id").to_numpy()
    rows, which = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    first = np.searchsorted(which.ravel()[order], np.arange(len(rows) + 1))
    names = [ids[order[a : min(b, a + NEAREST + 1)]].tolist() for a, b in zip(first, first[1:])]
    graph = Graph(rows)
    return pa.table(
        {
            "shard": pa.array([table.column("shard")[0].as_py()] * len(rows), pa.int64()),
            "kind": pa.array(np.zeros(len(rows), np.int32)),
            "node": pa.array(np.arange(len(rows), dtype=np.int32)),
            "enter": pa.array(np.full(len(rows), graph.enter, np.int32)),
            "ids": pa.array(names, pa.list_(pa.int64())),
            "vector": pa.array(list(rows), table.schema.field("vector").type),
            "edges": pa.array(list(graph.edges), pa.list_(pa.int32())),
        }
    )


FOUND = "query_id long, vec_id long, score double"


class _Shard:
    """One shard's index, as it is searched."""

    def __init__(self, nodes: pa.Table):
        nodes = nodes.sort_by("node")
        x = _matrix(nodes.column("vector"))
        self.graph = Graph(x, _matrix(nodes.column("edges")).astype(np.int32), nodes.column("enter")[0].as_py())
        self.names, self.x = nodes.column("ids").to_pylist(), x.astype(np.float64)

    def nearest(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The nearest of the shard to each query, measured exactly on the vectors as given."""
        asked = queries.column("ids").flatten().to_pylist()
        q = _matrix(pa.chunked_array([queries.column("vector")])).astype(np.float64)
        wide = np.c_[q, np.zeros(len(q))].astype(np.float32)
        for start in range(0, len(q), 256):
            out: tuple[list, list, list] = ([], [], [])
            for i, row in enumerate(self.graph.search(wide[start : start + 256], BREADTH)[0], start):
                row = row[row >= 0]
                score = self.x[row] @ q[i]
                near = [(-s, v) for s, r in zip(score.tolist(), row.tolist()) for v in self.names[r] if v != asked[i]]
                for s, v in sorted(near)[:NEAREST]:
                    out[0].append(asked[i])
                    out[1].append(v)
                    out[2].append(-s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, each shard's index before its queries: one index is held while the queries stream past it."""
    shard, held, index = None, [], None
    for batch in batches:
        keys = batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, stop in pairwise(cuts):
            if start == stop:
                continue
            part, number, kind = batch.slice(start, stop - start), *divmod(int(keys[start]), 2)
            if number != shard:
                shard, held, index = number, [], None
            if kind == 0:
                held.append(part)
                continue
            if index is None and held:
                index, held = _Shard(pa.Table.from_batches(held)), []
            if index is not None:
                yield from index.nearest(part)


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that can take part, one for each id.

    Left out are null ids and vectors that are null, empty, zero, or hold a
    null or a component that is not finite.  Of rows with one id the smallest
    vector stays.
    """
    element = embeddings.schema["embedding"].dataType.elementType
    kept = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("vector"))
    good = given.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return good.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """The 20 nearest found for each row whose id is divisible by ``every``, by inner product, with ranks from 1.

    Candidates are all other rows, all of them indexed; fewer than 20 give
    fewer results.  Ties go to the smaller id; equal vectors are all found.
    Only vectors of one length are compared, in the type they are given in.  An
    empty table gives no rows.  Ids decide the shards, which are bounded by
    bytes; rows that cannot take part are named at ``usable``.  Only id and
    vector are read, whatever other columns are called.
    """
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings).withColumn("size", F.size("vector")), "vectors")
    count, width = rows.agg(F.count(F.lit(1)), F.max("size")).first()
    # held of a vector: as given, as doubles, as searched, and its edges
    held = 20 * (width or 1) + 8 * DEGREE
    per_shard = int(min(SHARD_MOST, max(SHARD_LEAST, 16 * math.sqrt(count)), max(1, SHARD_BYTES // held)))
    shards = max(1, math.ceil(count / per_shard))
    # one key for length and shard, so that a shard holds vectors of one length
    lowest = F.col("size").cast("long") * shards
    key = lowest + F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    schema = ROW.format(rows.schema["vector"].dataType.elementType.simpleString())
    index = stored(rows.select("vec_id", "vector", key.alias("shard")).groupBy("shard").applyInArrow(_index_shard, schema), "graph")
    # every query meets every shard of its length, whose index is shuffled once and stays while queries stream past
    asked = rows.where(F.col("vec_id") % every == 0)
    given = {"shard": F.explode(F.sequence(lowest, lowest + shards - 1)), "kind": F.lit(1), "node": F.lit(None), "enter": F.lit(None),
             "ids": F.array("vec_id"), "vector": F.col("vector"), "edges": F.lit(None)}
    queries = asked.select(*[given[f.name].cast(f.dataType).alias(f.name) if f.name != "shard" else given["shard"].alias("shard") for f in index.schema])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = index.unionByName(queries).repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search_shards, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")
