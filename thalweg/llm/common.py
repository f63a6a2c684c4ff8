"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Texts that a Python function takes at once, in bytes and in rows; a longer text comes alone.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 2048


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds few megabytes of text, or one long text."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = int(np.searchsorted(sizes, done + SLICE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(
    docs: DataFrame,
    function: Callable[[list[str]], dict[str, list]],
    schema: T.StructType,
    keep: tuple[str, ...] = ("doc_id",),
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Add columns that ``function`` makes from lists of texts.

    ``function(texts)``, or ``function(texts, state)`` with ``state = setup()``
    once per task, returns a list per field of ``schema``.  The result has the
    columns ``keep`` and those fields; texts go through Python once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = T.StructType([docs.schema[c] for c in keep] + list(schema.fields))
    arrow = to_arrow_schema(whole)
    names = [f.name for f in schema.fields]

    def run(batches):
        state = (setup(),) if setup else ()
        for part in slices(batches):
            made = function(part.column("text").to_pylist(), *state)
            columns = [part.column(c) for c in keep] + [made[c] for c in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c).cast(f.type) for c, f in zip(columns, arrow)],
                schema=arrow,
            )

    return docs.mapInArrow(run, whole)
