"""Apply a user function to each project, in parallel, without letting one failure stop the rest."""

from __future__ import annotations

from typing import Any, Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType


def batch_projects(
    projects: DataFrame,
    function: Callable[[dict[str, Any]], dict[str, Any]],
    output: StructType,
    key: str = "project_id",
    slots: int | None = None,
) -> DataFrame:
    """Result columns of ``function`` for each row, plus ``error``.

    The function gets the row as a dict of plain Python values, null being
    None, and returns a dict of output columns.  Where it raises, or returns
    what does not fit the output columns, those are null and ``error`` holds
    the message.  ``slots`` is how many rows are worked on at a time at most,
    spread evenly; by default the input's partitions decide.
    """
    names = [field.name for field in output.fields]
    schema = StructType([projects.schema[key], *output.fields, StructField("error", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in arrow]
            for record in batch.to_pylist():
                try:
                    result = function(record)
                    row = [pa.scalar(result.get(n), arrow.field(n).type).as_py() for n in names]
                    error = None
                except Exception as problem:  # noqa: BLE001 - any failure belongs to its row
                    row, error = [None] * len(names), f"{type(problem).__name__}: {problem}"
                for column, value in zip(columns, [record[key], *row, error]):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    spread = projects if slots is None else projects.repartition(slots)
    return spread.mapInArrow(run, schema)
