"""Geopackage layers as a Spark data source.

A geopackage is an SQLite file.  On mounted file systems each file is split by
row id into pieces of about ``split_bytes``, so one very large file is read by
many tasks.  On object stores or HDFS a file is one piece, which its task copies
to its own disk once: no bytes are fetched twice.

Comparisons and bounding boxes become SQL of the file's own engine, so rows that
don't count are never decoded; a box goes by the layer's R-tree where it has one.
"""

from __future__ import annotations

from typing import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ..functions.wkb import strip_gp_header
from ..session import stored
from .paths import listed_files, located, root_of

#: The setting by which Spark hands filters to data sources written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SPLIT_BYTES = 128 * 1024 * 1024


def _spark_type(declared: str) -> DataType:
    kind = (declared or "").upper().split("(")[0].strip()
    if kind == "BOOLEAN":
        return BooleanType()
    if kind in ("INTEGER", "INT", "MEDIUMINT", "SMALLINT", "TINYINT", "BIGINT"):
        return LongType()
    if kind in ("REAL", "DOUBLE", "FLOAT"):
        return DoubleType()
    if kind in ("TEXT", "DATE", "DATETIME", "VARCHAR"):
        return StringType()
    return BinaryType()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _opened:
    """A read-only connection to a geopackage on any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __enter__(self):
        import shutil
        import sqlite3
        import tempfile

        from pyarrow import fs

        system, inner = located(self.path)
        self.copy = None
        if not isinstance(system, fs.LocalFileSystem):
            self.copy = tempfile.NamedTemporaryFile(suffix=".gpkg")
            with system.open_input_stream(inner) as source:
                shutil.copyfileobj(source, self.copy)
            self.copy.flush()
            inner = self.copy.name
        self.connection = sqlite3.connect(f"file:{inner.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)
        return self.connection

    def __exit__(self, *_):
        self.connection.close()
        if self.copy is not None:
            self.copy.close()


class _Piece(InputPartition):
    def __init__(self, path: str, index: int, pieces: int) -> None:
        self.path = path
        self.index = index
        self.pieces = pieces


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _condition(f: Filter, schema: StructType) -> tuple[str, str, list] | None:
    """Column, SQL and values of a filter that the file's engine judges as Spark does; none for others.

    Only whole numbers, fractions and texts are compared: both order them
    alike, texts by code points.
    """
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in schema.names or name == "source_path":
        return None
    kind = schema[name].dataType
    if isinstance(f, IsNotNull):
        return name, f"{_quoted(name)} IS NOT NULL", []
    if isinstance(f, IsNull) and not isinstance(kind, BinaryType):  # an empty geometry is read as null
        return name, f"{_quoted(name)} IS NULL", []
    values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in _SIGNS else []
    plain = {LongType: int, DoubleType: float, StringType: str}.get(type(kind))
    if not values or plain is None or not all(type(v) is plain and v == v for v in values) or len(values) > 500:
        return None
    if plain is int and any(abs(v) >= 2**63 for v in values):
        return None
    if isinstance(f, In):
        return name, f"{_quoted(name)} IN ({', '.join('?' * len(values))})", values
    return name, f"{_quoted(name)} {_SIGNS[type(f)]} ?", values


def _box_condition(connection, layer: str, box: tuple[float, float, float, float] | None) -> tuple[str, list]:
    """SQL for the rows whose box may meet ``box``: by the layer's R-tree, if it has one."""
    if box is None:
        return "", []
    found = connection.execute("SELECT name FROM sqlite_master WHERE lower(name) LIKE ? ESCAPE '!'", (f"rtree!_{layer.lower().replace('_', '!_')}!_%",)).fetchall()
    trees = [name for (name,) in found if not name.endswith(("_node", "_rowid", "_parent"))]
    if not trees:
        return "", []
    x0, y0, x1, y1 = box
    return f" AND rowid IN (SELECT id FROM {_quoted(trees[0])} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)", [x0, x1, y0, y1]


class _LayerReader(DataSourceReader):
    def __init__(self, files: Sequence[tuple[str, int]], layer: str, schema: StructType, split: int, missing: str, box: tuple | None):
        self.files = files
        self.layer = layer
        self.schema = schema
        self.split = split
        self.missing = missing
        self.box = box
        self.conditions: list[tuple[str, str, list]] = []

    def partitions(self) -> list[InputPartition]:
        return [
            _Piece(path, i, pieces)
            for path, size in self.files
            for pieces in [max(1, -(-size // self.split)) if path.startswith("file:") else 1]
            for i in range(pieces)
        ]

    def read(self, piece: _Piece) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        table = _quoted(self.layer)
        with _opened(piece.path) as connection:
            declared = {row[1]: row[2] for row in connection.execute(f"PRAGMA table_info({table})")}
            if not declared:
                if self.missing == "skip":
                    return
                raise ValueError(f"no layer {self.layer!r} in {piece.path}")
            names = [n for n in self.schema.names if n in declared]
            columns = ", ".join(_quoted(n) for n in names) or "1"
            low, high = connection.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            if low is None:
                return
            step = -(-(high - low + 1) // piece.pieces)
            first = low + piece.index * step
            where, values = _box_condition(connection, self.layer, self.box)
            for name, sql, given in self.conditions:
                if name in declared:
                    where, values = f"{where} AND {sql}", values + given
                elif not sql.endswith("IS NULL"):
                    return  # a column that this file lacks is null in all its rows
            cursor = connection.execute(
                f"SELECT {columns} FROM {table} WHERE rowid >= ? AND rowid < ?{where}", (first, first + step, *values)
            )
            while rows := cursor.fetchmany(4096):
                values = dict(zip(names, zip(*rows))) if names else {}
                arrays = []
                for field in arrow:
                    column = values.get(field.name)
                    if field.name == "source_path":
                        column = [piece.path] * len(rows)
                    elif column is None:
                        column = [None] * len(rows)
                    elif pa.types.is_binary(field.type):
                        column = [strip_gp_header(v) for v in column]
                    elif pa.types.is_boolean(field.type):
                        column = [None if v is None else bool(v) for v in column]
                    arrays.append(pa.array(column, type=field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


class _PushingReader(_LayerReader):
    """Takes the comparisons that the file's engine can judge; Spark judges them again, so types that differ do no harm."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            condition = _condition(f, self.schema)
            if condition is not None:
                self.conditions.append(condition)
            yield f


class GeopackageSource(DataSource):
    """``format("geopackage").option("layer", ...).load(path)``: the files right under a folder, or one file.

    ``read_gpkg_layer`` hands over a listing of files at any depth.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _files(self) -> list[tuple[str, int]]:
        """Files and sizes, from the listing that ``read_gpkg_layer`` has stored, or of one folder's own files."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        listing = self.options.get("listing")
        if listing:
            system, inner = located(root_of(listing)[0])
            table = pq.read_table(inner, filesystem=system, columns=["path", "length"])
            return sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
        uri, prefix = root_of(self.options["path"])
        system, inner = located(uri)
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
        prefix = "file://" if prefix == "file:" else prefix
        return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".gpkg"))

    def schema(self) -> StructType:
        return _united([_fields(path, self.options["layer"]) for path, _ in self._files()], self.options["layer"], self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:
        box = self.options.get("box")
        kind = _PushingReader if self.options.get("pushdown") == "true" else _LayerReader
        return kind(
            self._files(),
            self.options["layer"],
            schema,
            int(self.options.get("split_bytes", SPLIT_BYTES)),
            self.options.get("missing_layer", "error"),
            tuple(map(float, box.split(","))) if box else None,
        )


def _fields(path: str, layer: str) -> list[tuple[str, str]]:
    """A file's columns of the layer with their declared types, none if it lacks the layer."""
    with _opened(path) as connection:
        return [(row[1], row[2]) for row in connection.execute(f"PRAGMA table_info({_quoted(layer)})")]


def _united(files: Sequence[Sequence[tuple[str, str]]], layer: str, path: str) -> StructType:
    """All files' columns in the order of their first use; a column of unlike types is refused."""
    kinds: dict[str, DataType] = {}
    for fields in files:
        for name, declared in fields:
            kind = _spark_type(declared)
            if kinds.setdefault(name, kind) != kind:
                raise ValueError(f"column {name!r} of layer {layer!r} is {kinds[name].simpleString()} in one file and {kind.simpleString()} in another")
    if not kinds:
        raise ValueError(f"no geopackage with layer {layer!r} under {path}")
    return StructType([*(StructField(n, k) for n, k in kinds.items()), StructField("source_path", StringType())])


def layer_schema(files: DataFrame, layer: str, path: str) -> StructType:
    """The union of the files' schemas: each file is opened by a task, distinct columns come back."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [(at, *field) for p in batch.column("path").to_pylist() for at, field in enumerate(_fields(p, layer))]
            names, types = ("at", "name", "declared"), (pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names)

    seen = files.select("path").mapInArrow(run, "at int, name string, declared string").groupBy("name", "declared").agg(F.min("at").alias("at"))
    rows = sorted((r["at"], r["name"], r["declared"]) for r in seen.collect())
    return _united([[(name, declared) for _, name, declared in rows]], layer, path)


def read_gpkg_layer(
    spark: SparkSession,
    path: str,
    layer: str,
    schema: StructType | str | None = None,
    missing_layer: str = "error",
    split_bytes: int = SPLIT_BYTES,
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Rows of a layer of every geopackage under ``path``, with the file in ``source_path``.

    Geometry arrives as plain WKB.  Without a schema, that of all files holding
    the layer is used; columns that a file lacks are null there, and a column
    that files declare with unlike types is an error.  ``missing_layer`` is
    ``error`` or ``skip``.  Folders are listed, and schemas read, by tasks.

    Filters on the result reach the files where ``PUSHDOWN`` is set in the
    session.  ``box`` (min x, min y, max x, max y) leaves out rows that can't
    meet it, in files whose layer has an R-tree; others are read whole.
    """
    spark.dataSource.register(GeopackageSource)
    # names as tasks open them: a scheme and two slashes
    name = F.regexp_replace("path", "^file:/+", "file:///")
    files = stored(listed_files(spark, path, "*.gpkg").select(name.alias("path"), "length"), "listing")
    reader = (
        spark.read.format("geopackage")
        .option("layer", layer)
        .option("missing_layer", missing_layer)
        .option("split_bytes", str(split_bytes))
        .option("listing", files.inputFiles()[0].rsplit("/", 1)[0] if files.inputFiles() else "")
        .option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    )
    if box is not None:
        reader = reader.option("box", ",".join(map(repr, map(float, box))))
    return reader.schema(layer_schema(files, layer, path) if schema is None else schema).load(path)


def with_project(layer: DataFrame, root: str) -> DataFrame:
    """Tag layer rows with the project folder that their file lies in."""
    from .readings import project_of

    return layer.withColumn("project", project_of(layer.sparkSession, root, F.col("source_path"))).drop("source_path")
