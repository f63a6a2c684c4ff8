"""Project manifests: XML documents that list datasets, layers, metadata and QA events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# The dataset tags of the manifest schema, and the reference tag.
DATASET_TAGS = (
    "AuxInstrumentFile",
    "CSV",
    "ConfigFile",
    "DEM",
    "DataTable",
    "Database",
    "File",
    "Geopackage",
    "HTMLFile",
    "HillShade",
    "Image",
    "InstrumentFile",
    "LogFile",
    "MSAccessDB",
    "PDF",
    "Raster",
    "SQLiteDB",
    "SurveyQualityDB",
    "TIN",
    "Vector",
    "Video",
    "ZipFile",
)
REFERENCE_TAG = "CommonDatasetRef"
LAYER_TAGS = ("Raster", "Vector", "DataTable")


def _struct(fields: dict[str, str]) -> str:
    return "STRUCT<" + ", ".join(f"`{name}`: {kind}" for name, kind in fields.items()) + ">"


def _texts(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "STRING")


_HEADS = _texts("Name", "Summary", "Description", "Citation")
META_ITEM = _struct(_texts("_VALUE", "_name", "_type", "_ext", "_locked"))
_META = {"MetaData": _struct({"Meta": f"ARRAY<{META_ITEM}>"})}
REALIZATION_CONTAINERS = ("Logs", "Datasets", "Inputs", "Intermediates", "Outputs")
ANALYSIS_CONTAINERS = ("Configuration", "Products")


def layers_type(meta: bool) -> str:
    layer = _struct({**_texts("_lyrName", "_type", "_extRef"), **_HEADS, **(_META if meta else {})})
    return _struct({tag: f"ARRAY<{layer}>" for tag in LAYER_TAGS})


def _doubles(*names: str) -> str:
    return _struct(dict.fromkeys(names, "DOUBLE"))


def project_schema(
    datasets: bool = True, layers: bool = True, meta: bool = True, bounds: bool = True, events: bool = True
) -> DataType:
    """Type of a manifest, or of the parts of it that a caller needs.

    The parser's cost grows with the schema, so each operator asks for its own
    part; nothing prunes this for it.  Every dataset tag is an array: a lone
    child and many children then parse alike.
    """
    extra = _META if meta else {}
    own = {**_HEADS, **extra}
    dataset = {**_texts("_id", "_type", "_extRef", "Path", "URL"), **own}

    def container() -> str:
        tags = {tag: f"ARRAY<{_struct(dataset)}>" for tag in DATASET_TAGS}
        if layers:
            tags["Geopackage"] = f"ARRAY<{_struct({**dataset, 'Layers': layers_type(meta)})}>"
        tags[REFERENCE_TAG] = f"ARRAY<{_struct(_texts('_ref'))}>"
        return _struct(tags)

    def containers(names: tuple[str, ...]) -> dict[str, str]:
        return dict.fromkeys(names, container()) if datasets else {}

    analysis = {**_texts("_id"), **own, **containers(ANALYSIS_CONTAINERS)}
    if meta:
        analysis["Metrics"] = _struct({"Metric": f"ARRAY<{META_ITEM}>"})
    realization = {
        **_texts("_id", "_dateCreated", "_productVersion"),
        **own,
        **containers(REALIZATION_CONTAINERS),
        "Analyses": _struct({"Analysis": f"ARRAY<{_struct(analysis)}>"}),
    }
    project = {
        **own,
        "ProjectType": "STRING",
        "Warehouse": _struct(_texts("_id", "_apiUrl")),
        **containers(("CommonDatasets",)),
        "Realizations": _struct({"Realization": f"ARRAY<{_struct(realization)}>"}),
    }
    if bounds:
        project["ProjectBounds"] = _struct(
            {
                "Centroid": _doubles("Lat", "Lng"),
                "BoundingBox": _doubles("MinLat", "MinLng", "MaxLat", "MaxLng"),
                "Path": "STRING",
            }
        )
    if events:
        links = _struct({"URL": f"ARRAY<{_struct(_texts('_VALUE', '_text'))}>"})
        event = {**_texts("_datePerformed", "_state", "PerformedBy"), **own, "Links": links}
        project["QAQCEvents"] = _struct({"QAQCEvent": f"ARRAY<{_struct(event)}>"})
    return DataType.fromDDL(_struct(project))


#: Field of a parsed manifest that holds the text of a document which is not well-formed.
UNREADABLE = "_unreadable"


def parse_project_xml(df: DataFrame, column: Column | str = "xml", **parts: bool) -> DataFrame:
    """Add ``project``, the typed content of a column of manifest text (see ``project_schema``).

    A broken document has its text in ``project._unreadable`` and nothing else
    that can be relied on; ``manifest.xml_audit`` reports it.
    """
    text = F.col(column) if isinstance(column, str) else column
    schema = project_schema(**parts).add(UNREADABLE, "string")
    return df.withColumn("project", F.from_xml(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}))


def read_project_xml(spark: SparkSession, path: str, pattern: str = "*.rs.xml") -> DataFrame:
    """Manifests under a folder, one row per file: ``project_id, xml, project``.

    The file's path identifies the project.  The typed ``project`` is computed
    only where it is used; the manifest operators parse what they need from ``xml``.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
    )
    return parse_project_xml(files.select(F.col("_metadata.file_path").alias("project_id"), F.col("value").alias("xml")))
