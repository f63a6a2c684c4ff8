"""Flatten, check and compare project manifests.

Every operator takes documents (``project_id`` and the text in ``xml``), walks
each once and reads only the kinds of nodes that it needs; or it takes a store
of nodes (``sources.manifest_nodes``) and is then a scan of those files.  Nodes
know their owners, so nothing is shuffled; only the comparison of two sets of
documents brings each pair together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.manifest_nodes import (
    ANALYSIS,
    BOUNDS,
    DATASET,
    EVENT,
    KINDS,
    LAYER,
    META,
    ODD_LAYER,
    PROJECT,
    REALIZATION,
    UNREADABLE,
    as_batches,
    node_schema,
    nodes_of,
    walk,
)
from ..sources.manifests import REFERENCE_TAG

# Domains and patterns of the manifest schema.
META_TYPES = (
    "guid",
    "url",
    "filepath",
    "image",
    "video",
    "isodate",
    "timestamp",
    "float",
    "boolean",
    "int",
    "richtext",
    "markdown",
    "json",
    "hidden",
)
EXT_TYPES = ("warehouse", "project", "dataset")
EVENT_STATES = ("passed", "failed", "provisional")
PATH_PATTERN = r"^([A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+"
EXT_REF_PATTERN = r"^[0-9a-zA-Z-]{36,}:Project/[A-Za-z0-9_/#-]+$"
VERSION_PATTERN = r"^[0-9]+\.[0-9]+\.[0-9]+[a-z-]*$"

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)?)?$"


def xml_datasets(manifests: DataFrame) -> DataFrame:
    """One row per dataset or dataset reference in any container, its position counted within its tag and container."""
    columns = "container realization_id analysis_id tag position id name path type ext_ref url ref summary description citation"
    return nodes_of(manifests, (DATASET,), columns).withColumnsRenamed({"id": "dataset_id", "type": "type_attr"})


def xml_layers(manifests: DataFrame) -> DataFrame:
    """One row per geopackage layer."""
    columns = "owner path tag position id name type ext_ref summary description citation"
    named = {"owner": "dataset_id", "tag": "layer_type", "id": "layer_name", "type": "type_attr"}
    return nodes_of(manifests, (LAYER,), columns).withColumnsRenamed(named)


def xml_metadata(manifests: DataFrame) -> DataFrame:
    """One row per metadata item of projects, realizations, analyses, datasets, layers and QA events.

    Analysis metrics have the level ``metric``.
    """
    return nodes_of(manifests, (META,), "level owner position name value type ext locked")


def xml_bounds(manifests: DataFrame) -> DataFrame:
    """Centroid and bounding box of each project that states them, by element name; null where no number stands."""
    number = lambda group, name: F.col("box")[f"{group}.{name}"].try_cast("double")
    return nodes_of(manifests, (BOUNDS,), "box path").select(
        "project_id",
        number("Centroid", "Lng").alias("centroid_lng"),
        number("Centroid", "Lat").alias("centroid_lat"),
        number("BoundingBox", "MinLng").alias("min_lng"),
        number("BoundingBox", "MinLat").alias("min_lat"),
        number("BoundingBox", "MaxLng").alias("max_lng"),
        number("BoundingBox", "MaxLat").alias("max_lat"),
        "path",
    )


def _valid_state() -> Column:
    return F.coalesce(F.col("state").isin(*EVENT_STATES), F.lit(False))


def xml_qaqc(manifests: DataFrame) -> DataFrame:
    """One row per QA event with its links, and whether its state is a known one."""
    return nodes_of(manifests, (EVENT,), "name dated state performed_by summary links").select(
        "project_id", "name", F.col("dated").alias("date_performed"), "state", "performed_by", "summary", "links",
        _valid_state().alias("valid_state"),
    )


def xml_resolve_refs(manifests: DataFrame) -> DataFrame:
    """One row per dataset reference with the common dataset that it names.

    The first common dataset with the id is taken; ``unresolved`` marks the
    references that name none.  References inside analyses resolve as well.
    """
    named = lambda node: node["tag"] == REFERENCE_TAG
    nodes = nodes_of(manifests, (DATASET,), "container realization_id analysis_id position tag ref target", named)
    return nodes.where(F.col("tag") == REFERENCE_TAG).select(
        "project_id", "container", "realization_id", "analysis_id", "position", "ref",
        "target.name", "target.path", "target.tag", F.col("target").isNull().alias("unresolved"),
    )


def _iso(column: str) -> Column:
    """Whether a text is a date, with or without a time; missing text is none."""
    day = F.substring(column, 1, 10).try_cast("date").isNotNull()
    return F.coalesce(F.col(column).rlike(_ISO) & day, F.lit(False))


def _missing(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def _repeated(column: str) -> Column:
    return F.size(column) != F.size(F.array_distinct(column))


def _rules() -> dict[str, list[tuple[str, str | None, Column]]]:
    """Per kind of node: the rule, the column that tells where, and when it is broken (null: it is not)."""
    is_ref = F.col("tag") == REFERENCE_TAG
    own = lambda broken: ~is_ref & broken
    return {
        PROJECT: [
            ("project name missing", None, _missing("name")),
            ("project type missing", None, _missing("project_type")),
            ("project bounds missing", None, F.col("box").isNull()),
            ("model version missing", None, ~F.coalesce(F.array_contains("meta_names", "ModelVersion"), F.lit(False))),
            ("meta name repeated", None, _repeated("meta_names")),
        ],
        REALIZATION: [
            ("realization id missing", "id", _missing("id")),
            ("realization name missing", "id", _missing("name")),
            ("realization date invalid", "id", ~_iso("dated")),
            ("realization version invalid", "id", ~F.col("version").rlike(VERSION_PATTERN)),
            ("meta name repeated", "id", _repeated("meta_names")),
        ],
        ANALYSIS: [
            ("analysis id missing", "id", _missing("id")),
            ("analysis name missing", "id", _missing("name")),
            ("meta name repeated", "id", _repeated("metric_names")),
            ("meta name repeated", "id", _repeated("meta_names")),
        ],
        DATASET: [
            ("dataset id missing", "path", own(F.col("id").isNull())),
            ("dataset name missing", "id", own(F.col("name").isNull())),
            ("dataset path missing", "id", own(F.col("path").isNull())),
            ("dataset path invalid", "id", own(~F.col("path").rlike(PATH_PATTERN))),
            ("dataset reference invalid", "id", own(~F.col("ext_ref").rlike(EXT_REF_PATTERN))),
            ("common dataset not found", "ref", is_ref & F.col("target").isNull()),
            ("meta name repeated", "id", _repeated("meta_names")),
        ],
        LAYER: [
            ("layer name missing", "owner", _missing("id")),
            ("layer title missing", "id", _missing("name")),
            ("meta name repeated", "id", _repeated("meta_names")),
        ],
        META: [
            ("meta name empty", "owner", F.coalesce("name", F.lit("")) == ""),
            ("meta type invalid", "name", ~F.col("type").isin(*META_TYPES)),
            ("meta ext invalid", "name", ~F.col("ext").isin(*EXT_TYPES)),
        ],
        EVENT: [
            ("event name missing", "dated", _missing("name")),
            ("event date invalid", "name", ~_iso("dated")),
            ("event author missing", "name", _missing("performed_by")),
            ("event state invalid", "name", ~_valid_state()),
        ],
        ODD_LAYER: [("layer type invalid", "id", F.lit(True))],
        UNREADABLE: [("document unreadable", None, F.lit(True))],
    }


#: The columns that the rules look at.
_JUDGED = "kind tag id name path type ext ext_ref ref owner dated version state performed_by project_type box meta_names metric_names target"
#: Rules whose breach is no error.
_WARNINGS = ("project bounds missing", "model version missing")


_ISO_FORM = re.compile(r"\d{4}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)(?:[T ]\d{2}:\d{2}(?::\d{2})?Z?)?", re.ASCII)
_PATH_FORM, _VERSION_FORM = re.compile(r"[A-Za-z0-9_.-][A-Za-z0-9_./-]*"), re.compile(r"[0-9]+\.[0-9]+\.[0-9]+")
_TYPES, _EXTS, _STATES = frozenset((None, *META_TYPES)), frozenset((None, *EXT_TYPES)), frozenset(EVENT_STATES)


def _doubtful(node: dict) -> bool:
    """Whether a node may break a rule; false only for plain cases that break none.

    Most nodes are in order, and a node that isn't sent on costs a third of one
    that is.  The rules alone decide on the others.
    """
    kind, get = node["kind"], node.get
    names = get("meta_names")
    if names and len(names) > 1 and len(set(names)) < len(names):
        return True
    if kind == META:
        return not get("name") or node["type"] not in _TYPES or node["ext"] not in _EXTS
    if kind == DATASET:
        if node["tag"] == REFERENCE_TAG:
            return "target" not in node
        path = get("path")
        return not (node["id"] and get("name") and path and node["ext_ref"] is None and _PATH_FORM.fullmatch(path))
    if kind == LAYER:
        return not (node["id"] and node["id"].strip() and get("name"))
    dated = get("dated")
    if kind == EVENT:
        return not (get("name") and get("performed_by") and node["state"] in _STATES and dated and _ISO_FORM.fullmatch(dated))
    if kind == BOUNDS:
        return False
    if kind == ANALYSIS:
        metrics = get("metric_names") or ()
        return len(set(metrics)) < len(metrics) or not (node["id"] and node["id"].strip() and get("name"))
    if kind == REALIZATION:
        version = node["version"]
        plain = node["id"] and node["id"].strip() and get("name") and dated and _ISO_FORM.fullmatch(dated)
        return not (plain and (version is None or _VERSION_FORM.fullmatch(version)))
    if kind == PROJECT:
        return not (get("name") and get("project_type") and "box" in node and "ModelVersion" in (names or ()))
    return True


def xml_audit(manifests: DataFrame) -> DataFrame:
    """Rule violations of each manifest: ``project_id, severity, rule, location``.

    A document that is missing or not well-formed has one: ``document
    unreadable``; no other rule is applied to what is left of it.  Each node is
    held against the rules of its kind, in one scan; of documents, nodes that
    are plainly in order don't leave the walk.
    """
    findings = F.lit(None).cast("array<struct<severity:string,rule:string,location:string>>")
    for kind, rules in _rules().items():
        listed = [
            F.when(
                broken,
                F.struct(
                    F.lit("warning" if rule in _WARNINGS else "error").alias("severity"),
                    F.lit(rule).alias("rule"),
                    (F.lit("") if where is None else F.coalesce(where, F.lit(""))).alias("location"),
                ),
            )
            for rule, where, broken in rules
        ]
        findings = F.when(F.col("kind") == kind, F.array(*listed)).otherwise(findings)
    # The outer form is deliberate: for the inner one the optimizer adds a filter on the array's
    # size, which computes the whole array a second time.  So is leaving out the rules that hold
    # by a function with a lambda: it is evaluated rule by rule, where generated code for all
    # rules at once would be too long for the JVM to compile.
    broken = F.filter(findings, lambda f: f.isNotNull())
    return nodes_of(manifests, KINDS, _JUDGED, _doubtful).select("project_id", F.inline_outer(broken)).where("rule IS NOT NULL")


#: Kinds that are compared, with the fields that equality looks at and their names in the content.
_COMPARED = {
    PROJECT: {**{c: c for c in ("name", "summary", "description", "citation")}, "type": "project_type"},
    REALIZATION: {**{c: c for c in ("name", "summary", "description", "citation")}, "date": "dated", "version": "version"},
    ANALYSIS: {c: c for c in ("name", "summary", "description", "citation")},
    DATASET: {c: c for c in ("id", "name", "path", "ext_ref", "url", "ref", "summary", "description", "citation")},
    LAYER: {"layer": "id", **{c: c for c in ("name", "ext_ref", "summary", "description", "citation")}},
    META: {c: c for c in ("name", "value", "type", "ext", "locked")},
}


_CONTENT = tuple(sorted({column for fields in _COMPARED.values() for column in fields.values()}))


def _content() -> Column:
    """What equality looks at, as JSON text."""
    text = F.lit(None).cast("string")
    for kind, fields in _COMPARED.items():
        text = F.when(F.col("kind") == kind, F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]))).otherwise(text)
    return text


def manifest_parts(manifests: DataFrame) -> DataFrame:
    """Every comparable part of a document: ``project_id, kind, address, content``.

    The address holds the place, id and position, so it names one part; the
    content is everything that equality looks at.
    """
    nodes = nodes_of(manifests, tuple(_COMPARED), " ".join(("kind", "place", *_CONTENT)))
    return nodes.select("project_id", "kind", F.col("place").alias("address"), _content().alias("content"))


def _differing(left: str | None, right: str | None):
    """Nodes by which two documents differ, with their side; of an unreadable one an empty project is left."""

    def parts(text: str | None) -> dict[tuple, tuple]:
        found = {}
        for node in walk(text, frozenset(_COMPARED)) if text is not None else ():
            node = {"kind": PROJECT, "place": ""} if node["kind"] == UNREADABLE else node
            if fields := _COMPARED.get(node["kind"]):
                found[node["kind"], node["place"]] = (tuple(node.get(c) for c in fields.values()), node)
        return found

    sides = parts(left), parts(right)
    for side, other, name in ((*sides, "left"), (*sides[::-1], "right")):
        for address, (content, node) in side.items():
            if address not in other or other[address][0] != content:
                yield node | {"side": name}


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Parts by which two versions of each project's manifest differ; equal trees give no rows.

    The two documents meet in one row, where equal texts are left at once; of
    the others both are walked and only the parts that differ go on, to be put
    side by side by address.  A document that cannot be read has no parts but
    an empty project.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = [df.select("project_id", F.col("xml").cast("string").alias(name)) for df, name in ((left, "left_xml"), (right, "right_xml"))]
    both = texts[0].join(texts[1], "project_id", "full_outer").where("NOT left_xml <=> right_xml")
    schema = node_schema(both.schema["project_id"].dataType, ("kind", "place", *_CONTENT)).add("side", T.StringType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        def found():
            for batch in batches:
                for project, old, new in zip(*(column.to_pylist() for column in batch.columns)):
                    yield from ((project, node) for node in _differing(old, new))

        yield from as_batches(found(), arrow)

    parts = both.select("project_id", "left_xml", "right_xml").mapInArrow(run, schema).withColumn("content", _content())
    on = lambda side: F.max(F.when(F.col("side") == side, F.col("content")))
    met = parts.groupBy("project_id", "kind", F.col("place").alias("address")).agg(on("left").alias("left_content"), on("right").alias("right_content"))
    status = F.when(F.col("right_content").isNull(), "removed").when(F.col("left_content").isNull(), "added").otherwise("changed")
    return met.withColumn("status", status)
