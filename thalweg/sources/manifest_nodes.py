"""Manifests shredded into rows: one walk over a document, one row per part of it.

A node has its place in the document, its parent's place, its position among
its like, and typed columns for what it states.  Rows of one document come out
together.  Written by ``write_nodes`` they are kept by kind, so that a later
question reads the files of its own kinds and the columns it names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree.ElementTree import Element, ParseError, fromstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifests import ANALYSIS_CONTAINERS, DATASET_TAGS, LAYER_TAGS, REALIZATION_CONTAINERS, REFERENCE_TAG

PROJECT, BOUNDS, REALIZATION, ANALYSIS, DATASET, LAYER, META, EVENT = "project bounds realization analysis dataset layer meta event".split()
#: A layer of a tag that the schema does not know, and a document that cannot be read.
ODD_LAYER, UNREADABLE = "odd_layer", "unreadable"
KINDS = (PROJECT, BOUNDS, REALIZATION, ANALYSIS, DATASET, LAYER, META, EVENT, ODD_LAYER, UNREADABLE)

_TEXTS = (
    "kind place parent tag container realization_id analysis_id id name path type ext_ref url ref summary description citation "
    "level owner value ext dated version state performed_by project_type"
).split()
_FIELDS = dict.fromkeys(_TEXTS, "string") | {
    "position": "int", "locked": "boolean", "meta_names": "array<string>", "metric_names": "array<string>",
    "links": "map<string,string>", "box": "map<string,string>", "target": "struct<name:string,path:string,tag:string>",
}
#: Nodes that are turned into columns at once.
_ROWS = 16_384

_HEADS = {"Name": "name", "Summary": "summary", "Description": "description", "Citation": "citation"}
#: Child elements that are a text column of the node around them.
_OF_PROJECT = {**_HEADS, "ProjectType": "project_type"}
_OF_DATASET = {**_HEADS, "Path": "path", "URL": "url"}
_OF_EVENT = {**_HEADS, "PerformedBy": "performed_by"}
#: Boxes of a project's bounds and the numbers that they state.
_BOXES, _NUMBERS = ("Centroid", "BoundingBox"), frozenset("Lat Lng MinLat MinLng MaxLat MaxLng".split())
_DATASETS, _LAYERS = frozenset((*DATASET_TAGS, REFERENCE_TAG)), frozenset(LAYER_TAGS)
_EVERY = frozenset(KINDS)


def _clean(text: str | None) -> str | None:
    return text.strip(" \t\r\n") or None if text else None


def _text(element: Element) -> str | None:
    text = "".join(element.itertext()) if len(element) else element.text
    return text.strip(" \t\r\n") or None if text else None


class _Walk:
    """One pass over a parsed document: its nodes in the order of the text.

    This runs for every element of every document, so kinds that nothing wanted
    needs are passed over with what they hold, and nodes get places, which are
    texts put together, only where they are asked for.
    """

    def __init__(self, kinds: frozenset[str], places: bool):
        self.meta = META in kinds
        self.layers = self.meta or LAYER in kinds
        self.events = self.meta or EVENT in kinds
        self.boxes = BOUNDS in kinds or PROJECT in kinds
        self.datasets = self.layers or DATASET in kinds
        self.realizations = self.datasets or REALIZATION in kinds or ANALYSIS in kinds
        self.analyses = self.datasets or ANALYSIS in kinds
        self.heads = PROJECT in kinds
        self.places = places
        self.nodes: list[dict] = []

    def project(self, root: Element) -> None:
        node = {"kind": PROJECT, "up": None, "tag": root.tag, "counts": {}}
        if self.places:
            node.update(parent=None, place="", spot="/", meta_place="")
        self.nodes.append(node)
        for child in root:
            tag = child.tag
            if tag in _OF_PROJECT:
                if self.heads:
                    node[_OF_PROJECT[tag]] = _text(child)
            elif tag == "MetaData":
                self.metadata(child, "Meta", node, PROJECT)
            elif tag == "CommonDatasets":
                if self.datasets:
                    self.container(child, node)
            elif tag == "Realizations":
                if self.realizations:
                    for each in child.iterfind("Realization"):
                        self.realization(each, node)
            elif tag == "QAQCEvents":
                if self.events:
                    for each in child.iterfind("QAQCEvent"):
                        self.event(each, node)
            elif tag == "ProjectBounds" and self.boxes:
                self.bounds(child, node)

    def bounds(self, element: Element, up: dict) -> None:
        up["box"] = {}  # says that bounds are stated
        box: dict[str, str | None] = {}
        node = {"kind": BOUNDS, "up": up, "tag": element.tag, "box": box}
        if self.places:
            node.update(parent=up["place"], place="bounds")
        self.nodes.append(node)
        for child in element:
            if child.tag in _BOXES:
                box.update((f"{child.tag}.{n.tag}", _text(n)) for n in child if n.tag in _NUMBERS)
            elif child.tag == "Path":
                node["path"] = _text(child)

    def realization(self, element: Element, up: dict) -> None:
        counts, name = up["counts"], element.get("id")
        counts[REALIZATION] = at = counts.get(REALIZATION, -1) + 1
        node = {
            "kind": REALIZATION, "up": up, "tag": element.tag, "counts": {}, "position": at, "id": name, "realization_id": name,
            "dated": element.get("dateCreated"), "version": element.get("productVersion"),
        }
        if self.places:
            here = f"{name or ''}#{at}"
            node.update(parent=up["place"], place=here, spot=here + "/", meta_place=here)
        self.nodes.append(node)
        for child in element:
            tag = child.tag
            if tag in REALIZATION_CONTAINERS:
                if self.datasets:
                    self.container(child, node)
            elif tag in _HEADS:
                node[_HEADS[tag]] = _text(child)
            elif tag == "MetaData":
                self.metadata(child, "Meta", node, REALIZATION)
            elif tag == "Analyses" and self.analyses:
                for each in child.iterfind("Analysis"):
                    self.analysis(each, node)

    def analysis(self, element: Element, up: dict) -> None:
        counts, name = up["counts"], element.get("id")
        counts[ANALYSIS] = at = counts.get(ANALYSIS, -1) + 1
        node = {"kind": ANALYSIS, "up": up, "tag": element.tag, "counts": {}, "position": at, "id": name, "realization_id": up["id"], "analysis_id": name}
        if self.places:
            here = f"{up['place']}/{name or ''}#{at}"
            node.update(parent=up["place"], place=here, spot=here, meta_place=here)
        self.nodes.append(node)
        for child in element:
            tag = child.tag
            if tag in ANALYSIS_CONTAINERS:
                if self.datasets:
                    self.container(child, node)
            elif tag in _HEADS:
                node[_HEADS[tag]] = _text(child)
            elif tag == "MetaData":
                self.metadata(child, "Meta", node, ANALYSIS)
            elif tag == "Metrics":
                self.metadata(child, "Metric", node, "metric")

    def container(self, element: Element, up: dict) -> None:
        around, counts, nodes = element.tag, up["counts"], self.nodes
        realization_id, analysis_id = up.get("realization_id"), up.get("analysis_id")
        for child in element:
            tag = child.tag
            if tag not in _DATASETS:
                continue
            counts[around, tag] = at = counts.get((around, tag), -1) + 1
            node = {
                "kind": DATASET, "up": up, "tag": tag, "position": at, "container": around,
                "realization_id": realization_id, "analysis_id": analysis_id,
            }
            if self.places:
                here = f"{up['spot']}/{around}/{tag}/{at}"
                node.update(parent=up["place"], place=here, meta_place=here)
            nodes.append(node)
            if tag == REFERENCE_TAG:
                node["ref"] = child.get("ref")
                continue
            get = child.get
            node["id"], node["type"], node["ext_ref"] = _clean(get("id")), _clean(get("type")), _clean(get("extRef"))
            for part in child:
                inner = part.tag
                if inner in _OF_DATASET:
                    node[_OF_DATASET[inner]] = _text(part)
                elif inner == "MetaData":
                    self.metadata(part, "Meta", node, DATASET)
                elif inner == "Layers" and tag == "Geopackage" and self.layers:
                    for each in part:
                        if each.tag in _LAYERS:
                            self.layer(each, node)

    def layer(self, element: Element, up: dict) -> None:
        tag, counts = element.tag, up.setdefault("counts", {})
        counts[LAYER, tag] = at = counts.get((LAYER, tag), -1) + 1
        get = element.get
        node = {"kind": LAYER, "up": up, "tag": tag, "position": at, "id": get("lyrName"), "type": get("type"), "ext_ref": get("extRef")}
        if self.places:
            here = f"{up['place']}/{tag}/{at}"
            node.update(parent=up["place"], place=here, meta_place=here)
        self.nodes.append(node)
        for child in element:
            if child.tag in _HEADS:
                node[_HEADS[child.tag]] = _text(child)
            elif child.tag == "MetaData":
                self.metadata(child, "Meta", node, LAYER)

    def event(self, element: Element, up: dict) -> None:
        counts = up["counts"]
        counts[EVENT] = at = counts.get(EVENT, -1) + 1
        node = {"kind": EVENT, "up": up, "tag": element.tag, "position": at, "dated": element.get("datePerformed"), "state": element.get("state")}
        if self.places:
            node.update(parent=up["place"], place=str(at), meta_place=str(at))
        self.nodes.append(node)
        for child in element:
            if child.tag in _OF_EVENT:
                node[_OF_EVENT[child.tag]] = _text(child)
            elif child.tag == "MetaData":
                self.metadata(child, "Meta", node, "qaqc")
            elif child.tag == "Links":
                named = ((u.get("text"), _text(u)) for u in child.iterfind("URL"))
                node.setdefault("links", {}).update((k, v) for k, v in named if k is not None)

    def metadata(self, element: Element, tag: str, up: dict, level: str) -> None:
        if not self.meta:
            return
        names, counts = up.setdefault("metric_names" if level == "metric" else "meta_names", []), up.setdefault("counts", {})
        for child in element:
            if child.tag != tag:
                continue
            counts[META, level] = at = counts.get((META, level), -1) + 1
            get = child.get
            name = get("name")
            node = {
                "kind": META, "up": up, "tag": tag, "position": at, "level": level, "name": name, "value": _text(child) or "",
                "type": get("type"), "ext": get("ext"), "locked": get("locked") == "true",
            }
            if self.places:
                node.update(parent=up["place"], place=f"{level}/{up['meta_place']}/{at}")
            self.nodes.append(node)
            if name is not None:
                names.append(name)

    def finish(self) -> list[dict]:
        """Fill in what only the end of the document tells: owners' names, and what references name."""
        common: dict[str, dict] = {}
        refs = []
        for node in self.nodes:
            kind = node["kind"]
            if kind == META:
                up = node["up"]
                node["owner"] = up.get("name") if up["kind"] == EVENT else up.get("id")
            elif kind == DATASET:
                if "ref" in node:
                    refs.append(node)
                elif node["container"] == "CommonDatasets" and node["id"] is not None:
                    common.setdefault(node["id"], node)
            elif kind == LAYER:
                up = node["up"]
                node["owner"], node["path"] = up["id"], up.get("path")
        for node in refs:
            if found := common.get(node["ref"]):
                node["target"] = {k: found.get(k) for k in ("name", "path", "tag")}
        return self.nodes


def walk(text: str | None, kinds: frozenset[str] = _EVERY, places: bool = True) -> list[dict]:
    """The nodes of a document in the order of its text; a missing or broken one has a single node that says so.

    Kinds that aren't named may still come.  The nodes' lists of metadata names
    are filled where metadata is among the kinds; without ``places`` they have
    neither their place nor their parent's.
    """
    try:
        root = fromstring(text or "")
    except (ParseError, ValueError):  # the latter for characters that no document may hold
        return [{"kind": UNREADABLE, "place": ""}]
    walker = _Walk(kinds, places)
    walker.project(root)
    nodes = walker.finish()
    # every element is looked at only if the text names more layers than the nodes do
    if ODD_LAYER in kinds and (text.count("lyrName") != sum(n["kind"] == LAYER and n["id"] is not None for n in nodes) or "<!DOCTYPE" in text):
        odd = (e for e in root.iter() if e.get("lyrName") is not None and e.tag not in _LAYERS)
        nodes += [{"kind": ODD_LAYER, "id": e.get("lyrName"), "tag": e.tag} for e in odd]
    return nodes


def node_schema(project_id: T.DataType = T.StringType(), columns: tuple[str, ...] = tuple(_FIELDS)) -> T.StructType:
    fields = T.StructType.fromDDL(", ".join(f"{c} {_FIELDS[c]}" for c in columns))
    return T.StructType([T.StructField("project_id", project_id), *fields])


def as_batches(found: Iterator[tuple[object, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Nodes, each with its project, as Arrow columns, some thousands at a time."""
    ids, nodes = [], []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(ids, schema.field(0).type)]
        for field in list(schema)[1:]:
            name = field.name
            values = [node.get(name) for node in nodes]
            columns.append(pa.array([v and list(v.items()) for v in values] if pa.types.is_map(field.type) else values, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for project, node in found:
        ids.append(project)
        nodes.append(node)
        if len(nodes) >= _ROWS:
            yield batch()
            ids, nodes = [], []
    if nodes:
        yield batch()


def shred(
    manifests: DataFrame,
    kinds: tuple[str, ...] = KINDS,
    columns: tuple[str, ...] = tuple(_FIELDS),
    keep: Callable[[dict], bool] | None = None,
) -> DataFrame:
    """Nodes of the named kinds, and their named columns, from documents in ``xml`` (see the module's head).

    Each document is walked once.  Element names that the schema does not know
    are passed over with what they hold; containers that occur twice are read
    as one.  Nodes for which ``keep`` is false are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    given = manifests.select("project_id", F.col("xml").cast("string").alias("xml"))
    schema = node_schema(given.schema["project_id"].dataType, columns)
    arrow, wanted = to_arrow_schema(schema), frozenset(kinds)
    places = "place" in columns or "parent" in columns

    def run(batches):
        def found():
            for batch in batches:
                for project, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for node in walk(text.as_py(), wanted, places):
                        if node["kind"] in wanted and (keep is None or keep(node)):
                            yield project, node

        yield from as_batches(found(), arrow)

    return given.mapInArrow(run, schema)


def write_nodes(manifests: DataFrame, path: str) -> None:
    """Shred documents into a store: files by kind."""
    shred(manifests).write.partitionBy("kind").parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A store of nodes; every manifest operator takes it in place of the documents."""
    return spark.read.parquet(path)


def nodes_of(source: DataFrame, kinds: tuple[str, ...], columns: str, keep: Callable[[dict], bool] | None = None) -> DataFrame:
    """Nodes of these kinds with these columns, of documents or of a store; of documents only those to ``keep``."""
    names = ("project_id", *columns.split())
    if "xml" in source.columns:
        return shred(source, kinds, names[1:], keep)
    return source.where(F.col("kind").isin(*kinds)).select(*names)
