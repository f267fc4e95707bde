"""City-model semantics, schemas and vocabularies as DataFrames of objects, edges and concepts.

A city model is read once by a streaming parser in a worker; names are
resolved by joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetlake.schema import CATEGORIES, StoreError
from facetlake.session import written

# Namespaces of the public encodings.
GML = "http://www.opengis.net/gml"
CITYGML = "http://www.opengis.net/citygml/"
XLINK = "{http://www.w3.org/1999/xlink}href"
XS = "{http://www.w3.org/2001/XMLSchema}"
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
RDFS = "{http://www.w3.org/2000/01/rdf-schema#}"
OWL = "{http://www.w3.org/2002/07/owl#}"
# The category of each property that links city objects in version 3.0 of the public schema, by its module.
# The schema itself has no categories; some (boundary, storey, relatedTo among them) are a reading of it that must be the same for all stores.
DEFAULT_CATEGORIES = {
    "3.0": {"boundary": "containment", "relatedTo": "peer", "generalizesTo": "generalization"},
    "construction/3.0": {"filling": "containment", "fillingSurface": "containment"},
    "building/3.0": {
        "buildingPart": "containment", "buildingRoom": "containment", "buildingInstallation": "containment", "buildingConstructiveElement": "containment",
        "buildingFurniture": "containment", "buildingSubdivision": "containment", "buildingUnit": "peer", "storey": "peer",
    },
    "bridge/3.0": {"bridgePart": "containment", "bridgeRoom": "containment", "bridgeInstallation": "containment", "bridgeConstructiveElement": "containment", "bridgeFurniture": "containment"},
    "tunnel/3.0": {"tunnelPart": "containment", "hollowSpace": "containment", "tunnelInstallation": "containment", "tunnelConstructiveElement": "containment", "tunnelFurniture": "containment"},
    "transportation/3.0": {
        "section": "containment", "intersection": "containment", "trafficSpace": "containment", "auxiliaryTrafficSpace": "containment", "clearanceSpace": "containment",
        "hole": "containment", "marking": "containment", "predecessor": "peer", "successor": "peer",
    },
    "relief/3.0": {"reliefComponent": "containment"},
    "cityobjectgroup/3.0": {"groupMember": "grouping", "parent": "grouping"},
}


def default_types(spark: SparkSession) -> DataFrame:
    rows = [(name, CITYGML + module, category, True) for module, names in DEFAULT_CATEGORIES.items() for name, category in names.items()]
    return spark.createDataFrame(rows, "local_name string, code_space string, category string, is_default boolean")


def _split(tag: str) -> tuple[str, str]:
    return tuple(tag[1:].split("}", 1)) if tag.startswith("{") else ("", tag)  # type: ignore[return-value]


def _gml_id(e: ET.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if k.startswith("{" + GML) and k.endswith("}id")), None)


#: Elements that stand for a relation and carry its type or role themselves.
OBJECTIFIED = {"CityObjectRelation", "Role"}


def parse_citygml(path: str, classes: set[tuple[str, str]]) -> tuple[list[tuple], list[tuple]]:
    """(objects, edges) of a document.

    An object is an element whose qualified name is one of ``classes``:
    (number, gml_id, namespace, name). An edge is (owner number, type's code
    space, type, target number, target href, role, whether its type was stated):
    the owner is the nearest object around the property, and the target stands
    inline or as a link. The type is the property, but where a relation element
    lies between owner and target, the ``relationType`` it states, wherever in
    the element that stands.
    """
    objects, edges = [], []
    owners: list[int] = []
    open_elements: list[tuple[str, str, bool]] = []
    relations: list[dict] = []
    for event, e in ET.iterparse(path, events=("start", "end")):
        ns, name = _split(e.tag)
        relation = name in OBJECTIFIED and ns.startswith(CITYGML)
        if event == "start":
            is_object = (ns, name) in classes
            if is_object:
                number = len(objects)
                objects.append((number, _gml_id(e), ns, name))
                if owners:
                    prop = next(((n, p) for n, p, o in reversed(open_elements) if not o), ("", ""))
                    edges.append((owners[-1], *prop, number, None, None, False))
                owners.append(number)
            elif owners and XLINK in e.attrib:
                edges.append((owners[-1], ns, name, None, e.attrib[XLINK], None, False))
            if relation:
                relations.append({"since": len(edges), "owner": owners[-1] if owners else None})
            open_elements.append((ns, name, is_object))
            continue
        text = (e.text or "").strip()
        if relations and text and name in ("relationType", "role"):
            relations[-1] |= {"type": text, "space": e.attrib.get("codeSpace", "")} if name == "relationType" else {"role": text}
        if relation:
            r = relations.pop()
            for i in range(r["since"], len(edges)):
                owner, space, kind, target, href, role, stated = edges[i]
                # Edges of objects that lie within the target are their own.
                if owner == r["owner"]:
                    said = (r["space"], r["type"]) if "type" in r else (space, kind)
                    edges[i] = (owner, *said, target, href, r.get("role", role), stated or "type" in r)
        if open_elements.pop()[2]:
            owners.pop()
        e.clear()
    return objects, edges


_PARSED = "path string, what string, n long, gml_id string, ns string, name string, target long, href string, role string, stated boolean"


def parsed_citygml(spark: SparkSession, files: list[str], classes: set[tuple[str, str]]) -> DataFrame:
    """Objects and edges of documents as rows, written; a worker parses one document at a time, none passes through the driver."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                try:
                    objects, edges = parse_citygml(p, classes)
                except (OSError, ET.ParseError) as x:
                    raise StoreError(f"{p}: {x}") from None
                rows = [(p, "object", n, g, ns, name, None, None, None, None) for n, g, ns, name in objects] + [(p, "edge", o, None, ns, t, to, href, role, stated) for o, ns, t, to, href, role, stated in edges]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")]).astype({"target": "Int64", "stated": "boolean"})

    return written(spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files))).mapInPandas(parse, _PARSED))


def read_citygml(spark: SparkSession, path: str, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects: object_uid, gml_id, semantic_class, ns; edges: from_uid, to_uid, to_external_uri, relationship_type, code_space, role, stated).

    ``concepts`` has (source_namespace, local_name). A gml:id stated twice
    counts once, the first place; an object without one gets a generated uid.
    A link is resolved by its fragment; one that finds nothing stays external.
    ``stated`` tells types that a relation element names. Links of properties
    that no edge of the document and no given type knows are left out by the caller's type join.
    """
    names = {(r[0], r[1]) for r in concepts.select("source_namespace", "local_name").distinct().toLocalIterator()}
    rows = parsed_citygml(spark, [path], names)
    o = rows.where("what = 'object'").select("n", "gml_id", "ns", F.col("name").alias("semantic_class"))
    uid = F.coalesce(F.nullif("gml_id", F.lit("")), F.format_string("generated_%s_%06d", "semantic_class", "n"))
    o = o.withColumn("object_uid", uid).withColumn("first", F.row_number().over(W.partitionBy("object_uid").orderBy("n")) == 1)
    e = rows.where("what = 'edge'").select(F.col("n").alias("owner"), F.col("ns").alias("code_space"), F.col("name").alias("relationship_type"), "target", "href", "role", "stated")
    target_key = F.substring_index("href", "#", -1)
    local = o.where("first").select(F.col("object_uid").alias("linked_uid"), F.col("gml_id").alias("key")).where("key is not null")
    e = (
        e.join(o.select(F.col("n").alias("owner"), F.col("object_uid").alias("from_uid")), "owner")
        .join(o.select(F.col("n").alias("target"), F.col("object_uid").alias("inline_uid")), "target", "left")
        .withColumn("key", F.when(F.col("href").startswith("#"), target_key)).join(local, "key", "left")
    )
    to = F.coalesce("inline_uid", "linked_uid")
    edges = e.select("from_uid", to.alias("to_uid"), F.when(to.isNull(), F.col("href")).alias("to_external_uri"), "relationship_type", "code_space", "role", "stated").distinct()
    return o.where("first").drop("n", "first"), edges


def parse_xsd(path: str) -> list[tuple]:
    """(namespace, name, parent namespace, parent, abstract) of each top-level element; the parent is its substitution group."""
    ns_of: dict[str, str] = {}
    for _, (prefix, uri) in ET.iterparse(path, events=("start-ns",)):
        ns_of.setdefault(prefix, uri)
    root = ET.parse(path).getroot()
    target = root.get("targetNamespace", "")
    out = []
    for e in root.findall(f"{XS}element"):
        group = e.get("substitutionGroup")
        prefix, _, local = group.rpartition(":") if group else ("", "", None)
        out.append((target, e.get("name"), (ns_of.get(prefix) or target) if group else None, local, e.get("abstract") == "true"))
    return out


def split_iri(iri: str) -> tuple[str, str]:
    """Namespace and name of an IRI; of ``Class.property`` the property."""
    cut = max(iri.rfind("#"), iri.rfind("/"))
    return iri[:cut], iri[cut + 1 :].rpartition(".")[2]


def parse_ontology(path: str, category_name: str = "category") -> tuple[list[tuple], list[tuple], list[str]]:
    """(classes: iri, parent iri; properties: iri, category; imported ontologies) of an RDF/XML document."""
    classes, properties, imports = [], [], []
    root = ET.parse(path).getroot()
    for e in root:
        iri = e.get(f"{RDF}about") or e.get(f"{RDF}ID")
        if e.tag == f"{OWL}Ontology":
            imports += [i.get(f"{RDF}resource") for i in e.findall(f"{OWL}imports")]
        elif e.tag == f"{OWL}Class" and iri:
            parents = [p.get(f"{RDF}resource") for p in e.findall(f"{RDFS}subClassOf") if p.get(f"{RDF}resource")]
            classes += [(iri, p) for p in parents] or [(iri, None)]
        elif e.tag == f"{OWL}ObjectProperty" and iri:
            category = next((c.text.strip() for c in e if _split(c.tag)[1] == category_name and c.text), None)
            if category is not None and category not in CATEGORIES:
                raise StoreError(f"{path}: no category: {category!r}")
            properties.append((iri, category))
    return classes, properties, imports


_CONCEPT = "scheme string, scheme_version string, class_uri string, local_name string, parent_uri string, source_namespace string, concept_iri string, is_ade boolean"
_VOCABULARY_KEYS = {"scheme", "scheme_version", "is_ade", "concepts", "source_namespace"}
_CONCEPT_KEYS = {"local_name", "parent_uri", "class_uri", "concept_iri", "is_ade"}


def unknown_keys(found: Iterator[str] | dict, known: set[str], what: str) -> None:
    """Keys beginning with '_' are comments; any other that is not known raises."""
    wrong = sorted(k for k in found if k not in known and not k.startswith("_"))
    if wrong:
        raise StoreError(f"{what}: unknown keys {wrong}")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of a JSON registry, ``class_uri`` defaulting to scheme:local_name."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    unknown_keys(doc, _VOCABULARY_KEYS, path)
    rows = []
    for c in doc.get("concepts", []):
        unknown_keys(c, _CONCEPT_KEYS, path)
        name = c["local_name"]
        rows.append((doc["scheme"], doc.get("scheme_version"), c.get("class_uri") or f"{doc['scheme']}:{name}", name, c.get("parent_uri"), doc.get("source_namespace"), c.get("concept_iri"), bool(c.get("is_ade", doc.get("is_ade", False)))))
    return spark.createDataFrame(rows, _CONCEPT)


def read_xsd(spark: SparkSession, path: str, scheme: str, version: str | None = None) -> DataFrame:
    uri = lambda ns, n: f"{ns}#{n}" if n else None
    return spark.createDataFrame([(scheme, version, uri(ns, n), n, uri(pns, p), ns, None, False) for ns, n, pns, p, _ in parse_xsd(path)], _CONCEPT)


def read_ontology(spark: SparkSession, path: str, scheme: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(concepts, link types) of an ontology."""
    classes, properties, _ = parse_ontology(path)
    concepts = [(scheme, version, iri, split_iri(iri)[1], parent, split_iri(iri)[0], iri, False) for iri, parent in classes]
    types = [(split_iri(iri)[1], split_iri(iri)[0], category, False) for iri, category in properties]
    return spark.createDataFrame(concepts, _CONCEPT), spark.createDataFrame(types, "local_name string, code_space string, category string, is_default boolean")


def ontology_imports(files: list[str]) -> list[str]:
    """The ontologies that those of ``files`` import: told, never followed."""
    return sorted({i for p in files if p.lower().endswith((".rdf", ".owl")) for i in parse_ontology(p)[2] if i})


def read_vocabulary_folder(spark: SparkSession, files: list[str], scheme: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Concepts and link types of schema files, then ontologies, then registries, whatever the order given; other suffixes raise."""
    rank = {".xsd": 0, ".rdf": 1, ".owl": 1, ".json": 2}
    suffix = lambda p: re.search(r"\.[^./]*$", p).group(0).lower() if re.search(r"\.[^./]*$", p) else ""
    for p in files:
        if suffix(p) not in rank:
            raise StoreError(f"no vocabulary: {p}")
    concepts, types = spark.createDataFrame([], _CONCEPT), spark.createDataFrame([], "local_name string, code_space string, category string, is_default boolean")
    for p in sorted(files, key=lambda p: (rank[suffix(p)], p)):
        if suffix(p) == ".xsd":
            concepts = concepts.unionByName(read_xsd(spark, p, scheme, version))
        elif suffix(p) == ".json":
            concepts = concepts.unionByName(read_vocabulary(spark, p))
        else:
            c, t = read_ontology(spark, p, scheme, version)
            concepts, types = concepts.unionByName(c), types.unionByName(t)
    return concepts, types
