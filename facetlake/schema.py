"""Logical tables of a store, fixed enumerations, and the kinds of elements and values."""

from __future__ import annotations

# Fixed values of the data model.
BLOCK_SIZE = 16_384
VALUE_CHUNK = 65_536
STATUSES = ["draft", "accepted", "rejected", "superseded"]
OBJECT_STATUSES = ["accepted", "temporary"]
CATEGORIES = ["containment", "peer", "generalization", "grouping"]
DIRECTIONS = ["out", "in", "both"]
ELEMENT_KINDS = {"face": 1, "faces": 1, "triangle": 1, "triangles": 1, "point": 2, "points": 2, "vertex": 3, "vertices": 3, "feature": 4, "features": 4}
DTYPES = {
    "u1": "smallint", "i1": "tinyint", "u2": "int", "i2": "smallint", "u4": "bigint", "i4": "int", "f2": "float", "f4": "float", "f8": "double",
}
DTYPE_RANGES = {"u1": (0, 2**8 - 1), "i1": (-(2**7), 2**7 - 1), "u2": (0, 2**16 - 1), "i2": (-(2**15), 2**15 - 1), "u4": (0, 2**32 - 1), "i4": (-(2**31), 2**31 - 1)}
FLOAT_LIMITS = {"f2": 65504.0, "f4": 3.4028234663852886e38, "f8": 1.7976931348623157e308}
MAX_INDEX = 2**32 - 1

TABLES = {
    "asset": "asset_id long, uri string, asset_kind string, media_type string, content_hash string, srs_id int, metadata_json string",
    "asset_part": "asset_part_id long, asset_id long, part_path string, element_kind int, element_count long, index_origin string, indexing_profile string, minx double, miny double, minz double, maxx double, maxy double, maxz double, metadata_json string",
    "semantic_class": "semantic_class_id long, scheme string, scheme_version string, class_uri string, local_name string, parent_class_id long, source_namespace string, concept_iri string, is_ade boolean, metadata_json string",
    "city_object": "city_object_id long, object_uid string, semantic_class_id long, gml_id string, source_asset_id long, source_object_id string, object_status string, attributes_json string",
    "relationship_type": "relationship_type_id long, local_name string, code_space string, category string, metadata_json string",
    "relationship": "relationship_id long, graph_name string, from_city_object_id long, to_city_object_id long, to_external_uri string, relationship_type_id long, role string, source_asset_id long, source_relation_id string, metadata_json string",
    "annotation": "annotation_id long, annotation_uid string, semantic_class_id long, primary_city_object_id long, status string, confidence double, label string, attributes_json string, created_at string, updated_at string",
    "annotation_object": "annotation_id long, city_object_id long, relation_type string",
    "assessment": "assessment_id long, assessment_uid string, annotation_id long, asset_id long, assessed_at string, status string, confidence double, attributes_json string, created_at string, updated_at string",
    "membership_block": "membership_block_id long, assessment_id long, annotation_id long, asset_part_id long, element_kind int, block_start long, block_size int, encoding string, element_count int, min_element_index long, max_element_index long, offsets array<int>",
    "value_block": "value_block_id long, assessment_id long, annotation_id long, asset_part_id long, element_kind int, block_start long, element_count int, value_dtype string, encoding string, value_min double, value_max double, values array<double>",
    "path_block": "path_block_id long, assessment_id long, asset_part_id long, segment_ordinal int, continues_previous int, element_count int, encoding string, indices array<bigint>",
    "edit_log": "edit_id long, operation string, target_table string, target_id long, details_json string, created_at string",
}


class StoreError(Exception):
    """A rule of the data model is broken."""


class AmbiguityError(StoreError):
    """A reference names more than one record."""


def element_kind(kind: int | str) -> int:
    """The number of an element kind given by number, digits or any of its names."""
    if isinstance(kind, str):
        name = kind.strip().lower()
        kind = int(name) if name.isdigit() else ELEMENT_KINDS.get(name, 0)
    if isinstance(kind, bool) or kind not in set(ELEMENT_KINDS.values()):
        raise StoreError(f"no element kind: {kind!r}")
    return int(kind)


def value_dtype(name: str) -> str:
    tag = name.strip().lstrip("<").lower()
    if tag not in DTYPES:
        raise StoreError(f"no value dtype: {name!r}")
    return tag
