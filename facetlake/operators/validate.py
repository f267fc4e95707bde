"""The catalogue of integrity rules, each one DataFrame of the rows that break it.

``run`` takes the logical tables and a level ('basic', 'deep', 'external';
each includes those before it) and returns (severity, code, table_name,
row_id, details). A rule is a plain filter, anti join or grouped count; no
rule brings rows to the driver, but for the rounds of the cycle rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.operators import graph, paths, values
from facetlake.operators.catalog import asset_extents, canonical_hash
from facetlake.schema import DTYPES, OBJECT_STATUSES, STATUSES, StoreError

LEVELS = ["basic", "deep", "external"]
Tables = dict[str, DataFrame]


@dataclass
class Rule:
    code: str
    severity: str
    level: str
    table: str
    check: Callable[[Tables], DataFrame | None]


RULES: dict[str, Rule] = {}


def _rows(df: DataFrame, row_id: Column | str, details: Column | None = None) -> DataFrame:
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return df.select(c.cast("string").alias("row_id"), (details if details is not None else F.lit("")).cast("string").alias("details"))


def rule(code: str, table: str, severity: str = "error", level: str = "basic") -> Callable:
    def register(f: Callable[[Tables], DataFrame | None]) -> Callable:
        RULES[code] = Rule(code, severity, level, table, f)
        return f

    return register


def _where(code: str, table: str, row_id: str, test: Callable[[], Column], severity: str = "error", level: str = "basic", details: str | None = None) -> None:
    rule(code, table, severity, level)(lambda t: _rows(t[table].where(test()), row_id, F.col(details) if details else None))


def _orphan(code: str, table: str, column: str, parent: str, key: str, row_id: str) -> None:
    def check(t: Tables) -> DataFrame:
        given = t[table].where(F.col(column).isNotNull())
        return _rows(given.join(t[parent].select(F.col(key).alias(column)), column, "left_anti"), row_id, F.col(column))

    rule(code, table)(check)


for _code, _table, _column, _parent, _key, _id in [
    ("ORPHAN_MEMBERSHIP_ANNOTATION", "membership_block", "annotation_id", "annotation", "annotation_id", "membership_block_id"),
    ("ORPHAN_MEMBERSHIP_ASSET_PART", "membership_block", "asset_part_id", "asset_part", "asset_part_id", "membership_block_id"),
    ("ORPHAN_VALUE_BLOCK_ANNOTATION", "value_block", "annotation_id", "annotation", "annotation_id", "value_block_id"),
    ("ORPHAN_VALUE_BLOCK_ASSET_PART", "value_block", "asset_part_id", "asset_part", "asset_part_id", "value_block_id"),
    ("ORPHAN_MEMBERSHIP_ASSESSMENT", "membership_block", "assessment_id", "assessment", "assessment_id", "membership_block_id"),
    ("ORPHAN_VALUE_BLOCK_ASSESSMENT", "value_block", "assessment_id", "assessment", "assessment_id", "value_block_id"),
    ("ORPHAN_ASSESSMENT_ANNOTATION", "assessment", "annotation_id", "annotation", "annotation_id", "assessment_id"),
    ("ORPHAN_ASSESSMENT_ASSET", "assessment", "asset_id", "asset", "asset_id", "assessment_id"),
    ("ORPHAN_ANNOTATION_CLASS", "annotation", "semantic_class_id", "semantic_class", "semantic_class_id", "annotation_id"),
    ("ORPHAN_ANNOTATION_OBJECT_ANNOTATION", "annotation_object", "annotation_id", "annotation", "annotation_id", "annotation_id"),
    ("ORPHAN_ANNOTATION_OBJECT_CITY_OBJECT", "annotation_object", "city_object_id", "city_object", "city_object_id", "annotation_id"),
    ("ORPHAN_RELATIONSHIP_FROM", "relationship", "from_city_object_id", "city_object", "city_object_id", "relationship_id"),
    ("ORPHAN_RELATIONSHIP_TO", "relationship", "to_city_object_id", "city_object", "city_object_id", "relationship_id"),
    ("ORPHAN_RELATIONSHIP_TYPE", "relationship", "relationship_type_id", "relationship_type", "relationship_type_id", "relationship_id"),
    ("ORPHAN_PATH_ASSESSMENT", "path_block", "assessment_id", "assessment", "assessment_id", "path_block_id"),
    ("ORPHAN_PATH_ASSET_PART", "path_block", "asset_part_id", "asset_part", "asset_part_id", "path_block_id"),
]:
    _orphan(_code, _table, _column, _parent, _key, _id)


@rule("DUPLICATE_SEMANTIC_CLASS_REGISTRATION", "semantic_class")
def _duplicate_class(t: Tables) -> DataFrame:
    return _rows(t["semantic_class"].groupBy("class_uri").agg(F.count(F.lit(1)).alias("n")).where("class_uri is not null and n > 1"), "class_uri", F.col("n"))


def _mismatch(table: str, row_id: str) -> Callable[[Tables], DataFrame]:
    def check(t: Tables) -> DataFrame:
        s = t["assessment"].select("assessment_id", F.col("annotation_id").alias("own"))
        return _rows(t[table].join(s, "assessment_id").where("annotation_id <> own"), row_id, F.col("own"))

    return check


@rule("ASSESSMENT_ANNOTATION_MISMATCH", "membership_block")
def _assessment_annotation(t: Tables) -> DataFrame:
    return _mismatch("membership_block", "membership_block_id")(t).unionByName(_mismatch("value_block", "value_block_id")(t))


def _outside(code: str, table: str, row_id: str) -> None:
    def check(t: Tables) -> DataFrame:
        s = t["assessment"].select("assessment_id", F.col("asset_id").alias("assessed"))
        p = t["asset_part"].select("asset_part_id", F.col("asset_id").alias("lies_on"))
        return _rows(t[table].join(s, "assessment_id").join(p, "asset_part_id").where("assessed is not null and assessed <> lies_on"), row_id, F.col("lies_on"))

    rule(code, table)(check)


_outside("MEMBERSHIP_OUTSIDE_ASSESSMENT_ASSET", "membership_block", "membership_block_id")
_outside("VALUE_BLOCK_OUTSIDE_ASSESSMENT_ASSET", "value_block", "value_block_id")
_outside("PATH_OUTSIDE_ASSESSMENT_ASSET", "path_block", "path_block_id")
_where("ASSESSMENT_UNKNOWN_STATUS", "assessment", "assessment_id", lambda: ~F.col("status").isin(STATUSES), details="status")


@rule("ASSESSMENT_WITHOUT_MEMBERSHIP", "assessment", "warning")
def _empty_assessment(t: Tables) -> DataFrame:
    rows = t["assessment"]
    for b in ("membership_block", "value_block"):
        rows = rows.join(t[b].select("assessment_id"), "assessment_id", "left_anti")
    return _rows(rows, "assessment_id")


@rule("ANNOTATION_PRIMARY_OBJECT_LINK_MISSING", "annotation")
def _primary_link(t: Tables) -> DataFrame:
    links = t["annotation_object"].where("relation_type = 'represents'").select("annotation_id", F.col("city_object_id").alias("primary_city_object_id"))
    return _rows(t["annotation"].where("primary_city_object_id is not null").join(links, ["annotation_id", "primary_city_object_id"], "left_anti"), "annotation_id", F.col("primary_city_object_id"))


def _good_blocks(t: Tables) -> DataFrame:
    """Membership blocks that the later block rules look at: known encoding, positive size."""
    return t["membership_block"].where("encoding = 'roaring' and block_size > 0")


_where("UNSUPPORTED_MEMBERSHIP_ENCODING", "membership_block", "membership_block_id", lambda: ~F.col("encoding").eqNullSafe("roaring"), details="encoding")


def _block(code: str, test: Callable[[], Column], severity: str = "error", level: str = "basic", details: str | None = None) -> None:
    rule(code, "membership_block", severity, level)(lambda t: _rows(_good_blocks(t).where(test()), "membership_block_id", F.col(details) if details else None))


rule("INVALID_BLOCK_SIZE", "membership_block")(lambda t: _rows(t["membership_block"].where("encoding = 'roaring' and not block_size > 0"), "membership_block_id", F.col("block_size")))
_block("INVALID_BLOCK_START", lambda: F.col("block_start") < 0, details="block_start")
_block("MISALIGNED_BLOCK_START", lambda: F.col("block_start") % F.col("block_size") != 0, "warning", details="block_start")
_block("EMPTY_MEMBERSHIP_BLOCK", lambda: F.col("element_count") <= 0, details="element_count")
_block("INVALID_MEMBERSHIP_MIN_MAX", lambda: F.col("min_element_index") > F.col("max_element_index"))
_block("CORRUPT_MEMBERSHIP_PAYLOAD", lambda: F.col("offsets").isNull(), level="deep")
_block("MEMBERSHIP_COUNT_MISMATCH", lambda: F.col("offsets").isNotNull() & (F.size("offsets") != F.col("element_count")), level="deep", details="element_count")
_block("OFFSET_OUTSIDE_BLOCK", lambda: F.array_max("offsets") >= F.col("block_size"), level="deep")
_block("MIN_ELEMENT_MISMATCH", lambda: F.array_min("offsets") + F.col("block_start") != F.col("min_element_index"), level="deep", details="min_element_index")
_block("MAX_ELEMENT_MISMATCH", lambda: F.array_max("offsets") + F.col("block_start") != F.col("max_element_index"), level="deep", details="max_element_index")


def _with_part(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(t["asset_part"].select("asset_part_id", F.col("element_kind").alias("part_kind"), F.col("element_count").alias("part_count")), "asset_part_id")


rule("MEMBERSHIP_ELEMENT_KIND_MISMATCH", "membership_block")(lambda t: _rows(_with_part(t, _good_blocks(t)).where("element_kind <> part_kind"), "membership_block_id", F.col("part_kind")))
rule("MEMBERSHIP_OUT_OF_ASSET_PART_RANGE", "membership_block", level="deep")(
    lambda t: _rows(_with_part(t, _good_blocks(t)).where(F.array_max("offsets") + F.col("block_start") >= F.col("part_count")), "membership_block_id", F.col("part_count"))
)

_FIELD = ["assessment_id", "asset_part_id", "element_kind"]
_where("UNSUPPORTED_VALUE_DTYPE", "value_block", "value_block_id", lambda: ~F.coalesce(F.col("value_dtype").isin(list(DTYPES)), F.lit(False)), details="value_dtype")


def _good_values(t: Tables) -> DataFrame:
    return t["value_block"].where(F.col("value_dtype").isin(list(DTYPES)) & (F.col("element_count") > 0))


rule("EMPTY_VALUE_BLOCK", "value_block")(lambda t: _rows(t["value_block"].where(F.col("value_dtype").isin(list(DTYPES)) & ~(F.col("element_count") > 0)), "value_block_id", F.col("element_count")))
rule("INVALID_VALUE_BLOCK_START", "value_block")(lambda t: _rows(_good_values(t).where("block_start < 0"), "value_block_id", F.col("block_start")))
rule("VALUE_ELEMENT_KIND_MISMATCH", "value_block")(lambda t: _rows(_with_part(t, _good_values(t)).where("element_kind <> part_kind"), "value_block_id", F.col("part_kind")))
rule("VALUE_BLOCK_OUT_OF_RANGE", "value_block")(lambda t: _rows(_with_part(t, _good_values(t)).where("block_start + element_count > part_count"), "value_block_id", F.col("part_count")))


def _field_problem(code: str, problem: list[str], severity: str) -> None:
    def check(t: Tables) -> DataFrame:
        found = values.field_problems(_good_values(t), t["asset_part"], _FIELD)
        return _rows(found.where(F.col("problem").isin(problem)), F.concat_ws("/", *_FIELD), F.col("problem"))

    rule(code, "value_block", severity)(check)


_field_problem("OVERLAPPING_VALUE_BLOCKS", ["overlap"], "error")
_field_problem("PARTIAL_VALUE_FIELD_COVERAGE", ["gap", "partial"], "warning")
rule("CORRUPT_VALUE_PAYLOAD", "value_block", level="deep")(lambda t: _rows(_good_values(t).where(F.col("values").isNull() | (F.size("values") != F.col("element_count"))), "value_block_id"))


@rule("VALUE_MIN_MAX_MISMATCH", "value_block", level="deep")
def _value_range(t: Tables) -> DataFrame:
    solid = F.filter("values", lambda v: ~F.isnan(v))
    return _rows(_good_values(t).where(F.col("values").isNotNull() & ~(F.array_min(solid).eqNullSafe(F.col("value_min")) & F.array_max(solid).eqNullSafe(F.col("value_max")))), "value_block_id")


@rule("MIXED_VALUE_DTYPE_FIELD", "value_block")
def _mixed_dtype(t: Tables) -> DataFrame:
    return _rows(t["value_block"].groupBy(*_FIELD).agg(F.count_distinct("value_dtype").alias("n")).where("n > 1"), F.concat_ws("/", *_FIELD), F.col("n"))


_PATH = "u32-seq-zlib"
_where("UNSUPPORTED_PATH_ENCODING", "path_block", "path_block_id", lambda: ~F.col("encoding").eqNullSafe(_PATH), details="encoding")


def _good_paths(t: Tables) -> DataFrame:
    return t["path_block"].where((F.col("encoding") == _PATH) & (F.col("element_count") > 0))


rule("EMPTY_PATH_SEGMENT", "path_block")(lambda t: _rows(t["path_block"].where((F.col("encoding") == _PATH) & ~(F.col("element_count") > 0)), "path_block_id", F.col("element_count")))
rule("CORRUPT_PATH_PAYLOAD", "path_block", level="deep")(lambda t: _rows(_good_paths(t).where("indices is null"), "path_block_id"))
rule("PATH_COUNT_MISMATCH", "path_block", level="deep")(lambda t: _rows(_good_paths(t).where("indices is not null and size(indices) <> element_count"), "path_block_id", F.col("element_count")))
rule("PATH_OUT_OF_ASSET_PART_RANGE", "path_block", level="deep")(lambda t: _rows(_with_part(t, _good_paths(t)).where(F.array_max("indices") >= F.col("part_count")), "path_block_id", F.col("part_count")))
rule("PATH_SEGMENT_ORDINAL_GAP", "path_block")(lambda t: _rows(paths.ordinal_problems(t["path_block"], "assessment_id").where("problem = 'gap'"), "assessment_id"))
rule("PATH_FIRST_SEGMENT_CONTINUES", "path_block")(lambda t: _rows(paths.ordinal_problems(t["path_block"], "assessment_id").where("problem = 'first_continues'"), "assessment_id"))


@rule("PATH_MEMBERSHIP_MISMATCH", "path_block", level="deep")
def _path_membership(t: Tables) -> DataFrame:
    key = ["assessment_id", "asset_part_id"]
    path = _good_paths(t).select(*key, F.explode("indices").alias("i")).distinct().withColumn("p", F.lit(1))
    owners = _good_paths(t).select("assessment_id").distinct()
    member = _good_blocks(t).join(owners, "assessment_id", "left_semi").select(*key, "block_start", F.explode("offsets").alias("o")).select(*key, (F.col("block_start") + F.col("o")).alias("i")).distinct().withColumn("m", F.lit(1))
    both = path.join(member, [*key, "i"], "full_outer").where("p is null or m is null")
    return _rows(both.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), F.concat_ws("/", *key), F.col("n"))


@rule("MISSING_SEMANTIC_CLASS_SELF_CLOSURE", "semantic_class")
def _self_closure(t: Tables) -> DataFrame | None:
    if "class_closure" not in t:  # a derived closure has its self rows by construction
        return None
    have = t["class_closure"].where("depth = 0 and ancestor = descendant").select(F.col("ancestor").alias("semantic_class_id"))
    return _rows(t["semantic_class"].join(have, "semantic_class_id", "left_anti"), "semantic_class_id")


@rule("MISSING_SEMANTIC_CLASS_PARENT_CLOSURE", "semantic_class")
def _parent_closure(t: Tables) -> DataFrame | None:
    if "class_closure" not in t:
        return None
    have = t["class_closure"].where("depth = 1").select(F.col("ancestor").alias("parent_class_id"), F.col("descendant").alias("semantic_class_id"))
    return _rows(t["semantic_class"].where("parent_class_id is not null").join(have, ["parent_class_id", "semantic_class_id"], "left_anti"), "semantic_class_id", F.col("parent_class_id"))


@rule("DUPLICATE_GML_ID", "city_object")
def _duplicate_gml(t: Tables) -> DataFrame:
    return _rows(t["city_object"].where("gml_id <> ''").groupBy("gml_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "gml_id", F.col("n"))


@rule("DUPLICATE_ASSET_URI", "asset", "warning")
def _duplicate_uri(t: Tables) -> DataFrame:
    g = t["asset"].groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("content_hash").isNull(), 1).otherwise(0)).alias("bare"))
    return _rows(g.where("n > 1 and bare > 0"), "uri", F.col("n"))


_EDGE = ["graph_name", "from_city_object_id", "to_city_object_id", "to_external_uri", "relationship_type_id", "role", "source_asset_id"]


@rule("DUPLICATE_RELATIONSHIP_EDGE", "relationship", "warning")
def _duplicate_edge(t: Tables) -> DataFrame:
    return _rows(t["relationship"].groupBy(*_EDGE).agg(F.min("relationship_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first", F.col("n"))


@rule("UNCLASSIFIED_RELATIONSHIP_TYPE", "relationship_type", "warning")
def _unclassified(t: Tables) -> DataFrame:
    used = t["relationship"].groupBy("relationship_type_id").agg(F.count(F.lit(1)).alias("n"))
    return _rows(t["relationship_type"].where("category is null").join(used, "relationship_type_id"), "relationship_type_id", F.col("n"))


@rule("UNRESOLVED_RELATIONSHIP_TARGET", "relationship", "warning")
def _unresolved(t: Tables) -> DataFrame:
    ext = t["relationship"].where("to_external_uri is not null")
    # The number and the first five, kept as a bounded heap and not as a list of all.
    some = ext.select("relationship_id").orderBy("relationship_id").limit(5).agg(F.concat_ws(",", F.array_sort(F.collect_list("relationship_id")).cast("array<string>")).alias("s"))
    return _rows(ext.agg(F.count(F.lit(1)).alias("n")).where("n > 0").crossJoin(F.broadcast(some)), "n", F.col("s"))


@rule("MISSING_ASSET_EXTENT", "asset_part", "warning", "deep")
def _missing_extent(t: Tables) -> DataFrame | None:
    if "asset_extent" not in t:  # extents are derived unless a store brings its own
        return None
    return _rows(asset_extents(t["asset_part"]).join(t["asset_extent"].select("asset_id"), "asset_id", "left_anti"), "asset_id")


@rule("ORPHAN_ASSET_EXTENT", "asset_extent", level="deep")
def _orphan_extent(t: Tables) -> DataFrame | None:
    return _rows(t["asset_extent"].join(t["asset"].select("asset_id"), "asset_id", "left_anti"), "asset_id") if "asset_extent" in t else None


@rule("EXTENT_ENVELOPE_MISMATCH", "asset_extent", level="deep")
def _extent_differs(t: Tables) -> DataFrame | None:
    if "asset_extent" not in t:
        return None
    own = asset_extents(t["asset_part"]).withColumnsRenamed({c: f"p_{c}" for c in ("minx", "miny", "maxx", "maxy")})
    same = F.lit(True)
    for c in ("minx", "miny", "maxx", "maxy"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return _rows(t["asset_extent"].join(own, "asset_id", "left").where(~same), "asset_id")


@rule("MIXED_ASSET_CRS", "asset", "warning", "deep")
def _mixed_crs(t: Tables) -> DataFrame:
    g = t["asset"].where("srs_id is not null").agg(F.count_distinct("srs_id").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("srs_id")).cast("array<string>")).alias("ids"))
    return _rows(g.where("n > 1"), "n", F.col("ids"))


@rule("ASSET_PART_NO_INDEXING_PROFILE", "asset_part", "warning", "deep")
def _no_profile(t: Tables) -> DataFrame:
    return _rows(t["asset_part"].where("indexing_profile is null").join(t["membership_block"].select("asset_part_id"), "asset_part_id", "left_semi"), "asset_part_id")


rule("NON_CANONICAL_CONTENT_HASH", "asset", "warning", "deep")(lambda t: _rows(t["asset"].where(F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(canonical_hash(F.col("content_hash")))), "asset_id", F.col("content_hash")))


@rule("CITY_OBJECT_GRAPH_CYCLE", "relationship", level="deep")
def _cycles(t: Tables) -> DataFrame:
    inside = t["relationship_type"].where("category = 'containment'").select("relationship_type_id")
    e = t["relationship"].where("to_city_object_id is not null").join(inside, "relationship_type_id", "left_semi")
    end = lambda c: F.concat_ws("/", F.coalesce("graph_name", F.lit("")), F.col(c).cast("string"))
    return _rows(graph.cycle_members(e.select(end("from_city_object_id").alias("src"), end("to_city_object_id").alias("dst"))), "object_id")


_where("ANNOTATION_UNKNOWN_STATUS", "annotation", "annotation_id", lambda: ~F.col("status").isin(STATUSES), level="deep", details="status")
_where("ANNOTATION_CONFIDENCE_OUT_OF_RANGE", "annotation", "annotation_id", lambda: ~F.col("confidence").between(0.0, 1.0), level="deep", details="confidence")
_where("ANNOTATION_ATTRIBUTES_NOT_JSON", "annotation", "annotation_id", lambda: F.col("attributes_json").isNotNull() & F.try_parse_json("attributes_json").isNull(), level="deep")
_where("CITY_OBJECT_UNKNOWN_STATUS", "city_object", "city_object_id", lambda: ~F.col("object_status").isin(OBJECT_STATUSES), level="deep", details="object_status")


def path_key(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$['{key}']").isNotNull()


rule("PATH_IN_ATTRIBUTES", "annotation", "warning", "deep")(lambda t: _rows(t["annotation"].where(F.col("attributes_json").rlike(r'"[a-z]+:path"\s*:')), "annotation_id"))


def file_states(assets: DataFrame, base_dir: str) -> DataFrame:
    """(asset_id, uri, status, recorded_hash, actual_hash): ok, missing, changed or unhashed, each file read in pieces where it lies."""

    def look(batches):
        for pdf in batches:
            out = []
            for i, uri, recorded in zip(pdf["asset_id"], pdf["uri"], pdf["recorded"]):
                state, actual = file_hash(uri, base_dir)
                sha = isinstance(recorded, str) and recorded.startswith("sha256:")
                out.append((i, uri, "missing" if state == "missing" else "unhashed" if not sha else "ok" if actual == recorded else "changed", recorded if isinstance(recorded, str) else None, actual))
            yield pd.DataFrame(out, columns=["asset_id", "uri", "status", "recorded_hash", "actual_hash"])

    rows = assets.select("asset_id", "uri", canonical_hash(F.col("content_hash")).alias("recorded"))
    return rows.mapInPandas(look, "asset_id long, uri string, status string, recorded_hash string, actual_hash string")


def local_path(uri: str, base_dir: str) -> str:
    """A file's path from a path or a file: uri, relative ones from ``base_dir``; other schemes raise."""
    parsed = urlparse(uri)
    if parsed.scheme and len(parsed.scheme) > 1 and parsed.scheme != "file":
        raise StoreError(f"no local file: {uri}")
    path = unquote(parsed.path) if parsed.scheme == "file" else uri
    return path if path.startswith("/") else f"{base_dir}/{path}"


def file_hash(uri: str, base_dir: str) -> tuple[str, str | None]:
    try:
        digest = hashlib.sha256()
        with open(local_path(uri, base_dir), "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
        return "there", f"sha256:{digest.hexdigest()}"
    except (OSError, StoreError):
        return "missing", None


for _code, _state, _sev in (("ASSET_FILE_MISSING", "missing", "error"), ("ASSET_FILE_CHANGED", "changed", "error"), ("ASSET_NOT_HASHED", "unhashed", "warning")):
    rule(_code, "asset", _sev, "external")(lambda t, s=_state: _rows(t["asset_files"].where(F.col("status") == s), "asset_id", F.col("uri")) if "asset_files" in t else None)


#: What a file's or store's header can lack: found by its reader, given to ``run`` as the table ``header`` (code, row_id, details).
for _code, _severity, _table in [
    ("INVALID_GPKG_APPLICATION_ID", "error", "header"), ("OLD_GPKG_USER_VERSION", "warning", "header"), ("MISSING_GPKG_TABLE", "error", "gpkg"), ("MISSING_GPKG_SRS", "error", "gpkg_spatial_ref_sys"), ("MISSING_EXTENSION_ROW", "warning", "gpkg_extensions"),
    ("MISSING_GIS_ATTRIBUTE_LAYER", "warning", "gpkg_contents"), ("MISSING_GIS_FEATURES_LAYER", "warning", "gpkg_contents"), ("INCONSISTENT_FEATURES_LAYER", "error", "gpkg_contents"), ("FEATURES_LAYER_SRS_MISMATCH", "error", "gpkg_geometry_columns"),
    ("MISSING_PROFILE", "error", "manifest"), ("INVALID_PACKAGE_IRI", "error", "manifest"), ("CORRUPT_EXTENT_BLOB", "error", "asset_extent"), ("EXTENT_SRS_MISMATCH", "error", "asset_extent"),
]:
    rule(_code, _table, _severity)(lambda t, c=_code: _rows(t["header"].where(F.col("code") == c), "row_id", F.col("details")))


class Absent(KeyError):
    """A rule asked for a table that is not given."""


class _Given(dict):
    def __missing__(self, name: str):
        raise Absent(name)


def run(tables: Tables, level: str = "basic", codes: list[str] | None = None, base_dir: str | None = None, skipped: list[tuple[str, str]] | None = None) -> DataFrame:
    """All issues up to ``level``; rules whose tables are not given are left out, and told as (code, table) in ``skipped``."""
    if level not in LEVELS:
        raise StoreError(f"no validation level: {level!r}")
    if level == "external" and base_dir is not None:
        tables = {**tables, "asset_files": file_states(tables["asset"], base_dir)}
    given, out = _Given(tables), None
    for r in RULES.values():
        if LEVELS.index(r.level) > LEVELS.index(level) or (codes is not None and r.code not in codes):
            continue
        try:
            found = r.check(given)
        except Absent as e:
            if skipped is not None:
                skipped.append((r.code, e.args[0]))
            continue
        if found is not None:
            rows = found.select(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), F.lit(r.table).alias("table_name"), "row_id", "details")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise StoreError("no rule applies")
    return out


def is_ok(issues: DataFrame) -> bool:
    """Warnings aside, whether nothing is broken."""
    return issues.where("severity = 'error'").isEmpty()
