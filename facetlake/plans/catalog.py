"""Catalogue and validation queries over the imported tables, each with its SQL.

The imported tables become a store whose object, type and concept ids are
their names: rules compare ids of any type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import blocks, catalog, validate
from facetlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def imported_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = lambda n: table(spark, folder, n)
    type_id = F.concat("local_name", F.lit("|"), F.coalesce("code_space", F.lit("")))
    rel, batch = t("imported_relationship"), t("example_annotation_batch")
    # Parts are named by id, else by uri and path; a name that no part has is for the orphan report, not for rules about blocks.
    named = t("asset_part").join(t("asset").select("asset_id", "uri"), "asset_id").groupBy("uri", "part_path").agg(F.min("asset_part_id").alias("by_uri"))
    stated = batch.select("entry_id", F.explode("memberships").alias("m")).select("entry_id", "m.*").drop("element_kind").withColumnRenamed("asset_uri", "uri")
    by_uri = stated.where("asset_part_id is null").join(named, ["uri", "part_path"]).select("entry_id", F.col("by_uri").alias("asset_part_id"), "element_indices")
    member = stated.where("asset_part_id is not null").select("entry_id", "asset_part_id", "element_indices").unionByName(by_uri).select("entry_id", "asset_part_id", F.explode("element_indices").alias("element_index")).where("element_index is not null")
    built = blocks.build_blocks(member, ["entry_id", "asset_part_id"])
    return {
        "asset": t("asset"), "asset_part": t("asset_part"),
        "city_object": t("city_object").withColumn("city_object_id", F.col("object_uid")),
        "relationship_type": t("relationship_type").withColumn("relationship_type_id", type_id),
        "relationship": rel.withColumns({
            "from_city_object_id": F.col("from_uid"), "to_city_object_id": F.col("to_uid"),
            "relationship_type_id": F.concat("relationship_type", F.lit("|"), F.coalesce("code_space", F.lit(""))),
        }),
        "semantic_class": t("local_minimal_example").select(F.col("local_name").alias("semantic_class_id"), "class_uri").distinct(),
        "annotation": batch.select(F.col("entry_id").alias("annotation_id"), F.col("concept").alias("semantic_class_id"), "status", "confidence", "attributes_json", F.lit(None).cast("string").alias("primary_city_object_id")),
        "assessment": t("usap_assessment"),
        "membership_block": built.withColumns({"membership_block_id": F.concat_ws("/", F.col("entry_id").cast("string"), F.col("asset_part_id").cast("string"), F.col("block_start").cast("string")), "annotation_id": F.col("entry_id"), "encoding": F.lit("roaring")}),
    }


_BLOCKS = """named AS (SELECT uri, part_path, min(asset_part_id) by_uri FROM asset_part JOIN asset USING (asset_id) GROUP BY ALL),
mb AS (SELECT entry_id, part, x - x % 16384 block_start, count(DISTINCT x) n, max(x) hi FROM (SELECT entry_id, coalesce(m.asset_part_id, by_uri) part, unnest(m.element_indices) x
FROM (SELECT entry_id, unnest(memberships) m FROM example_annotation_batch) LEFT JOIN named ON m.asset_part_id IS NULL AND uri = m.asset_uri AND named.part_path = m.part_path WHERE coalesce(m.asset_part_id, by_uri) IS NOT NULL) WHERE x IS NOT NULL GROUP BY ALL)"""
_MB_ID = "entry_id || '/' || part || '/' || block_start"
_TYPE = "relationship_type || '|' || coalesce(code_space, '')"
_ISSUES = {
    "ORPHAN_RELATIONSHIP_FROM": ("error", "relationship", "SELECT CAST(relationship_id AS VARCHAR), from_uid FROM imported_relationship WHERE from_uid IS NOT NULL AND from_uid NOT IN (SELECT object_uid FROM city_object WHERE object_uid IS NOT NULL)"),
    "ORPHAN_RELATIONSHIP_TO": ("error", "relationship", "SELECT CAST(relationship_id AS VARCHAR), to_uid FROM imported_relationship WHERE to_uid IS NOT NULL AND to_uid NOT IN (SELECT object_uid FROM city_object WHERE object_uid IS NOT NULL)"),
    "ORPHAN_RELATIONSHIP_TYPE": ("error", "relationship", f"SELECT CAST(relationship_id AS VARCHAR), {_TYPE} FROM imported_relationship WHERE {_TYPE} NOT IN (SELECT local_name || '|' || coalesce(code_space, '') FROM relationship_type)"),
    "ORPHAN_ASSESSMENT_ASSET": ("error", "assessment", "SELECT CAST(assessment_id AS VARCHAR), CAST(asset_id AS VARCHAR) FROM usap_assessment WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM asset)"),
    "ORPHAN_ANNOTATION_CLASS": ("error", "annotation", "SELECT CAST(entry_id AS VARCHAR), concept FROM example_annotation_batch WHERE concept IS NOT NULL AND concept NOT IN (SELECT local_name FROM local_minimal_example)"),
    "ORPHAN_MEMBERSHIP_ASSET_PART": ("error", "membership_block", f"SELECT {_MB_ID}, CAST(part AS VARCHAR) FROM mb WHERE part NOT IN (SELECT asset_part_id FROM asset_part)"),
    "DUPLICATE_SEMANTIC_CLASS_REGISTRATION": ("error", "semantic_class", "SELECT class_uri, CAST(count(DISTINCT local_name) AS VARCHAR) FROM local_minimal_example WHERE class_uri IS NOT NULL GROUP BY class_uri HAVING count(DISTINCT local_name) > 1"),
    "ASSESSMENT_UNKNOWN_STATUS": ("error", "assessment", "SELECT CAST(assessment_id AS VARCHAR), status FROM usap_assessment WHERE status NOT IN ('draft', 'accepted', 'rejected', 'superseded')"),
    "MISALIGNED_BLOCK_START": ("warning", "membership_block", f"SELECT {_MB_ID}, CAST(block_start AS VARCHAR) FROM mb WHERE block_start % 16384 <> 0"),
    "MEMBERSHIP_OUT_OF_ASSET_PART_RANGE": ("error", "membership_block", f"SELECT {_MB_ID}, CAST(element_count AS VARCHAR) FROM mb JOIN asset_part ON asset_part_id = part WHERE hi >= element_count"),
    "MEMBERSHIP_COUNT_MISMATCH": ("error", "membership_block", f"SELECT {_MB_ID}, CAST(n AS VARCHAR) FROM mb WHERE false"),
    "DUPLICATE_GML_ID": ("error", "city_object", "SELECT gml_id, CAST(count(*) AS VARCHAR) FROM city_object WHERE gml_id <> '' GROUP BY gml_id HAVING count(*) > 1"),
    "DUPLICATE_ASSET_URI": ("warning", "asset", "SELECT uri, CAST(count(*) AS VARCHAR) FROM asset GROUP BY uri HAVING count(*) > 1 AND count(*) > count(content_hash)"),
    "DUPLICATE_RELATIONSHIP_EDGE": ("warning", "relationship", f"SELECT CAST(min(relationship_id) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM imported_relationship GROUP BY graph_name, from_uid, to_uid, to_external_uri, {_TYPE}, role, source_asset_id HAVING count(*) > 1"),
    "UNCLASSIFIED_RELATIONSHIP_TYPE": ("warning", "relationship_type", f"SELECT t, CAST(n AS VARCHAR) FROM (SELECT {_TYPE} t, count(*) n FROM imported_relationship GROUP BY 1) JOIN (SELECT local_name || '|' || coalesce(code_space, '') t FROM relationship_type WHERE category IS NULL) USING (t)"),
    "UNRESOLVED_RELATIONSHIP_TARGET": ("warning", "relationship", "SELECT CAST(count(*) AS VARCHAR), (SELECT string_agg(CAST(relationship_id AS VARCHAR), ',' ORDER BY relationship_id) FROM (SELECT relationship_id FROM imported_relationship WHERE to_external_uri IS NOT NULL ORDER BY 1 LIMIT 5)) FROM imported_relationship WHERE to_external_uri IS NOT NULL"),
    "MIXED_ASSET_CRS": ("warning", "asset", "SELECT CAST(count(DISTINCT srs_id) AS VARCHAR), (SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) FROM (SELECT DISTINCT srs_id s FROM asset WHERE srs_id IS NOT NULL)) FROM asset HAVING count(DISTINCT srs_id) > 1"),
    "ASSET_PART_NO_INDEXING_PROFILE": ("warning", "asset_part", "SELECT CAST(asset_part_id AS VARCHAR), '' FROM asset_part WHERE indexing_profile IS NULL AND asset_part_id IN (SELECT part FROM mb)"),
    "NON_CANONICAL_CONTENT_HASH": ("warning", "asset", "SELECT CAST(asset_id AS VARCHAR), content_hash FROM asset WHERE content_hash IS NOT NULL AND NOT regexp_full_match(content_hash, '[a-z0-9]+:[0-9a-f]+')"),
    "CITY_OBJECT_GRAPH_CYCLE": ("error", "relationship", "SELECT n, '' FROM looped"),
    "ANNOTATION_UNKNOWN_STATUS": ("error", "annotation", "SELECT CAST(entry_id AS VARCHAR), status FROM example_annotation_batch WHERE status NOT IN ('draft', 'accepted', 'rejected', 'superseded')"),
    "ANNOTATION_CONFIDENCE_OUT_OF_RANGE": ("error", "annotation", "SELECT CAST(entry_id AS VARCHAR), CAST(confidence AS VARCHAR) FROM example_annotation_batch WHERE NOT confidence BETWEEN 0 AND 1"),
    "ANNOTATION_ATTRIBUTES_NOT_JSON": ("error", "annotation", "SELECT CAST(entry_id AS VARCHAR), '' FROM example_annotation_batch WHERE attributes_json IS NOT NULL AND NOT json_valid(attributes_json)"),
    "CITY_OBJECT_UNKNOWN_STATUS": ("error", "city_object", "SELECT object_uid, object_status FROM city_object WHERE object_status NOT IN ('accepted', 'temporary')"),
    "PATH_IN_ATTRIBUTES": ("warning", "annotation", "SELECT CAST(entry_id AS VARCHAR), '' FROM example_annotation_batch WHERE regexp_matches(attributes_json, '\"[a-z]+:path\"\\s*:')"),
}
_GRAPH = f"""edge AS (SELECT DISTINCT coalesce(graph_name, '') || '/' || from_uid a, coalesce(graph_name, '') || '/' || to_uid b FROM imported_relationship WHERE from_uid IS NOT NULL AND to_uid IS NOT NULL
AND {_TYPE} IN (SELECT local_name || '|' || coalesce(code_space, '') FROM relationship_type WHERE category = 'containment')),
walk(a, b) AS (SELECT a, b FROM edge UNION SELECT w.a, e.b FROM walk w JOIN edge e ON e.a = w.b),
looped AS (SELECT DISTINCT n FROM (SELECT a n FROM walk WHERE a = b UNION SELECT b FROM walk WHERE a IN (SELECT a FROM walk WHERE a = b)))"""


def _issues_sql(codes: list[str]) -> str:
    parts = [f"SELECT '{_ISSUES[c][0]}' AS severity, '{c}' AS code, '{_ISSUES[c][1]}' AS table_name, CAST(x.r AS VARCHAR) AS row_id, x.d AS details FROM ({_ISSUES[c][2]}) x(r, d)" for c in codes]
    return f"WITH RECURSIVE {_BLOCKS},\n{_GRAPH}\n" + "\nUNION ALL ".join(parts)


_BASIC = [c for c in _ISSUES if validate.RULES[c].level == "basic"]
_DEEP = [c for c in _ISSUES if validate.RULES[c].level == "deep"]


@query(_issues_sql(_BASIC))
def validate_basic(spark: SparkSession, folder: str) -> DataFrame:
    return validate.run(imported_store(spark, folder), "basic", _BASIC)


@query(_issues_sql(_DEEP))
def validate_deep(spark: SparkSession, folder: str) -> DataFrame:
    return validate.run(imported_store(spark, folder), "deep", _DEEP)


@query("""SELECT a.asset_id, uri, asset_kind, media_type, content_hash, srs_id, CAST(coalesce(p.n, 0) AS BIGINT) part_count, CAST(coalesce(p.e, 0) AS BIGINT) element_count
FROM asset a LEFT JOIN (SELECT asset_id, count(*) n, sum(element_count) e FROM asset_part GROUP BY 1) p USING (asset_id)""")
def assets_list(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_assets(table(spark, folder, "asset"), table(spark, folder, "asset_part"))


@query("""SELECT a.asset_id, uri, asset_kind, media_type, content_hash, srs_id, CAST(coalesce(p.n, 0) AS BIGINT) part_count, CAST(coalesce(p.e, 0) AS BIGINT) element_count
FROM asset a LEFT JOIN (SELECT asset_id, count(*) n, sum(element_count) e FROM asset_part GROUP BY 1) p USING (asset_id) WHERE asset_kind = 'mesh'""")
def assets_list_meshes(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_assets(table(spark, folder, "asset"), table(spark, folder, "asset_part"), "mesh")


@query("SELECT asset_id, min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy FROM asset_part WHERE minx IS NOT NULL AND miny IS NOT NULL AND maxx IS NOT NULL AND maxy IS NOT NULL GROUP BY asset_id")
def asset_extents(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.asset_extents(table(spark, folder, "asset_part"))


@query("""SELECT t.relationship_type_id, t.local_name, t.code_space, t.category, CAST(coalesce(e.n, 0) AS BIGINT) edge_count FROM relationship_type t
LEFT JOIN (SELECT relationship_type ln, coalesce(code_space, '') cs, count(*) n FROM imported_relationship GROUP BY ALL) e ON e.ln = t.local_name AND e.cs = coalesce(t.code_space, '')""")
def relationship_types_list(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_relationship_types(table(spark, folder, "relationship_type"), table(spark, folder, "imported_relationship")).select("relationship_type_id", "local_name", "code_space", "category", "edge_count")


@query("""SELECT city_object_id, object_uid, object_status, gml_id, uri source_asset_uri FROM city_object LEFT JOIN asset ON asset_id = source_asset_id
WHERE object_status = 'accepted' AND (object_uid ILIKE '%WALL%' OR gml_id ILIKE '%WALL%')""")
def objects_search(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_objects(table(spark, folder, "city_object"), table(spark, folder, "asset"), "WALL", "accepted")


@query("""SELECT c.*, CAST(coalesce(n, 0) AS BIGINT) annotation_count, n IS NOT NULL in_use FROM (SELECT scheme, local_name, min(class_uri) class_uri, min(concept_iri) concept_iri, max(is_ade) is_ade FROM local_minimal_example GROUP BY ALL) c
LEFT JOIN (SELECT scheme, concept local_name, count(*) n FROM example_annotation_batch GROUP BY ALL) u USING (scheme, local_name) WHERE local_name ILIKE '%roof%'""")
def concepts_search(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_concepts(table(spark, folder, "local_minimal_example"), table(spark, folder, "example_annotation_batch").select("scheme", "concept"), search="roof")


@query("""SELECT assessment_id, annotation_id, assessed_at, CAST(row_number() OVER (PARTITION BY annotation_id ORDER BY assessed_at IS NOT NULL, assessed_at, assessment_id) AS BIGINT) place FROM usap_assessment""")
def assessments_in_order(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.assessment_places(table(spark, folder, "usap_assessment")).select("assessment_id", "annotation_id", "assessed_at", "place")


@query("SELECT asset_id, content_hash, CASE WHEN regexp_full_match(content_hash, '[a-z0-9]+:[0-9a-f]+') THEN content_hash WHEN regexp_full_match(content_hash, '[0-9A-Fa-f]{64}') THEN 'sha256:' || lower(content_hash) END canonical FROM asset")
def asset_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "asset").select("asset_id", "content_hash", catalog.canonical_hash(F.col("content_hash")).alias("canonical"))


def queries() -> dict:
    return QUERIES
