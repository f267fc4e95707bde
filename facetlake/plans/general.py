"""Queries p1 to p4 and p6 over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.functions.text import instant_seconds, iso_utc, local_us, strip, uri_key
from facetlake.operators import hierarchy, history, instants, orphans, shred
from facetlake.session import written
from facetlake.sources.tables import table


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of both sources; an entry is the only object where a document has its list of annotations."""
    batch, raw = table(spark, folder, "example_annotation_batch"), table(spark, folder, "batch_raw")
    entry = F.struct(F.struct("annotation_uid", "attributes", "attributes_json", "memberships").alias("annotations"))
    return shred.struct_adjacency(batch, "example_annotation_batch", "entry_id", entry).unionByName(written(shred.adjacency(raw, "batch_raw", "raw_id", F.col("payload"))))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.annotation_entities(_nodes(spark, folder))[2]


def p1_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return shred.annotation_entities(_nodes(spark, folder))[0]


def p1_memberships(spark: SparkSession, folder: str) -> DataFrame:
    return shred.annotation_entities(_nodes(spark, folder))[1].drop("method", "annotation_uid")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    rel = table(spark, folder, "imported_relationship").where("to_uid is not null and from_uid is not null")
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    kinds = table(spark, folder, "relationship_type").where("category = 'containment'").select(F.col("local_name").alias("relationship_type"), blank("code_space").alias("cs")).distinct()
    edges = rel.withColumn("cs", blank("code_space")).join(kinds, ["relationship_type", "cs"], "left_semi")
    edges = edges.select(F.lit("imported_relationship").alias("hierarchy"), F.col("graph_name").alias("scope"), F.col("to_uid").alias("node"), F.col("from_uid").alias("parent"))
    con = table(spark, folder, "local_minimal_example").where("local_name is not null").select(F.coalesce("scheme", F.lit("")).alias("scheme"), "local_name", "class_uri", "concept_iri", strip(F.col("parent_uri")).alias("alias"))
    aliases = con.select("scheme", "local_name", F.explode(F.array("local_name", "class_uri", "concept_iri")).alias("alias")).where("alias is not null").groupBy("scheme", "alias").agg(F.min("local_name").alias("parent"))
    given = con.select("scheme", F.col("local_name").alias("node"), F.when(F.col("alias") != "", F.col("alias")).alias("alias")).distinct().join(aliases, ["scheme", "alias"], "left")
    return edges.distinct().unionByName(given.select(F.lit("local_minimal_example").alias("hierarchy"), F.col("scheme").alias("scope"), "node", "parent"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy_table(_links(spark, folder))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, folder))


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "example_annotation_batch").select("entry_id", "assessed_at", "site_tz", F.col("attributes.source").alias("source"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """By the stated conventions alone, which leave nothing to learn; a text that only another convention can read names no instant."""
    return instants.stated_instants(_timed(spark, folder), "entry_id", "assessed_at", "site_tz").withColumnRenamed("row_id", "entry_id").distinct()


def p3_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Without stated conventions: what each entry's text is taken for, how surely, and whether that is left open."""
    return instants.normalise_instants(_timed(spark, folder), "entry_id", "assessed_at", "site_tz", "source").drop("stated").withColumnRenamed("row_id", "entry_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "usap_assessment").select(
        "annotation_id", instant_seconds(F.col("assessed_at")).alias("at"), "updated_at", "assessment_id",
        F.lower(strip(F.col("status"))).alias("status"), F.round("confidence", 4).alias("confidence"),
    )
    v = history.attribute_history(rows, "annotation_id", "at", ["updated_at", "assessment_id"], ["status", "confidence"], F.col("status") == "superseded")
    return v.select("annotation_id", iso_utc(F.col("valid_from")).alias("valid_from"), F.coalesce(iso_utc(F.col("valid_to")), F.lit("")).alias("valid_to"))


def p4_change_log(spark: SparkSession, folder: str) -> DataFrame:
    """The per-attribute change log: when status and confidence of an annotation took which value."""
    rows = table(spark, folder, "usap_assessment").select(
        "annotation_id", instant_seconds(F.col("assessed_at")).alias("at"), "updated_at", "assessment_id",
        F.lower(strip(F.col("status"))).alias("status"), F.round("confidence", 4).alias("confidence"),
    )
    events = history.latest_statements(rows, "annotation_id", "at", ["updated_at", "assessment_id"], ["status", "confidence"])
    log = history.change_log(events, "annotation_id", "at", ["status", "confidence"])
    value = F.when(F.col("attribute") == "status", F.col("s0.v")).otherwise(F.col("s1.v").cast("string"))
    return log.select("annotation_id", iso_utc(F.col("at")).alias("changed_at"), "attribute", value.alias("value"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rel, open_, batch = (table(spark, folder, n) for n in ("imported_relationship", "unresolved_target", "example_annotation_batch"))

    def ref(df: DataFrame, name: str, field: str, row_id: str, domain: str, key, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(row_id).alias("row_id"), F.lit(domain).alias("domain"), key.alias("ref_key"), local_us(F.col(at)).alias("at_us"))

    parts = batch.select("entry_id", "received_at", F.explode("memberships").alias("m"))
    refs = (
        ref(rel, "imported_relationship", "to_external_uri", "relationship_id", "gml_id", uri_key(F.col("to_external_uri")), "imported_at")
        .unionByName(ref(open_, "unresolved_target", "href", "unresolved_id", "gml_id", uri_key(F.col("href")), "noted_at"))
        .unionByName(ref(batch, "example_annotation_batch", "city_object_uid", "entry_id", "object_uid", strip(F.col("city_object_uid")), "received_at"))
        .unionByName(ref(parts, "example_annotation_batch", "memberships.asset_part_id", "entry_id", "asset_part", F.col("m.asset_part_id").cast("string"), "received_at"))
    )
    obj, part = table(spark, folder, "city_object"), table(spark, folder, "asset_part")

    def parent(df: DataFrame, domain: str, key: str) -> DataFrame:
        return df.select(F.lit(domain).alias("domain"), F.col(key).cast("string").alias("key"), local_us(F.col("registered_at")).alias("registered_us"), F.col("removed_at").isNotNull().alias("removed"))

    return orphans.orphan_references(refs, parent(obj, "gml_id", "gml_id").unionByName(parent(obj, "object_uid", "object_uid")).unionByName(parent(part, "asset_part", "asset_part_id")))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field, kind and period."""
    return p6_found(spark, folder).groupBy("ref_table", "ref_field", "orphan_kind", "period").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ref_key").alias("n_keys"))


def queries() -> dict:
    names = [p1_found, p1_annotations, p1_memberships, p2_found, p2_descendants, p3_found, p3_readings, p4_found, p4_change_log, p6_found, p6_report]
    return {f.__name__: f for f in names}


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_URI_KEY = "CASE WHEN contains(u, '#') THEN url_decode(split_part(u, '#', -1)) WHEN lower(u) LIKE 'urn:%' THEN url_decode(split_part(u, ':', -1)) END"
_STATED = f"""WITH e AS (SELECT annotation_id, CAST(epoch(CAST(assessed_at AS TIMESTAMPTZ)) AS BIGINT) sec, updated_at, assessment_id, lower({_STRIP.format("status")}) st, round(confidence, 4) cf FROM usap_assessment WHERE assessed_at IS NOT NULL AND annotation_id IS NOT NULL),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY annotation_id, sec ORDER BY updated_at DESC NULLS LAST, assessment_id DESC) = 1),"""
_TREE = f"""WITH RECURSIVE kinds AS (SELECT DISTINCT local_name, coalesce(trim(code_space), '') cs FROM relationship_type WHERE category = 'containment'),
alias AS (SELECT scheme, a, min(local_name) p FROM (SELECT coalesce(scheme, '') scheme, local_name, unnest([local_name, class_uri, concept_iri]) a FROM local_minimal_example) WHERE a IS NOT NULL GROUP BY ALL),
given AS (SELECT 'imported_relationship' h, coalesce(graph_name, '') s, to_uid n, from_uid p FROM imported_relationship r SEMI JOIN kinds k ON k.local_name = r.relationship_type AND k.cs = coalesce(trim(r.code_space), '') WHERE to_uid IS NOT NULL AND from_uid IS NOT NULL
  UNION SELECT 'local_minimal_example', coalesce(c.scheme, ''), c.local_name, a.p FROM local_minimal_example c LEFT JOIN alias a ON a.scheme = coalesce(c.scheme, '') AND a.a = {_STRIP.format("c.parent_uri")} AND a.a <> ''),
up AS (SELECT h, s, n, min(p) p FROM (SELECT * FROM given UNION ALL SELECT h, s, p, NULL FROM given WHERE p IS NOT NULL) GROUP BY ALL),
anc(h, s, n, a) AS (SELECT h, s, n, p FROM up WHERE p IS NOT NULL UNION SELECT x.h, x.s, x.n, u.p FROM anc x JOIN up u ON u.h = x.h AND u.s = x.s AND u.n = x.a WHERE u.p IS NOT NULL),
looped AS (SELECT h, s, n FROM anc WHERE n = a), hit AS (SELECT DISTINCT x.h, x.s, x.n FROM anc x SEMI JOIN looped l ON l.h = x.h AND l.s = x.s AND l.n = x.a),
depth AS (SELECT h, s, n, count(*) d FROM anc GROUP BY ALL), below AS (SELECT h, s, a n, count(*) k FROM anc GROUP BY ALL),"""
ORACLE = {
    "p2_found": f"""{_TREE}
line AS (SELECT x.h, x.s, x.n, string_agg(x.a, '/' ORDER BY coalesce(d.d, 0)) trail, min_by(x.a, coalesce(d.d, 0)) root FROM anc x LEFT JOIN depth d ON d.h = x.h AND d.s = x.s AND d.n = x.a GROUP BY ALL)
SELECT u.h AS hierarchy, u.s AS scope, u.n AS node, CASE WHEN t.n IS NOT NULL THEN '' ELSE coalesce(line.root, u.n) END AS root, CAST(CASE WHEN l.n IS NOT NULL THEN -1 WHEN t.n IS NOT NULL THEN -2 ELSE coalesce(d.d, 0) END AS INTEGER) AS depth,
CAST(CASE WHEN t.n IS NOT NULL THEN -1 ELSE coalesce(b.k, 0) END AS INTEGER) AS n_descendants, CASE WHEN t.n IS NOT NULL THEN '' ELSE coalesce(line.trail || '/' || u.n, u.n) END AS path
FROM up u LEFT JOIN looped l USING (h, s, n) LEFT JOIN hit t USING (h, s, n) LEFT JOIN depth d USING (h, s, n) LEFT JOIN below b USING (h, s, n) LEFT JOIN line USING (h, s, n)""",
    "p4_found": f"""{_STATED}
c AS (SELECT * FROM d WINDOW w AS (PARTITION BY annotation_id ORDER BY sec) QUALIFY row_number() OVER w = 1 OR st IS DISTINCT FROM lag(st) OVER w OR cf IS DISTINCT FROM lag(cf) OVER w),
v AS (SELECT *, lead(sec) OVER (PARTITION BY annotation_id ORDER BY sec) nxt FROM c)
SELECT annotation_id, strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS valid_from, coalesce(strftime(make_timestamp(nxt * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '') AS valid_to FROM v WHERE st IS DISTINCT FROM 'superseded'""",
    "p4_change_log": f"""{_STATED}
x AS (SELECT annotation_id, sec, 'status' a, st v FROM d UNION ALL SELECT annotation_id, sec, 'confidence', CAST(cf AS VARCHAR) FROM d)
SELECT annotation_id, strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS changed_at, a AS attribute, v AS value FROM x WINDOW w AS (PARTITION BY annotation_id, a ORDER BY sec) QUALIFY row_number() OVER w = 1 OR v IS DISTINCT FROM lag(v) OVER w""",
    "p6_found": f"""WITH refs AS (SELECT 'imported_relationship' ref_table, 'to_external_uri' ref_field, relationship_id row_id, 'g' dom, {_URI_KEY} k, imported_at seen FROM (SELECT *, {_STRIP.format("to_external_uri")} u FROM imported_relationship)
UNION ALL SELECT 'unresolved_target', 'href', unresolved_id, 'g', {_URI_KEY}, noted_at FROM (SELECT *, {_STRIP.format("href")} u FROM unresolved_target)
UNION ALL SELECT 'example_annotation_batch', 'city_object_uid', entry_id, 'u', {_STRIP.format("city_object_uid")}, received_at FROM example_annotation_batch
UNION ALL SELECT 'example_annotation_batch', 'memberships.asset_part_id', entry_id, 'p', CAST(m.asset_part_id AS VARCHAR), received_at FROM (SELECT entry_id, received_at, unnest(memberships) m FROM example_annotation_batch)),
have AS (SELECT dom, k, min(registered_at) FILTER (WHERE removed_at IS NULL) live FROM (SELECT 'g' dom, gml_id k, registered_at, removed_at FROM city_object UNION ALL SELECT 'u', object_uid, registered_at, removed_at FROM city_object
UNION ALL SELECT 'p', CAST(asset_part_id AS VARCHAR), registered_at, removed_at FROM asset_part) WHERE k IS NOT NULL GROUP BY ALL),
j AS (SELECT r.*, CASE WHEN h.k IS NULL THEN 'missing' WHEN h.live IS NULL THEN 'deleted' WHEN h.live > r.seen THEN 'late' END kind FROM refs r LEFT JOIN have h ON h.dom = r.dom AND h.k = r.k WHERE trim(r.k) <> '')
SELECT DISTINCT ref_table, ref_field, row_id, k AS ref_key, kind AS orphan_kind, strftime(seen, '%Y-%m') AS period FROM j WHERE kind IS NOT NULL""",
}
ORACLE["p2_descendants"] = f"""{_TREE.rstrip().rstrip(",")}
SELECT x.h AS hierarchy, x.s AS scope, x.a AS ancestor, x.n AS descendant, d.d - coalesce(e.d, 0) AS distance FROM anc x JOIN depth d ON d.h = x.h AND d.s = x.s AND d.n = x.n LEFT JOIN depth e ON e.h = x.h AND e.s = x.s AND e.n = x.a
ANTI JOIN hit t ON t.h = x.h AND t.s = x.s AND t.n = x.n"""
ORACLE["p6_report"] = f"SELECT ref_table, ref_field, orphan_kind, period, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT ref_key) AS BIGINT) AS n_keys FROM ({ORACLE['p6_found']}) GROUP BY ALL"
# A list, a list of one for anything else that is there, nothing for NULL.
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'NULL' THEN [] ELSE [{0}] END"
_DOCS = f"""r AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN CAST(payload AS JSON) END END doc FROM batch_raw),
a0 AS (SELECT raw_id, {_LIST.format("x")} l FROM (SELECT raw_id, json_extract(doc, '$.annotations') x FROM r WHERE doc IS NOT NULL) WHERE x IS NOT NULL),
a AS (SELECT raw_id, pos ap, x FROM (SELECT raw_id, unnest(l) x, generate_subscripts(l, 1) - 1 pos FROM a0) WHERE json_type(x) = 'OBJECT'),
m0 AS (SELECT raw_id, ap, x doc, coalesce(json_extract_string(x, '$.attributes.method'), CASE WHEN json_valid(json_extract_string(x, '$.attributes_json')) THEN json_extract_string(json_extract_string(x, '$.attributes_json'), '$.method') END, '') method, {_LIST.format("y")} l FROM (SELECT *, json_extract(x, '$.memberships') y FROM a)),
m AS (SELECT raw_id, ap, method, pos mp, x FROM (SELECT raw_id, ap, method, unnest(l) x, generate_subscripts(l, 1) - 1 pos FROM m0 WHERE l IS NOT NULL) WHERE json_type(x) = 'OBJECT')"""
_TEXT = "CASE WHEN json_type(json_extract(x, '$.{0}')) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(x, '$.{0}') END"
_METHOD = "coalesce(attributes.method, json_extract_string(attributes_json, '$.method'), '')"
ORACLE["p1_annotations"] = f"""WITH {_DOCS}
SELECT 'example_annotation_batch' AS record_table, CAST(entry_id AS BIGINT) AS record_id, CAST(0 AS INTEGER) AS annotation_pos, annotation_uid, {_METHOD} AS method FROM example_annotation_batch
UNION ALL SELECT 'batch_raw', raw_id, CAST(ap AS INTEGER), {_TEXT.format("annotation_uid")}, method FROM (SELECT raw_id, ap, method, doc x FROM m0)"""
ORACLE["p1_memberships"] = f"""WITH {_DOCS}
SELECT 'example_annotation_batch' AS record_table, CAST(entry_id AS BIGINT) AS record_id, CAST(0 AS INTEGER) AS annotation_pos, CAST(pos AS INTEGER) AS membership_pos, CAST(m.asset_part_id AS VARCHAR) AS asset_part_id, m.asset_uri AS asset_uri, coalesce(m.part_path, '') AS part_path
FROM (SELECT entry_id, unnest(memberships) m, generate_subscripts(memberships, 1) - 1 pos FROM example_annotation_batch) WHERE m IS NOT NULL
UNION ALL SELECT 'batch_raw', raw_id, CAST(ap AS INTEGER), CAST(mp AS INTEGER), {_TEXT.format("asset_part_id")}, {_TEXT.format("asset_uri")}, coalesce({_TEXT.format("part_path")}, '') FROM m"""
ORACLE["p1_found"] = f"""WITH b AS (SELECT entry_id, {_METHOD} method, unnest(memberships) m, generate_subscripts(memberships, 1) - 1 pos FROM example_annotation_batch),
{_DOCS},
e AS (SELECT raw_id, ap, mp, method, coalesce(json_extract_string(x, '$.part_path'), '') pp, unnest({_LIST.format("y")}) i FROM (SELECT *, json_extract(x, '$.element_indices') y FROM m) WHERE y IS NOT NULL)
SELECT DISTINCT 'example_annotation_batch' AS record_table, CAST(entry_id AS BIGINT) AS record_id, CAST(0 AS INTEGER) AS annotation_pos, CAST(pos AS INTEGER) AS membership_pos, CAST(i AS BIGINT) AS element_index, pp AS part_path, method
FROM (SELECT entry_id, pos, method, coalesce(m.part_path, '') pp, unnest(m.element_indices) i FROM b WHERE m IS NOT NULL) WHERE i IS NOT NULL
UNION ALL SELECT DISTINCT 'batch_raw', raw_id, CAST(ap AS INTEGER), CAST(mp AS INTEGER), v, pp, method FROM (SELECT *, TRY_CAST(json_extract_string(i, '$') AS BIGINT) v FROM e) WHERE v IS NOT NULL"""
