"""Validation over stores with planted breaks, so that every rule about blocks, values, paths and links finds something; each with its SQL.

The star-schema claims become store tables in which every claim of a residue
class is broken in one way. The SQL plants the same breaks and states each rule
by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import blocks, graph, validate, values
from facetlake.plans.projection import CHUNK, Projection, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_KEY = ["assessment_id", "annotation_id", "asset_part_id", "element_kind"]
_OTHERS = 1_000_000


def _named(codes: dict[str, tuple[str, str, str]], ctes: str, tables: Callable[[Projection], dict[str, DataFrame]], name: str) -> None:
    """Registers a query over ``tables``: every code of ``codes`` (severity, table, SQL giving row_id and details)."""
    body = "\nUNION ALL ".join(f"SELECT '{s}' AS severity, '{c}' AS code, '{t}' AS table_name, CAST(x.r AS VARCHAR) AS row_id, coalesce(CAST(x.d AS VARCHAR), '') AS details FROM ({sql}) x(r, d)" for c, (s, t, sql) in codes.items())
    sql = with_views(body + "\n--" + ctes)  # the views that the tables below need
    head = sql[: sql.rindex(body)].rstrip()
    ORACLE[name] = f"{head + ',' if head else 'WITH'}\n{ctes}\n{body}"
    QUERIES[name] = lambda spark, folder: validate.run(tables(Projection(spark, folder)), "deep", list(codes)).withColumn("details", F.coalesce("details", F.lit("")))


def _when(k: Column, n: int, broken, sound) -> Column:
    return F.when(k == n, broken).otherwise(sound)


# --- memberships, assessments and links


def _members(p: Projection) -> dict[str, DataFrame]:
    none = lambda kind: F.lit(None).cast(kind)
    stated = p.stated_elements().withColumns({"assessment_id": F.col("annotation_id") * 10_000 + F.col("assessed_year"), "element_kind": F.lit(1)})
    b, k = blocks.build_blocks(stated, _KEY), F.col("annotation_id") % 23
    mb = b.select(
        F.concat_ws("/", "assessment_id", "block_start").alias("membership_block_id"), _when(k, 14, F.col("assessment_id") + 5000, F.col("assessment_id")).alias("assessment_id"),
        _when(k, 13, F.col("annotation_id") + _OTHERS, F.col("annotation_id")).alias("annotation_id"), _when(k, 15, F.lit(99), F.col("asset_part_id")).alias("asset_part_id"), _when(k, 7, F.lit(2), F.lit(1)).alias("element_kind"),
        F.when(k == 3, -16384).when(k == 4, F.col("block_start") + 5).otherwise(F.col("block_start")).alias("block_start"), _when(k, 2, F.lit(0), F.lit(16384)).alias("block_size"), _when(k, 1, F.lit("zip"), F.lit("roaring")).alias("encoding"),
        F.when(k == 5, 0).when(k == 9, F.col("element_count") + 1).otherwise(F.col("element_count")).alias("element_count"),
        F.when(k == 6, F.col("max_element_index") + 1).when(k == 11, F.col("min_element_index") - 1).otherwise(F.col("min_element_index")).alias("min_element_index"), _when(k, 12, F.col("max_element_index") + 1, F.col("max_element_index")).alias("max_element_index"),
        F.when(k == 8, none("array<int>")).when(k == 10, F.array_append("offsets", F.lit(20000))).otherwise(F.col("offsets")).alias("offsets"),
    )
    years = stated.select("assessment_id", "annotation_id").distinct()
    a = p.annotations()
    own = a.where("primary_object_id is not null").select("annotation_id", F.col("primary_object_id").alias("city_object_id"))
    links = own.where(k != 21).select(_when(k, 0, F.col("annotation_id") + _OTHERS, F.col("annotation_id")).alias("annotation_id"), _when(k, 22, F.col("city_object_id") + 10 * _OTHERS, F.col("city_object_id")).alias("city_object_id"), F.lit("represents").alias("relation_type"))
    return {
        "asset": p.parts().select("asset_id").distinct(), "asset_part": p.parts(), "city_object": p.objects().select(F.col("object_id").alias("city_object_id")), "semantic_class": p.classes().select(F.col("class_id").alias("semantic_class_id"), "local_name"),
        "annotation": a.select("annotation_id", _when(k, 20, F.lit(9999), F.col("class_id")).alias("semantic_class_id"), F.col("primary_object_id").alias("primary_city_object_id"), _when(k, 18, F.lit("odd"), F.col("status")).alias("status")),
        "annotation_object": links, "membership_block": mb, "value_block": p.spark.createDataFrame([], "value_block_id string, assessment_id long, annotation_id long"),
        "assessment": years.select("assessment_id", _when(k, 17, F.col("annotation_id") + 2 * _OTHERS, F.col("annotation_id")).alias("annotation_id"), F.when(k == 16, 2).when(k == 19, 77).otherwise(1).cast("long").alias("asset_id"), F.lit("accepted").alias("status")),
    }


_GOOD = "mb WHERE encoding = 'roaring' AND block_size > 0"
_M = "membership_block"
_MEMBER_CTES = """b0 AS (SELECT annotation_id a, annotation_id % 23 k, annotation_id * 10000 + assessed_year s, element_index - element_index % 16384 bs, list(element_index % 16384 ORDER BY element_index) offs, count(*) n, min(element_index) lo, max(element_index) hi FROM member_element GROUP BY ALL),
mb AS (SELECT s || '/' || bs id, CASE k WHEN 14 THEN s + 5000 ELSE s END assessment_id, CASE k WHEN 13 THEN a + 1000000 ELSE a END annotation_id, CASE k WHEN 15 THEN 99 ELSE 1 END part, CASE k WHEN 7 THEN 2 ELSE 1 END kind, CASE k WHEN 3 THEN -16384 WHEN 4 THEN bs + 5 ELSE bs END block_start,
  CASE k WHEN 2 THEN 0 ELSE 16384 END block_size, CASE k WHEN 1 THEN 'zip' ELSE 'roaring' END encoding, CASE k WHEN 5 THEN 0 WHEN 9 THEN n + 1 ELSE n END element_count, CASE k WHEN 6 THEN hi + 1 WHEN 11 THEN lo - 1 ELSE lo END lo, CASE k WHEN 12 THEN hi + 1 ELSE hi END hi,
  CASE k WHEN 8 THEN NULL WHEN 10 THEN list_append(offs, 20000) ELSE offs END offs FROM b0),
ass AS (SELECT s assessment_id, CASE k WHEN 17 THEN a + 2000000 ELSE a END annotation_id, CASE k WHEN 16 THEN 2 WHEN 19 THEN 77 ELSE 1 END asset_id FROM (SELECT DISTINCT s, a, k FROM b0)),
ann AS (SELECT annotation_id, annotation_id % 23 k, CASE annotation_id % 23 WHEN 20 THEN 9999 ELSE class_id END class_id, primary_object_id, CASE annotation_id % 23 WHEN 18 THEN 'odd' ELSE status END status FROM annotation_fact),
lnk AS (SELECT CASE k WHEN 0 THEN annotation_id + 1000000 ELSE annotation_id END annotation_id, CASE k WHEN 22 THEN primary_object_id + 10000000 ELSE primary_object_id END city_object_id FROM ann WHERE primary_object_id IS NOT NULL AND k <> 21)"""
_named({
    "ORPHAN_MEMBERSHIP_ANNOTATION": ("error", _M, "SELECT id, annotation_id FROM mb WHERE annotation_id NOT IN (SELECT annotation_id FROM ann)"),
    "ORPHAN_MEMBERSHIP_ASSET_PART": ("error", _M, "SELECT id, part FROM mb WHERE part NOT IN (SELECT asset_part_id FROM part_dim)"),
    "ORPHAN_MEMBERSHIP_ASSESSMENT": ("error", _M, "SELECT id, assessment_id FROM mb WHERE assessment_id NOT IN (SELECT assessment_id FROM ass)"),
    "ORPHAN_ASSESSMENT_ANNOTATION": ("error", "assessment", "SELECT assessment_id, annotation_id FROM ass WHERE annotation_id NOT IN (SELECT annotation_id FROM ann)"),
    "ORPHAN_ASSESSMENT_ASSET": ("error", "assessment", "SELECT assessment_id, asset_id FROM ass WHERE asset_id NOT IN (SELECT asset_id FROM part_dim)"),
    "ORPHAN_ANNOTATION_CLASS": ("error", "annotation", "SELECT annotation_id, class_id FROM ann WHERE class_id NOT IN (SELECT class_id FROM class_dim)"),
    "ORPHAN_ANNOTATION_OBJECT_ANNOTATION": ("error", "annotation_object", "SELECT annotation_id, annotation_id FROM lnk WHERE annotation_id NOT IN (SELECT annotation_id FROM ann)"),
    "ORPHAN_ANNOTATION_OBJECT_CITY_OBJECT": ("error", "annotation_object", "SELECT annotation_id, city_object_id FROM lnk WHERE city_object_id NOT IN (SELECT object_id FROM object_dim)"),
    "ASSESSMENT_ANNOTATION_MISMATCH": ("error", _M, "SELECT id, ass.annotation_id FROM mb JOIN ass USING (assessment_id) WHERE mb.annotation_id <> ass.annotation_id"),
    "MEMBERSHIP_OUTSIDE_ASSESSMENT_ASSET": ("error", _M, "SELECT id, p.asset_id FROM mb JOIN ass USING (assessment_id) JOIN part_dim p ON p.asset_part_id = part WHERE ass.asset_id <> p.asset_id"),
    "ASSESSMENT_WITHOUT_MEMBERSHIP": ("warning", "assessment", "SELECT assessment_id, '' FROM ass WHERE assessment_id NOT IN (SELECT assessment_id FROM mb)"),
    "ANNOTATION_PRIMARY_OBJECT_LINK_MISSING": ("error", "annotation", "SELECT annotation_id, primary_object_id FROM ann WHERE primary_object_id IS NOT NULL AND (annotation_id, primary_object_id) NOT IN (SELECT (annotation_id, city_object_id) FROM lnk)"),
    "ANNOTATION_UNKNOWN_STATUS": ("error", "annotation", "SELECT annotation_id, status FROM ann WHERE status = 'odd'"),
    "UNSUPPORTED_MEMBERSHIP_ENCODING": ("error", _M, "SELECT id, encoding FROM mb WHERE encoding <> 'roaring'"),
    "INVALID_BLOCK_SIZE": ("error", _M, "SELECT id, block_size FROM mb WHERE encoding = 'roaring' AND block_size <= 0"),
    "INVALID_BLOCK_START": ("error", _M, f"SELECT id, block_start FROM {_GOOD} AND block_start < 0"),
    "MISALIGNED_BLOCK_START": ("warning", _M, f"SELECT id, block_start FROM {_GOOD} AND block_start % block_size <> 0"),
    "EMPTY_MEMBERSHIP_BLOCK": ("error", _M, f"SELECT id, element_count FROM {_GOOD} AND element_count <= 0"),
    "INVALID_MEMBERSHIP_MIN_MAX": ("error", _M, f"SELECT id, '' FROM {_GOOD} AND lo > hi"),
    "CORRUPT_MEMBERSHIP_PAYLOAD": ("error", _M, f"SELECT id, '' FROM {_GOOD} AND offs IS NULL"),
    "MEMBERSHIP_COUNT_MISMATCH": ("error", _M, f"SELECT id, element_count FROM {_GOOD} AND len(offs) <> element_count"),
    "OFFSET_OUTSIDE_BLOCK": ("error", _M, f"SELECT id, '' FROM {_GOOD} AND list_max(offs) >= block_size"),
    "MIN_ELEMENT_MISMATCH": ("error", _M, f"SELECT id, lo FROM {_GOOD} AND list_min(offs) + block_start <> lo"),
    "MAX_ELEMENT_MISMATCH": ("error", _M, f"SELECT id, hi FROM {_GOOD} AND list_max(offs) + block_start <> hi"),
    "MEMBERSHIP_ELEMENT_KIND_MISMATCH": ("error", _M, "SELECT id, p.element_kind FROM mb JOIN part_dim p ON p.asset_part_id = part WHERE encoding = 'roaring' AND block_size > 0 AND kind <> p.element_kind"),
    "MEMBERSHIP_OUT_OF_ASSET_PART_RANGE": ("error", _M, "SELECT id, p.element_count FROM mb JOIN part_dim p ON p.asset_part_id = part WHERE encoding = 'roaring' AND block_size > 0 AND list_max(offs) + block_start >= p.element_count"),
}, _MEMBER_CTES, _members, "validate_broken_members")


# --- value fields


def _fields(p: Projection) -> dict[str, DataFrame]:
    first = p.t("part").agg(F.min("p_partkey").alias("lo"), F.count(F.lit(1)).alias("size"))
    shifted = p.value_elements().join(F.broadcast(first)).withColumn("element_index", F.col("element_index") - F.col("lo")).drop("lo", "size")
    f, at_first = F.col("f"), F.col("block_start") == 0
    vb = values.chunk_values(shifted, ["asset_part_id"], CHUNK).join(F.broadcast(p.spark.range(14).withColumnRenamed("id", "f")))
    top = F.broadcast(vb.agg(F.max("block_start").alias("top")))
    vb = vb.join(top).where(~((f == 6) & (F.col("block_start") == F.col("top")))).select(
        F.concat_ws("/", "f", "block_start").alias("value_block_id"), (f + 100).alias("assessment_id"), _when(f, 10, f + _OTHERS, f + 1).alias("annotation_id"), _when(f, 11, F.lit(77), F.lit(2)).cast("long").alias("asset_part_id"), _when(f, 4, F.lit(4), F.lit(2)).alias("element_kind"),
        F.when((f == 0) & (F.col("block_start") == F.col("top")), F.col("block_start") + 1).when((f == 3) & at_first, -CHUNK).when((f == 5) & (F.col("block_start") == CHUNK), CHUNK - 10).otherwise(F.col("block_start")).alias("block_start"), F.when((f == 2) & at_first, 0).otherwise(F.col("element_count")).alias("element_count"),
        F.when(f == 1, "c8").when((f == 9) & at_first, "f4").otherwise("f8").alias("value_dtype"), F.when((f == 8) & at_first, F.col("value_min") - 1).otherwise(F.col("value_min")).alias("value_min"), "value_max", F.when((f == 7) & at_first, F.lit(None)).otherwise(F.col("values")).alias("values"),
    )
    parts = p.parts().join(F.broadcast(first)).withColumn("element_count", F.when(F.col("asset_part_id") == 2, F.col("size")).otherwise(F.col("element_count"))).drop("lo", "size")
    g = p.spark.range(14)
    return {
        "asset_part": parts, "annotation": g.select((F.col("id") + 1).alias("annotation_id")), "value_block": vb, "membership_block": p.spark.createDataFrame([], "membership_block_id string, assessment_id long, annotation_id long"),
        "assessment": g.where("id <> 12").select((F.col("id") + 100).alias("assessment_id"), (F.col("id") + 1).alias("annotation_id"), _when(F.col("id"), 13, F.lit(1), F.lit(2)).cast("long").alias("asset_id")),
    }


_V = "value_block"
_SOUND = "vb WHERE dtype <> 'c8' AND n > 0"
_VALUE_CTES = f"""v0 AS (SELECT element_index - (SELECT min(p_partkey) FROM part) i, v FROM value_element),
v1 AS (SELECT i - i % {CHUNK} bs, count(*) n, min(v) FILTER (WHERE NOT isnan(v)) lo, max(v) FILTER (WHERE NOT isnan(v)) hi, list(v ORDER BY i) vals FROM v0 GROUP BY 1),
vb AS (SELECT f || '/' || bs id, f + 100 s, CASE f WHEN 10 THEN f + 1000000 ELSE f + 1 END a, CASE f WHEN 11 THEN 77 ELSE 2 END part, CASE f WHEN 4 THEN 4 ELSE 2 END kind, CASE WHEN f = 0 AND bs = (SELECT max(bs) FROM v1) THEN bs + 1 WHEN f = 3 AND bs = 0 THEN -{CHUNK} WHEN f = 5 AND bs = {CHUNK} THEN {CHUNK} - 10 ELSE bs END bs, CASE WHEN f = 2 AND bs = 0 THEN 0 ELSE n END n,
  CASE WHEN f = 1 THEN 'c8' WHEN f = 9 AND bs = 0 THEN 'f4' ELSE 'f8' END dtype, CASE WHEN f = 8 AND bs = 0 THEN lo - 1 ELSE lo END lo, hi, CASE WHEN f = 7 AND bs = 0 THEN NULL ELSE vals END vals FROM v1, range(14) r(f) WHERE NOT (f = 6 AND bs = (SELECT max(bs) FROM v1))),
ass AS (SELECT f + 100 s, f + 1 a, CASE f WHEN 13 THEN 1 ELSE 2 END asset_id FROM range(14) r(f) WHERE f <> 12),
prt AS (SELECT 2 part, 2 asset_id, 2 kind, (SELECT count(*) FROM part) n),
w AS (SELECT s, part, kind, bs, bs + n stop, coalesce(max(bs + n) OVER (PARTITION BY s, part, kind ORDER BY bs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) reached FROM {_SOUND}),
fld AS (SELECT s || '/' || w.part || '/' || w.kind id, bool_or(bs < reached) over_, bool_or(bs > reached) gap, max(stop) stop, any_value(p.n) size FROM w LEFT JOIN prt p ON p.part = w.part GROUP BY s, w.part, w.kind),
prb AS (SELECT id, CASE WHEN over_ THEN 'overlap' WHEN gap THEN 'gap' WHEN stop <> size THEN 'partial' END d FROM fld)"""
_named({
    "ORPHAN_VALUE_BLOCK_ANNOTATION": ("error", _V, "SELECT id, a FROM vb WHERE a NOT IN (SELECT f + 1 FROM range(14) r(f))"),
    "ORPHAN_VALUE_BLOCK_ASSET_PART": ("error", _V, "SELECT id, part FROM vb WHERE part = 77"),
    "ORPHAN_VALUE_BLOCK_ASSESSMENT": ("error", _V, "SELECT id, s FROM vb WHERE s NOT IN (SELECT s FROM ass)"),
    "ASSESSMENT_ANNOTATION_MISMATCH": ("error", _M, "SELECT id, ass.a FROM vb JOIN ass USING (s) WHERE vb.a <> ass.a"),
    "VALUE_BLOCK_OUTSIDE_ASSESSMENT_ASSET": ("error", _V, "SELECT id, p.asset_id FROM vb JOIN ass USING (s) JOIN prt p USING (part) WHERE ass.asset_id <> p.asset_id"),
    "UNSUPPORTED_VALUE_DTYPE": ("error", _V, "SELECT id, dtype FROM vb WHERE dtype = 'c8'"),
    "EMPTY_VALUE_BLOCK": ("error", _V, "SELECT id, n FROM vb WHERE dtype <> 'c8' AND n <= 0"),
    "INVALID_VALUE_BLOCK_START": ("error", _V, f"SELECT id, bs FROM {_SOUND} AND bs < 0"),
    "VALUE_ELEMENT_KIND_MISMATCH": ("error", _V, "SELECT id, p.kind FROM vb JOIN prt p USING (part) WHERE dtype <> 'c8' AND vb.n > 0 AND vb.kind <> p.kind"),
    "VALUE_BLOCK_OUT_OF_RANGE": ("error", _V, "SELECT id, p.n FROM vb JOIN prt p USING (part) WHERE dtype <> 'c8' AND vb.n > 0 AND bs + vb.n > p.n"),
    "OVERLAPPING_VALUE_BLOCKS": ("error", _V, "SELECT id, d FROM prb WHERE d = 'overlap'"),
    "PARTIAL_VALUE_FIELD_COVERAGE": ("warning", _V, "SELECT id, d FROM prb WHERE d IN ('gap', 'partial')"),
    "CORRUPT_VALUE_PAYLOAD": ("error", _V, f"SELECT id, '' FROM {_SOUND} AND (vals IS NULL OR len(vals) <> n)"),
    "VALUE_MIN_MAX_MISMATCH": ("error", _V, f"SELECT id, '' FROM {_SOUND} AND vals IS NOT NULL AND (list_min(list_filter(vals, lambda x: NOT isnan(x))) IS DISTINCT FROM lo OR list_max(list_filter(vals, lambda x: NOT isnan(x))) IS DISTINCT FROM hi)"),
    "MIXED_VALUE_DTYPE_FIELD": ("error", _V, "SELECT s || '/' || part || '/' || kind, count(DISTINCT dtype) FROM vb GROUP BY s, part, kind HAVING count(DISTINCT dtype) > 1"),
}, _VALUE_CTES, _fields, "validate_broken_values")


# --- ordered paths


def _paths(p: Projection) -> dict[str, DataFrame]:
    u, o = F.col("annotation_id") % 11, F.col("segment_ordinal")
    first = o == 0
    segs = p.path_segments().where(~((u == 6) & first)).select(
        F.concat_ws("/", "annotation_id", "segment_ordinal").alias("path_block_id"), _when(u, 8, F.col("annotation_id") + _OTHERS, F.col("annotation_id")).alias("assessment_id"), _when(u, 9, F.lit(99), F.col("asset_part_id")).alias("asset_part_id"), "segment_ordinal",
        F.when((u == 7) & first, 1).otherwise(F.col("continues_previous")).alias("continues_previous"), F.when((u == 2) & first, 0).when(u == 4, F.col("element_count") + 1).otherwise(F.col("element_count")).alias("element_count"), _when(u, 1, F.lit("zip"), F.lit("u32-seq-zlib")).alias("encoding"),
        F.when((u == 3) & first, F.lit(None)).when(u == 5, F.array_append("indices", F.lit(10**9).cast("long"))).otherwise(F.col("indices")).alias("indices"),
    )
    member = p.path_positions().where((u != 0) | (F.col("starts_run") == 0)).withColumns({"assessment_id": F.col("annotation_id"), "element_kind": F.lit(4)})
    mb = blocks.build_blocks(member, _KEY).withColumns({"encoding": F.lit("roaring"), "membership_block_id": F.lit(0)})
    owners = p.path_positions().select("annotation_id").distinct()
    return {"asset_part": p.parts(), "path_block": segs, "membership_block": mb, "assessment": owners.select(F.col("annotation_id").alias("assessment_id"), "annotation_id", _when(u, 10, F.lit(1), F.lit(3)).cast("long").alias("asset_id"))}


_P = "path_block"
_WAY = "pb WHERE encoding = 'u32-seq-zlib' AND n > 0"
_PATH_CTES = f"""p0 AS (SELECT c.annotation_id a, c.annotation_id % 11 u, segment_ordinal o, min(c.asset_part_id) part, 1 - max(starts_run) cont, count(*) n, list(element_index ORDER BY ordinal) ix FROM path_cut c GROUP BY ALL),
pb AS (SELECT a || '/' || o id, CASE u WHEN 8 THEN a + 1000000 ELSE a END s, CASE u WHEN 9 THEN 99 ELSE part END part, o, CASE WHEN u = 7 AND o = 0 THEN 1 ELSE cont END cont, CASE WHEN u = 2 AND o = 0 THEN 0 WHEN u = 4 THEN n + 1 ELSE n END n, CASE u WHEN 1 THEN 'zip' ELSE 'u32-seq-zlib' END encoding,
  CASE WHEN u = 3 AND o = 0 THEN NULL WHEN u = 5 THEN list_append(ix, 1000000000) ELSE ix END ix FROM p0 WHERE NOT (u = 6 AND o = 0)),
ass AS (SELECT DISTINCT annotation_id s, CASE annotation_id % 11 WHEN 10 THEN 1 ELSE 3 END asset_id FROM path_position),
ord AS (SELECT s, min(o) lo, max(o) hi, count(DISTINCT o) k, min_by(cont, o) f FROM pb GROUP BY s),
pe AS (SELECT DISTINCT s, part, unnest(ix) i FROM {_WAY}), me AS (SELECT DISTINCT annotation_id s, asset_part_id part, element_index i FROM path_position WHERE (annotation_id % 11 <> 0 OR starts_run = 0) AND annotation_id IN (SELECT s FROM {_WAY})),
dif AS (SELECT * FROM ((SELECT * FROM pe EXCEPT SELECT * FROM me) UNION ALL (SELECT * FROM me EXCEPT SELECT * FROM pe)))"""
_named({
    "ORPHAN_PATH_ASSESSMENT": ("error", _P, "SELECT id, s FROM pb WHERE s NOT IN (SELECT s FROM ass)"),
    "ORPHAN_PATH_ASSET_PART": ("error", _P, "SELECT id, part FROM pb WHERE part = 99"),
    "PATH_OUTSIDE_ASSESSMENT_ASSET": ("error", _P, "SELECT id, p.asset_id FROM pb JOIN ass USING (s) JOIN part_dim p ON p.asset_part_id = part WHERE ass.asset_id <> p.asset_id"),
    "UNSUPPORTED_PATH_ENCODING": ("error", _P, "SELECT id, encoding FROM pb WHERE encoding = 'zip'"),
    "EMPTY_PATH_SEGMENT": ("error", _P, "SELECT id, n FROM pb WHERE encoding <> 'zip' AND n <= 0"),
    "CORRUPT_PATH_PAYLOAD": ("error", _P, f"SELECT id, '' FROM {_WAY} AND ix IS NULL"),
    "PATH_COUNT_MISMATCH": ("error", _P, f"SELECT id, n FROM {_WAY} AND len(ix) <> n"),
    "PATH_OUT_OF_ASSET_PART_RANGE": ("error", _P, "SELECT id, p.element_count FROM pb JOIN part_dim p ON p.asset_part_id = part WHERE encoding <> 'zip' AND n > 0 AND list_max(ix) >= p.element_count"),
    "PATH_SEGMENT_ORDINAL_GAP": ("error", _P, "SELECT s, '' FROM ord WHERE lo <> 0 OR hi <> k - 1"),
    "PATH_FIRST_SEGMENT_CONTINUES": ("error", _P, "SELECT s, '' FROM ord WHERE f = 1"),
    "PATH_MEMBERSHIP_MISMATCH": ("error", _P, "SELECT s || '/' || part, count(*) FROM dif GROUP BY s, part"),
}, _PATH_CTES, _paths, "validate_broken_paths")


# --- graph, concepts, claims' own fields, extents


def _graph(p: Projection) -> dict[str, DataFrame]:
    none, k, n = F.lit(None), F.col("annotation_id") % 7, F.col("src") % 7
    kinds = p.edges().where("rel_type = 'part'")
    one = kinds.select(
        F.concat_ws("/", "src", "dst").alias("relationship_id"), F.lit("g").alias("graph_name"), _when(F.col("dst") % 7, 6, F.col("src") + 10 * _OTHERS, F.col("src")).alias("from_city_object_id"), _when(F.col("dst") % 7, 0, F.col("dst") + 10 * _OTHERS, F.col("dst")).alias("to_city_object_id"),
        none.cast("string").alias("to_external_uri"), F.lit(1).alias("relationship_type_id"), none.cast("string").alias("role"), none.cast("long").alias("source_asset_id"),
    )
    again = one.where("to_city_object_id % 7 = 5").withColumn("relationship_id", F.concat("relationship_id", F.lit("/again")))
    classes = p.classes().select(F.col("class_id").alias("semantic_class_id"), F.col("parent_id").alias("parent_class_id"), F.when(F.col("class_id").isin(1001, 1002), "w:twice").otherwise(F.concat(F.lit("w:"), "local_name")).alias("class_uri"))
    kept = graph.closure(p.classes()).where("not (depth = 0 and descendant % 10 = 3) and not (depth = 1 and descendant % 10 = 4)")
    i = F.col("id")
    box = p.spark.range(6).select(i.alias("asset_id"), i.cast("double").alias("minx"), (i + 1).cast("double").alias("miny"), (i + 2).cast("double").alias("maxx"), (i + 3).cast("double").alias("maxy"))
    extents = box.where("asset_id < 4").withColumn("maxx", _when(F.col("asset_id"), 2, F.col("maxx") + 1, F.col("maxx"))).unionByName(box.where("asset_id = 0").withColumn("asset_id", F.lit(99).cast("long")))
    return {
        "annotation": p.annotations().select("annotation_id", _when(k, 1, F.lit(1.5), F.lit(0.5)).alias("confidence"), F.when(k == 2, "{bad").when(k == 3, '{"x:path": [1]}').otherwise('{"a": 1}').alias("attributes_json")),
        "city_object": p.objects().select(F.col("object_id").alias("city_object_id"), _when(F.col("object_id") % 7, 4, F.lit("lost"), F.lit("accepted")).alias("object_status")),
        "semantic_class": classes, "class_closure": kept, "relationship": one.unionByName(again), "asset_part": box, "asset": box.select("asset_id"), "asset_extent": extents,
    }


_R = "relationship"
_GRAPH_CTES = """closure(ancestor, descendant, depth) AS (SELECT class_id, class_id, 0 FROM class_dim UNION ALL SELECT k.ancestor, c.class_id, k.depth + 1 FROM closure k JOIN class_dim c ON c.parent_id = k.descendant),
kept AS (SELECT * FROM closure WHERE NOT (depth = 0 AND descendant % 10 = 3) AND NOT (depth = 1 AND descendant % 10 = 4)),
r0 AS (SELECT src || '/' || dst id, CASE dst % 7 WHEN 6 THEN src + 10000000 ELSE src END f, CASE dst % 7 WHEN 0 THEN dst + 10000000 ELSE dst END t FROM edge_fact WHERE rel_type = 'part'),
rel AS (SELECT * FROM r0 UNION ALL SELECT id || '/again', f, t FROM r0 WHERE t % 7 = 5)"""
_named({
    "ORPHAN_RELATIONSHIP_FROM": ("error", _R, "SELECT id, f FROM rel WHERE f NOT IN (SELECT object_id FROM object_dim)"),
    "ORPHAN_RELATIONSHIP_TO": ("error", _R, "SELECT id, t FROM rel WHERE t NOT IN (SELECT object_id FROM object_dim)"),
    "DUPLICATE_RELATIONSHIP_EDGE": ("warning", _R, "SELECT min(id), count(*) FROM rel GROUP BY f, t HAVING count(*) > 1"),
    "DUPLICATE_SEMANTIC_CLASS_REGISTRATION": ("error", "semantic_class", "SELECT 'w:twice', count(*) FROM class_dim WHERE class_id IN (1001, 1002) HAVING count(*) > 1"),
    "MISSING_SEMANTIC_CLASS_SELF_CLOSURE": ("error", "semantic_class", "SELECT class_id, '' FROM class_dim WHERE class_id NOT IN (SELECT descendant FROM kept WHERE depth = 0)"),
    "MISSING_SEMANTIC_CLASS_PARENT_CLOSURE": ("error", "semantic_class", "SELECT class_id, parent_id FROM class_dim WHERE parent_id IS NOT NULL AND class_id NOT IN (SELECT descendant FROM kept WHERE depth = 1)"),
    "ANNOTATION_CONFIDENCE_OUT_OF_RANGE": ("error", "annotation", "SELECT annotation_id, '1.5' FROM annotation_fact WHERE annotation_id % 7 = 1"),
    "ANNOTATION_ATTRIBUTES_NOT_JSON": ("error", "annotation", "SELECT annotation_id, '' FROM annotation_fact WHERE annotation_id % 7 = 2"),
    "PATH_IN_ATTRIBUTES": ("warning", "annotation", "SELECT annotation_id, '' FROM annotation_fact WHERE annotation_id % 7 = 3"),
    "CITY_OBJECT_UNKNOWN_STATUS": ("error", "city_object", "SELECT object_id, 'lost' FROM object_dim WHERE object_id % 7 = 4"),
    "MISSING_ASSET_EXTENT": ("warning", "asset_part", "SELECT i, '' FROM range(4, 6) r(i)"),
    "ORPHAN_ASSET_EXTENT": ("error", "asset_extent", "SELECT 99, ''"),
    "EXTENT_ENVELOPE_MISMATCH": ("error", "asset_extent", "SELECT i, '' FROM (VALUES (2), (99)) v(i)"),
}, _GRAPH_CTES, _graph, "validate_broken_graph")
ORACLE["validate_broken_graph"] = ORACLE["validate_broken_graph"].replace("WITH ", "WITH RECURSIVE ", 1)


def queries() -> dict:
    return QUERIES
