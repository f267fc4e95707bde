"""Queries for the claim, graph, value, path and catalogue operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import blocks, catalog, claims, graph, paths, values
from facetlake.plans.projection import CHUNK, Projection, with_views
from facetlake.schema import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CLAIM = ["annotation_id", "assessed_year", "asset_part_id"]


def query(sql: str | None = None, recursive: str = "") -> Callable:
    def register(f: Callable[[Projection], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Projection(spark, folder))
        if sql:
            ORACLE[f.__name__] = with_views(sql, recursive)
        return f

    return register


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- building and reading blocks


@query("SELECT * FROM member_block")
def blocks_build(p: Projection) -> DataFrame:
    return _long(p.member_blocks().drop("offsets", "block_size"), "element_count")


@query("SELECT annotation_id, assessed_year, asset_part_id, element_index FROM member_element")
def forward_elements(p: Projection) -> DataFrame:
    return claims.elements_for_claims(p.member_blocks()).select(*CLAIM, "element_index")


@query("SELECT b.* FROM member_block b JOIN annotation_fact a USING (annotation_id) WHERE a.status = 'accepted'")
def forward_accepted_blocks(p: Projection) -> DataFrame:
    chosen = p.annotations().where("status = 'accepted'")
    return _long(claims.elements_for_claims(p.member_blocks(chosen), expand=False).drop("offsets", "block_size"), "element_count")


_SELECTED = "SELECT DISTINCT l_orderkey*7 + l_linenumber-1 element_index FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'"


def _selection(p: Projection) -> DataFrame:
    urgent = p.t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return p.t("lineitem").join(urgent, "l_orderkey", "left_semi").select(F.lit(1).cast("long").alias("asset_part_id"), (F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1).alias("element_index"))


@query(f"""SELECT m.annotation_id, a.annotation_uid, m.assessed_year, c.local_name AS concept, o.object_uid AS primary_object_uid, a.status, min(m.element_index - m.element_index % 16384) AS first_block,
CAST(count(*) AS BIGINT) AS n_matched, min(m.element_index) AS first_element, max(m.element_index) AS last_element
FROM member_element m JOIN ({_SELECTED}) s USING (element_index) JOIN annotation_fact a USING (annotation_id) JOIN class_dim c USING (class_id) LEFT JOIN object_dim o ON o.object_id = a.primary_object_id GROUP BY ALL""")
def reverse_claims(p: Projection) -> DataFrame:
    hit = claims.claims_for_elements(p.member_blocks(), _selection(p), ["annotation_id", "assessed_year"], elements=False)
    a = p.annotations().join(p.classes().select("class_id", F.col("local_name").alias("concept")), "class_id").join(p.objects().select(F.col("object_id").alias("primary_object_id"), F.col("object_uid").alias("primary_object_uid")), "primary_object_id", "left")
    return hit.join(a, "annotation_id").select("annotation_id", "annotation_uid", "assessed_year", "concept", "primary_object_uid", "status", "first_block", "n_matched", "first_element", "last_element")


@query(f"SELECT annotation_id, assessed_year, element_index FROM member_element JOIN ({_SELECTED}) s USING (element_index)")
def reverse_elements(p: Projection) -> DataFrame:
    return claims.matched_elements(p.member_blocks(), _selection(p), ["annotation_id", "assessed_year"]).select("annotation_id", "assessed_year", "element_index")


@query(f"""SELECT annotation_id, CAST(count(DISTINCT element_index) AS BIGINT) AS n_matched FROM member_element JOIN ({_SELECTED}) s USING (element_index)
WHERE assessed_year = (SELECT max(assessed_year) FROM member_element) GROUP BY annotation_id""")
def reverse_one_assessment(p: Projection) -> DataFrame:
    last = p.stated_elements().agg(F.max("assessed_year").alias("assessed_year"))
    one = p.stated_elements().join(F.broadcast(last), "assessed_year", "left_semi")
    return claims.claims_for_elements(blocks.build_blocks(one, CLAIM), _selection(p), ["annotation_id"], elements=False).select("annotation_id", "n_matched")


# --- concept and object subtrees

_CLOSURE = "closure(ancestor, descendant, depth) AS (SELECT class_id, class_id, CAST(0 AS BIGINT) FROM class_dim UNION ALL SELECT k.ancestor, c.class_id, k.depth + 1 FROM closure k JOIN class_dim c ON c.parent_id = k.descendant)"


@query("SELECT * FROM closure", _CLOSURE)
def class_closure(p: Projection) -> DataFrame:
    return graph.closure(p.classes())


@query("SELECT b.* FROM member_block b JOIN annotation_fact a USING (annotation_id) WHERE a.class_id IN (SELECT descendant FROM closure WHERE ancestor = (SELECT class_id FROM class_dim WHERE local_name = 'EUROPE'))", _CLOSURE)
def class_subtree_blocks(p: Projection) -> DataFrame:
    chosen = p.classes().where("local_name = 'EUROPE'").select("class_id")
    return _long(p.member_blocks(claims.claims_of_classes(graph.closure(p.classes()), p.annotations(), chosen)).drop("offsets", "block_size"), "element_count")


@query("SELECT k.ancestor AS class_id, CAST(count(DISTINCT a.annotation_id) AS BIGINT) AS n_claims, CAST(count(*) AS BIGINT) AS n_blocks, CAST(sum(b.element_count) AS BIGINT) AS n_elements FROM closure k JOIN annotation_fact a ON a.class_id = k.descendant JOIN member_block b USING (annotation_id) GROUP BY k.ancestor", _CLOSURE)
def class_rollup(p: Projection) -> DataFrame:
    # Blocks are summed per claim first, so each ancestor adds few rows and not blocks.
    per = p.member_blocks().groupBy("annotation_id").agg(F.count(F.lit(1)).alias("nb"), F.sum("element_count").alias("ne"))
    k = graph.closure(p.classes()).select(F.col("ancestor"), F.col("descendant").alias("class_id"))
    rows = p.annotations().select("annotation_id", "class_id").join(per, "annotation_id").join(k, "class_id")
    return rows.groupBy(F.col("ancestor").alias("class_id")).agg(F.count(F.lit(1)).alias("n_claims"), F.sum("nb").cast("long").alias("n_blocks"), F.sum("ne").cast("long").alias("n_elements"))


_REACH = "reach(object_id) AS (SELECT object_id FROM object_dim WHERE object_uid IN ({uids}) UNION SELECT e.dst FROM reach r JOIN edge_fact e ON e.src = r.object_id WHERE e.category = 'containment' AND e.dst IS NOT NULL)"
_ABOUT = "(SELECT annotation_id FROM annotation_fact WHERE primary_object_id IN (SELECT object_id FROM reach) UNION SELECT annotation_id FROM link_fact WHERE relation_type = 'represents' AND object_id IN (SELECT object_id FROM reach))"


def _object_blocks(p: Projection, uids: list[str]) -> DataFrame:
    start = p.objects().where(F.col("object_uid").isin(uids)).select("object_id")
    reached = graph.reachable(graph.typed_edges(p.edges(), ["containment"]), start).select("object_id").distinct()
    return _long(p.member_blocks(claims.claims_of_objects(reached, p.annotations(), p.links())).drop("offsets", "block_size"), "element_count")


@query(f"SELECT * FROM member_block WHERE annotation_id IN {_ABOUT}", _REACH.format(uids="'ASIA'"))
def object_subtree_blocks(p: Projection) -> DataFrame:
    return _object_blocks(p, ["ASIA"])


@query(f"SELECT * FROM member_block WHERE annotation_id IN {_ABOUT}", _REACH.format(uids="'AFRICA', 'EUROPE', 'no such object'"))
def object_set_blocks(p: Projection) -> DataFrame:
    return _object_blocks(p, ["AFRICA", "EUROPE", "no such object"])


# --- graph


@query("SELECT root, object_id, CAST(min(depth) AS BIGINT) depth FROM walk GROUP BY ALL", "walk(root, object_id, depth) AS (SELECT object_id, object_id, CAST(0 AS BIGINT) FROM object_dim UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edge_fact e ON e.src = w.object_id WHERE e.category = 'containment' AND e.dst IS NOT NULL)")
def graph_descendants(p: Projection) -> DataFrame:
    return graph.reachable(graph.typed_edges(p.edges(), ["containment"]), p.objects())


@query("SELECT root, object_id, CAST(min(depth) AS BIGINT) depth FROM walk GROUP BY ALL", "walk(root, object_id, depth) AS (SELECT object_id, object_id, CAST(0 AS BIGINT) FROM object_dim UNION SELECT w.root, e.src, w.depth + 1 FROM walk w JOIN edge_fact e ON e.dst = w.object_id WHERE e.category = 'containment')")
def graph_ancestors(p: Projection) -> DataFrame:
    return graph.reachable(graph.typed_edges(p.edges(), ["containment"]), p.objects(), "in")


@query("SELECT * FROM walk", "hop(a, b) AS (SELECT src, dst FROM edge_fact WHERE dst IS NOT NULL UNION SELECT dst, src FROM edge_fact WHERE dst IS NOT NULL), walk(root, object_id) AS (SELECT class_id, class_id FROM class_dim UNION SELECT w.root, h.b FROM walk w JOIN hop h ON h.a = w.object_id)")
def graph_reach_both(p: Projection) -> DataFrame:
    return graph.reachable(p.edges(), p.classes().select(F.col("class_id").alias("object_id")), "both").select("root", "object_id")


@query("SELECT src object_id, dst neighbour_id FROM edge_fact WHERE dst IS NOT NULL UNION SELECT dst, src FROM edge_fact WHERE dst IS NOT NULL")
def graph_neighbours(p: Projection) -> DataFrame:
    return graph.neighbours(p.edges())


@query("""SELECT x.object_id, x.direction, x.other_id, o.object_uid other_uid, x.ext, x.rel_type, x.category FROM (SELECT src object_id, 'out' direction, dst other_id, ext, rel_type, category FROM edge_fact
UNION ALL SELECT dst, 'in', src, ext, rel_type, category FROM edge_fact WHERE dst IS NOT NULL) x LEFT JOIN object_dim o ON o.object_id = x.other_id""")
def graph_incident_edges(p: Projection) -> DataFrame:
    names = p.objects().select(F.col("object_id").alias("other_id"), F.col("object_uid").alias("other_uid"))
    return graph.incident_edges(p.edges()).join(names, "other_id", "left").select("object_id", "direction", "other_id", "other_uid", "ext", "rel_type", "category")


@query("SELECT object_id FROM object_dim WHERE object_id NOT IN (SELECT dst FROM edge_fact WHERE dst IS NOT NULL AND category = 'containment')")
def graph_roots(p: Projection) -> DataFrame:
    return graph.roots(graph.typed_edges(p.edges(), ["containment"]), p.objects())


@query("SELECT DISTINCT object_id FROM (SELECT src object_id FROM walk WHERE src = dst UNION SELECT e.dst FROM walk w JOIN walk e ON e.src = w.src WHERE w.src = w.dst)", "walk(src, dst) AS (SELECT src, dst FROM edge_fact WHERE dst IS NOT NULL UNION SELECT w.src, e.dst FROM walk w JOIN edge_fact e ON e.src = w.dst WHERE e.dst IS NOT NULL)")
def graph_cycles(p: Projection) -> DataFrame:
    return graph.cycle_members(p.edges())


# --- value fields


@query(f"""SELECT element_index - element_index % {CHUNK} block_start, CAST(count(*) AS BIGINT) element_count, min(v) FILTER (WHERE NOT isnan(v)) value_min, max(v) FILTER (WHERE NOT isnan(v)) value_max FROM value_element GROUP BY 1""")
def value_chunks(p: Projection) -> DataFrame:
    return p.value_chunks().select("block_start", "element_count", "value_min", "value_max")


def _first_index(p: Projection) -> DataFrame:
    """The field by position: keys of the source begin at some number, fields begin at zero."""
    first = p.t("part").agg(F.min("p_partkey").alias("lo"))
    return p.value_elements().join(F.broadcast(first)).withColumn("element_index", F.col("element_index") - F.col("lo")).drop("lo")


def _where(op: str, threshold: float) -> Callable[[Projection], DataFrame]:
    def run(p: Projection) -> DataFrame:
        return values.elements_where(values.chunk_values(_first_index(p), ["asset_part_id"], CHUNK), op, threshold, keys=["asset_part_id"])

    return run


for _name, _op, _sql in (("gt", ">", ">"), ("ge", ">=", ">="), ("lt", "<", "<"), ("le", "<=", "<="), ("eq", "==", "="), ("ne", "!=", "<>")):
    _f = _where(_op, 950.0)
    _f.__name__ = f"value_where_{_name}"
    query(f"SELECT CAST(2 AS BIGINT) asset_part_id, element_index - (SELECT min(p_partkey) FROM part) element_index FROM value_element WHERE NOT isnan(v) AND v {_sql} 950.0")(_f)


@query("SELECT CAST(2 AS BIGINT) asset_part_id, element_index - (SELECT min(p_partkey) FROM part) element_index FROM value_element WHERE NOT isnan(v) AND (v < 910 OR v BETWEEN 950 AND 960)")
def value_where_callable(p: Projection) -> DataFrame:
    return values.elements_where(values.chunk_values(_first_index(p), ["asset_part_id"], CHUNK), lambda v: (v < 910) | v.between(950, 960), keys=["asset_part_id"])


@query("SELECT CAST(2 AS BIGINT) asset_part_id, element_index - (SELECT min(p_partkey) FROM part) element_index, CASE WHEN NOT isnan(v) THEN v END v, isnan(v) no_value FROM value_element")
def value_read(p: Projection) -> DataFrame:
    return values.field_values(values.chunk_values(_first_index(p), ["asset_part_id"], CHUNK), ["asset_part_id"]).select("asset_part_id", "element_index", F.when(~F.isnan("v"), F.col("v")).alias("v"), F.isnan("v").alias("no_value"))


@query(f"""SELECT CAST(2 AS BIGINT) asset_part_id, min(v) FILTER (WHERE NOT isnan(v)) min_value, max(v) FILTER (WHERE NOT isnan(v)) max_value, CAST(count(*) AS BIGINT) value_count, CAST(count(DISTINCT element_index - element_index % {CHUNK}) AS BIGINT) block_count FROM value_element""")
def value_stats(p: Projection) -> DataFrame:
    return values.field_stats(p.value_chunks(), ["asset_part_id"])


# --- ordered paths


@query("SELECT * FROM path_segment")
def path_segments(p: Projection) -> DataFrame:
    return p.path_segments().drop("indices")


@query("SELECT *, CAST(sum(1 - continues_previous) OVER (PARTITION BY annotation_id ORDER BY segment_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) run FROM path_segment")
def path_runs(p: Projection) -> DataFrame:
    return paths.runs(p.path_segments(), "annotation_id").drop("indices")


@query("SELECT annotation_id, segment_ordinal, asset_part_id, CAST(row_number() OVER (PARTITION BY annotation_id, segment_ordinal ORDER BY ordinal) - 1 AS BIGINT) place, element_index FROM path_cut")
def path_positions(p: Projection) -> DataFrame:
    return _long(paths.positions(p.path_segments(), "annotation_id"), "place")


@query("SELECT annotation_id, CAST(count(*) AS BIGINT) segment_count, CAST(sum(1 - continues_previous) AS BIGINT) run_count, CAST(sum(element_count) AS BIGINT) position_count FROM path_segment GROUP BY annotation_id")
def path_summary(p: Projection) -> DataFrame:
    return paths.path_summary(p.path_segments(), "annotation_id")


@query("SELECT DISTINCT annotation_id, asset_part_id, element_index FROM path_position")
def path_membership(p: Projection) -> DataFrame:
    return paths.derived_membership(p.path_segments(), "annotation_id")


@query("""SELECT annotation_id, asset_part_id, side, CAST(count(*) AS BIGINT) n FROM (
(SELECT annotation_id, asset_part_id, element_index, 'path only' side FROM path_position EXCEPT SELECT annotation_id, asset_part_id, element_index, 'path only' FROM path_position WHERE starts_run = 1)
) x GROUP BY ALL""")
def path_against_membership(p: Projection) -> DataFrame:
    """What a path covers beyond a membership (here that of the run starts), and the other way."""
    path = paths.derived_membership(p.path_segments(), "annotation_id")
    member = p.path_positions().where("starts_run = 1").select("annotation_id", "asset_part_id", "element_index")
    sides = path.exceptAll(member.distinct()).withColumn("side", F.lit("path only")).unionByName(member.distinct().exceptAll(path).withColumn("side", F.lit("membership only")))
    return sides.groupBy("annotation_id", "asset_part_id", "side").agg(F.count(F.lit(1)).alias("n"))


# --- summaries


@query("SELECT annotation_id, asset_part_id, CAST(sum(element_count) AS BIGINT) element_count, CAST(count(*) AS BIGINT) block_count FROM member_block GROUP BY ALL")
def membership_summary(p: Projection) -> DataFrame:
    return p.member_blocks().groupBy("annotation_id", "asset_part_id").agg(F.sum("element_count").cast("long").alias("element_count"), F.count(F.lit(1)).alias("block_count"))


@query("SELECT annotation_id, CAST(count(DISTINCT assessed_year) AS BIGINT) n_assessments, min(assessed_year) first_year, max(assessed_year) last_year, CAST(sum(element_count) AS BIGINT) selected_count FROM member_block GROUP BY ALL")
def assessment_summary(p: Projection) -> DataFrame:
    return p.member_blocks().groupBy("annotation_id").agg(F.count_distinct("assessed_year").alias("n_assessments"), F.min("assessed_year").alias("first_year"), F.max("assessed_year").alias("last_year"), F.sum("element_count").cast("long").alias("selected_count"))


@query("""SELECT a.annotation_id, a.annotation_uid, c.local_name concept, a.status, CAST(coalesce(m.n, 0) AS BIGINT) element_count, CAST(coalesce(m.b, 0) AS BIGINT) block_count FROM annotation_fact a JOIN class_dim c USING (class_id)
LEFT JOIN (SELECT annotation_id, sum(element_count) n, count(*) b FROM member_block GROUP BY 1) m USING (annotation_id) WHERE a.status IN ('draft', 'accepted')""")
def annotations_list(p: Projection) -> DataFrame:
    per = p.member_blocks().groupBy("annotation_id").agg(F.sum("element_count").alias("n"), F.count(F.lit(1)).alias("b"))
    rows = p.annotations().where(F.col("status").isin("draft", "accepted")).join(p.classes().select("class_id", F.col("local_name").alias("concept")), "class_id").join(per, "annotation_id", "left")
    return rows.select("annotation_id", "annotation_uid", "concept", "status", F.coalesce("n", F.lit(0)).cast("long").alias("element_count"), F.coalesce("b", F.lit(0)).cast("long").alias("block_count"))


@query("SELECT annotation_id FROM annotation_fact WHERE primary_object_id IN (SELECT object_id FROM object_dim WHERE class_id = 1007) UNION SELECT annotation_id FROM link_fact WHERE object_id IN (SELECT object_id FROM object_dim WHERE class_id = 1007)")
def annotations_by_object(p: Projection) -> DataFrame:
    return claims.claims_of_objects(p.objects().where("class_id = 1007"), p.annotations(), p.links())


@query("SELECT c.class_id, c.local_name, CAST(count(a.annotation_id) AS BIGINT) annotation_count, count(a.annotation_id) > 0 in_use FROM class_dim c LEFT JOIN annotation_fact a USING (class_id) GROUP BY ALL")
def concepts_usage(p: Projection) -> DataFrame:
    used = p.annotations().groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return p.classes().join(used, "class_id", "left").select("class_id", "local_name", F.coalesce("n", F.lit(0)).cast("long").alias("annotation_count"), F.col("n").isNotNull().alias("in_use"))


@query("SELECT p.asset_part_id, p.asset_id, p.part_path, p.element_kind, p.element_count, CAST(coalesce(m.n, 0) AS BIGINT) claimed FROM part_dim p LEFT JOIN (SELECT asset_part_id, count(DISTINCT element_index) n FROM member_element GROUP BY 1) m USING (asset_part_id)")
def parts_list(p: Projection) -> DataFrame:
    used = p.stated_elements().select("asset_part_id", "element_index").distinct().groupBy("asset_part_id").agg(F.count(F.lit(1)).alias("n"))
    return p.parts().join(used, "asset_part_id", "left").select("asset_part_id", "asset_id", "part_path", "element_kind", "element_count", F.coalesce("n", F.lit(0)).cast("long").alias("claimed"))


# --- lists and lookups over the claims as a store

_A = """SELECT a.annotation_id, a.annotation_uid, a.class_id AS semantic_class_id, 'world' AS semantic_scheme, 'w:' || c.local_name AS semantic_class_uri, c.local_name AS semantic_class, a.class_id >= 1000 AS semantic_is_ade,
a.primary_object_id AS primary_city_object_id, o.object_uid AS primary_city_object_uid, 'gml-' || o.object_uid AS primary_city_object_gml_id, a.status, CAST(coalesce(m.y, 0) AS BIGINT) assessment_count, CAST(coalesce(m.p, 0) AS BIGINT) part_count,
CAST(coalesce(m.b, 0) AS BIGINT) block_count, CAST(coalesce(m.n, 0) AS BIGINT) element_count FROM annotation_fact a JOIN class_dim c USING (class_id) LEFT JOIN object_dim o ON o.object_id = a.primary_object_id
LEFT JOIN (SELECT annotation_id, count(DISTINCT assessed_year) y, count(DISTINCT asset_part_id) p, count(*) b, sum(element_count) n FROM member_block GROUP BY 1) m USING (annotation_id)"""
_EMPTY = ["semantic_scheme_version", "label", "confidence", "attributes_json", "created_at", "updated_at"]


def _listed(p: Projection, **filters) -> DataFrame:
    return catalog.list_annotations(p.store(), **filters).drop(*_EMPTY)


@query(f"{_A} WHERE a.status = 'accepted' AND c.local_name = 'NATION_6'")
def annotations_of_class_name(p: Projection) -> DataFrame:
    return _listed(p, status="accepted", class_name="NATION_6")


@query(f"{_A} WHERE a.class_id = 1003 ORDER BY a.annotation_id LIMIT 5")
def annotations_limited(p: Projection) -> DataFrame:
    return _listed(p, class_id=1003, limit=5)


@query(f"{_A} WHERE a.primary_object_id = 100007 OR a.annotation_id IN (SELECT annotation_id FROM link_fact WHERE object_id = 100007)")
def annotations_of_object(p: Projection) -> DataFrame:
    return _listed(p, object_id=100007)


@query(f"{_A} WHERE a.annotation_id IN (SELECT k.annotation_id FROM link_fact k JOIN object_dim d USING (object_id) WHERE d.object_uid = 'Supplier#000000010')")
def annotations_of_linked_object(p: Projection) -> DataFrame:
    return _listed(p, object_uid="gml-Supplier#000000010")


@query(f"{_A} WHERE a.annotation_id IN (SELECT annotation_id FROM member_block WHERE asset_part_id = 1)")
def annotations_of_part(p: Projection) -> DataFrame:
    return _listed(p, asset_id=1, asset_part_id=1)


_S = """SELECT annotation_id * 10000 + assessed_year assessment_id, 'asm_' || (annotation_id * 10000 + assessed_year) assessment_uid, annotation_id, a.annotation_uid, CAST(1 AS BIGINT) asset_id, 'lineitem/all' asset_uri, 'mesh' asset_kind,
CASE WHEN assessed_year > 1992 THEN assessed_year || '-01-01' END assessed_at, 'accepted' status, CAST(coalesce(g.r, 0) AS BIGINT) path_run_count, CAST(coalesce(g.s, 0) AS BIGINT) segment_count, CAST(m.n AS BIGINT) selected_count
FROM (SELECT annotation_id, assessed_year, sum(element_count) n FROM member_block GROUP BY ALL) m LEFT JOIN annotation_fact a USING (annotation_id) LEFT JOIN (SELECT annotation_id, CAST(1994 AS BIGINT) assessed_year, count(*) s, sum(1 - continues_previous) r FROM path_segment GROUP BY 1) g USING (annotation_id, assessed_year)"""


@query(_S)
def assessments_list(p: Projection) -> DataFrame:
    return catalog.list_assessments(p.store()).drop("confidence", "attributes_json", "created_at", "updated_at")


@query(f"{_S} WHERE annotation_id = 7")
def assessments_of_claim(p: Projection) -> DataFrame:
    return catalog.list_assessments(p.store(), annotation_id=7, asset_id=1).drop("confidence", "attributes_json", "created_at", "updated_at")


@query(f"{_A} WHERE a.annotation_uid = 'ann_Supplier#000000007'")
def annotation_by_uid(p: Projection) -> DataFrame:
    t = {**p.store(), "value_block": p.spark.createDataFrame([], TABLES["value_block"])}
    return catalog.get_annotation(t, "ann_Supplier#000000007")["annotation"].drop(*_EMPTY)


@query("SELECT annotation_id * 10000 + assessed_year assessment_id, asset_part_id, CAST(1 AS INTEGER) element_kind, CAST(count(*) AS BIGINT) block_count, CAST(sum(element_count) AS BIGINT) element_count FROM member_block WHERE annotation_id = 7 GROUP BY ALL")
def annotation_memberships(p: Projection) -> DataFrame:
    t = {**p.store(), "value_block": p.spark.createDataFrame([], TABLES["value_block"])}
    return catalog.get_annotation(t, 7)["memberships"]


@query("SELECT class_id, local_name FROM closure k JOIN class_dim c ON c.class_id = k.descendant WHERE k.ancestor = 102", _CLOSURE)
def classes_instantiable(p: Projection) -> DataFrame:
    t = p.store()
    k = graph.closure(p.classes())
    return catalog.instantiable_classes(t["semantic_class"], k, "ASIA").select(F.col("semantic_class_id").alias("class_id"), "local_name")


@query("SELECT annotation_id * 10000 + assessed_year assessment_id, element_index FROM member_element WHERE annotation_id = 7 AND assessed_year = 1995")
def forward_one_assessment(p: Projection) -> DataFrame:
    one = p.annotations().where("annotation_id = 7").select("annotation_id")
    return claims.elements_for_claims(p.store()["membership_block"], one, assessment_id=71995, asset_part_id=1).select("assessment_id", "element_index")


@query("SELECT object_id AS city_object_id, object_uid FROM object_dim WHERE object_id IN (SELECT object_id FROM reach)", _REACH.format(uids="'MIDDLE EAST'"))
def objects_below(p: Projection) -> DataFrame:
    start = p.objects().where("object_uid = 'MIDDLE EAST'").select("object_id")
    below = graph.reachable(graph.typed_edges(p.edges(), types=["boundary", "part"]), start).select(F.col("object_id").alias("city_object_id"))
    objects = p.store()["city_object"].withColumns({"object_status": F.lit("accepted"), "source_asset_id": F.lit(None).cast("long")})
    return catalog.list_objects(objects, p.store()["asset"], below=below).select("city_object_id", "object_uid")


@query(f"SELECT asset_part_id, 'f8' value_dtype, CAST(count(DISTINCT element_index // {CHUNK}) AS BIGINT) block_count, CAST(count(*) AS BIGINT) value_count, min(v) FILTER (WHERE NOT isnan(v)) min_value, max(v) FILTER (WHERE NOT isnan(v)) max_value FROM (SELECT CAST(2 AS BIGINT) asset_part_id, element_index - (SELECT min(p_partkey) FROM part) element_index, v FROM value_element) GROUP BY asset_part_id")
def value_fields_summary(p: Projection) -> DataFrame:
    field = values.chunk_values(_first_index(p), ["asset_part_id"], CHUNK)
    return catalog.value_rollup(field.withColumns({"annotation_id": F.lit(1), "assessment_id": F.lit(1), "element_kind": F.lit(2), "value_dtype": F.lit("f8")})).select("asset_part_id", "value_dtype", "block_count", "value_count", "min_value", "max_value")


def queries() -> dict:
    return QUERIES
