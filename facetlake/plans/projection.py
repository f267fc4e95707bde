"""The star-schema tables seen as a store of parts, concepts, objects, claims, blocks, fields and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetlake.operators import blocks, paths, values
from facetlake.sources.tables import table

CHUNK = 256


class Projection:
    """DataFrames of one data folder, made on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def parts(self) -> DataFrame:
        row = lambda df, i, asset, path, kind, n: df.agg(n.cast("long").alias("element_count")).select(F.lit(i).cast("long").alias("asset_part_id"), F.lit(asset).cast("long").alias("asset_id"), F.lit(path).alias("part_path"), F.lit(kind).cast("long").alias("element_kind"), "element_count")
        ev = self.t("events")
        return (
            row(self.t("lineitem"), 1, 1, "lineitem/all", 1, 7 * (F.max("l_orderkey") + 1))
            .unionByName(row(self.t("part"), 2, 2, "part/all", 2, F.max("p_partkey") + 1))
            .unionByName(row(ev, 3, 3, "events/even", 4, F.floor(F.max("event_id") / 2) + 1))
            .unionByName(row(ev, 4, 3, "events/odd", 4, F.floor((F.max("event_id") - 1) / 2) + 1))
        )

    def classes(self) -> DataFrame:
        cols = lambda df, i, p, n: df.select(i.cast("long").alias("class_id"), p.cast("long").alias("parent_id"), n.alias("local_name"))
        root = self.spark.range(1).select(F.lit(0).cast("long").alias("class_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("World").alias("local_name"))
        region = cols(self.t("region"), 100 + F.col("r_regionkey"), F.lit(0), F.col("r_name"))
        return root.unionByName(region).unionByName(cols(self.t("nation"), 1000 + F.col("n_nationkey"), 100 + F.col("n_regionkey"), F.col("n_name")))

    def objects(self) -> DataFrame:
        tree = self.classes().select(F.col("class_id").alias("object_id"), F.col("local_name").alias("object_uid"), "class_id")
        return tree.unionByName(self.t("supplier").select((100000 + F.col("s_suppkey")).alias("object_id"), F.col("s_name").alias("object_uid"), (1000 + F.col("s_nationkey")).cast("long").alias("class_id")))

    def edges(self) -> DataFrame:
        def e(df: DataFrame, src, dst, ext, kind: str, category: str | None) -> DataFrame:
            return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), ext.cast("string").alias("ext"), F.lit(kind).alias("rel_type"), F.lit(category).cast("string").alias("category"))

        none, s = F.lit(None), self.t("supplier")
        n = F.col("n_nationkey")
        return (
            e(self.classes().where("parent_id is not null"), F.col("parent_id"), F.col("class_id"), none, "boundary", "containment")
            .unionByName(e(s, 1000 + F.col("s_nationkey"), 100000 + F.col("s_suppkey"), none, "part", "containment"))
            .unionByName(e(self.t("nation"), 1000 + n, 1000 + (n + 1) % 25, none, "adjacentTo", "peer"))
            .unionByName(e(s.where("s_suppkey % 10 = 0"), 100000 + F.col("s_suppkey"), none, F.concat(F.lit("ext://"), "s_name"), "relatedTo", None))
        )

    def annotations(self) -> DataFrame:
        k = F.col("s_suppkey")
        status = F.when(k % 4 == 0, "draft").when(k % 4 == 1, "accepted").when(k % 4 == 2, "rejected").otherwise("superseded")
        return self.t("supplier").select(
            k.alias("annotation_id"), F.concat(F.lit("ann_"), "s_name").alias("annotation_uid"), (1000 + F.col("s_nationkey")).cast("long").alias("class_id"),
            F.when(k % 5 != 0, 100000 + k).alias("primary_object_id"), status.alias("status"),
        )

    def links(self) -> DataFrame:
        """Claims without primary object are linked to their supplier's object."""
        return self.annotations().where("primary_object_id is null").select("annotation_id", (100000 + F.col("annotation_id")).alias("object_id"), F.lit("represents").alias("relation_type"))

    def stated_elements(self) -> DataFrame:
        """Elements as stated, repeats included; blocks and counts take sets of them anyway."""
        return self.t("lineitem").select(
            F.col("l_suppkey").alias("annotation_id"), F.year("l_shipdate").cast("long").alias("assessed_year"), F.lit(1).cast("long").alias("asset_part_id"),
            (F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1).alias("element_index"),
        )

    def elements(self) -> DataFrame:
        return self.stated_elements().distinct()

    def member_blocks(self, chosen: DataFrame | None = None) -> DataFrame:
        """Blocks of all claims, or of those in ``chosen`` (annotation_id): no others are built."""
        stated = self.stated_elements()
        return blocks.build_blocks(stated if chosen is None else stated.join(chosen.select("annotation_id").distinct(), "annotation_id", "left_semi"), ["annotation_id", "assessed_year", "asset_part_id"])

    def store(self) -> dict[str, DataFrame]:
        """The same claims as tables of a store; assessments are (claim, year)."""
        none = lambda kind: F.lit(None).cast(kind)
        stated = self.stated_elements().withColumns({"assessment_id": F.col("annotation_id") * 10_000 + F.col("assessed_year"), "element_kind": F.lit(1)})
        years = stated.select("assessment_id", "annotation_id", "assessed_year").distinct()
        return {
            "asset": self.parts().groupBy("asset_id").agg(F.min("part_path").alias("uri")).withColumns({"asset_kind": F.when(F.col("asset_id") == 3, "pointcloud").otherwise("mesh"), "content_hash": none("string"), "srs_id": none("int")}),
            "asset_part": self.parts(),
            "semantic_class": self.classes().select(F.col("class_id").alias("semantic_class_id"), F.lit("world").alias("scheme"), none("string").alias("scheme_version"), F.concat(F.lit("w:"), "local_name").alias("class_uri"), "local_name", F.col("parent_id").alias("parent_class_id"), none("string").alias("concept_iri"), (F.col("class_id") >= 1000).alias("is_ade")),
            "city_object": self.objects().select(F.col("object_id").alias("city_object_id"), "object_uid", F.concat(F.lit("gml-"), "object_uid").alias("gml_id"), F.col("class_id").alias("semantic_class_id")),
            "annotation": self.annotations().select("annotation_id", "annotation_uid", F.col("class_id").alias("semantic_class_id"), F.col("primary_object_id").alias("primary_city_object_id"), "status", *[none(k).alias(c) for c, k in (("confidence", "double"), ("label", "string"), ("attributes_json", "string"), ("created_at", "string"), ("updated_at", "string"))]),
            "annotation_object": self.links().withColumnRenamed("object_id", "city_object_id"),
            "assessment": years.select("assessment_id", F.concat(F.lit("asm_"), "assessment_id").alias("assessment_uid"), "annotation_id", F.lit(1).cast("long").alias("asset_id"), F.when(F.col("assessed_year") > 1992, F.concat(F.col("assessed_year").cast("string"), F.lit("-01-01"))).alias("assessed_at"), F.lit("accepted").alias("status"), none("double").alias("confidence"), none("string").alias("attributes_json"), none("string").alias("created_at"), none("string").alias("updated_at")),
            "membership_block": blocks.build_blocks(stated, ["assessment_id", "annotation_id", "asset_part_id", "element_kind"]),
            "path_block": self.path_segments().select(F.lit(None).cast("long").alias("path_block_id"), (F.col("annotation_id") * 10_000 + 1994).alias("assessment_id"), "asset_part_id", "segment_ordinal", "continues_previous", "element_count", "indices"),
        }

    def value_elements(self) -> DataFrame:
        v = F.when(F.col("p_size") % 10 == 0, float("nan")).otherwise(F.col("p_retailprice"))
        return self.t("part").select(F.lit(2).cast("long").alias("asset_part_id"), F.col("p_partkey").alias("element_index"), v.alias("v"))

    def value_chunks(self, chunk: int = CHUNK) -> DataFrame:
        return values.chunk_values(self.value_elements(), ["asset_part_id"], chunk)

    def path_positions(self) -> DataFrame:
        w = W.partitionBy("user_id").orderBy("ts", "event_id")
        before = F.lag("ts").over(w)
        gap = before.isNull() | (F.col("ts") > before + F.expr("INTERVAL '12' HOUR"))
        return self.t("events").select(
            F.col("user_id").alias("annotation_id"), (3 + F.col("event_id") % 2).cast("long").alias("asset_part_id"), ((F.col("event_id") - F.col("event_id") % 2) / 2).cast("long").alias("element_index"),
            (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.when(gap, 1).otherwise(0).cast("long").alias("starts_run"),
        )

    def path_segments(self) -> DataFrame:
        return paths.segments(self.path_positions(), "annotation_id")


#: The same projection for the comparing database.
SQL = {
    "part_dim": """SELECT CAST(1 AS BIGINT) asset_part_id, CAST(1 AS BIGINT) asset_id, 'lineitem/all' part_path, CAST(1 AS BIGINT) element_kind, (SELECT CAST(7*(max(l_orderkey)+1) AS BIGINT) FROM lineitem) element_count
UNION ALL SELECT 2, 2, 'part/all', 2, (SELECT max(p_partkey)+1 FROM part)
UNION ALL SELECT 3, 3, 'events/even', 4, (SELECT CAST(floor(max(event_id)/2)+1 AS BIGINT) FROM events)
UNION ALL SELECT 4, 3, 'events/odd', 4, (SELECT CAST(floor((max(event_id)-1)/2)+1 AS BIGINT) FROM events)""",
    "class_dim": """SELECT CAST(0 AS BIGINT) class_id, CAST(NULL AS BIGINT) parent_id, 'World' local_name
UNION ALL SELECT 100+r_regionkey, 0, r_name FROM region
UNION ALL SELECT 1000+n_nationkey, 100+n_regionkey, n_name FROM nation""",
    "object_dim": """SELECT class_id object_id, local_name object_uid, class_id FROM class_dim
UNION ALL SELECT 100000+s_suppkey, s_name, 1000+s_nationkey FROM supplier""",
    "edge_fact": """SELECT parent_id src, class_id dst, CAST(NULL AS VARCHAR) ext, 'boundary' rel_type, 'containment' category FROM class_dim WHERE parent_id IS NOT NULL
UNION ALL SELECT 1000+s_nationkey, 100000+s_suppkey, NULL, 'part', 'containment' FROM supplier
UNION ALL SELECT 1000+n_nationkey, 1000+(n_nationkey+1)%25, NULL, 'adjacentTo', 'peer' FROM nation
UNION ALL SELECT 100000+s_suppkey, NULL, 'ext://'||s_name, 'relatedTo', NULL FROM supplier WHERE s_suppkey%10=0""",
    "annotation_fact": """SELECT CAST(s_suppkey AS BIGINT) annotation_id, 'ann_'||s_name annotation_uid, CAST(1000+s_nationkey AS BIGINT) class_id, CAST(CASE WHEN s_suppkey%5=0 THEN NULL ELSE 100000+s_suppkey END AS BIGINT) primary_object_id,
CASE s_suppkey%4 WHEN 0 THEN 'draft' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'superseded' END status FROM supplier""",
    "link_fact": """SELECT annotation_id, 100000+annotation_id object_id, 'represents' relation_type FROM annotation_fact WHERE primary_object_id IS NULL""",
    "member_element": """SELECT DISTINCT l_suppkey annotation_id, CAST(year(l_shipdate) AS BIGINT) assessed_year, CAST(1 AS BIGINT) asset_part_id, CAST(l_orderkey*7 + l_linenumber-1 AS BIGINT) element_index FROM lineitem""",
    "member_block": """SELECT annotation_id, assessed_year, asset_part_id, element_index - element_index % 16384 block_start, CAST(count(*) AS BIGINT) element_count, min(element_index) min_element_index, max(element_index) max_element_index
FROM member_element GROUP BY ALL""",
    "value_element": """SELECT CAST(p_partkey AS BIGINT) element_index, CASE WHEN p_size%10=0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END v FROM part""",
    "path_position": """SELECT user_id annotation_id, CAST(3 + event_id % 2 AS BIGINT) asset_part_id, CAST((event_id - event_id % 2) / 2 AS BIGINT) element_index, CAST(row_number() OVER w - 1 AS BIGINT) ordinal,
CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL '12' HOUR THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END starts_run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "path_cut": """SELECT *, CAST(sum(cut) OVER (PARTITION BY annotation_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) segment_ordinal
FROM (SELECT *, CASE WHEN starts_run = 1 OR asset_part_id <> lag(asset_part_id) OVER (PARTITION BY annotation_id ORDER BY ordinal) THEN 1 ELSE 0 END cut FROM path_position) p""",
    "path_segment": """SELECT annotation_id, segment_ordinal, min(asset_part_id) asset_part_id, CAST(1 - max(starts_run) AS BIGINT) continues_previous, CAST(count(*) AS BIGINT) element_count FROM path_cut GROUP BY annotation_id, segment_ordinal""",
}


def with_views(body: str, recursive: str = "") -> str:
    """``body`` behind the projection as common table expressions; only those it needs."""
    need, grown = set(), True
    text = body + recursive
    while grown:
        more = {n for n in SQL if n not in need and (n in text or any(n in SQL[m] for m in need))}
        grown, need = bool(more), need | more
    ctes = [f"{n} AS ({SQL[n]})" for n in SQL if n in need] + ([recursive] if recursive else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body if ctes else body
