"""Batch entries with value fields and paths, applied to a store, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import catalog
from facetlake.plans.projection import Projection, with_views
from facetlake.schema import TABLES
from facetlake.session import scratch
from facetlake.sources import batch
from facetlake.store import Store

#: Elements of a part that a value field of one entry covers.
PIECE = 1000


def _store(spark: SparkSession, parts: DataFrame) -> Store:
    """A store of one asset, its parts (asset_part_id, element_kind, element_count) and one concept."""
    store = Store.create(spark, scratch(spark, "store"))
    blank = lambda name, df: df.select("*", *[F.lit(None).alias(f.split()[0]) for f in TABLES[name].split(", ") if f.split()[0] not in df.columns])
    with store.transaction():
        store.stage("asset", blank("asset", spark.range(1).select(F.lit(1).alias("asset_id"), F.lit("all").alias("uri"), F.lit("mesh").alias("asset_kind"))))
        store.stage("asset_part", blank("asset_part", parts.select("asset_part_id", F.lit(1).alias("asset_id"), F.concat(F.lit("part/"), "asset_part_id").alias("part_path"), "element_kind", "element_count")))
        store.stage("semantic_class", blank("semantic_class", spark.range(1).select(F.lit(1).alias("semantic_class_id"), F.lit("s").alias("scheme"), F.lit("s:Thing").alias("class_uri"), F.lit("Thing").alias("local_name"))))
    return store


def _entries(rows: DataFrame) -> DataFrame:
    """``rows`` (n, annotation_uid, and carriers) as batch entries of the concept."""
    schema = rows.sparkSession.createDataFrame([], batch.ENTRY).schema
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in rows.columns} | {"concept": F.lit("Thing"), "given": F.array(F.lit("concept"))})


def batch_value_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of parts as value fields, one entry a piece of PIECE keys; the fields as stored."""
    p = Projection(spark, folder)
    v = p.value_elements().withColumns({"piece": F.floor(F.col("element_index") / PIECE)})
    first = v.groupBy("piece").agg(F.min("element_index").alias("lo"), F.count(F.lit(1)).alias("size"))
    store = _store(spark, first.select((F.col("piece") + 1).alias("asset_part_id"), F.lit(1).alias("element_kind"), F.col("size").alias("element_count")))
    field = F.struct((F.col("piece") + 1).alias("asset_part_id"), F.lit(None).cast("string").alias("asset_uri"), F.lit(None).cast("string").alias("part_path"), F.lit(1).alias("element_kind"), F.transform(F.array_sort("vals"), lambda x: x["v"]).alias("values"), F.lit("f8").alias("value_dtype"))
    lists = v.groupBy("piece").agg(F.collect_list(F.struct("element_index", "v")).alias("vals"))
    entries = lists.select(F.col("piece").alias("n"), F.concat(F.lit("price "), "piece").alias("annotation_uid"), F.array(field).alias("value_fields"))
    batch.apply_entries(store, _entries(entries))
    named = store.table("annotation").select("annotation_id", "annotation_uid")
    return catalog.value_rollup(store.table("value_block")).join(named, "annotation_id").select("annotation_uid", "asset_part_id", "value_dtype", "value_count", "min_value", "max_value")


def batch_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Tours of users as ordered paths, one entry a user; the segments and the implied memberships as stored."""
    p = Projection(spark, folder)
    store = _store(spark, p.parts().where("asset_id = 3").select("asset_part_id", F.col("element_kind").cast("int").alias("element_kind"), "element_count"))
    step = F.struct("segment_ordinal", "asset_part_id", F.lit(None).cast("string").alias("asset_uri"), F.lit(None).cast("string").alias("part_path"), F.lit(None).cast("int").alias("element_kind"), F.col("indices").alias("element_indices"), (F.col("continues_previous") == 1).alias("continues_previous"))
    tours = p.path_segments().groupBy("annotation_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    way = F.transform("steps", lambda s: F.struct(*[s[c].alias(c) for c in ("asset_part_id", "asset_uri", "part_path", "element_kind", "element_indices", "continues_previous")]))
    batch.apply_entries(store, _entries(tours.select(F.col("annotation_id").alias("n"), F.concat(F.lit("tour "), "annotation_id").alias("annotation_uid"), way.alias("path"))))
    t = store.tables()
    owner = t["assessment"].select("assessment_id", "annotation_id").join(t["annotation"].select("annotation_id", "annotation_uid"), "annotation_id")
    rollup = catalog.path_rollup(t["path_block"]).join(owner, "assessment_id")
    member = t["membership_block"].groupBy("assessment_id").agg(F.sum("element_count").cast("long").alias("element_count"))
    return rollup.join(member, "assessment_id").select("annotation_uid", "segment_count", "path_run_count", "position_count", "element_count")


ORACLE = {
    "batch_value_fields": f"""SELECT 'price ' || piece AS annotation_uid, CAST(piece + 1 AS BIGINT) AS asset_part_id, 'f8' AS value_dtype, CAST(count(*) AS BIGINT) AS value_count, min(v) FILTER (WHERE NOT isnan(v)) AS min_value, max(v) FILTER (WHERE NOT isnan(v)) AS max_value
FROM (SELECT p_partkey // {PIECE} piece, CASE WHEN p_size % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END v FROM part) GROUP BY piece""",
    "batch_paths": with_views("""SELECT 'tour ' || s.annotation_id AS annotation_uid, CAST(count(*) AS BIGINT) AS segment_count, CAST(sum(1 - continues_previous) AS BIGINT) AS path_run_count, CAST(sum(s.element_count) AS BIGINT) AS position_count, CAST(any_value(m.n) AS BIGINT) AS element_count
FROM path_segment s JOIN (SELECT annotation_id, count(*) n FROM (SELECT DISTINCT annotation_id, asset_part_id, element_index FROM path_position) GROUP BY 1) m ON m.annotation_id = s.annotation_id GROUP BY s.annotation_id"""),
}


def queries() -> dict:
    return {f.__name__: f for f in (batch_value_fields, batch_paths)}
