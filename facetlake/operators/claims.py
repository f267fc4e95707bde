"""Questions about claims: which cover a selection, and what a claim, concept or object covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.operators.blocks import block_start, expand_blocks
from facetlake.schema import BLOCK_SIZE, StoreError


def matched_elements(blocks: DataFrame, selection: DataFrame, keys: list[str], size: int = BLOCK_SIZE) -> DataFrame:
    """Reverse query, one row per claim key and selected element it covers: keys, element_index, block_start.

    ``selection``: asset_part_id, element_index (NULLs and repeats allowed).
    Blocks whose range meets no selected index of their start are left unread;
    the offsets of the others meet the selection on (part, element), so that a
    block that many claims share is spread over its elements.
    """
    sel = selection.select("asset_part_id", F.col("element_index").cast("long").alias("element_index")).where("asset_part_id is not null and element_index is not null").distinct()
    spans = sel.groupBy("asset_part_id", block_start(F.col("element_index"), size).alias("block_start")).agg(F.min("element_index").alias("lo"), F.max("element_index").alias("hi"))
    hit = blocks.join(spans, ["asset_part_id", "block_start"]).where((F.col("min_element_index") <= F.col("hi")) & (F.col("max_element_index") >= F.col("lo")))
    inside = F.filter("offsets", lambda o: (F.col("block_start") + o).between(F.col("lo"), F.col("hi")))
    rows = hit.select(*keys, "asset_part_id", "block_start", F.explode(inside).alias("o")).withColumn("element_index", F.col("block_start") + F.col("o")).drop("o")
    return rows.join(sel, ["asset_part_id", "element_index"]).select(*keys, "asset_part_id", "block_start", "element_index").distinct()


def claims_for_elements(blocks: DataFrame, selection: DataFrame, keys: list[str], size: int = BLOCK_SIZE, elements: bool = True) -> DataFrame:
    """Reverse query, one row per claim key: first_block (for first-hit order), n_matched, first_element, last_element, and with ``elements`` matched_elements (ascending, distinct)."""
    rows = matched_elements(blocks, selection, keys, size)
    more = [F.array_sort(F.collect_set("element_index")).alias("matched_elements")] if elements else []
    return rows.groupBy(*keys).agg(
        F.min("block_start").alias("first_block"), F.count_distinct("element_index").alias("n_matched"), F.min("element_index").alias("first_element"), F.max("element_index").alias("last_element"), *more
    )


#: A pick of more elements goes through the selection as a table only.
MOST_PICKED = 100_000


def claims_for_pick(blocks: DataFrame, asset_part_id: int, elements: list[int], keys: list[str], size: int = BLOCK_SIZE) -> DataFrame:
    """``claims_for_elements`` for a pick that is at hand as numbers: the part, the block starts and the range become filters of the scan, so a clustered table opens few row groups."""
    picked = sorted(set(elements))
    if len(picked) > MOST_PICKED:
        raise StoreError(f"a pick has at most {MOST_PICKED} elements; larger ones are a selection table")
    spark = blocks.sparkSession
    if not picked:
        return claims_for_elements(blocks.limit(0), spark.createDataFrame([], "asset_part_id long, element_index long"), keys, size)
    near = (F.col("asset_part_id") == asset_part_id) & (F.col("min_element_index") <= picked[-1]) & (F.col("max_element_index") >= picked[0])
    starts = sorted({i - i % size for i in picked})
    near = near & F.col("block_start").between(starts[0], starts[-1]) & F.col("block_start").isin(starts)
    selection = spark.createDataFrame([(asset_part_id, i) for i in picked], "asset_part_id long, element_index long")
    return claims_for_elements(blocks.where(near), selection, keys, size)


def elements_for_claims(blocks: DataFrame, claims: DataFrame | None = None, key: str = "annotation_id", expand: bool = True, assessment_id: int | None = None, asset_part_id: int | None = None) -> DataFrame:
    """Forward query: the blocks, or the elements, of the claims in ``claims`` (all without it), of one assessment or part where one is named."""
    rows = blocks if claims is None else blocks.join(claims.select(key).distinct(), key, "left_semi")
    for column, value in (("assessment_id", assessment_id), ("asset_part_id", asset_part_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return expand_blocks(rows) if expand else rows


def claims_of_classes(closure: DataFrame, annotations: DataFrame, classes: DataFrame, include_subclasses: bool = True) -> DataFrame:
    """Claims (annotation_id) whose concept is one of ``classes`` (class_id) or, by ``closure`` (ancestor, descendant), below one."""
    wanted = closure.join(classes.select(F.col("class_id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("class_id")) if include_subclasses else classes.select("class_id")
    return annotations.join(wanted.distinct(), "class_id", "left_semi").select("annotation_id")


def class_subtree(closure: DataFrame, annotations: DataFrame, blocks: DataFrame, classes: DataFrame, include_subclasses: bool = True) -> DataFrame:
    """Blocks of the claims of ``claims_of_classes``."""
    return blocks.join(claims_of_classes(closure, annotations, classes, include_subclasses), "annotation_id", "left_semi")


def claims_of_objects(objects: DataFrame, annotations: DataFrame, links: DataFrame, link_types: list[str] | None = None) -> DataFrame:
    """Claims (annotation_id) whose primary object is in ``objects`` (object_id), or that are linked to one by one of ``link_types``."""
    by_primary = annotations.join(objects.select(F.col("object_id").alias("primary_object_id")), "primary_object_id", "left_semi").select("annotation_id")
    chosen = links.where(F.col("relation_type").isin(link_types if link_types is not None else ["represents"]))
    return by_primary.unionByName(chosen.join(objects.select("object_id"), "object_id", "left_semi").select("annotation_id")).distinct()


def object_subtree(reached: DataFrame, annotations: DataFrame, links: DataFrame, blocks: DataFrame, link_types: list[str] | None = None) -> DataFrame:
    """Blocks of all claims about the objects in ``reached`` (object_id), each block once."""
    return blocks.join(claims_of_objects(reached, annotations, links, link_types), "annotation_id", "left_semi")


def block_order(blocks: DataFrame) -> DataFrame:
    """Blocks by part, kind, place and claim, as subtree queries give them."""
    return blocks.orderBy("asset_part_id", "element_kind", "block_start", "annotation_id")


def forward_order(blocks: DataFrame) -> DataFrame:
    """Blocks of a claim by assessment, part, kind and place."""
    return blocks.orderBy("assessment_id", "asset_part_id", "element_kind", "block_start")


def first_hit_order(claims: DataFrame) -> DataFrame:
    """Results of the reverse query in the order in which a scan by block meets them."""
    return claims.orderBy("first_block", "annotation_id")
