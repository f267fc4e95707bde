"""Element sets as blocks: one row per index range with the offsets inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.schema import BLOCK_SIZE, MAX_INDEX, StoreError


def block_start(index: Column, size: int = BLOCK_SIZE) -> Column:
    return index - F.pmod(index, F.lit(size))


def checked_indices(elements: DataFrame, index: str = "element_index") -> DataFrame:
    """``elements`` whose rows raise on a NULL index or one that is no unsigned 32-bit number."""
    bad = F.col(index).isNull() | (F.col(index) < 0) | (F.col(index) > MAX_INDEX)
    return elements.withColumn(index, F.when(bad, F.raise_error(F.concat(F.lit("element index out of range: "), F.coalesce(F.col(index).cast("string"), F.lit("NULL")))).cast("long")).otherwise(F.col(index)))


def build_blocks(elements: DataFrame, keys: list[str], index: str = "element_index", size: int = BLOCK_SIZE) -> DataFrame:
    """Blocks of the element sets of each key: block_start, block_size, element_count, min/max index, sorted distinct offsets.

    ``elements`` has one row per element and may repeat them. A block has at
    most ``size`` offsets, so no group is larger, whatever the claim.
    """
    rows = elements.select(*keys, F.col(index).cast("long").alias("i")).withColumn("block_start", block_start(F.col("i"), size))
    offsets = F.array_sort(F.collect_set((F.col("i") - F.col("block_start")).cast("int")))
    return rows.groupBy(*keys, "block_start").agg(F.min("i").alias("min_element_index"), F.max("i").alias("max_element_index"), offsets.alias("offsets")).select(
        *keys, "block_start", F.lit(size).alias("block_size"), F.size("offsets").alias("element_count"), "min_element_index", "max_element_index", "offsets"
    )


def expand_blocks(blocks: DataFrame) -> DataFrame:
    """One row per element of each block, as ``element_index``; the block's offsets are dropped."""
    rest = [c for c in blocks.columns if c != "offsets"]
    return blocks.select(*rest, F.explode("offsets").alias("o")).withColumn("element_index", F.col("block_start") + F.col("o")).drop("o")


def write_clustered(blocks: DataFrame, path: str) -> None:
    """Blocks written so that a read of one part and index range opens few row groups."""
    if "asset_part_id" not in blocks.columns:
        raise StoreError("blocks have no asset_part_id")
    blocks.repartitionByRange("asset_part_id", "block_start").sortWithinPartitions("asset_part_id", "block_start").write.mode("overwrite").parquet(path)
