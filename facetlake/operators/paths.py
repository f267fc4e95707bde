"""Ordered element paths: runs of segments, a segment lying on one part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


PLACES = 65_536


def segments(positions: DataFrame, key: str, places: int = PLACES) -> DataFrame:
    """Segments of (key, ordinal, asset_part_id, element_index, starts_run): cut at each run's start and change of part.

    Adds segment_ordinal, continues_previous, element_count, indices in
    traversal order (repeats kept). Ordinals are 0..n-1 within a key; windows
    run over stretches of ``places`` of them, and one row a stretch carries its
    last part and its number of cuts on, so a long path is no long task.
    """
    stretch = F.floor(F.col("ordinal") / places)
    rows = positions.select(key, "ordinal", "asset_part_id", "element_index", "starts_run", stretch.alias("__b")).repartition(F.col(key), F.col("__b"))
    w, along = W.partitionBy(key, "__b").orderBy("ordinal"), W.partitionBy(key).orderBy("__b")
    last = rows.groupBy(key, "__b").agg(F.max_by("asset_part_id", "ordinal").alias("__last"))
    last = last.select(key, "__b", F.lag("__last").over(along).alias("__before"))
    before = F.coalesce(F.lag("asset_part_id").over(w), F.col("__before"))
    cut = (F.col("starts_run") == 1) | ~F.col("asset_part_id").eqNullSafe(before)
    rows = rows.join(last, [key, "__b"]).withColumn("cut", F.when(cut, 1).otherwise(0))
    sums = rows.groupBy(key, "__b").agg(F.sum("cut").alias("__cuts"))
    sums = sums.select(key, "__b", F.coalesce(F.sum("__cuts").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__so_far"))
    rows = rows.withColumn("__run", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0))).join(sums, [key, "__b"]).withColumn("segment_ordinal", F.col("__so_far") + F.col("__run") - 1)
    return rows.groupBy(key, "segment_ordinal").agg(
        F.min("asset_part_id").alias("asset_part_id"), (1 - F.max("starts_run")).cast("long").alias("continues_previous"), F.count(F.lit(1)).alias("element_count"),
        F.array_sort(F.collect_list(F.struct("ordinal", "element_index")))["element_index"].alias("indices"),
    )


def runs(segs: DataFrame, key: str, places: int = PLACES) -> DataFrame:
    """Segments with ``run``: a run begins at each segment that does not continue the one before. Counted by stretches as in ``segments``."""
    rows = segs.withColumn("__b", F.floor(F.col("segment_ordinal") / places)).repartition(F.col(key), F.col("__b"))
    begins = 1 - F.col("continues_previous")
    so_far = F.sum("__n").over(W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    sums = rows.groupBy(key, "__b").agg(F.sum(begins).alias("__n")).select(key, "__b", F.coalesce(so_far, F.lit(0)).alias("__so_far"))
    within = F.sum(begins).over(W.partitionBy(key, "__b").orderBy("segment_ordinal").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__r", within).join(sums, [key, "__b"]).withColumn("run", (F.col("__so_far") + F.col("__r") - 1).cast("long")).select(*segs.columns, "run")


def positions(segs: DataFrame, key: str) -> DataFrame:
    """(key, segment_ordinal, place, asset_part_id, element_index) in traversal order."""
    return segs.select(key, "segment_ordinal", "asset_part_id", F.posexplode("indices").alias("place", "element_index"))


def path_summary(segs: DataFrame, key: str) -> DataFrame:
    return segs.groupBy(key).agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum(F.when(F.col("continues_previous") == 0, 1).otherwise(0)).cast("long").alias("run_count"), F.sum("element_count").cast("long").alias("position_count")
    )


def derived_membership(segs: DataFrame, key: str) -> DataFrame:
    """The element set a path covers, per part: (key, asset_part_id, element_index), distinct."""
    return segs.select(key, "asset_part_id", F.explode("indices").alias("element_index")).distinct()


def ordinal_problems(segs: DataFrame, key: str) -> DataFrame:
    """(key, problem): ordinals that are not 0..n-1, and first segments that continue nothing."""
    g = segs.groupBy(key).agg(F.min("segment_ordinal").alias("lo"), F.max("segment_ordinal").alias("hi"), F.count_distinct("segment_ordinal").alias("n"), F.min_by("continues_previous", "segment_ordinal").alias("first"))
    gap = g.where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)).select(key, F.lit("gap").alias("problem"))
    return gap.unionByName(g.where("first = 1").select(key, F.lit("first_continues").alias("problem")))


def stale_parts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, asset_part_id) that a path covered before and no longer does."""
    return before.select(key, "asset_part_id").distinct().join(after.select(key, "asset_part_id").distinct(), [key, "asset_part_id"], "left_anti")
