"""A synthetic city of any size, made by ranges and explodes: buildings of roof, wall and ground faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Faces of a building by kind.
FACES = {"RoofSurface": 120, "WallSurface": 300, "GroundSurface": 80}
PER_BUILDING = sum(FACES.values())


def city(spark: SparkSession, buildings: int) -> dict[str, DataFrame]:
    """objects (object_id, object_uid, concept), edges (src, dst, rel_type, category), annotations and elements of the city."""
    b = spark.range(buildings).withColumnRenamed("id", "b")
    first, rows = 0, []
    for i, (kind, n) in enumerate(FACES.items()):
        rows.append(F.struct(F.lit(i + 1).alias("k"), F.lit(kind).alias("concept"), F.lit(first).alias("first"), F.lit(n).alias("n")))
        first += n
    s = b.select("b", F.explode(F.array(*rows)).alias("s")).select("b", "s.*")
    surface = (F.col("b") * 4 + F.col("k")).alias("object_id")
    objects = b.select((F.col("b") * 4).alias("object_id"), F.concat(F.lit("building_"), "b").alias("object_uid"), F.lit("Building").alias("concept")).unionByName(
        s.select(surface, F.concat_ws("_", F.lit("building"), F.col("b").cast("string"), F.lower("concept")).alias("object_uid"), "concept")
    )
    edges = s.select((F.col("b") * 4).alias("src"), surface.alias("dst"), F.lit("boundary").alias("rel_type"), F.lit("containment").alias("category"))
    annotations = s.select((F.col("b") * 3 + F.col("k") - 1).alias("annotation_id"), "concept", surface.alias("primary_object_id"))
    elements = s.select((F.col("b") * 3 + F.col("k") - 1).alias("annotation_id"), F.lit(1).cast("long").alias("asset_part_id"), F.explode(F.sequence(F.col("b") * PER_BUILDING + F.col("first"), F.col("b") * PER_BUILDING + F.col("first") + F.col("n") - 1)).alias("element_index"))
    return {"objects": objects, "edges": edges, "annotations": annotations, "elements": elements}
