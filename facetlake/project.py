"""Building a store from a project description: vocabularies, link types, city models, geometry, batches, in one commit."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import graph, mutate, validate
from facetlake.schema import StoreError
from facetlake.session import cut_lineage
from facetlake.sources import batch, citymodel, geometry
from facetlake.store import Store

CONFIG_KEYS = {"store", "package_iri", "srs_id", "vocabulary_files", "scheme", "relationship_types", "citygml", "geometry", "batches", "validate_level", "graph_name"}
SAMPLES = 100


def register_concepts(store: Store, concepts: DataFrame) -> None:
    """Concepts by class_uri, NULLs filled and contradictions refused; parents by uri, name or IRI within the scheme."""
    given = cut_lineage(concepts.dropDuplicates(["class_uri", "parent_uri"]))
    rows = given.select("scheme", "scheme_version", "class_uri", "local_name", "source_namespace", "concept_iri", "is_ade").distinct()
    merged = cut_lineage(mutate.merge_rows(store.table("semantic_class"), rows, ["class_uri"], "semantic_class_id"))
    names = merged.select("scheme", F.col("semantic_class_id").alias("parent"), F.explode(F.array("class_uri", "local_name", "concept_iri")).alias("parent_uri")).where("parent_uri is not null").distinct()
    links = given.where("parent_uri is not null").join(names, ["scheme", "parent_uri"]).groupBy("class_uri").agg(F.min("parent").alias("parent"), F.count_distinct("parent").alias("k"))
    clash = links.where("k > 1").take(1)
    if clash:
        raise StoreError(f"two parents: {clash[0]['class_uri']}")
    out = merged.join(links, "class_uri", "left")
    conflict = out.where("parent is not null and parent_class_id is not null and parent <> parent_class_id").take(1)
    if conflict:
        raise StoreError(f"another parent is stored: {conflict[0]['class_uri']}")
    store.stage("semantic_class", out.withColumn("parent_class_id", F.coalesce("parent_class_id", "parent")))


def parents_first(classes: DataFrame) -> DataFrame:
    """Concepts (class_id, parent_id) with their depth, in an order in which every parent comes before its children."""
    depth = graph.closure(classes).groupBy(F.col("descendant").alias("class_id")).agg(F.max("depth").alias("depth"))
    return classes.join(depth, "class_id").orderBy("depth", "class_id")


def register_files(store: Store, files: list[str], kind: str) -> DataFrame:
    """Assets of files by uri and hash; returns (uri, asset_id). Files are read by workers, a file a row."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content_hash=[validate.file_hash(f, ".")[1] for f in pdf["uri"]])

    rows = store.spark.createDataFrame([(f, kind, geometry.MEDIA_TYPES.get(geometry.suffix_of(f))) for f in files], "uri string, asset_kind string, media_type string")
    wanted = cut_lineage(rows.repartition(max(1, len(files))).mapInPandas(hashed, "uri string, asset_kind string, media_type string, content_hash string"))
    assets = cut_lineage(mutate.register_assets(store.table("asset"), wanted))
    store.stage("asset", assets)
    # An asset of another hash under the same uri is not the one that was read.
    on = (F.col("a.uri") == F.col("w.uri")) & (F.col("w.content_hash").isNull() | F.col("a.content_hash").eqNullSafe(F.col("w.content_hash")))
    return assets.alias("a").join(wanted.alias("w"), on, "left_semi").select("uri", "asset_id")


def register_parts(store: Store, parts: DataFrame, kind: str) -> None:
    """Assets and index spaces of ``geometry.read_parts``; a part found again must have the same count. Asset CRS comes from the parts' own."""
    parts = cut_lineage(parts)
    ids = register_files(store, [r[0] for r in parts.select("path").distinct().collect()], kind)
    codes = {p: geometry.epsg_of_wkt(w) for p, w in parts.where("crs_wkt is not null").select("path", "crs_wkt").distinct().collect()}
    if any(codes.values()):
        srs = store.spark.createDataFrame([(p, c) for p, c in codes.items() if c], "uri string, found int")
        assets = store.table("asset")
        store.stage("asset", assets.join(srs, "uri", "left").withColumn("srs_id", F.coalesce("srs_id", "found")).select(*assets.columns))
    profile = F.when(F.col("element_kind") == 2, "facetlake:points-order").otherwise("facetlake:faces-order")
    wanted = parts.join(ids, parts["path"] == ids["uri"]).select("asset_id", "part_path", "element_kind", "element_count", F.lit("zero").alias("index_origin"), profile.alias("indexing_profile"), "minx", "miny", "minz", "maxx", "maxy", "maxz")
    store.stage("asset_part", mutate.merge_rows(store.table("asset_part"), wanted, ["asset_id", "part_path", "element_kind"], "asset_part_id"))


def register_city_model(store: Store, path: str, graph_name: str = "default") -> None:
    """Objects and edges of a document whose element names the store's concepts know; a linked property that is no known type is skipped."""
    classes = store.table("semantic_class")
    objects, edges = citymodel.read_citygml(store.spark, path, classes.select("source_namespace", "local_name"))
    asset = register_files(store, [path], "citymodel").first()["asset_id"]
    names = classes.select(F.col("source_namespace").alias("ns"), F.col("local_name").alias("semantic_class"), "semantic_class_id")
    wanted = objects.join(names, ["ns", "semantic_class"]).select("object_uid", "gml_id", "semantic_class_id", F.lit(asset).alias("source_asset_id"), F.lit("accepted").alias("object_status"))
    stored = cut_lineage(mutate.merge_rows(store.table("city_object"), wanted, ["object_uid"], "city_object_id"))
    store.stage("city_object", stored)
    inline = edges.where("to_uid is not null or stated").select("relationship_type", "code_space").distinct()
    types = mutate.register_types(store.table("relationship_type"), inline.select(F.col("relationship_type").alias("local_name"), "code_space", F.lit(None).cast("string").alias("category")))
    types = cut_lineage(types)
    store.stage("relationship_type", types)
    ids = stored.select(F.col("object_uid").alias("from_uid"), F.col("city_object_id").alias("from_city_object_id"))
    to = stored.select(F.col("object_uid").alias("to_uid"), F.col("city_object_id").alias("to_city_object_id"))
    t = types.select(F.col("local_name").alias("relationship_type"), F.coalesce("code_space", F.lit("")).alias("code_space"), "relationship_type_id")
    rows = edges.join(t, ["relationship_type", "code_space"]).join(ids, "from_uid").join(to, "to_uid", "left").select(
        F.lit(graph_name).alias("graph_name"), "from_city_object_id", "to_city_object_id", "to_external_uri", "relationship_type_id", "role",
        F.lit(asset).alias("source_asset_id"), F.lit(None).cast("string").alias("source_relation_id"), F.lit(None).cast("string").alias("metadata_json"),
    )
    store.stage("relationship", mutate.link_objects(store.table("relationship"), rows))


def build(spark: SparkSession, config: dict, base_dir: str = ".", update: bool = False) -> dict:
    """Builds or updates a store and returns its manifest of counts; errors found by validation undo everything."""
    citymodel.unknown_keys(config, CONFIG_KEYS, "project")
    at = lambda p: p if os.path.isabs(p) else os.path.join(base_dir, p)
    path = at(config["store"])
    store = Store.open(spark, path) if update else Store.create(spark, path, config.get("package_iri"), srs_id=config.get("srs_id"))
    with store.transaction():
        store.stage("relationship_type", mutate.register_types(store.table("relationship_type"), citymodel.default_types(spark)))
        concepts, types = citymodel.read_vocabulary_folder(spark, [at(p) for p in config.get("vocabulary_files", [])], config.get("scheme", "local"))
        register_concepts(store, concepts)
        declared = types.unionByName(spark.createDataFrame([(t["local_name"], t.get("code_space"), t.get("category"), False) for t in config.get("relationship_types", [])], types.schema))
        store.stage("relationship_type", mutate.register_types(store.table("relationship_type"), declared))
        for p in config.get("citygml", []):
            register_city_model(store, at(p), config.get("graph_name", "default"))
        for kind, suffixes in (("pointcloud", (".las", ".laz")), ("mesh", (".ply", ".obj", ".stl"))):
            files = [at(p) for p in config.get("geometry", []) if geometry.suffix_of(p) in suffixes]
            if files:
                register_parts(store, geometry.read_parts(spark, files), kind)
        for p in config.get("batches", []):
            with open(at(p), encoding="utf-8") as f:
                batch.apply_batch(store, json.load(f), os.path.dirname(at(p)), replace_existing=update)
        issues = validate.run({**store.tables(), "header": store.header()}, config.get("validate_level", "basic"), base_dir=base_dir).cache()
        errors = issues.where("severity = 'error'").limit(SAMPLES).collect()
        if errors:
            raise StoreError(f"the result is not sound: {[(r['code'], r['row_id']) for r in errors]}")
        warnings = issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
        store.log_edit("build", "*", details={"update": update})
    return {"store": path, "version": store.manifest["version"], "counts": {n: store.table(n).count() for n in store.manifest["tables"]}, "warnings": {r["code"]: r["n"] for r in warnings}, "imports": citymodel.ontology_imports([at(p) for p in config.get("vocabulary_files", [])])}


def set_srs(store: Store, srs_id: int) -> None:
    """Another reference system's number for the store; coordinates are not changed."""
    with store.transaction():
        store.restamp(srs_id=srs_id)
        store.log_edit("set_srs", "*", details={"srs_id": srs_id})
