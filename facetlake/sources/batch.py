"""Annotation batches: entries upserted into a store's tables as sets, not one by one."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import mutate
from facetlake.schema import AmbiguityError, StoreError, element_kind
from facetlake.session import cut_lineage
from facetlake.sources import citymodel
from facetlake.sources.citymodel import unknown_keys
from facetlake.store import Store, utc_now

# The keys a batch may have.
BATCH_KEYS = {"vocabularies", "annotations", "create_missing_city_objects"}
ITEM_KEYS = {
    "annotation_uid", "city_object_id", "city_object_uid", "gml_id", "source_object_id", "concept", "scheme", "label", "status", "confidence",
    "attributes", "attributes_json", "assessed_at", "memberships", "value_fields", "path",
}
PLACE_KEYS = {"asset_part_id", "asset_uri", "part_path", "element_kind"}
#: What an entry carries, and the keys beside its place.
CARRIERS = {"memberships": {"element_indices"}, "value_fields": {"values", "value_dtype"}, "path": {"element_indices", "continues_previous"}}
_PLACE = "asset_part_id: bigint, asset_uri: string, part_path: string, element_kind: int"
_FIELDS = "annotation_uid string, city_object_id long, city_object_uid string, gml_id string, source_object_id string, concept string, scheme string, label string, status string, confidence double, attributes_json string, assessed_at string"
#: ``given`` names the keys an entry has, so that one set to null differs from one left out.
ENTRY = (
    f"n long, {_FIELDS}, given array<string>, memberships array<struct<{_PLACE}, element_indices: array<bigint>>>, "
    f"value_fields array<struct<{_PLACE}, values: array<double>, value_dtype: string>>, path array<struct<{_PLACE}, element_indices: array<bigint>, continues_previous: boolean>>"
)


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _carried(item: dict, name: str, where: str) -> list[tuple] | None:
    """The rows of one carrier of an entry; a list that is there has something in it."""
    rows = item.get(name)
    if rows is None:
        return None
    if not isinstance(rows, list) or not rows:
        raise StoreError(f"{where}: {name!r} is a list with something in it")
    out = []
    for row in rows:
        unknown_keys(row, PLACE_KEYS | CARRIERS[name], f"{where}, {name}")
        kind = row.get("element_kind")
        place = (row.get("asset_part_id"), row.get("asset_uri"), row.get("part_path"), None if kind is None else element_kind(kind))
        if place[0] is None and place[1] is None:
            raise StoreError(f"{where}: {name!r} names no part")
        if name == "value_fields":
            values = row.get("values")
            if not isinstance(values, list) or not values or not all(v is None or _whole(v) or isinstance(v, float) for v in values):
                raise StoreError(f"{where}: values are numbers or null")
            out.append((*place, [None if v is None else float(v) for v in values], row.get("value_dtype")))
        else:
            indices = row.get("element_indices")
            if not isinstance(indices, list) or not all(map(_whole, indices)) or (name == "path" and not indices):
                raise StoreError(f"{where}: element_indices are whole numbers")
            out.append((*place, indices) if name == "memberships" else (*place, indices, bool(row.get("continues_previous", False))))
    return out


def read_batch(spark: SparkSession, doc: dict) -> DataFrame:
    """Entries of one batch document, keys checked at every level, attributes as JSON text."""
    unknown_keys(doc, BATCH_KEYS, "batch")
    rows = []
    for n, item in enumerate(doc.get("annotations", [])):
        where = f"annotation {n}"
        unknown_keys(item, ITEM_KEYS, where)
        for pair in (("city_object_id", "city_object_uid"), ("attributes", "attributes_json")):
            if all(item.get(k) is not None for k in pair):
                raise StoreError(f"{where}: {pair[0]} or {pair[1]}, not both")
        attributes = item.get("attributes_json") or (json.dumps(item["attributes"], sort_keys=True) if item.get("attributes") is not None else None)
        try:
            known = json.loads(attributes) if attributes is not None else {}
        except ValueError:
            raise StoreError(f"{where}: attributes are no JSON") from None
        if not isinstance(known, dict) or any(k.endswith(":path") for k in known):
            raise StoreError(f"{where}: attributes are an object; a path belongs in the path table")
        carried = [_carried(item, name, where) for name in CARRIERS]
        if all(c is None for c in carried):
            raise StoreError(f"{where}: one of {', '.join(CARRIERS)} is needed")
        fields = [attributes if f.split()[0] == "attributes_json" else item.get(f.split()[0]) for f in _FIELDS.split(", ")]
        rows.append((n, *fields, sorted(k for k in item if k in ITEM_KEYS), *carried))
    return spark.createDataFrame(rows, ENTRY)


def apply_entries(store: Store, entries: DataFrame, create_missing: bool = False, replace_existing: bool = False) -> None:
    """Claims, assessments, memberships, value fields and paths of ``entries`` in one transaction.

    - An entry's object is named by id, or by uid or gml_id; gml_id and source_object_id given beside it are filled in there, a contradiction raises.
      A missing object is an error, or with ``create_missing`` a temporary one without a class, which needs a concept.
    - The uid of an entry without one is ``ann_{object}_{concept}``; a concept left out is that of the object.
    - A claim that is stored or named before raises unless ``replace_existing``; then keys an entry has are changed and keys it lacks are kept.
    - A dated entry writes into the assessment of its date; an undated one into the only assessment of claim and asset, or a new undated one.
    - A path lies on one asset and implies its membership; an entry that lists one of its parts as a membership too is refused.
    """
    with store.transaction():
        e = _with_objects(store, entries, create_missing)
        e = _with_concepts(store, e)
        if not replace_existing and not e.select("annotation_uid").unionByName(store.table("annotation").select("annotation_uid")).groupBy("annotation_uid").count().where("count > 1").isEmpty():
            raise StoreError("a claim of that uid exists")
        _claims(store, e)
        _carry(store, e)


def _with_objects(store: Store, entries: DataFrame, create_missing: bool) -> DataFrame:
    """``entries`` with the id and uid of their object (``object_id``, ``object_uid``, ``object_class``), missing ones made, identities filled in."""
    objects = store.table("city_object")
    by_name = objects.select(F.col("object_uid").alias("city_object_uid"), "city_object_id").unionByName(objects.where("gml_id <> ''").select(F.col("gml_id").alias("city_object_uid"), "city_object_id")).distinct()
    named = cut_lineage(entries.where("city_object_uid is not null").select("city_object_uid").distinct().join(by_name.withColumnRenamed("city_object_id", "object_id"), "city_object_uid", "left"))
    if not named.groupBy("city_object_uid").count().where("count > 1").isEmpty():
        raise AmbiguityError("an object name means two objects")
    missing = named.where("object_id is null").select("city_object_uid")
    if not missing.isEmpty():
        if not create_missing:
            raise StoreError(f"no such object: {missing.first()[0]!r}")
        if not entries.where("concept is null").join(missing, "city_object_uid", "left_semi").isEmpty():
            raise StoreError("an entry that makes its object needs a concept")
        objects = mutate.merge_rows(objects, missing.select(F.col("city_object_uid").alias("object_uid"), F.lit("temporary").alias("object_status")), ["object_uid"], "city_object_id")
        objects = cut_lineage(objects)
        made = missing.join(objects.select(F.col("object_uid").alias("city_object_uid"), F.col("city_object_id").alias("object_id")), "city_object_uid")
        named = named.where("object_id is not null").unionByName(made.select(*named.columns))
    e = entries.join(named, "city_object_uid", "left").withColumn("object_id", F.coalesce("city_object_id", "object_id"))
    said = e.where("object_id is not null and (gml_id is not null or source_object_id is not null)").select(F.col("object_id").alias("city_object_id"), "gml_id", "source_object_id")
    if not said.isEmpty():
        objects = mutate.merge_rows(objects, said, ["city_object_id"], "city_object_id")
    store.stage("city_object", objects)
    have = objects.select(F.col("city_object_id").alias("object_id"), "object_uid", F.col("semantic_class_id").alias("object_class"))
    e = cut_lineage(e.join(have, "object_id", "left"))
    lost = e.where("object_id is not null and object_uid is null").select("object_id").take(1)
    if lost:
        raise StoreError(f"no such object: {lost[0][0]}")
    return e


def _with_concepts(store: Store, e: DataFrame) -> DataFrame:
    """``e`` with the id of its concept and the uid of its claim."""
    classes = store.table("semantic_class")
    known = classes.select(F.col("scheme").alias("c_scheme"), "semantic_class_id", F.explode(F.array_compact(F.array("local_name", "class_uri", "concept_iri"))).alias("concept")).distinct()
    found = e.where("concept is not null").select("n", "concept", "scheme").join(known, "concept").where("scheme is null or scheme = c_scheme").select("n", "semantic_class_id").distinct()
    if not found.groupBy("n").count().where("count > 1").isEmpty():
        raise AmbiguityError("a concept is ambiguous; name its scheme")
    e = e.join(found, "n", "left").withColumn("semantic_class_id", F.coalesce("semantic_class_id", F.when(F.col("concept").isNull(), F.col("object_class"))))
    e = e.join(classes.select("semantic_class_id", "local_name"), "semantic_class_id", "left")
    e = cut_lineage(e.withColumn("annotation_uid", F.coalesce("annotation_uid", F.when(F.col("object_uid").isNotNull(), F.concat_ws("_", F.lit("ann"), "object_uid", "local_name")))))
    bad = e.where("local_name is null or annotation_uid is null").select("n").take(1)
    if bad:
        raise StoreError(f"annotation {bad[0][0]} has no known concept, or neither uid nor object")
    return e


def _claims(store: Store, e: DataFrame) -> None:
    has = lambda c: F.array_contains("given", c)
    # Attributes that are null are no change; other keys may be set to null.
    told = {"semantic_class_id": F.lit(True), "object_id": F.col("object_id").isNotNull(), "label": has("label"), "status": has("status"), "confidence": has("confidence"), "attributes_json": F.col("attributes_json").isNotNull()}
    last = e.groupBy("annotation_uid").agg(*[F.max(F.when(test, F.struct("n", F.col(c).alias("v")))).alias(c) for c, test in told.items()]).withColumnRenamed("object_id", "primary_city_object_id")
    old, now = store.table("annotation"), utc_now()
    both = old.alias("s").join(last.alias("w"), "annotation_uid", "full_outer")
    pick = lambda c: F.when(F.col(f"w.{c}").isNotNull(), F.col(f"w.{c}.v")).otherwise(F.col(f"s.{c}"))
    rows = cut_lineage(both.select(
        F.col("s.annotation_id").alias("annotation_id"), "annotation_uid", *[pick(c).alias(c) for c in ("semantic_class_id", "primary_city_object_id", "confidence", "label", "attributes_json")],
        F.coalesce(pick("status"), F.lit("draft")).alias("status"), F.coalesce("s.created_at", now).alias("created_at"), F.when(F.col("w.semantic_class_id").isNotNull(), now).otherwise(F.col("s.updated_at")).alias("updated_at"),
    ))
    kept = rows.where("annotation_id is not null").select(*old.columns)
    out = cut_lineage(kept.unionByName(mutate.with_ids(rows.where("annotation_id is null"), "annotation_id", old, ["annotation_uid"]).select(*old.columns)))
    store.stage("annotation_object", mutate.primary_links(store.table("annotation_object"), old, out))
    store.stage("annotation", out)


def _carry(store: Store, e: DataFrame) -> None:
    """Memberships, value fields and paths of entries whose claims are stored."""
    t = store.tables()
    e = e.join(t["annotation"].select("annotation_uid", "annotation_id"), "annotation_uid")
    head = ["n", "annotation_id", "assessed_at"]
    places = None
    for name in CARRIERS:
        rows = e.select(*head, "status", "confidence", F.lit(name).alias("carrier"), F.posexplode(name).alias("item", "c")).select(*head, "status", "confidence", "carrier", "item", *[F.col(f"c.{k}").alias(k) for k in ("asset_part_id", "asset_uri", "part_path", "element_kind")])
        places = rows if places is None else places.unionByName(rows)
    places = _resolved(t, places)
    twice = places.where("carrier = 'path'").select("n", "part").distinct().join(places.where("carrier = 'memberships'").select("n", "part"), ["n", "part"], "left_semi")
    if not twice.isEmpty():
        raise StoreError("a part is covered by both path and memberships of an entry")
    if not places.where("carrier = 'path'").groupBy("n").agg(F.count_distinct("asset_id").alias("k")).where("k > 1").isEmpty():
        raise StoreError("a path lies on one asset")
    wanted = places.groupBy("annotation_id", "asset_id", "assessed_at").agg(F.max_by("status", "n").alias("status"), F.max_by("confidence", "n").alias("confidence"))
    every, ids = mutate.assessments_for(t["assessment"], wanted, utc_now())
    store.stage("assessment", cut_lineage(every))
    on = (F.col("p.annotation_id") == F.col("i.annotation_id")) & (F.col("p.asset_id") == F.col("i.asset_id")) & F.col("p.assessed_at").eqNullSafe(F.col("i.assessed_at"))
    places = cut_lineage(places.alias("p").join(ids.alias("i"), on).select("p.*", "i.assessment_id"))

    def of(carrier: str, *fields: str) -> DataFrame:
        """The places of one carrier with its payload."""
        payload = e.select("n", F.posexplode(carrier).alias("item", "c")).select("n", "item", *[F.col(f"c.{f}").alias(f) for f in fields])
        return places.where(F.col("carrier") == carrier).select("n", "item", "assessment_id", "annotation_id", F.col("part").alias("asset_part_id"), F.col("own_kind").alias("element_kind")).join(payload, ["n", "item"])

    # The last entry for a place counts, as if entries were applied one by one.
    def latest(rows: DataFrame, *key: str) -> DataFrame:
        top = rows.groupBy(*key).agg(F.max("n").alias("n"))
        return rows.join(top, [*key, "n"], "left_semi")

    paths = cut_lineage(latest(of("path", "element_indices", "continues_previous"), "assessment_id"))
    if not paths.isEmpty():
        segments = paths.select("assessment_id", "annotation_id", F.col("item").alias("segment_ordinal"), "asset_part_id", F.col("continues_previous").cast("int").alias("continues_previous"), F.col("element_indices").alias("indices"))
        for name, rows in mutate.write_segments(store.tables(), segments, store.manifest["block_size"]).items():
            store.stage(name, cut_lineage(rows))
    members = cut_lineage(latest(of("memberships", "element_indices"), "assessment_id", "asset_part_id", "element_kind"))
    if not members.isEmpty():
        # A path of the assessment covers other parts; it stays.
        now = store.tables()
        if not members.join(now["path_block"], ["assessment_id", "asset_part_id"], "left_semi").isEmpty():
            raise StoreError("an ordered path defines this membership")
        elements = members.select("assessment_id", "annotation_id", "asset_part_id", "element_kind", F.explode("element_indices").alias("element_index"))
        out = mutate.replace_memberships({**now, "path_block": now["path_block"].limit(0)}, elements, store.manifest["block_size"])
        store.stage("membership_block", out["membership_block"])
    fields = cut_lineage(latest(of("value_fields", "values", "value_dtype"), "assessment_id", "asset_part_id", "element_kind"))
    if not fields.isEmpty():
        rows = fields.select(*mutate.FIELD_KEY, "value_dtype", F.posexplode("values").alias("element_index", "v")).withColumn("element_index", F.col("element_index").cast("long"))
        store.stage("value_block", mutate.replace_fields(store.tables(), rows)["value_block"])


def _resolved(t: dict[str, DataFrame], places: DataFrame) -> DataFrame:
    """``places`` with ``part``, ``asset_id`` and ``own_kind``: parts by id, by uri and path, or by the uri of an asset with one part."""
    parts = t["asset_part"].join(t["asset"].select("asset_id", "uri"), "asset_id")
    by_path = parts.select(F.col("uri").alias("asset_uri"), "part_path", F.col("asset_part_id").alias("by_path"))
    only = parts.groupBy(F.col("uri").alias("asset_uri")).agg(F.count(F.lit(1)).alias("k"), F.min("asset_part_id").alias("only")).where("k = 1").select("asset_uri", "only")
    rows = places.join(by_path, ["asset_uri", "part_path"], "left").join(only, "asset_uri", "left")
    rows = rows.withColumn("part", F.coalesce("asset_part_id", "by_path", F.when(F.col("part_path").isNull(), F.col("only")))).drop("asset_part_id", "by_path", "only")
    rows = cut_lineage(rows.join(parts.select(F.col("asset_part_id").alias("part"), "asset_id", F.col("element_kind").alias("own_kind")), "part", "left"))
    if not rows.where("asset_id is null or element_kind <> own_kind").isEmpty():
        raise StoreError("an entry names no part of its kind")
    return rows


def apply_batch(store: Store, doc: dict, base_dir: str = ".", load_vocabularies: bool = True, replace_existing: bool = False) -> None:
    """A whole batch document: its vocabularies (files, from ``base_dir``) first, then its entries, all in one transaction."""
    entries = read_batch(store.spark, doc)
    with store.transaction():
        if load_vocabularies and doc.get("vocabularies"):
            from facetlake import project  # which reads batches itself

            files = [v if os.path.isabs(v) else os.path.join(base_dir, v) for v in doc["vocabularies"]]
            concepts, types = citymodel.read_vocabulary_folder(store.spark, files, "local")
            project.register_concepts(store, concepts)
            store.stage("relationship_type", mutate.register_types(store.table("relationship_type"), types))
        apply_entries(store, entries, bool(doc.get("create_missing_city_objects")), replace_existing)
