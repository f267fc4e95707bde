"""Changes to a store's tables, each from DataFrames to DataFrames; nothing is written here."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.operators import blocks, paths, values
from facetlake.schema import BLOCK_SIZE, DTYPES, STATUSES, VALUE_CHUNK, AmbiguityError, StoreError, value_dtype
from facetlake.session import cut_lineage

Tables = dict[str, DataFrame]
ID_BUCKETS = 256


def with_ids(rows: DataFrame, id_column: str, after: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with new ids above the greatest of ``after``, dense and the same for the same rows.

    Rows are numbered within hash buckets; only the counts of the buckets,
    at most ID_BUCKETS numbers, are summed over all.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(ID_BUCKETS)).cast("int")
    rows = cut_lineage(rows.withColumn("__b", bucket))
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    top = after.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__top"))
    numbered = rows.drop(id_column).withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy(*order)))
    return numbered.join(F.broadcast(offsets), "__b").crossJoin(F.broadcast(top)).withColumn(id_column, F.col("__top") + F.col("__o") + F.col("__r")).drop("__b", "__r", "__o", "__top")


def same(a: Column, b: Column, is_json: bool = False) -> Column:
    """Equal, NULLs alike; JSON texts by content and not by spelling."""
    if not is_json:
        return a.eqNullSafe(b)
    normal = lambda c: F.to_json(F.try_parse_json(c))
    return a.eqNullSafe(b) | F.coalesce(normal(a) == normal(b), F.lit(False))


def merge_rows(stored: DataFrame, wanted: DataFrame, key: list[str], id_column: str, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with ``wanted`` created or filled in: a NULL is filled, an equal value stays, a contradiction raises.

    Keys compare with NULL as a value. ``wanted`` has the key and any of the other columns.
    """
    others = [c for c in wanted.columns if c not in key and c != id_column]
    # Several requests for one record must agree too.
    asked = wanted.groupBy(*key).agg(*[F.max(c).alias(c) for c in others], *[F.count_distinct(c).alias(f"__n_{c}") for c in others if c not in json_columns])
    clash = F.lit(False)
    for c in others:
        if c not in json_columns:
            clash = clash | (F.col(f"__n_{c}") > 1)
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}"))
    both = stored.withColumn("__have", F.lit(True)).alias("s").join(asked.withColumn("__clash", clash).alias("w"), on, "full_outer")
    for c in others:
        differs = F.col("s.__have") & F.col(f"w.{c}").isNotNull() & F.col(f"s.{c}").isNotNull() & ~same(F.col(f"s.{c}"), F.col(f"w.{c}"), c in json_columns)
        both = both.withColumn("__bad", differs) if c == others[0] else both.withColumn("__bad", F.col("__bad") | differs)
    bad = (F.coalesce(F.col("__bad"), F.lit(False)) if others else F.lit(False)) | F.coalesce(F.col("__clash"), F.lit(False))
    both = cut_lineage(both.select(
        *[F.coalesce(f"s.{c}", f"w.{c}").alias(c) if c in key or c in others else F.col(f"s.{c}").alias(c) for c in stored.columns], bad.alias("__conflict"), F.col("s.__have").isNull().alias("__new")
    ))
    conflicts = both.where("__conflict").select(*key).take(3)
    if conflicts:
        raise StoreError(f"contradicts what is stored: {[r.asDict() for r in conflicts]}")
    old, new = both.where("not __new").drop("__conflict", "__new"), both.where("__new").drop("__conflict", "__new")
    if id_column in key:
        if not new.isEmpty():
            raise StoreError(f"no such {id_column}: {new.first()[id_column]}")
        return old
    return old.unionByName(with_ids(new, id_column, old, key).select(*old.columns))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti").select(*df.columns)


def delete_assessments(t: Tables, gone: DataFrame) -> Tables:
    """Without the assessments (assessment_id) and their blocks."""
    return {n: without(t[n], gone, "assessment_id") for n in ("assessment", "membership_block", "value_block", "path_block")}


def delete_annotations(t: Tables, gone: DataFrame) -> Tables:
    """Without the claims (annotation_id), their links, assessments and blocks."""
    out = delete_assessments(t, t["assessment"].join(gone.select("annotation_id"), "annotation_id", "left_semi"))
    out |= {n: without(t[n], gone, "annotation_id") for n in ("annotation", "annotation_object")}
    return out | {n: without(out[n], gone, "annotation_id") for n in ("membership_block", "value_block")}


def delete_assets(t: Tables, gone: DataFrame) -> Tables:
    """Without the assets (asset_id), their parts, assessments and blocks; what named one as its source names none."""
    parts = t["asset_part"].join(gone.select("asset_id"), "asset_id", "left_semi")
    out = delete_assessments(t, t["assessment"].join(gone.select("asset_id"), "asset_id", "left_semi"))
    out |= {n: without(t[n], gone, "asset_id") for n in ("asset", "asset_part")}
    out |= {n: without(out[n], parts, "asset_part_id") for n in ("membership_block", "value_block", "path_block")}
    mark = gone.select(F.col("asset_id").alias("source_asset_id")).distinct().withColumn("__gone", F.lit(True))
    for n in ("city_object", "relationship"):
        rows = t[n].join(mark, "source_asset_id", "left").withColumn("source_asset_id", F.when(F.col("__gone").isNull(), F.col("source_asset_id")))
        out[n] = rows.select(*t[n].columns)
    return out


def default_assessments(assessments: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (annotation_id, asset_id) of ``wanted`` its only assessment, else NULL to be created undated; two raise."""
    have = assessments.groupBy("annotation_id", "asset_id").agg(F.count(F.lit(1)).alias("__n"), F.min("assessment_id").alias("assessment_id"))
    out = cut_lineage(wanted.distinct().join(have, ["annotation_id", "asset_id"], "left"))
    if not out.where("__n > 1").isEmpty():
        raise AmbiguityError("a claim has several assessments of the asset; name one")
    return out.drop("__n")


def add_assessments(assessments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assessments created on (annotation, asset, assessed_at), NULL date alike; see ``merge_rows``."""
    return merge_rows(assessments, wanted, ["annotation_id", "asset_id", "assessed_at"], "assessment_id", ("attributes_json",))


def replace_memberships(t: Tables, elements: DataFrame, size: int = BLOCK_SIZE, drop_path: bool = False) -> Tables:
    """Sets of elements (assessment_id, annotation_id, asset_part_id, element_kind, element_index) in place of those stored for the same assessment, part and kind.

    Indices must lie in their part. An assessment with a path raises unless ``drop_path``, which removes the whole path.
    """
    key = ["assessment_id", "annotation_id", "asset_part_id", "element_kind"]
    touched = elements.select("assessment_id").distinct()
    walked = t["path_block"].join(touched, "assessment_id", "left_semi")
    if not drop_path and not walked.isEmpty():
        raise StoreError("an ordered path defines this membership")
    parts = t["asset_part"].select("asset_part_id", F.col("element_count").alias("__n"), F.col("element_kind").alias("__k"))
    checked = blocks.checked_indices(elements).join(parts, "asset_part_id", "left")
    wrong = F.col("__n").isNull() | (F.col("element_index") >= F.col("__n")) | (F.col("element_kind") != F.col("__k"))
    checked = checked.withColumn("element_index", F.when(wrong, F.raise_error(F.lit("element outside its part")).cast("long")).otherwise(F.col("element_index"))).drop("__n", "__k")
    new = blocks.build_blocks(checked, key, size=size).withColumn("encoding", F.lit("roaring"))
    part_key = ["assessment_id", "asset_part_id", "element_kind"]
    old = t["membership_block"].join(elements.select(*part_key).distinct(), part_key, "left_anti").select(*t["membership_block"].columns)
    new = with_ids(new, "membership_block_id", t["membership_block"], [*part_key, "block_start"])
    return {"membership_block": old.unionByName(new.select(*old.columns)), "path_block": without(t["path_block"], walked, "assessment_id")}


def write_segments(t: Tables, segments: DataFrame, size: int = BLOCK_SIZE) -> Tables:
    """Ordered paths given by segments (assessment_id, annotation_id, segment_ordinal, asset_part_id, continues_previous, indices), and the memberships they imply.

    The former path of the assessment goes, as do memberships of parts it no
    longer touches. Ordinals are 0..n-1, the first segment continues nothing,
    none is empty, and all parts belong to the assessment's asset; anything
    else raises.
    """
    segs = cut_lineage(segments)
    wrong = paths.ordinal_problems(segs, "assessment_id").take(1)
    if wrong or not segs.where("indices is null or size(indices) = 0").isEmpty():
        raise StoreError(f"no path: {wrong[0].asDict() if wrong else 'a segment is empty'}")
    parts = t["asset_part"].select("asset_part_id", F.col("asset_id").alias("__of_part"), "element_kind")
    known = segs.select("assessment_id", "asset_part_id").distinct().join(parts, "asset_part_id", "left").join(t["assessment"].select("assessment_id", "asset_id"), "assessment_id", "left")
    if not known.where("__of_part is null or asset_id is null or __of_part <> asset_id").isEmpty():
        raise StoreError("a path lies on the asset of its assessment")
    new = segs.select("assessment_id", "asset_part_id", *[F.col(c).cast("int").alias(c) for c in ("segment_ordinal", "continues_previous")], F.size("indices").alias("element_count"), F.lit("u32-seq-zlib").alias("encoding"), "indices")
    kept = without(t["path_block"], segs, "assessment_id")
    out = {"path_block": kept.unionByName(with_ids(new, "path_block_id", t["path_block"], ["assessment_id", "segment_ordinal"]).select(*kept.columns))}
    owner = segs.select("assessment_id", "annotation_id").distinct()
    member = paths.derived_membership(segs, "assessment_id").join(owner, "assessment_id").join(parts.select("asset_part_id", "element_kind"), "asset_part_id")
    # Parts that only the former path touched go; memberships that never came from a path stay.
    stale = paths.stale_parts(t["path_block"].join(owner.select("assessment_id"), "assessment_id", "left_semi"), segs, "assessment_id")
    member_now = t["membership_block"].join(stale, ["assessment_id", "asset_part_id"], "left_anti").select(*t["membership_block"].columns)
    return out | {"membership_block": replace_memberships({**t, "path_block": kept, "membership_block": member_now}, member, size)["membership_block"]}


def set_paths(t: Tables, positions: DataFrame, size: int = BLOCK_SIZE) -> Tables:
    """Ordered paths (assessment_id, annotation_id, ordinal, asset_part_id, element_index, starts_run), cut into segments; see ``write_segments``."""
    owner = positions.select("assessment_id", "annotation_id").distinct()
    return write_segments(t, paths.segments(positions, "assessment_id").join(owner, "assessment_id"), size)


def drop_path_target(t: Tables, annotation_id: int, assessment_id: int | None = None) -> int:
    """The assessment whose path is to go: the one named, else the claim's only one with a path; never creates one."""
    rows = t["assessment"].where(F.col("annotation_id") == annotation_id)
    rows = rows.where(F.col("assessment_id") == assessment_id) if assessment_id is not None else rows.join(t["path_block"].select("assessment_id"), "assessment_id", "left_semi")
    ids = [r[0] for r in rows.select("assessment_id").take(2)]
    if len(ids) > 1:
        raise AmbiguityError("a claim has several paths; name the assessment")
    if not ids:
        raise StoreError(f"claim {annotation_id} has no such path")
    return ids[0]


FIELD_KEY = ["assessment_id", "annotation_id", "asset_part_id", "element_kind"]


def replace_fields(t: Tables, elements: DataFrame, chunk: int = VALUE_CHUNK) -> Tables:
    """Dense value fields (FIELD_KEY, value_dtype, element_index, v) in place of those stored for the same assessment, part and kind.

    A field gives every element of its part one value, NULL or NaN meaning
    none; a NULL dtype is f4. Values that their dtype cannot hold, two dtypes
    in a field, gaps, repeats and parts of another kind or asset raise.
    """
    rows = elements.withColumn("value_dtype", F.coalesce("value_dtype", F.lit("f4"))).withColumn("v", F.col("v").cast("double"))
    # At most as many as there are dtypes, each cast by its own rule.
    names = sorted({r[0] for r in rows.select("value_dtype").distinct().take(len(DTYPES) * 4)})
    cast = None
    for name in names:
        one = values.checked_cast(rows.where(F.col("value_dtype") == name), name).withColumns({"value_dtype": F.lit(value_dtype(name)), "v": F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))})
        cast = one if cast is None else cast.unionByName(one)
    if cast is None:
        return {"value_block": t["value_block"]}
    cast = cut_lineage(cast)
    parts = t["asset_part"].select("asset_part_id", "asset_id", F.col("element_kind").alias("__k"), F.col("element_count").alias("__n"))
    whole = cast.groupBy(*FIELD_KEY).agg(F.count_distinct("value_dtype").alias("d"), F.count(F.lit(1)).alias("n"), F.count_distinct("element_index").alias("m"), F.min("element_index").alias("lo"), F.max("element_index").alias("hi"))
    whole = whole.join(parts, "asset_part_id", "left").join(t["assessment"].select("assessment_id", F.col("asset_id").alias("__a")), "assessment_id", "left")
    good = (F.col("d") == 1) & (F.col("n") == F.col("m")) & (F.col("lo") == 0) & (F.col("hi") == F.col("__n") - 1) & (F.col("n") == F.col("__n")) & (F.col("element_kind") == F.col("__k")) & (F.col("asset_id") == F.col("__a"))
    wrong = whole.where(~F.coalesce(good, F.lit(False))).select(*FIELD_KEY).take(1)
    if wrong:
        raise StoreError(f"a value field covers its part once, in one dtype: {wrong[0].asDict()}")
    new = values.chunk_values(cast, [*FIELD_KEY, "value_dtype"], chunk).withColumns({"encoding": F.lit("dense-zlib"), "element_count": F.col("element_count").cast("int")})
    key = ["assessment_id", "asset_part_id", "element_kind"]
    old = t["value_block"].join(cast.select(*key).distinct(), key, "left_anti").select(*t["value_block"].columns)
    return {"value_block": old.unionByName(with_ids(new, "value_block_id", t["value_block"], [*key, "block_start"]).select(*old.columns))}


EDGE_KEY = ["graph_name", "from_city_object_id", "to_city_object_id", "to_external_uri", "relationship_type_id", "role", "source_asset_id"]


def link_objects(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges added once: one equal in all seven parts of its identity, NULLs alike, is not added again. Exactly one target is set."""
    bad = wanted.where(F.col("to_city_object_id").isNull() == F.col("to_external_uri").isNull())
    if not bad.isEmpty():
        raise StoreError("an edge has exactly one target")
    on = F.lit(True)
    for k in EDGE_KEY:
        on = on & F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}"))
    new = wanted.dropDuplicates(EDGE_KEY).alias("w").join(edges.alias("s"), on, "left_anti")
    return edges.unionByName(with_ids(new, "relationship_id", edges, EDGE_KEY).select(*edges.columns))


def register_types(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """Link types by (local_name, code space), a default category (``is_default``) yielding to a declared one; two declared ones that differ raise."""
    space = lambda df: df.withColumn("code_space", F.coalesce("code_space", F.lit("")))
    default = F.coalesce(F.get_json_object("metadata_json", "$.category_source") == "default", F.lit(False))
    asked = space(wanted)
    if "is_default" not in asked.columns:
        asked = asked.withColumn("is_default", F.lit(False))
    declared = asked.where(~F.col("is_default") & F.col("category").isNotNull()).select("local_name", "code_space", F.lit(True).alias("__d"))
    have = space(types).join(declared.distinct(), ["local_name", "code_space"], "left")
    have = have.withColumn("category", F.when(default & F.col("__d"), F.lit(None)).otherwise(F.col("category"))).withColumn("metadata_json", F.when(default & F.col("__d"), F.lit(None)).otherwise(F.col("metadata_json"))).drop("__d")
    fresh = asked.join(space(types).where("category is not null").select("local_name", "code_space", F.lit(True).alias("__h")).distinct(), ["local_name", "code_space"], "left")
    fresh = fresh.where(~(F.col("is_default") & F.coalesce("__h", F.lit(False)))).withColumn("metadata_json", F.when(F.col("is_default"), F.lit('{"category_source": "default"}')))
    merged = merge_rows(have.select(*types.columns), fresh.select("local_name", "code_space", "category", "metadata_json"), ["local_name", "code_space"], "relationship_type_id", ("metadata_json",))
    return merged.withColumn("code_space", F.nullif("code_space", F.lit("")))


@F.pandas_udf(T.StringType())
def merged_json(old: pd.Series, patch: pd.Series) -> pd.Series:
    """The keys of ``patch`` over those of ``old``; a null removes a key."""

    def one(a: str | None, b: str | None) -> str | None:
        out = json.loads(a) if a else {}
        for k, v in (json.loads(b) if b else {}).items():
            out.pop(k, None) if v is None else out.__setitem__(k, v)
        return json.dumps(out, sort_keys=True) if out else None

    return pd.Series([one(a, b) for a, b in zip(old, patch)])


def updated(rows: DataFrame, changes: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """``rows`` with the given fields changed (``key`` unique in ``changes``); attributes merge by key, others are replaced where not NULL.

    Where the table has ``updated_at``, changed rows get ``now``. A key that is not stored raises.
    """
    if not changes.join(rows, key, "left_anti").isEmpty():
        raise StoreError(f"no such {key}")
    cols = [c for c in changes.columns if c != key]
    both = rows.alias("s").join(changes.withColumn("__hit", F.lit(True)).alias("w"), key, "left")
    out = []
    for c in rows.columns:
        if c == "attributes_json" and c in cols:
            out.append(F.when(F.col(f"w.{c}").isNotNull(), merged_json(F.col(f"s.{c}"), F.col(f"w.{c}"))).otherwise(F.col(f"s.{c}")).alias(c))
        elif c == "updated_at" and now is not None:
            out.append(F.when(F.col("w.__hit"), now).otherwise(F.col("s.updated_at")).alias(c))
        elif c in cols:
            out.append(F.coalesce(f"w.{c}", f"s.{c}").alias(c))
        else:
            out.append(F.col(key) if c == key else F.col(f"s.{c}").alias(c))
    return both.select(*out)


def update_annotations(t: Tables, changes: DataFrame, now: Column) -> Tables:
    """Claims with the fields of ``changes`` (annotation_id, ...) changed; a primary object that changes takes its 'represents' link along."""
    after = cut_lineage(updated(t["annotation"], changes, "annotation_id", now))
    return {"annotation": after, "annotation_object": primary_links(t["annotation_object"], t["annotation"], after)}


def update_assessments(t: Tables, changes: DataFrame, now: Column) -> Tables:
    """Assessments with status, confidence, date or attributes changed; the claim and the asset never change, nor may a date become that of another one."""
    if {"annotation_id", "asset_id"} & set(changes.columns):
        raise StoreError("an assessment keeps its claim and its asset")
    after = cut_lineage(updated(t["assessment"], changes, "assessment_id", now))
    key = ["annotation_id", "asset_id", "assessed_at"]
    if not after.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).join(after.join(changes.select("assessment_id"), "assessment_id", "left_semi").select("annotation_id", "asset_id"), ["annotation_id", "asset_id"], "left_semi").where("__n > 1").isEmpty():
        raise StoreError("another assessment has that date")
    return {"assessment": after}


def update_assets(t: Tables, changes: DataFrame) -> Tables:
    """Assets with uri, hash, media type or reference system put right; the kind never changes."""
    if "asset_kind" in changes.columns:
        raise StoreError("an asset keeps its kind")
    return {"asset": updated(t["asset"], changes, "asset_id")}


def register_assets(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assets by (uri, content_hash): the exact pair, else the only one of that uri without a hash, which is filled in; else a new one.

    A request without a hash means the only asset of its uri, or a new one;
    several make it ambiguous. Kinds that differ raise.
    """
    asked = cut_lineage(wanted.dropDuplicates(["uri", "content_hash"]))
    have = assets.select("uri", F.col("content_hash").alias("__h"), F.col("asset_id").alias("__id"))
    near = asked.select("uri", F.col("content_hash").alias("__w")).join(have, "uri", "left")
    per = near.groupBy("uri", "__w").agg(
        F.max(F.when(F.col("__h") == F.col("__w"), F.col("__id"))).alias("exact"), F.max(F.when(F.col("__h").isNull(), F.col("__id"))).alias("bare"), F.count_if(F.col("__h").isNull() & F.col("__id").isNotNull()).alias("bares"),
        F.max("__id").alias("any"), F.count("__id").alias("k"),
    )
    lost = (F.col("exact").isNull() & (F.col("bares") > 1)) | (F.col("__w").isNull() & (F.col("k") > 1))
    if not per.where(lost).isEmpty():
        raise AmbiguityError("several assets of one uri; name the hash")
    found = per.select("uri", F.col("__w").alias("content_hash"), F.coalesce("exact", F.when(F.col("__w").isNull(), F.col("any")).otherwise(F.col("bare"))).alias("asset_id"))
    on = (F.col("f.uri") == F.col("w.uri")) & F.col("f.content_hash").eqNullSafe(F.col("w.content_hash"))
    both = cut_lineage(asked.drop("asset_id").alias("w").join(found.alias("f"), on).select("w.*", "f.asset_id"))
    known = merge_rows(assets, both.where("asset_id is not null"), ["asset_id"], "asset_id")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in assets.schema.fields if f.name not in both.columns]
    new = with_ids(both.where("asset_id is null").select("*", *blank), "asset_id", known, ["uri", "content_hash"])
    return known.unionByName(new.select(*known.columns))


def accept_objects(objects: DataFrame, accepted: DataFrame) -> DataFrame:
    """Objects of ``accepted`` (city_object_id) are temporary no longer; an unknown one raises."""
    if not accepted.join(objects, "city_object_id", "left_anti").isEmpty():
        raise StoreError("no such object")
    hit = accepted.select("city_object_id", F.lit("accepted").alias("__s")).distinct()
    return objects.join(hit, "city_object_id", "left").withColumn("object_status", F.coalesce("__s", "object_status")).select(*objects.columns)


def create_annotations(t: Tables, wanted: DataFrame, now: Column) -> Tables:
    """New claims (annotation_uid, semantic_class_id, and any of primary_city_object_id, status, confidence, label, attributes_json) with their links.

    A uid that is stored or given twice, an unknown concept or object, a status that is none, a confidence outside 0..1 and attributes that are no JSON object raise.
    """
    blank = {f.name: F.lit(None).cast(f.dataType) for f in t["annotation"].schema.fields if f.name not in wanted.columns}
    rows = wanted.withColumns(blank)
    rows = cut_lineage(rows.withColumns({"status": F.coalesce("status", F.lit("draft")), "created_at": now, "updated_at": now}))
    checks = {
        "a claim of that uid exists": rows.join(t["annotation"], "annotation_uid", "left_semi"),
        "two claims of one uid": rows.groupBy("annotation_uid").count().where("count > 1"),
        "no such concept": rows.join(t["semantic_class"], "semantic_class_id", "left_anti"),
        "no such object": rows.where("primary_city_object_id is not null").join(t["city_object"].select(F.col("city_object_id").alias("primary_city_object_id")), "primary_city_object_id", "left_anti"),
        "no claim": rows.where(F.col("annotation_uid").isNull() | ~F.col("status").isin(STATUSES) | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)) | ~attributes_sound(F.col("attributes_json"))),
    }
    for what, bad in checks.items():
        if not bad.isEmpty():
            raise StoreError(what)
    new = with_ids(rows, "annotation_id", t["annotation"], ["annotation_uid"])
    after = cut_lineage(t["annotation"].unionByName(new.select(*t["annotation"].columns)))
    return {"annotation": after, "annotation_object": primary_links(t["annotation_object"], t["annotation"], after)}


def annotate_elements(t: Tables, wanted: DataFrame, elements: DataFrame, now: Column, size: int = BLOCK_SIZE) -> Tables:
    """New claims and what they select: ``wanted`` as in ``create_annotations``, ``elements`` (annotation_uid, asset_part_id, element_index, assessed_at)."""
    out = {**t, **create_annotations(t, wanted, now)}
    every, placed = _assessed(out, elements, now)
    out["assessment"] = every
    return out | replace_memberships(out, placed.select("assessment_id", "annotation_id", "asset_part_id", "element_kind", "element_index"), size)


def annotate_fields(t: Tables, wanted: DataFrame, fields: DataFrame, now: Column, chunk: int = VALUE_CHUNK) -> Tables:
    """New claims and their value fields: ``fields`` (annotation_uid, asset_part_id, element_index, v, value_dtype, assessed_at)."""
    out = {**t, **create_annotations(t, wanted, now)}
    every, placed = _assessed(out, fields, now)
    out["assessment"] = every
    return out | replace_fields(out, placed.select(*FIELD_KEY, "value_dtype", "element_index", "v"), chunk)


def _assessed(t: Tables, rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(all assessments, ``rows`` (annotation_uid, asset_part_id, assessed_at, ...) with their ids and kind)."""
    parts = t["asset_part"].select("asset_part_id", "asset_id", "element_kind")
    named = cut_lineage(rows.join(t["annotation"].select("annotation_uid", "annotation_id"), "annotation_uid", "left").join(parts, "asset_part_id", "left"))
    if not named.where("annotation_id is null or asset_id is null").isEmpty():
        raise StoreError("no such claim or part")
    every, ids = assessments_for(t["assessment"], named.select("annotation_id", "asset_id", "assessed_at").distinct(), now)
    on = (F.col("r.annotation_id") == F.col("i.annotation_id")) & (F.col("r.asset_id") == F.col("i.asset_id")) & F.col("r.assessed_at").eqNullSafe(F.col("i.assessed_at"))
    return every, named.alias("r").join(ids.alias("i"), on).select("r.*", "i.assessment_id")


def assessments_for(assessments: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(all assessments, ids: annotation_id, asset_id, assessed_at, assessment_id) for ``wanted`` (annotation_id, asset_id, assessed_at, and any of status, confidence).

    A date has an assessment of its own, made where there is none. Without a
    date the pair's only assessment is meant, an undated one is made where
    there is none, and several raise.
    """
    wanted = cut_lineage(wanted)
    none = default_assessments(assessments, wanted.where("assessed_at is null").select("annotation_id", "asset_id").distinct())
    on = (F.col("s.annotation_id") == F.col("w.annotation_id")) & (F.col("s.asset_id") == F.col("w.asset_id"))
    dated = wanted.where("assessed_at is not null").alias("w").join(assessments.alias("s"), on & (F.col("s.assessed_at") == F.col("w.assessed_at")), "left").select("w.*", "s.assessment_id")
    undated = wanted.where("assessed_at is null").join(none, ["annotation_id", "asset_id"])
    both = cut_lineage(dated.unionByName(undated.select(*dated.columns)))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in assessments.schema.fields if f.name not in both.columns]
    new = with_ids(both.where("assessment_id is null").select("*", *blank), "assessment_id", assessments, ["annotation_id", "asset_id", "assessed_at"])
    new = cut_lineage(new.withColumns({"assessment_uid": F.concat(F.lit("asm_"), F.sha2(F.concat_ws("/", "assessment_id", "annotation_id"), 256)), "status": F.coalesce("status", F.lit("accepted")), "created_at": now, "updated_at": now}).select(*assessments.columns))
    ids = both.where("assessment_id is not null").select("annotation_id", "asset_id", "assessed_at", "assessment_id").unionByName(new.select("annotation_id", "asset_id", "assessed_at", "assessment_id"))
    return assessments.unionByName(new), ids


def attributes_sound(c: Column) -> Column:
    """Whether attributes are NULL or a JSON object without a path key, which belongs in the path table."""
    return c.isNull() | (F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{") & ~c.rlike(r'"[a-z]+:path"\s*:'))


def primary_links(links: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Links after claims changed: the 'represents' link of a former primary object goes, that of each primary object is there once."""
    own = lambda df: df.where("primary_city_object_id is not null").select("annotation_id", F.col("primary_city_object_id").alias("city_object_id"), F.lit("represents").alias("relation_type"))
    now = own(after)
    gone = own(before).join(now, ["annotation_id", "city_object_id", "relation_type"], "left_anti")
    return links.join(gone, ["annotation_id", "city_object_id", "relation_type"], "left_anti").select("annotation_id", "city_object_id", "relation_type").unionByName(now).distinct()


def replace_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The links (annotation_id, city_object_id, relation_type) of every claim in ``wanted`` in place of its former ones of those types."""
    key = ["annotation_id", "relation_type"]
    return links.join(wanted.select(*key).distinct(), key, "left_anti").select(*links.columns).unionByName(wanted.select(*links.columns).distinct())
