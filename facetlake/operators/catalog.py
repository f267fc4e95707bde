"""Listing, looking up and naming: assets, parts, concepts, objects, links, claims and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetlake.schema import AmbiguityError, StoreError

#: A content hash in its one spelling: algorithm, colon, lower-case hex.
_TAGGED = r"^([a-z0-9]+):([0-9a-f]+)$"


def canonical_hash(c: Column) -> Column:
    """``sha256:hex`` of a tagged hash or of bare 64 hex digits in any case; NULL for any other text."""
    return F.when(c.rlike(_TAGGED), c).when(c.rlike(r"^[0-9A-Fa-f]{64}$"), F.concat(F.lit("sha256:"), F.lower(c)))


def contains_text(c: Column, text: str) -> Column:
    """Whether ``c`` has the search text in it, ASCII case aside; '%' and '_' in it are wildcards, a backslash is itself."""
    return c.ilike("%" + text.replace("\\", "\\\\") + "%")


def list_assets(assets: DataFrame, parts: DataFrame, kind: str | None = None) -> DataFrame:
    rows = assets if kind is None else assets.where(F.col("asset_kind") == kind)
    rollup = parts.groupBy("asset_id").agg(F.count(F.lit(1)).alias("pc"), F.sum("element_count").alias("ec"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(rollup, "asset_id", "left").select("asset_id", "uri", "asset_kind", "media_type", "content_hash", "srs_id", zero("pc").alias("part_count"), zero("ec").alias("element_count"))


def asset_extents(parts: DataFrame) -> DataFrame:
    """Per asset the union of the bounds of its fully bounded parts."""
    full = parts.where("minx is not null and miny is not null and maxx is not null and maxy is not null")
    return full.groupBy("asset_id").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def list_relationship_types(types: DataFrame, edges: DataFrame, category: str | None = None, include_unused: bool = True) -> DataFrame:
    """Types with the number of their edges; a type is the pair of name and code space, NULL and empty alike."""
    space = lambda c: F.coalesce(c, F.lit(""))
    used = edges.groupBy(F.col("relationship_type").alias("local_name"), space("code_space").alias("cs")).agg(F.count(F.lit(1)).alias("n"))
    rows = types.withColumn("cs", space("code_space")).join(used, ["local_name", "cs"], "left")
    rows = rows.withColumn("edge_count", F.coalesce("n", F.lit(0)).cast("long")).drop("cs", "n")
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows if include_unused else rows.where("edge_count > 0")


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """At most ``limit`` rows of an ordered list; a limit that is not positive is an error."""
    if limit is None:
        return df
    if limit <= 0:
        raise StoreError(f"a limit is positive: {limit}")
    return df.limit(limit)


def list_objects(
    objects: DataFrame, assets: DataFrame, search: str | None = None, status: str | None = None, class_id: int | None = None, below: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Objects by status, concept, search text and, by ``below`` (city_object_id), membership in a subtree; in order of uid."""
    rows = objects if status is None else objects.where(F.col("object_status") == status)
    if class_id is not None:
        rows = rows.where(F.col("semantic_class_id") == class_id)
    if below is not None:
        rows = rows.join(below.select("city_object_id").distinct(), "city_object_id", "left_semi")
    if search is not None:
        rows = rows.where(contains_text(F.col("object_uid"), search) | F.coalesce(contains_text(F.col("gml_id"), search), F.lit(False)))
    uris = assets.select(F.col("asset_id").alias("source_asset_id"), F.col("uri").alias("source_asset_uri"))
    return limited(rows.join(uris, "source_asset_id", "left").select("city_object_id", "object_uid", "object_status", "gml_id", "source_asset_uri").orderBy("object_uid", "city_object_id"), limit)


def list_concepts(concepts: DataFrame, used: DataFrame, scheme: str | None = None, is_ade: bool | None = None, search: str | None = None, in_use: bool | None = None) -> DataFrame:
    """Concepts (distinct by scheme and name) with the number of entries that name them; ``used`` has (scheme, concept)."""
    rows = concepts.groupBy("scheme", "local_name").agg(F.min("class_uri").alias("class_uri"), F.min("concept_iri").alias("concept_iri"), F.max("is_ade").alias("is_ade"))
    n = used.groupBy("scheme", F.col("concept").alias("local_name")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(n, ["scheme", "local_name"], "left").withColumn("annotation_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n").withColumn("in_use", F.col("annotation_count") > 0)
    tests = [scheme is not None and F.col("scheme") == scheme, is_ade is not None and F.col("is_ade") == is_ade, search is not None and (contains_text(F.col("local_name"), search or "") | contains_text(F.col("class_uri"), search or "")), in_use is not None and F.col("in_use") == in_use]
    for t in tests:
        rows = rows.where(t) if t is not False else rows
    return rows


def assessment_order() -> list[Column]:
    """Claims in order, undated assessments first, then by date and id."""
    return [F.col("annotation_id"), F.col("assessed_at").isNotNull(), F.col("assessed_at"), F.col("assessment_id")]


def assessment_places(assessments: DataFrame) -> DataFrame:
    """``assessments`` with ``place``, their number within the claim in that order.

    Dates sort as text, so the months they begin with sort alike: rows are
    numbered within (claim, month), and months are offset by those before.
    """
    month = F.coalesce(F.substring("assessed_at", 1, 7), F.lit(""))
    rows = assessments.withColumn("__m", month).withColumn("__dated", F.col("assessed_at").isNotNull())
    n = rows.groupBy("annotation_id", "__dated", "__m").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("annotation_id").orderBy("__dated", "__m").rowsBetween(W.unboundedPreceding, -1))
    n = n.select("annotation_id", "__dated", "__m", F.coalesce(before, F.lit(0)).alias("__so_far"))
    at = F.row_number().over(W.partitionBy("annotation_id", "__dated", "__m").orderBy("assessed_at", "assessment_id"))
    return rows.withColumn("__at", at).join(n, ["annotation_id", "__dated", "__m"]).withColumn("place", (F.col("__so_far") + F.col("__at")).cast("long")).drop("__m", "__dated", "__at", "__so_far")


def one(df: DataFrame, what: str, id_column: str) -> int:
    """The id of the only row of ``df``; raises when there is none or more than one. Reads two rows at most."""
    rows = df.select(id_column).distinct().take(2)
    if not rows:
        raise StoreError(f"no such {what}")
    if len(rows) > 1:
        raise AmbiguityError(f"{what} is ambiguous")
    return rows[0][0]


def resolve_object(objects: DataFrame, name: int | str) -> int:
    """By id, or by uid or gml_id; a name that means two objects raises."""
    test = F.col("city_object_id") == name if isinstance(name, int) else (F.col("object_uid") == name) | (F.col("gml_id") == name)
    return one(objects.where(test), f"object {name!r}", "city_object_id")


def resolve_asset(assets: DataFrame, name: int | str) -> int:
    return one(assets.where(F.col("asset_id" if isinstance(name, int) else "uri") == name), f"asset {name!r}", "asset_id")


def resolve_part(parts: DataFrame, assets: DataFrame, asset_part: int | str, part_path: str | None = None) -> int:
    """By id, or by asset uri and, where the asset has several parts, part path."""
    if isinstance(asset_part, int):
        return one(parts.where(F.col("asset_part_id") == asset_part), f"part {asset_part}", "asset_part_id")
    rows = parts.join(assets.where(F.col("uri") == asset_part).select("asset_id"), "asset_id", "left_semi")
    return one(rows if part_path is None else rows.where(F.col("part_path") == part_path), f"part of {asset_part!r}", "asset_part_id")


def resolve_type(types: DataFrame, name: str, code_space: str | None = None) -> int:
    """Exactly that name in that code space; another code space is never tried."""
    return one(types.where((F.col("local_name") == name) & (F.coalesce("code_space", F.lit("")) == (code_space or ""))), f"type {name!r}", "relationship_type_id")


def resolve_concept(classes: DataFrame, name: int | str, scheme: str | None = None) -> int:
    test = F.col("semantic_class_id") == name if isinstance(name, int) else (F.col("local_name") == name) | (F.col("class_uri") == name) | (F.col("concept_iri") == name)
    return one(classes.where(test if scheme is None else test & (F.col("scheme") == scheme)), f"concept {name!r}", "semantic_class_id")


def resolve_assessment(assessments: DataFrame, name: int | str) -> int:
    return one(assessments.where(F.col("assessment_id" if isinstance(name, int) else "assessment_uid") == name), f"assessment {name!r}", "assessment_id")


def get_concept(classes: DataFrame, name: int | str, scheme: str | None = None) -> DataFrame:
    """The row of one concept; none or several raise."""
    return classes.where(F.col("semantic_class_id") == resolve_concept(classes, name, scheme))


def concept_exists(classes: DataFrame, name: int | str, scheme: str | None = None) -> bool:
    """Whether a concept of that id, name or URI is there, once or more often."""
    test = F.col("semantic_class_id") == name if isinstance(name, int) else (F.col("local_name") == name) | (F.col("class_uri") == name) | (F.col("concept_iri") == name)
    return not classes.where(test if scheme is None else test & (F.col("scheme") == scheme)).isEmpty()


def instantiable_classes(classes: DataFrame, closure: DataFrame, root: str = "AbstractCityObject") -> DataFrame:
    """Concepts below the one named ``root`` (in whatever scheme), that one and other abstract ones left out; ``closure`` has ancestor and descendant ids."""
    top = classes.where(F.col("local_name") == root).select(F.col("semantic_class_id").alias("ancestor"))
    under = closure.join(top, "ancestor", "left_semi").select(F.col("descendant").alias("semantic_class_id")).distinct()
    return classes.join(under, "semantic_class_id", "left_semi").where(~F.col("local_name").startswith("Abstract"))


Tables = dict[str, DataFrame]


def membership_rollup(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part_count, block_count, element_count of membership blocks."""
    return blocks.groupBy(*keys).agg(F.count_distinct("asset_part_id").alias("part_count"), F.count(F.lit(1)).alias("block_count"), F.sum("element_count").cast("long").alias("element_count"))


def value_rollup(blocks: DataFrame) -> DataFrame:
    """Per field (claim, assessment, part, kind, dtype) its blocks, values and range, from the ranges of its blocks alone."""
    return blocks.groupBy("annotation_id", "assessment_id", "asset_part_id", "element_kind", "value_dtype").agg(
        F.count(F.lit(1)).alias("block_count"), F.sum("element_count").cast("long").alias("value_count"), F.min("value_min").alias("min_value"), F.max("value_max").alias("max_value")
    )


def path_rollup(segments: DataFrame) -> DataFrame:
    """assessment_id, segment_count, path_run_count, position_count."""
    return segments.groupBy("assessment_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_if(F.col("continues_previous") == 0).alias("path_run_count"), F.sum("element_count").cast("long").alias("position_count")
    )


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long").alias(c)


def list_annotations(
    t: Tables, status: str | None = None, class_id: int | None = None, class_name: str | None = None, object_id: int | None = None, object_uid: str | None = None,
    asset_id: int | None = None, asset_part_id: int | None = None, summary: bool = True, limit: int | None = None,
) -> DataFrame:
    """Claims that meet all given filters, with concept, primary object and, with ``summary``, counts of assessments, parts, blocks and elements; in order of id.

    An object filter means the primary object or one linked by any type; part
    and asset filters look at memberships, not at values.
    """
    rows, c, o = t["annotation"], t["semantic_class"], t["city_object"]
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if class_id is not None:
        rows = rows.where(F.col("semantic_class_id") == class_id)
    if object_id is not None or object_uid is not None:
        about = o.where(F.lit(True) if object_id is None else F.col("city_object_id") == object_id).where(F.lit(True) if object_uid is None else (F.col("object_uid") == object_uid) | (F.col("gml_id") == object_uid)).select("city_object_id")
        linked = t["annotation_object"].join(about, "city_object_id", "left_semi").select("annotation_id")
        primary = rows.join(about.withColumnRenamed("city_object_id", "primary_city_object_id"), "primary_city_object_id", "left_semi").select("annotation_id")
        rows = rows.join(linked.unionByName(primary).distinct(), "annotation_id", "left_semi")
    if asset_id is not None or asset_part_id is not None:
        parts = t["asset_part"].where(F.lit(True) if asset_id is None else F.col("asset_id") == asset_id).where(F.lit(True) if asset_part_id is None else F.col("asset_part_id") == asset_part_id)
        rows = rows.join(t["membership_block"].join(parts.select("asset_part_id"), "asset_part_id", "left_semi").select("annotation_id"), "annotation_id", "left_semi")
    names = c.select("semantic_class_id", F.col("scheme").alias("semantic_scheme"), F.col("scheme_version").alias("semantic_scheme_version"), F.col("class_uri").alias("semantic_class_uri"), F.col("local_name").alias("semantic_class"), F.col("is_ade").alias("semantic_is_ade"))
    rows = rows.join(names, "semantic_class_id", "left")
    if class_name is not None:
        rows = rows.where(F.col("semantic_class") == class_name)
    about = o.select(F.col("city_object_id").alias("primary_city_object_id"), F.col("object_uid").alias("primary_city_object_uid"), F.col("gml_id").alias("primary_city_object_gml_id"))
    rows = rows.join(about, "primary_city_object_id", "left")
    out = [
        "annotation_id", "annotation_uid", "semantic_class_id", "semantic_scheme", "semantic_scheme_version", "semantic_class_uri", "semantic_class", "semantic_is_ade",
        "primary_city_object_id", "primary_city_object_uid", "primary_city_object_gml_id", "label", "status", "confidence", "attributes_json", "created_at", "updated_at",
    ]
    if summary:
        dated = t["assessment"].groupBy("annotation_id").agg(F.count(F.lit(1)).alias("assessment_count"))
        rows = rows.join(dated, "annotation_id", "left").join(membership_rollup(t["membership_block"], ["annotation_id"]), "annotation_id", "left")
        out += [_zero(x) for x in ("assessment_count", "part_count", "block_count", "element_count")]
    return limited(rows.select(*out).orderBy("annotation_id"), limit)


def get_annotation(t: Tables, name: int | str) -> dict[str, DataFrame]:
    """One claim by id or uid: its row, and what it has: assessments, memberships by part, value fields, paths by assessment."""
    found = one(t["annotation"].where(F.col("annotation_id" if isinstance(name, int) else "annotation_uid") == name), f"claim {name!r}", "annotation_id")
    mine = lambda df: df.where(F.col("annotation_id") == found)
    blocks = mine(t["membership_block"])
    held = {**t, "annotation": mine(t["annotation"]), "membership_block": blocks, "assessment": mine(t["assessment"])}
    segments = t["path_block"].join(held["assessment"].select("assessment_id"), "assessment_id", "left_semi")
    return {
        "annotation": list_annotations(held), "assessments": list_assessments({**held, "path_block": segments}),
        "memberships": membership_rollup(blocks, ["assessment_id", "asset_part_id", "element_kind"]).drop("part_count"), "value_fields": value_rollup(mine(t["value_block"])), "paths": path_rollup(segments),
    }


def list_assessments(t: Tables, annotation_id: int | None = None, asset_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Assessments with claim, asset, path runs, segments and selected elements; by claim, undated first, then by date and id."""
    rows = t["assessment"]
    for column, value in (("annotation_id", annotation_id), ("asset_id", asset_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.join(t["annotation"].select("annotation_id", "annotation_uid"), "annotation_id", "left").join(t["asset"].select("asset_id", F.col("uri").alias("asset_uri"), "asset_kind"), "asset_id", "left")
    picked = t["membership_block"].groupBy("assessment_id").agg(F.sum("element_count").alias("selected_count"))
    rows = rows.join(picked, "assessment_id", "left").join(path_rollup(t["path_block"]), "assessment_id", "left")
    out = rows.select(
        "assessment_id", "assessment_uid", "annotation_id", "annotation_uid", "asset_id", "asset_uri", "asset_kind", "assessed_at", "status", "confidence",
        *[_zero(x) for x in ("path_run_count", "segment_count", "selected_count")], "attributes_json", "created_at", "updated_at",
    )
    return limited(out.orderBy(*assessment_order()), limit)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views for spark.sql: every table, and annotations, assessments, concepts, objects and extents with their counts."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    a, c, o = (tables[n] for n in ("annotation", "semantic_class", "city_object"))
    names = c.select("semantic_class_id", F.col("local_name").alias("semantic_class"))
    list_annotations(tables).createOrReplaceTempView("v_annotations")
    list_assessments(tables).createOrReplaceTempView("v_assessments")
    used = a.groupBy("semantic_class_id").agg(F.count(F.lit(1)).alias("annotation_count"))
    typed = o.groupBy("semantic_class_id").agg(F.count(F.lit(1)).alias("object_count"))
    c.join(used, "semantic_class_id", "left").join(typed, "semantic_class_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("annotation_count", "object_count")}).createOrReplaceTempView("v_concepts")
    links = tables["annotation_object"].groupBy("city_object_id").agg(F.count_distinct("annotation_id").alias("annotation_count"))
    edges = tables["relationship"]
    out = edges.groupBy(F.col("from_city_object_id").alias("city_object_id")).agg(F.count(F.lit(1)).alias("outgoing_count"))
    into = edges.where("to_city_object_id is not null").groupBy(F.col("to_city_object_id").alias("city_object_id")).agg(F.count(F.lit(1)).alias("incoming_count"))
    objects = o.join(names, "semantic_class_id", "left").join(links, "city_object_id", "left").join(out, "city_object_id", "left").join(into, "city_object_id", "left")
    objects.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("annotation_count", "outgoing_count", "incoming_count")}).createOrReplaceTempView("v_city_objects")
    asset_extents(tables["asset_part"]).createOrReplaceTempView("v_asset_extents")
