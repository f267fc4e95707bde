"""What a batch entry may carry, and what is refused, against a store of two assets."""

import json
import math

import pytest

from facetlake.operators import mutate, values
from facetlake.schema import TABLES, AmbiguityError, StoreError
from facetlake.sources.batch import apply_batch
from facetlake.store import Store, utc_now


@pytest.fixture
def store(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "store"))
    make = lambda name, data: spark.createDataFrame(data, TABLES[name])
    with s.transaction():
        s.stage("asset", make("asset", [(1, "m.ply", "mesh", None, None, None, None), (2, "road.las", "pointcloud", None, None, None, None)]))
        s.stage("asset_part", make("asset_part", [(1, 1, "a", 1, 6, "zero", "p", *[None] * 7), (2, 2, "x", 2, 50, "zero", "p", *[None] * 7), (3, 2, "y", 2, 9, "zero", "p", *[None] * 7)]))
        s.stage("semantic_class", make("semantic_class", [(1, "s", None, "s:Roof", "Roof", None, None, None, False, None), (2, "t", None, "t:Roof", "Roof", None, None, None, True, None)]))
        s.stage("city_object", make("city_object", [(10, "roof 1", 1, "g1", None, None, "accepted", None), (20, "roof 2", None, "g2", None, None, "accepted", None), (30, "g2", None, None, None, None, "accepted", None)]))
    return s


def entry(**more):
    return {"annotations": [{"annotation_uid": "a", "concept": "Roof", "scheme": "s", **more}]}


def test_value_fields(store, rows):
    field = {"asset_uri": "m.ply", "element_kind": "face", "values": [1, 2.5, None, 4, 5, 6]}
    apply_batch(store, entry(assessed_at="2026-01-01", value_fields=[field]))
    block = store.table("value_block").first()
    assert (block["asset_part_id"], block["value_dtype"], block["element_count"], block["value_min"], block["value_max"]) == (1, "f4", 6, 1.0, 6.0)
    assert math.isnan(block["values"][2]) and block["values"][:2] == [1.0, 2.5]
    assert store.table("assessment").first()["assessed_at"] == "2026-01-01" and store.table("membership_block").count() == 0
    apply_batch(store, entry(assessed_at="2026-01-01", value_fields=[{**field, "values": [9] * 6, "value_dtype": "u1"}]), replace_existing=True)
    assert rows(store.table("value_block"), "value_dtype", "value_max") == [("u1", 9.0)]
    before = store.manifest["version"]
    for bad in ([{**field, "values": ["x"] * 6}], [{**field, "values": []}], [], [{**field, "dtype": "f4"}]):
        with pytest.raises(StoreError):
            apply_batch(store, entry(value_fields=bad), replace_existing=True)
    elements = lambda values, dtype, kind=1: store.spark.createDataFrame([(1, 1, 1, kind, dtype, i, v) for i, v in enumerate(values)], "assessment_id long, annotation_id long, asset_part_id long, element_kind int, value_dtype string, element_index long, v double")
    for bad in (elements([1.0, 2.0], "f4"), elements([1.0] * 5 + [None], "i2"), elements([1.0] * 6, "f4", 2), elements([1.0] * 6, "c8"), elements([300.0] * 6, "u1"), elements([1.0] * 7, None)):
        with pytest.raises(Exception, match="."):
            mutate.replace_fields(store.tables(), bad)
    assert store.manifest["version"] == before
    assert rows(values.elements_where(store.table("value_block"), ">=", 9.0, "u1"), "element_index") == [(i,) for i in range(6)]


def test_paths(store, rows):
    way = [{"asset_uri": "road.las", "part_path": "x", "element_indices": [7, 3, 7]}, {"asset_part_id": 3, "element_indices": [0], "continues_previous": True}, {"asset_part_id": 2, "element_indices": [40]}]
    apply_batch(store, entry(path=way))
    assert rows(store.table("path_block"), "segment_ordinal", "asset_part_id", "continues_previous", "indices") == [(0, 2, 0, [7, 3, 7]), (1, 3, 1, [0]), (2, 2, 0, [40])]
    assert rows(store.table("membership_block"), "asset_part_id", "offsets") == [(2, [3, 7, 40]), (3, [0])]
    apply_batch(store, entry(path=[way[0]], memberships=[{"asset_part_id": 1, "element_indices": [5]}]), replace_existing=True)
    assert rows(store.table("membership_block"), "asset_part_id", "offsets") == [(1, [5]), (2, [3, 7])] and store.table("path_block").count() == 1
    before = store.manifest["version"]
    for bad in (
        {"path": [way[0], {"asset_part_id": 1, "element_indices": [1]}]}, {"path": []}, {"path": [{**way[0], "element_indices": []}]}, {"path": [{**way[0], "ordinal": 1}]},
        {"path": [way[0]], "memberships": [{"asset_part_id": 2, "element_indices": [1]}]}, {"memberships": [{"asset_part_id": 2, "element_indices": [1]}]}, {"path": [{**way[0], "element_indices": [1.5]}]},
    ):
        with pytest.raises(StoreError):
            apply_batch(store, entry(**bad), replace_existing=True)
    segment = lambda *x: store.spark.createDataFrame([x], "assessment_id long, annotation_id long, segment_ordinal int, asset_part_id long, continues_previous int, indices array<long>")
    with pytest.raises(StoreError, match="no path"):
        mutate.write_segments(store.tables(), segment(1, 1, 0, 2, 1, [1]))
    with pytest.raises(Exception, match="outside its part"):
        mutate.write_segments(store.tables(), segment(1, 1, 0, 2, 0, [50]))["membership_block"].collect()
    assert store.manifest["version"] == before


def test_objects_identities_and_vocabularies(store, rows, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"scheme": "own", "concepts": [{"local_name": "Gutter", "class_uri": "own:Gutter"}]}))
    one = [{"asset_part_id": 1, "element_indices": [1]}]
    doc = {"vocabularies": ["v.json"], "create_missing_city_objects": True, "annotations": [
        {"city_object_id": 10, "source_object_id": "src-1", "memberships": one}, {"city_object_uid": "new", "gml_id": "g-new", "concept": "Gutter", "memberships": one}, {"annotation_uid": "free", "concept": "own:Gutter", "memberships": one},
    ]}
    apply_batch(store, doc, str(tmp_path))
    assert rows(store.table("annotation"), "annotation_uid", "primary_city_object_id") == [("ann_new_Gutter", 31), ("ann_roof 1_Roof", 10), ("free", None)]
    assert rows(store.table("city_object").where("city_object_id in (10, 31)"), "object_uid", "gml_id", "source_object_id", "object_status", "semantic_class_id") == [("new", "g-new", None, "temporary", None), ("roof 1", "g1", "src-1", "accepted", 1)]
    for bad in (
        {"city_object_id": 10, "gml_id": "other", "memberships": one}, {"city_object_id": 99, "concept": "Gutter", "memberships": one}, {"city_object_id": 10, "city_object_uid": "roof 1", "memberships": one},
        {"annotation_uid": "z", "memberships": one}, {"city_object_uid": "newer", "memberships": one}, {"city_object_uid": "roof 2", "memberships": one},
        {"annotation_uid": "z", "concept": "Gutter", "attributes": {}, "attributes_json": "{}", "memberships": one}, {"annotation_uid": "z", "concept": "Gutter", "attributes_json": "[1]", "memberships": one},
        {"annotation_uid": "z", "concept": "Gutter", "memberships": [{"asset_part_id": 1, "indices": [1]}]}, {"annotation_uid": "z", "concept": "Gutter", "memberships": [{"element_indices": [1]}]},
    ):
        with pytest.raises(StoreError):
            apply_batch(store, {"create_missing_city_objects": True, "annotations": [bad]})
    for bad in ({"city_object_uid": "g2", "concept": "Gutter", "memberships": one}, {"annotation_uid": "z", "concept": "Roof", "memberships": one}):
        with pytest.raises(AmbiguityError):
            apply_batch(store, {"annotations": [bad]})


def test_replacing_changes_what_is_given_and_moves_the_link(store, rows):
    one = [{"asset_part_id": 1, "element_indices": [1]}]
    apply_batch(store, entry(city_object_id=10, label="l", status="accepted", confidence=0.5, attributes={"k": 1}, memberships=one))
    assert rows(store.table("annotation_object"), "city_object_id", "relation_type") == [(10, "represents")]
    apply_batch(store, entry(city_object_id=20, label=None, memberships=one), replace_existing=True)
    assert rows(store.table("annotation"), "primary_city_object_id", "label", "status", "confidence", "attributes_json") == [(20, None, "accepted", 0.5, '{"k": 1}')]
    assert rows(store.table("annotation_object"), "city_object_id", "relation_type") == [(20, "represents")]
    assert store.table("assessment").count() == 1
    apply_batch(store, entry(assessed_at="2026-02-02", memberships=one), replace_existing=True)
    with pytest.raises(AmbiguityError):
        apply_batch(store, entry(memberships=one), replace_existing=True)


def test_claims_fields_and_assets_as_frames(store, spark, rows):
    t, now = store.tables(), utc_now()
    new = spark.createDataFrame([("u", 1, 10, '{"a": 1}'), ("v", 2, None, None)], "annotation_uid string, semantic_class_id long, primary_city_object_id long, attributes_json string")
    picked = spark.createDataFrame([("u", 1, 3, None), ("u", 2, 4, "2026-01-01"), ("v", 3, 1, None)], "annotation_uid string, asset_part_id long, element_index long, assessed_at string")
    out = {**t, **mutate.annotate_elements(t, new, picked, now)}
    assert rows(out["membership_block"], "annotation_id", "asset_part_id", "offsets") == rows(out["membership_block"].join(out["assessment"], ["assessment_id", "annotation_id"]), "annotation_id", "asset_part_id", "offsets")
    assert out["assessment"].count() == 3 and rows(out["annotation_object"], "city_object_id") == [(10,)]
    for bad in ([("u", 9, None, None)], [("u", 1, 99, None)], [("u", 1, None, "[]")], [("u", 1, None, '{"x:path": 1}')], [("u", 1, None, None)] * 2):
        with pytest.raises(StoreError):
            mutate.create_annotations(t, spark.createDataFrame(bad, new.schema), now)
    with pytest.raises(StoreError):
        mutate.create_annotations(out, new, now)
    field = spark.createDataFrame([("w", 1, i, float(i), "f8", None) for i in range(6)], "annotation_uid string, asset_part_id long, element_index long, v double, value_dtype string, assessed_at string")
    more = {**out, **mutate.annotate_fields(out, spark.createDataFrame([("w", 1, None, None)], new.schema), field, now)}
    assert rows(more["value_block"], "value_dtype", "value_min", "value_max") == [("f8", 0.0, 5.0)]
    with pytest.raises(StoreError, match="covers its part"):
        mutate.annotate_fields(out, spark.createDataFrame([("w", 1, None, None)], new.schema), field.where("element_index <> 2"), now)
    change = spark.createDataFrame([(1, "road2.las", None)], "asset_id long, uri string, content_hash string")
    assert rows(mutate.update_assets(t, change)["asset"], "asset_id", "uri", "asset_kind") == [(1, "road2.las", "mesh"), (2, "road.las", "pointcloud")]
    with pytest.raises(StoreError):
        mutate.update_assets(t, spark.createDataFrame([(1, "mesh")], "asset_id long, asset_kind string"))
    dated = spark.createDataFrame([(out["assessment"].where("assessed_at is not null").first()["assessment_id"], "rejected", 0.25)], "assessment_id long, status string, confidence double")
    assert rows(mutate.update_assessments(out, dated, now)["assessment"].where("assessed_at is not null"), "status", "confidence") == [("rejected", 0.25)]
    with pytest.raises(StoreError):
        mutate.update_assessments(out, spark.createDataFrame([(77, "rejected")], "assessment_id long, status string"), now)


def test_assets_by_uri_and_hash(spark, rows):
    make = lambda data: spark.createDataFrame(data, "uri string, asset_kind string, content_hash string")
    none = spark.createDataFrame([], TABLES["asset"])
    one = mutate.register_assets(none, make([("u", "mesh", None), ("w", "mesh", "sha256:1")]))
    filled = mutate.register_assets(one, make([("u", "mesh", "sha256:9")]))
    assert rows(filled, "uri", "content_hash") == [("u", "sha256:9"), ("w", "sha256:1")]
    other = mutate.register_assets(filled, make([("u", "mesh", "sha256:8"), ("w", "mesh", None), ("u", "mesh", "sha256:9")]))
    assert rows(other, "uri", "content_hash") == [("u", "sha256:8"), ("u", "sha256:9"), ("w", "sha256:1")] and other.select("asset_id").distinct().count() == 3
    with pytest.raises(AmbiguityError):
        mutate.register_assets(other, make([("u", "mesh", None)]))
    with pytest.raises(StoreError):
        mutate.register_assets(other, make([("u", "pointcloud", "sha256:8")]))
