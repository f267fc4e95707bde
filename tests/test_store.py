import sqlite3

import pytest

from facetlake import cli, interop
from facetlake.operators import catalog, mutate, validate
from facetlake.schema import TABLES, AmbiguityError, StoreError
from facetlake.sources.batch import apply_batch
from facetlake.sources.citymodel import default_types
from facetlake.store import Store


@pytest.fixture
def store(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "store"))
    make = lambda name, data: spark.createDataFrame(data, TABLES[name])
    with s.transaction():
        s.stage("asset", make("asset", [(1, "m.ply", "mesh", None, None, 4326, None), (2, "c.las", "pointcloud", None, None, None, None)]))
        s.stage("asset_part", make("asset_part", [
            (1, 1, "geometry/0:default", 1, 100, "zero", "p", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, None), (2, 2, "points/all", 2, 50_000, "zero", None, *[None] * 6, None),
        ]))
        s.stage("semantic_class", make("semantic_class", [(1, "s", None, "s:Roof", "Roof", None, None, None, False, None)]))
        s.stage("city_object", make("city_object", [(1, "b1_roof", 1, "g1", 1, None, "accepted", None)]))
    return s


BATCH = {
    "_comment": "by hand", "create_missing_city_objects": True,
    "annotations": [
        {"city_object_uid": "g1", "concept": "Roof", "assessed_at": "2026-01-01", "status": "draft", "attributes": {"method": "m"}, "memberships": [{"asset_uri": "m.ply", "element_indices": [5, 1, 5]}]},
        {"city_object_uid": "b1_roof", "concept": "Roof", "assessed_at": "2027-01-01", "label": "later", "memberships": [{"asset_part_id": 2, "element_kind": "point", "element_indices": [20_000, 3]}]},
        {"annotation_uid": "other", "city_object_uid": "new one", "concept": "s:Roof", "memberships": [{"asset_part_id": 1, "element_indices": [9]}]},
    ],
}


ONE = [{"asset_part_id": 1, "element_indices": [1]}]


def test_batch_is_applied_once_and_again(store, spark, rows, tmp_path):
    doc = {**BATCH, "annotations": [{**BATCH["annotations"][0], "annotation_uid": "x"}, {**BATCH["annotations"][1], "annotation_uid": "x"}, BATCH["annotations"][2]]}
    with pytest.raises(StoreError, match="exists"):
        apply_batch(store, doc)
    apply_batch(store, doc, replace_existing=True)
    for s in (store, Store.open(spark, store.path)):
        assert rows(s.table("annotation"), "annotation_uid", "status", "label") == [("other", "draft", None), ("x", "draft", "later")]
        assert rows(s.table("assessment"), "asset_id", "assessed_at", "status") == [(1, "2026-01-01", "draft"), (1, None, "accepted"), (2, "2027-01-01", "accepted")]
        assert rows(s.table("membership_block"), "asset_part_id", "block_start", "offsets") == [(1, 0, [1, 5]), (1, 0, [9]), (2, 0, [3]), (2, 16384, [3616])]
    apply_batch(store, doc, replace_existing=True)
    assert store.table("annotation").count() == 2 and store.table("assessment").count() == 3 and store.table("membership_block").count() == 4
    assert rows(store.table("city_object"), "object_uid", "object_status") == [("b1_roof", "accepted"), ("new one", "temporary")]
    assert validate.is_ok(validate.run(store.tables(), "deep"))
    path = str(tmp_path / "out.gpkg")
    interop.export_geopackage(store, path, 4326)
    assert interop.header_problems(path) == []
    assert rows(interop.import_table(spark, path, "membership_block"), "membership_block_id", "offsets") == rows(store.table("membership_block"), "membership_block_id", "offsets")


def test_derived_uid_and_refusals(store):
    apply_batch(store, {"annotations": [BATCH["annotations"][0]]})
    assert store.table("annotation").first()["annotation_uid"] == "ann_b1_roof_Roof"
    before = store.manifest["version"]
    for bad in ({"annotation": []}, {"annotations": [{"label": "x", "wrong": 1}]}, {"annotations": [{"city_object_uid": "absent", "concept": "Roof", "memberships": ONE}]}, {"annotations": [{"city_object_uid": "g1", "concept": "Wall", "memberships": ONE}]}, {"annotations": [{"annotation_uid": "y", "concept": "Roof"}]},
                {"annotations": [{"annotation_uid": "y", "concept": "Roof", "attributes": {"x:path": 1}, "memberships": ONE}]}, {"annotations": [{"annotation_uid": "y", "concept": "Roof", "memberships": [{"asset_part_id": 1, "element_kind": 2, "element_indices": [1]}]}]}):
        with pytest.raises(StoreError):
            apply_batch(store, bad)
    assert store.manifest["version"] == before and store.table("annotation").count() == 1


def test_membership_range_and_path(store, spark, rows):
    apply_batch(store, {"annotations": [{**BATCH["annotations"][0], "annotation_uid": "x"}]})
    t = store.tables()
    out_of_range = spark.createDataFrame([(1, 1, 1, 1, 100)], "assessment_id long, annotation_id long, asset_part_id long, element_kind int, element_index long")
    with pytest.raises(Exception, match="outside its part"):
        mutate.replace_memberships(t, out_of_range)["membership_block"].collect()
    walk = spark.createDataFrame([(1, 1, i, 1, x, int(i == 0)) for i, x in enumerate([7, 3, 7])], "assessment_id long, annotation_id long, ordinal long, asset_part_id long, element_index long, starts_run long")
    after = {**t, **mutate.set_paths(t, walk)}
    assert rows(after["path_block"], "segment_ordinal", "indices") == [(0, [7, 3, 7])] and rows(after["membership_block"], "offsets") == [([3, 7],)]
    assert validate.is_ok(validate.run(after, "deep"))
    inside = spark.createDataFrame([(1, 1, 1, 1, 4)], out_of_range.schema)
    with pytest.raises(StoreError, match="path"):
        mutate.replace_memberships(after, inside)
    assert mutate.replace_memberships(after, inside, drop_path=True)["path_block"].count() == 0
    assert mutate.delete_annotations(after, spark.createDataFrame([(1,)], "annotation_id long"))["membership_block"].count() == 0
    assert mutate.delete_assets(after, spark.createDataFrame([(1,)], "asset_id long"))["path_block"].count() == 0


def test_merging_fills_and_refuses(store, spark):
    types = mutate.register_types(store.table("relationship_type"), default_types(spark))
    assert types.count() == 35
    declared = spark.createDataFrame([("storey", "http://www.opengis.net/citygml/building/3.0", "containment")], "local_name string, code_space string, category string")
    again = mutate.register_types(types, declared)
    assert again.count() == 35 and again.where("local_name = 'storey'").first()["category"] == "containment"
    with pytest.raises(StoreError):
        mutate.register_types(again, declared.selectExpr("local_name", "code_space", "'peer' AS category"))
    assert mutate.register_types(again, default_types(spark)).where("local_name = 'storey'").first()["category"] == "containment"
    edge = spark.createDataFrame([("g", 1, None, "#x", 1, None, None, None, None)] * 2, "graph_name string, from_city_object_id long, to_city_object_id long, to_external_uri string, relationship_type_id long, role string, source_asset_id long, source_relation_id string, metadata_json string")
    once = mutate.link_objects(store.table("relationship"), edge)
    assert once.count() == 1 and mutate.link_objects(once, edge).count() == 1


def test_lookups(store):
    assert catalog.resolve_object(store.table("city_object"), "g1") == 1 and catalog.resolve_part(store.table("asset_part"), store.table("asset"), "m.ply") == 1
    with pytest.raises(StoreError):
        catalog.resolve_concept(store.table("semantic_class"), "Wall")
    twice = store.table("asset").unionByName(store.table("asset").selectExpr("asset_id + 10 AS asset_id", *[c for c in store.table("asset").columns if c != "asset_id"]))
    with pytest.raises(AmbiguityError):
        catalog.resolve_asset(twice, "m.ply")


def test_transactions_and_opening(store, spark, tmp_path):
    with pytest.raises(ZeroDivisionError):
        with store.transaction():
            store.stage("asset", store.table("asset").limit(0))
            1 / 0
    assert store.table("asset").count() == 2
    assert store.problems() == []
    store.manifest["package_iri"] = "  "
    assert store.problems() == [("error", "INVALID_PACKAGE_IRI")]
    with pytest.raises(StoreError):
        Store.create(spark, store.path)
    with pytest.raises(FileNotFoundError):
        Store.open(spark, str(tmp_path / "nowhere"))
    assert cli.main(["validate", str(tmp_path / "nowhere")]) == 2
    assert cli.main(["validate", store.path, "--format", "json"]) == 0


def test_tampering_is_found(store, spark):
    apply_batch(store, {"annotations": [{**BATCH["annotations"][0], "annotation_uid": "x"}]})
    t = store.tables()
    cases = {
        "ORPHAN_MEMBERSHIP_ASSET_PART": ("membership_block", "asset_part_id", "99L"), "ORPHAN_MEMBERSHIP_ANNOTATION": ("membership_block", "annotation_id", "99L"), "INVALID_BLOCK_SIZE": ("membership_block", "block_size", "0"),
        "UNSUPPORTED_MEMBERSHIP_ENCODING": ("membership_block", "encoding", "'zip'"), "MEMBERSHIP_COUNT_MISMATCH": ("membership_block", "element_count", "7"), "MIN_ELEMENT_MISMATCH": ("membership_block", "min_element_index", "0L"),
        "OFFSET_OUTSIDE_BLOCK": ("membership_block", "offsets", "array(20000)"), "ASSESSMENT_UNKNOWN_STATUS": ("assessment", "status", "'odd'"), "ANNOTATION_CONFIDENCE_OUT_OF_RANGE": ("annotation", "confidence", "1.5D"),
        "ANNOTATION_ATTRIBUTES_NOT_JSON": ("annotation", "attributes_json", "'{bad'"), "NON_CANONICAL_CONTENT_HASH": ("asset", "content_hash", "'XYZ'"), "MEMBERSHIP_ELEMENT_KIND_MISMATCH": ("membership_block", "element_kind", "2"),
        "ASSESSMENT_ANNOTATION_MISMATCH": ("membership_block", "annotation_id", "99L"), "MEMBERSHIP_OUTSIDE_ASSESSMENT_ASSET": ("assessment", "asset_id", "2L"), "ORPHAN_ANNOTATION_CLASS": ("annotation", "semantic_class_id", "99L"),
    }
    for code, (table, column, value) in cases.items():
        broken = {**t, table: t[table].selectExpr(*[f"{value} AS {c}" if c == column else c for c in t[table].columns])}
        assert {r["code"] for r in validate.run(broken, "deep", [code]).collect()} == {code}, code


def test_header_rules_are_part_of_the_run(store, spark, tmp_path):
    assert not {r["code"] for r in validate.run({"header": store.header()}, "basic", skipped=[]).collect()}
    path = str(tmp_path / "out.gpkg")
    interop.export_geopackage(store, path, 4326)
    assert interop.header_table(spark, path).count() == 0
    conn = sqlite3.connect(path)
    conn.executescript(
        "PRAGMA application_id = 1; PRAGMA user_version = 5; DROP TABLE gpkg_extensions; DELETE FROM gpkg_spatial_ref_sys WHERE srs_id = 0; DELETE FROM gpkg_contents WHERE table_name = 'asset';"
        "UPDATE gpkg_geometry_columns SET srs_id = 25832; INSERT OR REPLACE INTO asset_extent VALUES (9, x'00')"
    )
    conn.commit()
    conn.close()
    found = {r["code"] for r in validate.run({"header": interop.header_table(spark, path)}, "basic").collect()}
    assert found == {"INVALID_GPKG_APPLICATION_ID", "OLD_GPKG_USER_VERSION", "MISSING_GPKG_TABLE", "MISSING_GPKG_SRS", "MISSING_GIS_ATTRIBUTE_LAYER", "FEATURES_LAYER_SRS_MISMATCH", "CORRUPT_EXTENT_BLOB", "EXTENT_SRS_MISMATCH"}
    skipped = []
    validate.run({"asset": store.table("asset")}, "basic", skipped=skipped)
    assert ("ORPHAN_MEMBERSHIP_ANNOTATION", "membership_block") in skipped
