import json

import pytest

from facetlake import project
from facetlake.schema import StoreError
from facetlake.store import Store
from tests_data import CITY, CITY_CLASSES, CITY_NS, las


def test_build_and_update(spark, rows, tmp_path):
    (tmp_path / "c.gml").write_text(CITY)
    (tmp_path / "p.las").write_bytes(las(40))
    files = [f"v{i}.json" for i in range(len(CITY_CLASSES))]
    for f, (module, names) in zip(files, CITY_CLASSES.items()):
        (tmp_path / f).write_text(json.dumps({"scheme": "s", "source_namespace": CITY_NS + module, "concepts": [{"local_name": n} for n in names]}))
    (tmp_path / "b.json").write_text(json.dumps({"annotations": [{"annotation_uid": "a", "city_object_uid": "sec-b", "memberships": [{"asset_uri": str(tmp_path / "p.las"), "element_indices": [1, 39]}]}]}))
    config = {"store": "out", "vocabulary_files": files, "citygml": ["c.gml"], "geometry": ["p.las"], "batches": ["b.json"], "validate_level": "deep"}
    made = project.build(spark, config, str(tmp_path))
    counts = made["counts"]
    assert (counts["city_object"], counts["relationship"], counts["annotation"], counts["membership_block"], counts["asset"]) == (6, 7, 1, 1, 2)
    store = Store.open(spark, str(tmp_path / "out"))
    assert store.table("annotation").first()["label"] is None and store.table("asset").where("asset_kind = 'pointcloud'").first()["srs_id"] == 25832
    again = project.build(spark, config, str(tmp_path), update=True)["counts"]
    assert {k: v for k, v in again.items() if k != "edit_log"} == {k: v for k, v in counts.items() if k != "edit_log"}
    (tmp_path / "b.json").write_text(json.dumps({"annotations": [{"annotation_uid": "a", "city_object_uid": "sec-b", "confidence": 7.0, "memberships": [{"asset_uri": str(tmp_path / "p.las"), "element_indices": [1]}]}]}))
    with pytest.raises(StoreError, match="not sound"):
        project.build(spark, config, str(tmp_path), update=True)
    assert Store.open(spark, str(tmp_path / "out")).manifest["version"] == store.manifest["version"] + 1
    with pytest.raises(StoreError):
        project.build(spark, {"storr": "x"}, str(tmp_path))
