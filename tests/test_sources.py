import hashlib
import json
import struct

import pytest

from facetlake.functions.crs import wkt_for_epsg
from facetlake.operators import validate
from facetlake.schema import StoreError
from facetlake.sources import citymodel, geometry, synthetic
from tests_data import CITY, CITY_CLASSES, CITY_NS, las


def test_city_model_objects_and_edges(spark, rows, tmp_path):
    p = tmp_path / "c.gml"
    p.write_text(CITY)
    concepts = spark.createDataFrame([(CITY_NS + m, n) for m, names in CITY_CLASSES.items() for n in names], "source_namespace string, local_name string")
    objects, edges = citymodel.read_citygml(spark, str(p), concepts)
    assert rows(objects, "object_uid", "semantic_class") == [("generated_TrafficSpace_000002", "TrafficSpace"), ("lane-2", "TrafficSpace"), ("road-7", "Road"), ("sec-a", "Section"), ("sec-b", "Section"), ("works", "CityObjectGroup")]
    lane = "generated_TrafficSpace_000002"
    assert rows(edges, "from_uid", "to_uid", "to_external_uri", "relationship_type", "role", "stated") == sorted([
        ("road-7", "sec-a", None, "section", None, False), ("road-7", "sec-b", None, "section", None, False), ("sec-a", lane, None, "trafficSpace", None, False), (lane, "lane-2", None, "predecessor", None, False),
        ("sec-b", "lane-2", None, "trafficSpace", None, False), ("road-7", None, "bridge.gml#deck", "carriedBy", None, True), ("works", "sec-b", None, "groupMember", "closed", False),
    ], key=str)
    assert edges.where("stated").first()["code_space"] == "urn:site"
    (tmp_path / "bad.gml").write_text(CITY[:-5])
    with pytest.raises(Exception, match="bad.gml"):
        citymodel.read_citygml(spark, str(tmp_path / "bad.gml"), concepts)


def test_vocabularies(spark, rows, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"scheme": "s", "_why": 1, "concepts": [{"local_name": "A"}, {"local_name": "B", "parent_uri": "s:A"}]}))
    (tmp_path / "x.xsd").write_text('<schema xmlns="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:t" targetNamespace="urn:t"><element name="P" abstract="true"/><element name="Q" substitutionGroup="t:P"/></schema>')
    (tmp_path / "o.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:u="urn:u#"><owl:Ontology rdf:about="urn:o"><owl:imports rdf:resource="urn:base"/></owl:Ontology><owl:Class rdf:about="urn:o#C"><rdfs:subClassOf rdf:resource="urn:o#D"/></owl:Class><owl:ObjectProperty rdf:about="urn:o#C.part"><u:category>containment</u:category></owl:ObjectProperty></rdf:RDF>')
    concepts, types = citymodel.read_vocabulary_folder(spark, [str(tmp_path / n) for n in ("v.json", "o.rdf", "x.xsd")], "k")
    assert rows(concepts, "class_uri", "parent_uri") == [("s:A", None), ("s:B", "s:A"), ("urn:o#C", "urn:o#D"), ("urn:t#P", None), ("urn:t#Q", "urn:t#P")]
    assert rows(types, "local_name", "code_space", "category") == [("part", "urn:o", "containment")]
    assert citymodel.ontology_imports([str(tmp_path / n) for n in ("v.json", "o.rdf")]) == ["urn:base"]
    (tmp_path / "bad.json").write_text('{"scheme": "s", "concept": []}')
    with pytest.raises(StoreError):
        citymodel.read_vocabulary(spark, str(tmp_path / "bad.json"))


def test_geometry_parts(spark, rows, tmp_path):
    (tmp_path / "a.las").write_bytes(las(12))
    (tmp_path / "b.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 2 3\nv 0 1 0\ng empty\ng wall\nf 1 2 3 4\n")
    header = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "c.ply").write_text(header.format("ascii") + "0 0 0\n1 0 0\n0 5 -1\n3 0 1 2\n")
    (tmp_path / "d.ply").write_bytes(header.format("binary_big_endian").encode() + struct.pack(">9f", 0, 0, 0, 1, 0, 0, 0, 5, -1) + struct.pack(">B3i", 3, 0, 1, 2))
    (tmp_path / "e.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 1) + struct.pack("<12fH", *[0] * 3, 0, 0, 0, 4, 0, 0, 0, 4, 1, 0))
    got = geometry.read_parts(spark, [str(tmp_path / n) for n in ("a.las", "b.obj", "c.ply", "d.ply", "e.stl")])
    table = {r["path"].rpartition("/")[2]: r for r in got.collect()}
    assert (table["a.las"]["element_count"], table["a.las"]["maxx"], geometry.epsg_of_wkt(table["a.las"]["crs_wkt"])) == (12, 9.0, 25832)
    assert (table["b.obj"]["part_path"], table["b.obj"]["element_count"], table["b.obj"]["maxz"]) == ("geometry/1:wall", 2, 3.0)
    assert [table[n]["minz"] for n in ("c.ply", "d.ply")] == [-1.0, -1.0] and table["e.stl"]["maxx"] == 4.0
    with pytest.raises(StoreError):
        geometry.read_parts(spark, ["x.glb"])
    with pytest.raises(StoreError):
        geometry.given_parts(spark, "p", [{"name": "a", "face_count": 1, "bounds": [1, 0, 0, 0, 0, 0]}])
    assert geometry.given_parts(spark, "p", [{"name": "a", "face_count": 0}, {"name": "b", "face_count": 2}]).first()["part_path"] == "geometry/1:b"


def test_reference_systems_of_point_clouds(tmp_path):
    plain = bytearray(las(3))
    keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 25833)
    (tmp_path / "keys.las").write_bytes(bytes(plain[:227]) + struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys)
    assert geometry.epsg_of_wkt(geometry.read_las(str(tmp_path / "keys.las"))[0][-1]) == 25833
    own = keys[:-2] + struct.pack("<H", 32767)
    (tmp_path / "own.las").write_bytes(bytes(plain[:227]) + struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(own), b"") + own)
    with pytest.raises(StoreError, match="cannot be read"):
        geometry.read_las(str(tmp_path / "own.las"))
    wkt = b'PROJCS["x",AUTHORITY["EPSG","32633"]]'
    head = plain[:227] + bytearray(148)
    head[25] = 4
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<I", head, 100, 0)
    struct.pack_into("<QI", head, 235, 375, 1)
    (tmp_path / "late.las").write_bytes(bytes(head) + struct.pack("<H16sHQ32s", 0, b"LASF_Projection", 2112, len(wkt), b"") + wkt)
    assert geometry.epsg_of_wkt(geometry.read_las(str(tmp_path / "late.las"))[0][-1]) == 32633


def test_large_meshes_are_streamed(tmp_path, monkeypatch):
    text = "v 0 0 0\nv 1 0 0\nv 1 2 3\nv -4 1 0\ng wall\nf 1 2 3 4\nf -4 -3 -2\n"
    (tmp_path / "a.obj").write_text(text)
    (tmp_path / "b.obj").write_text(text + "g roof\nf 1 2 3\n")
    whole = geometry.read_any_obj(str(tmp_path / "a.obj"))
    monkeypatch.setattr(geometry, "STREAM_BYTES", 10)
    assert geometry.read_any_obj(str(tmp_path / "a.obj")) == whole == [("geometry/0:wall", 1, 3, -4.0, 0.0, 0.0, 1.0, 2.0, 3.0, None)]
    with pytest.raises(StoreError, match="group"):
        geometry.read_any_obj(str(tmp_path / "b.obj"))


def test_definitions_follow_from_codes():
    assert 'PARAMETER["central_meridian",15]' in wkt_for_epsg(32633) and 'PARAMETER["false_northing",10000000]' in wkt_for_epsg(32733) and "ETRS89 / UTM zone 32N" in wkt_for_epsg(25832)
    assert [geometry.epsg_of_wkt(wkt_for_epsg(c)) for c in (4326, 4258, 32601, 25838)] == [4326, 4258, 32601, 25838] and wkt_for_epsg(31370) is None


def test_synthetic_city(spark):
    c = synthetic.city(spark, 3)
    assert c["objects"].count() == 12 and c["edges"].count() == 9
    assert c["elements"].select("element_index").distinct().count() == 1500


def test_asset_files(spark, rows, tmp_path):
    (tmp_path / "here").write_bytes(b"abc")
    good = "sha256:" + hashlib.sha256(b"abc").hexdigest()
    assets = spark.createDataFrame([(1, "here", good), (2, "file://" + str(tmp_path / "here"), "sha256:" + "0" * 64), (3, "gone", good), (4, "here", None), (5, "http://x/y", good)], "asset_id long, uri string, content_hash string")
    assert rows(validate.file_states(assets, str(tmp_path)), "asset_id", "status") == [(1, "ok"), (2, "changed"), (3, "missing"), (4, "unhashed"), (5, "missing")]
