import json

import pytest
from pyspark.sql import functions as F

from facetlake.operators.shred import _parse, adjacency, annotation_entities, document_nodes, struct_adjacency
from facetlake.session import written


def shred(spark, docs):
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "id long, payload string, label string")
    return annotation_entities(written(adjacency(df, "t", "id", F.col("payload"))))


def test_nodes_and_strictness():
    assert document_nodes('{"a": [1, null]}') == [("0", None, None, None, "object", None), ("0.0", "0", "a", None, "array", None), ("0.0.1", "0.0", None, 1, "null", None), ("0.0.0", "0.0", None, 0, "number", "1")]
    for bad in (None, "", "[1]", "null", '{"a": 1', '{"a": 1} x', "not json", "[" * 100_000, '{"a": NaN}', '{"a": [-Infinity, ' + "9" * 5000 + "]}"):
        assert document_nodes(bad) == []


def test_any_depth_and_any_number_of_digits():
    deep = '{"_note": ' + '{"a": [' * 30_000 + "1" + "]}" * 30_000 + ', "annotations": []}'
    nodes = document_nodes(deep)
    assert len(nodes) == 60_003 and [n[4] for n in nodes if n[2] == "annotations"] == ["array"]
    for digits in ("1" * 5000, "-" + "1" * 5000):
        assert document_nodes('{"_note": [' + digits + '], "b": 7}')[1:] == [("0.1", "0", "b", None, "number", "7"), ("0.0", "0", "_note", None, "array", None), ("0.0.0", "0.0", None, 0, "number", digits)]
    for bad in (deep[:-1], deep + "x", deep.replace("1", "01")):
        assert document_nodes(bad) == []


def test_parser_without_recursion_is_that_of_json():
    for text in ('{"a": [1, -2.5e3, "x\\u00e9\\n", true, false, null, {}, [], {"b": {"c": [[1], 2]}}], "a b": " ", "a": 3}', " [ 1 , 2 ] ", '{"k":{"k":1,"k":2},"l":[{}]}', '"s"', "-0"):
        assert _parse(text) == json.loads(text)
    for bad in ("", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "[1 2]", "[1}", '{"a":1]', "]", "[", '{"a":1} {}', '"x', "nul", "\u00a01"):
        with pytest.raises(ValueError):
            json.loads(bad)
        with pytest.raises(ValueError):
            _parse(bad)


def test_entities(spark, rows):
    docs = [
        json.dumps({"annotations": [None, {"annotation_uid": "u", "attributes": {"method": "m"}, "memberships": [None, {"part_path": "p", "element_indices": [3, "4", 3, None, 5.0, 1.5, True, "x", {"a": 1}]}, {"element_indices": 7}]}]}),
        json.dumps({"annotations": {"attributes": {"method": None}, "attributes_json": '{"method": "j"}', "memberships": {"element_indices": "9", "part_path": None}}, "_note": {"annotations": 3}}),
        json.dumps({"annotations": [{"memberships": [{"element_indices": [2**63]}, 5, "s", [1]]}, "text", 4]}),
        '{"annotations": [{"memberships": [{"element_indices": [1',
        None, "", json.dumps({}), json.dumps({"annotations": None}),
        json.dumps({"annotations": [{"attributes_json": "broken{", "memberships": [{"element_indices": list(range(3000))}]}]}),
    ]
    a, m, e = shred(spark, docs)
    assert rows(e.where("record_id < 8"), "record_id", "annotation_pos", "membership_pos", "element_index", "part_path", "method") == [
        (0, 1, 1, 3, "p", "m"), (0, 1, 1, 4, "p", "m"), (0, 1, 1, 5, "p", "m"), (0, 1, 2, 7, "", "m"), (1, 0, 0, 9, "", "j"),
    ]
    assert e.where("record_id = 8").count() == 3000
    assert rows(a, "record_id", "annotation_pos", "annotation_uid", "method") == [(0, 1, "u", "m"), (1, 0, None, "j"), (2, 0, None, ""), (8, 0, None, "")]
    assert rows(m.where("record_id < 3"), "record_id", "annotation_pos", "membership_pos") == [(0, 1, 1), (0, 1, 2), (1, 0, 0), (2, 0, 0)]


def test_deep_notes_and_long_numbers_beside_the_data(spark, rows):
    data = '"annotations": [{"memberships": [{"element_indices": [3, ' + "9" * 5000 + "]}]}]"
    docs = ["{" + data + "}", '{"_note": ' + "[" * 40_000 + "]" * 40_000 + ", " + data + "}"]
    assert rows(shred(spark, docs)[2], "record_id", "element_index") == [(0, 3), (1, 3)]


def test_empty_table(spark):
    assert all(d.count() == 0 for d in shred(spark, []))


def test_structs_have_the_nodes_of_their_json(spark, rows):
    schema = "id long, label string, r struct<a: struct<b: string, c: int>, l: array<struct<d: boolean, e: array<bigint>>>, m: map<string, double>>"
    data = [(1, "clash", (("x", None), [(True, [3, None, 5]), None, (None, [])], {"k": 1.5})), (2, "", ((None, 2), None, None)), (3, "", None)]
    got = struct_adjacency(spark.createDataFrame(data, schema), "t", "id", F.col("r"))
    assert rows(got.where("record_id = 1"), "node", "parent", "label", "ordinal", "kind", "scalar") == sorted([
        ("0", None, None, None, "object", None), ("0.0", "0", "a", None, "object", None), ("0.0.0", "0.0", "b", None, "string", "x"),
        ("0.1", "0", "l", None, "array", None), ("0.1.0", "0.1", None, 0, "object", None), ("0.1.0.0", "0.1.0", "d", None, "boolean", "true"), ("0.1.0.1", "0.1.0", "e", None, "array", None),
        ("0.1.0.1.0", "0.1.0.1", None, 0, "number", "3"), ("0.1.0.1.2", "0.1.0.1", None, 2, "number", "5"), ("0.1.2", "0.1", None, 2, "object", None), ("0.1.2.1", "0.1.2", "e", None, "array", None),
        ("0.2", "0", "m", None, "object", None), ("0.2.0", "0.2", "k", None, "number", "1.5"),
    ], key=str)
    assert rows(got.where("record_id > 1"), "record_id", "node", "scalar") == [(2, "0", None), (2, "0.0", None), (2, "0.0.1", "2")]


def test_entities_of_structs(spark, rows):
    schema = "id long, record_table string, annotations struct<annotation_uid: string, attributes: struct<method: string>, attributes_json: string, memberships: array<struct<part_path: string, element_indices: array<bigint>>>>"
    data = [
        (1, "own", ("u", ("m",), '{"method": "j"}', [None, ("p", [3, 3, None, 4]), (None, None)])), (2, "own", (None, (None,), '{"method": "j"}', [(None, [9])])),
        (3, "own", (None, None, None, [])), (4, "own", None), (1, "own", ("u", ("m",), None, None)),
    ]
    a, m, e = annotation_entities(struct_adjacency(spark.createDataFrame(data[:4], schema), "t", "id", F.struct("annotations")))
    assert rows(a, "record_id", "annotation_pos", "annotation_uid", "method") == [(1, 0, "u", "m"), (2, 0, None, "j"), (3, 0, None, "")]
    assert rows(m, "record_id", "membership_pos", "part_path") == [(1, 1, "p"), (1, 2, ""), (2, 0, "")]
    assert rows(e, "record_id", "membership_pos", "element_index", "part_path", "method") == [(1, 1, 3, "p", "m"), (1, 1, 4, "p", "m"), (2, 0, 9, "", "j")]
