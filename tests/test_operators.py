"""Claims, blocks, values, paths and graph against brute force on small fixtures."""

import math
import random

import pytest

from facetlake.operators import blocks, catalog, claims, graph, paths, values
from facetlake.schema import StoreError
from facetlake.streaming.arrivals import arrivals, shred_stream

CITY = {
    1: range(0, 4 * 16384, 1000), 2: range(100, 600), 3: range(500, 3 * 16384, 7), 4: [*range(50, 60), 2**32 - 1],
}
SELECTIONS = {"one": [0], "across": [16383, 16384, 40_000], "none": [99_999], "empty": [], "dense": list(range(16384)), "last": [2**32 - 1, 55, 55, None]}


def city_blocks(spark):
    rows = [(a, 1, i) for a, s in CITY.items() for i in s]
    return blocks.build_blocks(spark.createDataFrame(rows + rows[:50], "annotation_id long, asset_part_id long, element_index long"), ["annotation_id", "asset_part_id"])


@pytest.mark.parametrize("name", SELECTIONS)
def test_reverse_query_against_sets(spark, name):
    sel = spark.createDataFrame([(1, i) for i in SELECTIONS[name]] + [(2, 0)], "asset_part_id long, element_index long")
    got = {r["annotation_id"]: r["matched_elements"] for r in claims.claims_for_elements(city_blocks(spark), sel, ["annotation_id"]).collect()}
    want = {a: sorted(set(s) & set(SELECTIONS[name])) for a, s in CITY.items()}
    assert got == {a: s for a, s in want.items() if s}
    picked = [i for i in SELECTIONS[name] if i is not None]
    assert {r["annotation_id"]: r["matched_elements"] for r in claims.claims_for_pick(city_blocks(spark), 1, picked, ["annotation_id"]).collect()} == got


def test_plan_joins_on_block_and_never_by_nested_loop(spark):
    sel = spark.createDataFrame([(1, 5)], "asset_part_id long, element_index long")
    plan = claims.claims_for_elements(city_blocks(spark), sel, ["annotation_id"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "EvalPython" not in plan and "InPandas" not in plan


def test_blocks_round_trip_and_bad_indices(spark):
    back = blocks.expand_blocks(city_blocks(spark))
    assert {(r["annotation_id"], r["element_index"]) for r in back.collect()} == {(a, i) for a, s in CITY.items() for i in s}
    for bad in (-1, 2**32, None):
        with pytest.raises(Exception, match="out of range"):
            blocks.checked_indices(spark.createDataFrame([(bad,)], "element_index long")).collect()


@pytest.mark.parametrize("op", list(values.OPERATORS))
def test_value_predicates_and_pruning(spark, op):
    v = [math.nan if i % 7 == 0 else float(i % 40) for i in range(300)] + [math.nan] * 50
    chunks = values.chunk_values(spark.createDataFrame(list(enumerate(v)), "element_index long, v double"), [], 50)
    got = sorted(r[0] for r in values.elements_where(chunks, op, 20.0).collect())
    assert got == [i for i, x in enumerate(v) if not math.isnan(x) and eval(f"x {op} 20.0")]


def test_float_thresholds_and_casts(spark):
    chunks = values.chunk_values(values.checked_cast(spark.createDataFrame([(0, 0.1), (1, 0.2)], "element_index long, v double"), "f4"), [], 8)
    assert [r[0] for r in values.elements_where(chunks, "==", 0.1, "f4").collect()] == [0]
    for value, dtype in ((300.0, "u1"), (1.5, "i4"), (1e39, "f4"), (math.nan, "i2"), (-1.0, "u4")):
        with pytest.raises(Exception, match="no .* value"):
            values.checked_cast(spark.createDataFrame([(0, value)], "element_index long, v double"), dtype).collect()
    with pytest.raises(StoreError):
        values.elements_where(chunks, "=~", 1.0)


def test_typed_edges_know_their_types(spark, rows):
    edges = spark.createDataFrame([(1, 2, "part", "a", "containment"), (2, 3, "part", None, None), (3, 1, "near", "", "peer")], "src long, dst long, rel_type string, code_space string, category string")
    assert rows(graph.typed_edges(edges, types=["part"]), "src") == [(1,), (2,)] and rows(graph.typed_edges(edges, types=[("part", None)]), "src") == [(2,)]
    assert rows(graph.typed_edges(edges, ["peer"], [("part", "a")]), "src") == [(1,), (3,)] and graph.typed_edges(edges, [], []).count() == 0 and graph.typed_edges(edges).count() == 3
    for bad in ("prat", ("part", "b"), ("near", "a")):
        with pytest.raises(StoreError):
            graph.typed_edges(edges, types=[bad])
    with pytest.raises(StoreError):
        graph.typed_edges(edges, ["kinship"])


def test_list_limits(spark):
    df = spark.range(5)
    assert catalog.limited(df, 2).count() == 2 and catalog.limited(df, None).count() == 5
    for bad in (0, -1):
        with pytest.raises(StoreError):
            catalog.limited(df, bad)


def test_field_problems(spark, rows):
    chunks = spark.createDataFrame([("ok", 1, 0, 5), ("ok", 1, 5, 5), ("gap", 1, 0, 4), ("gap", 1, 5, 5), ("over", 1, 0, 6), ("over", 1, 5, 5), ("part", 1, 0, 5)], "f string, asset_part_id long, block_start long, element_count long")
    parts = spark.createDataFrame([(1, 10)], "asset_part_id long, element_count long")
    assert rows(values.field_problems(chunks, parts, ["f"]), "f", "problem") == [("gap", "gap"), ("over", "overlap"), ("part", "partial")]


def test_only_whole_fields_are_read(spark):
    parts = spark.createDataFrame([(1, 10)], "asset_part_id long, element_count long")
    make = lambda rows: spark.createDataFrame(rows, "f string, asset_part_id long, block_start long, element_count long, value_dtype string")
    assert values.whole_field(make([("a", 1, 0, 5, "f4"), ("a", 1, 5, 5, "f4")]), parts, ["f"]).count() == 2
    for rows in ([], [("a", 1, 0, 5, "f4"), ("a", 1, 5, 5, "f8")], [("a", 1, 0, 5, "f4")]):
        with pytest.raises(StoreError):
            values.whole_field(make(rows), parts, ["f"])


def test_paths_are_the_same_in_short_stretches(spark, rows):
    rng = random.Random(1)
    pos = [(k, o, rng.choice([1, 1, 2]), rng.randrange(5), int(o == 0 or rng.random() < 0.1)) for k in (1, 2) for o in range(60)]
    df = spark.createDataFrame(pos, "k long, ordinal long, asset_part_id long, element_index long, starts_run long")
    want, last = [], None
    for k, o, part, e, start in pos:
        if start or last != (k, part):
            want.append([k, part, 1 - start, []])
        want[-1][3].append(e)
        last = (k, part)
    for places in (7, 65_536):
        segs = paths.segments(df, "k", places)
        assert [[r["k"], r["asset_part_id"], r["continues_previous"], r["indices"]] for r in segs.orderBy("k", "segment_ordinal").collect()] == want
    starts = [(k, sum(1 - w[2] for w in want[: i + 1] if w[0] == k) - 1) for i, (k, *_) in enumerate(want)]
    for places in (3, 65_536):
        assert [(r["k"], r["run"]) for r in paths.runs(segs, "k", places).orderBy("k", "segment_ordinal").collect()] == starts
    assert rows(paths.ordinal_problems(segs.where("segment_ordinal <> 1"), "k"), "problem") == [("gap",), ("gap",)]


def test_graph_with_cycle_and_external_target(spark, rows):
    e = spark.createDataFrame([(1, 2, None, "a", "containment"), (2, 3, None, "a", "containment"), (3, 1, None, "b", "peer"), (3, 3, None, "b", "peer"), (4, None, "x#y", "c", None)], "src long, dst long, ext string, rel_type string, category string")
    one = spark.createDataFrame([(1,)], "object_id long")
    assert rows(graph.reachable(e, one), "object_id", "depth") == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.reachable(graph.typed_edges(e, ["peer"]), one, "both"), "object_id") == [(1,), (3,)]
    assert graph.typed_edges(e, [], []).count() == 0 and graph.typed_edges(e, ["peer"], ["a"]).count() == 4
    assert rows(graph.cycle_members(e), "object_id") == [(1,), (2,), (3,)]
    assert graph.cycle_members(graph.typed_edges(e, ["containment"])).count() == 0
    assert graph.incident_edges(e).where("object_id = 3").count() == 4
    with pytest.raises(StoreError):
        graph.hops(e, "sideways")


def test_search_and_order(spark, rows):
    df = spark.createDataFrame([("Wall_1",), ("wallx1",), ("a\\b",), (None,)], "t string")
    assert rows(df.where(catalog.contains_text(df["t"], "WALL_1")), "t") == [("Wall_1",), ("wallx1",)]
    assert rows(df.where(catalog.contains_text(df["t"], "\\")), "t") == [("a\\b",)]
    a = spark.createDataFrame([(1, 5, "2026-01-02"), (2, 5, None), (3, 5, "2025-12-31"), (4, 5, "2026-01-02")], "assessment_id long, annotation_id long, assessed_at string")
    assert rows(catalog.assessment_places(a), "place", "assessment_id") == [(1, 2), (2, 3), (3, 1), (4, 4)]


def test_streamed_batches(spark, tmp_path):
    docs = [(1, '{"annotations": [{"memberships": {"element_indices": [1, 2]}}]}', "b", "2026-01-01 10:00:00"), (2, "broken", "b", "2026-01-01 11:00:00"), (3, None, "c", "2026-01-03 00:00:00")]
    spark.createDataFrame(docs, "raw_id long, payload string, batch_id string, received_at string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("raw_id long, payload string, batch_id string, received_at string").parquet(str(tmp_path / "in"))
    shred_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "elements")).count() == 2
    q = arrivals(stream).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n_documents"] for r in spark.table("arrived").collect()) == [1, 2]
