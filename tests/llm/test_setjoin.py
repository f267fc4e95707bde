import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from facetlake.llm.setjoin import expand_pairs, partition, set_classes, similar_classes, similar_pairs, united_sets

SCHEMA = "id string, space long, indices array<long>, sid string, home string, cell long"


def expected(sets, threshold):
    live = [(i, set(s)) for i, s in sets if i is not None and s]
    return sorted((min(a, b), max(a, b)) for k, (a, x) in enumerate(live) for b, y in live[k + 1 :] if len(x & y) / len(x | y) >= threshold)


def frame(spark, sets):
    return spark.createDataFrame([(i, 2**40, None if s is None else [*sorted(s, reverse=True), None], "c", "c", 1) for i, s in sets], SCHEMA)


def pairs(spark, rows, sets, threshold=0.75):
    return rows(similar_pairs(frame(spark, sets), threshold, 3), "id_a", "id_b")


def test_random_clusters_match_brute_force(spark, rows):
    rng = random.Random(11)
    sets = []
    for c in range(25):
        base = set(rng.sample(range(400), rng.randrange(1, 30)))
        for k in range(rng.randrange(1, 6)):
            s = set(base)
            for _ in range(rng.randrange(0, 4)):
                s.discard(rng.choice(sorted(s))) if s and rng.random() < 0.5 else s.add(rng.randrange(400))
            sets.append((f"r{c:02d}_{k}", s | ({0} if rng.random() < 0.4 else set())))
    sets += [(f"copy{i}", {1, 2, 3, 4}) for i in range(12)] + [("near", {1, 2, 3}), ("one", {7}), ("one b", {7})]
    sets += [(None, {1, 2, 3, 4}), ("none", None), ("void", set())]
    assert pairs(spark, rows, sets) == expected(sets, 0.75)
    assert pairs(spark, rows, sets, 0.5) == expected(sets, 0.5)


def test_thresholds_down_to_the_reach_and_below(spark, rows):
    rng = random.Random(5)
    sets = [(f"r{i:02d}", set(rng.sample(range(24), rng.randrange(1, 9)))) for i in range(90)]
    for c in range(12):
        base = [100 * (c + 1) + i for i in range(8)]
        sets += [(f"c{c}_{k}", set(base) - {base[k]}) for k in range(8)] + [(f"d{c}_{k}", {base[k], 5000 + 10 * c + k}) for k in range(8)]
    for threshold in (0.25, 0.1):
        assert pairs(spark, rows, sets, threshold) == expected(sets, threshold)


def test_threshold_of_nothing_is_refused(spark, rows):
    for threshold in (0, -0.5, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            pairs(spark, rows, [("a", {1}), ("b", {2})], threshold)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(0, 9), max_size=7), max_size=14))
def test_small_dense_universes(spark, rows, sets):
    named = [(f"s{i:02d}", s) for i, s in enumerate(sets)]
    assert pairs(spark, rows, named) == expected(named, 0.75)


def test_empty_table_and_class_form(spark, rows):
    assert pairs(spark, rows, []) == []
    df = frame(spark, [("a", [1, 2, 3, 4]), ("b", [4, 3, 2, 1]), ("b", [1]), ("c", [1, 2, 3])])
    classes, membership = set_classes(united_sets(df))
    assert rows(membership, "id", "sid") == [("a", "a"), ("b", "a"), ("c", "c")]
    links = similar_classes(classes, 0.75)
    assert rows(links, "a", "b") == [("a", "c")]
    assert rows(expand_pairs(links, membership), "id_a", "id_b") == [("a", "b"), ("a", "c"), ("b", "c")]


def test_elements_are_exact_whatever_their_numbers(spark, rows):
    data = [("a", 2**62, [2**62, -5]), ("b", 2**62, [2**62, -5]), ("c", 2**62 + 1, [2**62, -5]), ("d", None, [1]), ("e", 2**62, [2**62 - 1, -5])]
    df = spark.createDataFrame(data, "id string, space long, indices array<long>")
    assert rows(similar_pairs(df, 0.3), "id_a", "id_b") == [("a", "b"), ("a", "e"), ("b", "e")]


def test_large_cells_are_cut_again_and_then_joined_in_blocks(spark, rows):
    """Small bounds send sets through several levels of pivots, rests, and blocks; hidden pairs lie within and across all of them."""
    rng = random.Random(2)
    sets = []
    for c in range(70):
        at = rng.randrange(40) * 50
        base = set(rng.sample(range(at, at + 60), rng.randrange(4, 25)))
        sets += [(f"r{c:02d}_{k}", base ^ set(rng.sample(range(at, at + 60), rng.randrange(0, 4)))) for k in range(5)]
    sets += [(f"x{i}", {0, 1, 2, 3, 4, 5, 6, 7} - {i}) for i in range(8)]
    classes, membership = set_classes(united_sets(frame(spark, sets)))
    for most, levels in ((60, 4), (40, 1)):
        cells, large = partition(classes, 0.6, 4, most, levels)
        assert cells.where("home").count() == classes.count() and cells.select("cell").distinct().count() > 10
        got = expand_pairs(similar_classes(classes, 0.6, 4, most, levels), membership)
        assert bool(large) or levels > 1
        assert rows(got, "id_a", "id_b") == expected(sets, 0.6)
