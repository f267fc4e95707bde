import random

from pyspark.sql import functions as F

from facetlake.operators.history import attribute_history, change_log, latest_statements

SCHEMA = "k long, at long, upd string, status string, conf double, value string, __b string"


def expected(data):
    best = {}
    for k, at, upd, s, c, *_ in data:
        if k is None or at is None:
            continue
        # NULL sorts lowest, in the order of recency first.
        rank = ((upd is not None, upd or ""), (s is not None, s or ""), (c is not None, c or 0))
        if (k, at) not in best or best[(k, at)][0] < rank:
            best[(k, at)] = (rank, (s, c))
    out = []
    for key in {k for k, _ in best}:
        prev, opened = None, None
        for at, state in sorted((a, v[1]) for (k, a), v in best.items() if k == key):
            if state == prev:
                continue
            if opened is not None:
                out.append((key, opened, at))
            opened, prev = (None if state[0] == "gone" else at), state
        if opened is not None:
            out.append((key, opened, None))
    return sorted(out, key=str)


def run(spark, data, bucket=50):
    df = spark.createDataFrame(data, SCHEMA)
    return attribute_history(df, "k", "at", ["upd"], ["status", "conf"], F.col("status") == "gone", bucket)


def test_random_histories_match_brute_force_across_buckets(spark, rows):
    rng = random.Random(3)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(0, 400, 7)]), rng.choice([None, "a", "b"]), rng.choice(["x", "y", "gone", None]), rng.choice([0.5, 0.7, None]), "v", "w") for _ in range(400)]
    data += data[:40]  # repeated deliveries
    for bucket in (20, 10_000):
        assert rows(run(spark, data, bucket), "k", "valid_from", "valid_to") == expected(data)


def test_empty_table_and_all_null(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(None, None, None, None, None, None, None)]).count() == 0


def test_null_is_a_value_and_superseded_restarts_equal_state(spark, rows):
    data = [(1, 0, "a", None, None, "", ""), (1, 10, "a", "gone", None, "", ""), (1, 20, "a", None, None, "", ""), (1, 30, "a", None, None, "", "")]
    assert rows(run(spark, data), "valid_from", "valid_to") == [(0, 10), (20, None)]


def test_change_log_has_one_row_per_attribute_change(spark, rows):
    data = [(1, 0, "a", "x", 0.5, "", ""), (1, 200, "a", "x", 0.6, "", ""), (1, 400, "a", "y", 0.6, "", "")]
    events = latest_statements(spark.createDataFrame(data, SCHEMA), "k", "at", ["upd"], ["status", "conf"])
    log = change_log(events, "k", "at", ["status", "conf"], 50)
    assert rows(log, "at", "attribute") == [(0, "conf"), (0, "status"), (200, "conf"), (400, "status")]
