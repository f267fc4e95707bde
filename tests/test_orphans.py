import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from facetlake.functions.text import uri_key
from facetlake.operators.orphans import orphan_references, pack_bits, unpack_bits

REF = "ref_table string, ref_field string, row_id long, domain string, ref_key string, at_us long, rng int"
PAR = "domain string, key string, registered_us long, removed boolean, bit int"
DAY = 86_400_000_000


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 20_000)))
def test_bitmaps_round_trip(values):
    assert unpack_bits(pack_bits(np.array(sorted(values), np.int64))).tolist() == sorted(values)


def test_every_kind(spark, rows):
    refs = [
        ("t", "f", 1, "d", "absent", 40 * DAY, 0), ("t", "f", 2, "d", "dead", 40 * DAY, 0), ("t", "f", 3, "d", "later", 40 * DAY, 0), ("t", "f", 4, "d", "same month", 40 * DAY, 0),
        ("t", "f", 5, "d", "there", 40 * DAY, 0), ("t", "f", 6, "d", None, 40 * DAY, 0), ("t", "f", 7, "d", "  ", 40 * DAY, 0), ("t", "f", 8, "e", "there", 40 * DAY, 0),
        ("t", "f", 9, "d", "back", 40 * DAY, 0), ("t", "f", 10, "d", "absent", None, 0), ("t", "f", 1, "d", "absent", 40 * DAY, 0), ("t", "f", 11, "d", "always", 0, 0), ("t", "f", 12, "d", "later", None, 0),
    ]
    parents = [
        ("d", "dead", 0, True, 1), ("d", "later", 400 * DAY, False, 1), ("d", "same month", 40 * DAY + 1, False, 1), ("d", "there", 40 * DAY, False, 1), ("d", "there", 900 * DAY, False, 1),
        ("d", None, 0, False, 1), ("d", "back", 0, True, 1), ("d", "back", 41 * DAY, False, 1), ("d", "always", None, False, 1),
    ]
    want = [(1, "absent", "missing", "1970-02"), (10, "absent", "missing", ""), (2, "dead", "deleted", "1970-02"), (3, "later", "late", "1970-02"), (4, "same month", "late", "1970-02"), (8, "there", "missing", "1970-02"), (9, "back", "late", "1970-02")]
    for ranges in (0, 3):
        out = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), ranges)
        assert rows(out, "row_id", "ref_key", "orphan_kind", "period") == sorted(want, key=str)


def test_empty_sides(spark):
    r, p = spark.createDataFrame([], REF), spark.createDataFrame([], PAR)
    assert orphan_references(r, p).count() == 0
    one = spark.createDataFrame([("t", "f", 1, "d", "x", 0, 0)], REF)
    assert orphan_references(one, p).count() == 1


def test_uri_keys(spark):
    cases = {"a#b#c%5Fd": "c_d", " #x ": "x", "urn:a:b:c%C3%A9": "cé", "urn:a#b:c": "b:c", "https://x/y": None, "": None, None: None, "#": "", "#a+b": "a+b", "#100%": "100%", "URN:a:b": "b"}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", uri_key(F.col("u")).alias("k"))
    assert {r["u"]: r["k"] for r in df.collect()} == cases
