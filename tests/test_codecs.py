import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetlake.functions import codecs as c
from facetlake.schema import StoreError, element_kind


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**32 - 1), max_size=50))
def test_roaring_round_trip(values):
    assert c.roaring_decode(c.roaring_encode(sorted(values))).tolist() == sorted(values)


def test_roaring_dense_and_run_containers():
    dense = list(range(0, 30_000, 2)) + [2**32 - 1]
    assert c.roaring_decode(c.roaring_encode(dense)).tolist() == dense
    runs = struct.pack("<IB", 12347, 1) + struct.pack("<HH", 1, 9) + struct.pack("<H4H", 2, 5, 3, 100, 5)
    assert c.roaring_decode(runs).tolist() == [65536 + i for i in [*range(5, 9), *range(100, 106)]]
    for bad in (b"", b"abcd", c.roaring_encode([1, 2])[:-1]):
        with pytest.raises(StoreError):
            c.roaring_decode(bad)


def test_indices():
    assert c.index_array([3, 1, 3, 2.0]).tolist() == [1, 2, 3]
    assert c.sequence_array([3, 1, 3]).tolist() == [3, 1, 3]
    for bad in ([-1], [2**32], [0.5], [float("nan")]):
        with pytest.raises(StoreError):
            c.index_array(bad)


def test_payloads_and_bounds():
    assert c.path_decode(c.path_encode([5, 1, 5])).tolist() == [5, 1, 5]
    assert c.value_decode(c.value_encode([1.5, float("nan")], "f4"), "f4", 2)[0] == 1.5
    whole = zlib.compress(b"x" * 1000)
    for bad in (whole[:-3], b"junk"):
        with pytest.raises(StoreError):
            c.inflate(bad)
    with pytest.raises(StoreError):
        c.inflate(whole, 999)
    with pytest.raises(StoreError):
        c.value_decode(c.value_encode([1.0], "f8"), "f8", 2)
    assert c.bbox_decode(c.bbox_encode(1, 2, 3, 4, 4326)) == (1, 2, 3, 4, 4326)
    with pytest.raises(StoreError):
        c.bbox_decode(b"nothing")


def test_element_kinds():
    assert [element_kind(k) for k in ("Faces", "2", 3, " feature ")] == [1, 2, 3, 4]
    for bad in ("edge", 9, True):
        with pytest.raises(StoreError):
            element_kind(bad)
