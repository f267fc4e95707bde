import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetlake.llm.split import PIECES, RangeMax, cut_text, pieces_mapper, strengths
from facetlake.llm.tokens import TOKENIZERS, VOCABULARY, _encoder, vocabulary


@pytest.fixture(scope="module")
def enc():
    with open(f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        return _encoder(f.read())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.data())
def test_range_max_is_the_rightmost_strongest(keys, data):
    table = RangeMax(np.array(keys), len(keys))
    lo = data.draw(st.integers(0, len(keys) - 1))
    hi = data.draw(st.integers(lo, len(keys) - 1))
    assert table.query(lo, hi) == max(range(lo, hi + 1), key=lambda i: (keys[i], i))


def check(enc, text, most, overlap):
    ids = enc.tokenizer.encode_ordinary(text)
    pieces = cut_text(enc, np.frombuffer(text.encode(), np.uint8), np.array(ids, np.int32), most, overlap)
    end = 0
    for a, b, n, shared, _, piece in pieces:
        assert a == end - shared and b > end
        assert enc.tokenizer.decode_bytes(ids[a:b]) == piece
        assert enc.count(piece.decode()) == n <= most
        end = b
    assert end == len(ids)
    return pieces


WORDS = st.sampled_from(["word", " more", "\n\n", "\n", ". ", ", ", "日本の", "。", "x" * 40, " 12.5", "'s", "  ", "é", "👩‍🚀"])


@settings(max_examples=60, deadline=None)
@given(st.lists(WORDS, min_size=60, max_size=200).map("".join), st.integers(12, 40), st.integers(0, 6))
def test_pieces_fit_overlap_and_rebuild(enc, text, most, overlap):
    if len(enc.tokenizer.encode_ordinary(text)) > most:
        check(enc, text, most, overlap)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORDS, min_size=60, max_size=200).map("".join), st.integers(12, 40), st.integers(1, 9))
def test_every_cut_is_the_strongest_of_its_window(enc, text, most, overlap):
    """Against all cuts of the window: none that fits is stronger, none as strong with as clean an overlap lies to the right."""
    ids = np.array(enc.tokenizer.encode_ordinary(text), np.int32)
    if len(ids) <= most:
        return
    start = np.concatenate([[0], np.cumsum(enc.width[ids])])
    raw = text.encode()
    kind, join = strengths(np.frombuffer(raw, np.uint8), start[:-1])
    pieces = check(enc, text, most, overlap)
    for a, b, _, shared, boundary, _ in pieces:
        if boundary == "end" or shared < overlap and a:
            continue
        lo, hi = max(a + max(shared, overlap) + 1, a + most // 2 + 1), min(a + most, len(ids) - 1)
        fits = [e for e in range(lo, hi + 1) if kind[e] and enc.count(raw[start[a] : start[e]].decode()) <= most]
        clean = lambda e: 2 if join[e] and join[e - overlap] else 1 if kind[e - overlap] else 0
        if b >= lo:
            assert b == max(fits, key=lambda e: (kind[e], clean(e), e))
        else:
            assert all(kind[e] < kind[b] for e in fits)


def test_natural_boundaries_win(enc):
    text = "One short sentence here. Another one follows it, as said.\n\nA new paragraph starts and goes on for a while, with words. And more of it then."
    pieces = check(enc, text, 16, 0)
    assert "paragraph" in [p[4] for p in pieces]


def test_strength_comes_before_a_clean_overlap_start(enc):
    # Stepping back 3 tokens from the paragraph ends inside the long word, from the words after it at a join.
    text = " a" * 12 + " " + "x" * 40 + "\n\nb" + " b" * 40
    ids = enc.tokenizer.encode_ordinary(text)
    assert len(enc.tokenizer.encode_ordinary(text.split("\n\n")[0])) in range(14, 24)
    first = check(enc, text, 26, 3)[0]
    assert first[4] == "paragraph" and enc.tokenizer.decode_bytes(ids[first[1] :]).startswith(b"\nb")


def test_unbroken_run_is_cut_before_rather_than_inside(enc):
    run = "ab" * 20
    assert 14 < len(enc.tokenizer.encode_ordinary(" " + run)) <= 24
    pieces = check(enc, "One two. Three four five" + (" " + run) + " six seven." + " word" * 20, 24, 0)
    assert pieces[0][5] == b"One two." and "character" not in [p[4] for p in pieces]


def test_stretch_without_breaks_and_tiny_limits(enc):
    check(enc, "ab" * 4000, 64, 8)
    check(enc, "日" * 900, 20, 4)
    check(enc, " a" * 50, 2, 9)


def test_large_overlaps_are_kept(enc):
    for most, overlap in [(20, 10), (20, 16), (20, 19), (8, 7)]:
        pieces = check(enc, " word, more." * 40, most, overlap)
        assert all(p[3] == overlap for p in pieces[1:])
    for text in ("ab" * 300, "👩‍🚀日本" * 40, "é's  x" * 40):
        for overlap in (6, 9, 11):
            check(enc, text, 12, overlap)


def test_overlap_of_the_limit_or_more_is_refused(spark):
    for limit in [(20, 20), (20, 21)]:
        with pytest.raises(ValueError, match="overlap"):
            pieces_mapper(vocabulary(spark), {"k": limit})


def test_query_on_null_unknown_kind_and_short_texts(spark):
    rows = [(1, "k", "word " * 50, "x"), (2, "k", None, "x"), (3, "k", "", "x"), (4, None, "word " * 50, "x"), (5, "other", "word " * 50, "x"), (6, "k", "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string, piece_no string").select("doc_id", "kind", "text")
    out = df.mapInArrow(pieces_mapper(vocabulary(spark), {"k": (20, 3)}), PIECES)
    got = out.collect()
    assert {r["doc_id"] for r in got} == {1} and all(r["n_tokens"] <= 20 for r in got)
    assert all(r["overlap"] == 3 for r in got if r["piece_no"])
    assert df.where("false").mapInArrow(pieces_mapper(vocabulary(spark), {"k": (20, 3)}), PIECES).count() == 0
