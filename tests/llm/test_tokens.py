import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetlake.llm.tokens import _PLACE, TOKENIZERS, VOCABULARY, ChunkEncoder, _encoder, _last_place, agreed, counts_mapper, ids_mapper, steps, vocabulary

PIECES = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'", " ", "　", "。", "、", "日", "本", "の", "ab 12", "12", ".", ",", "é", "\t", "\r\n", "!", "カ", "・", "…", " ", "\x1c", "\x85", "字。", "ー", "x" * 9, " abcdefgh", "<|endoftext|>", "﻿", "👩‍🚀"]


@pytest.fixture(scope="module")
def enc():
    with open(f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        return _encoder(f.read())


@pytest.fixture(scope="module")
def every(enc):
    """An encoder that cuts before every character and forgets soon."""
    return ChunkEncoder({b: enc.tokenizer.encode_single_token(b) for b in enc.tokenizer.token_byte_values()}, bits=0, most_bytes=400)


def ids_of(enc, texts, step=1 << 22):
    out = []
    for _, b, off in steps(pa.array(texts, pa.string()), step):
        ids, n = enc.encode(b, off)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def plain(enc, texts):
    return [enc.tokenizer.encode_ordinary(t or "") for t in texts]


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=30).map("".join)).map(lambda s: s.encode("utf-8", "ignore").decode()), max_size=12))
def test_reuse_changes_no_id(enc, every, texts):
    assert ids_of(enc, texts) == plain(enc, texts)
    assert ids_of(every, texts) == plain(enc, texts)


def test_long_texts_repeats_and_forgetting(enc):
    rng = random.Random(2)
    words = [" " + "".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(300)]
    texts = ["".join(rng.choices(words, k=4000)), "x" * 60_000, None, "", "日" * 5000, "".join(rng.choices(words, k=50))] * 2
    assert ids_of(enc, texts, 10_000) == plain(enc, texts)
    assert ids_of(enc, texts) == plain(enc, texts)


def test_chunks_are_reused_and_joins_repaired(enc):
    rng = random.Random(4)
    words = [" " + "".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(300)]
    passage = "".join(rng.choices(words, k=3000))
    fresh = ChunkEncoder({b: enc.tokenizer.encode_single_token(b) for b in enc.tokenizer.token_byte_values()}, bits=6)
    texts = [passage, "another beginning" + passage, passage[:9000] + "another end", passage]
    assert ids_of(fresh, texts) == plain(enc, texts)
    assert fresh.stats["encoded"] < 1.2 * len(passage) and fresh.stats["runs"] > 100


@settings(max_examples=80, deadline=None)
@given(text=st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_the_pattern_of_places_is_that_of_agreed(text):
    raw = text.encode()
    places = np.flatnonzero(agreed(np.frombuffer(raw, np.uint8), np.array([len(raw)])))
    assert [m.start() for m in _PLACE.finditer(raw)] == places.tolist()
    if len(places):
        assert _last_place(raw) == places[-1]


def test_queries_on_null_empty_and_repeated_rows(spark, enc):
    texts = ["one two", None, "", "one two", "  ", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in df.select("doc_id", "text").mapInArrow(ids_mapper(vocabulary(spark)), "doc_id long, ids array<int>").collect()}
    assert [got[i] for i in range(6)] == plain(enc, texts)
    counted = df.select("text", "doc_id").mapInArrow(counts_mapper(vocabulary(spark)), "n_tokens long, doc_id long")
    assert {r["doc_id"]: r["n_tokens"] for r in counted.collect()} == {i: len(x) for i, x in enumerate(plain(enc, texts))}
    assert df.where("false").select("doc_id", "text").mapInArrow(ids_mapper(vocabulary(spark)), "doc_id long, ids array<int>").count() == 0
