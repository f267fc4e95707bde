import random

import numpy as np

from facetlake.llm.mix import mix_sources, rake

DOC = "doc_id long, source string, lang string, kind string, n_tokens long, expected double, copies int"
TARGET = "source string, target_share double, max_repeats int, n_tokens long"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, 0.0, 0) for d in docs], DOC), spark.createDataFrame([(*t, 1) for t in targets], TARGET)


def test_rake_keeps_sources_and_limits():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 1000, (4, 3, 2)).astype(float)
    most = np.array([1.0, 2.0, 8.0, 3.0])
    mass = np.array([0.9, 0.5, 3.0, 1.0]) * tokens.sum(axis=(1, 2))
    copies, _ = rake(tokens, mass, most)
    assert np.allclose((copies * tokens).sum(axis=(1, 2)), mass, rtol=1e-6)
    assert (copies <= most[:, None, None] + 1e-9).all()


def test_rake_follows_the_other_marginals_where_it_may():
    tokens = np.array([[[100.0], [900.0]], [[900.0], [100.0]]])
    copies, met = rake(tokens, np.array([500.0, 500.0]), np.array([9.0, 9.0]))
    assert met
    assert np.allclose((copies * tokens).sum(axis=(0, 2)), [500, 500], rtol=1e-6)


def test_shares_repeats_and_dirt(spark):
    rng = random.Random(8)
    docs = [(i, "big" if i % 3 else "small", rng.choice(["en", "EN", "de-x", None, "zz"]), rng.choice(["k", "l", None]), rng.randrange(50, 150)) for i in range(3000)]
    docs += [(9000, None, "en", "k", 100), (9001, "stranger", "en", "k", 100), (9002, "big", "en", "k", 0), (9003, "big", "en", "k", None)]
    d, t = frames(spark, docs, [("big", 0.3, 1), ("small", 0.6, 4), ("empty", 0.1, 5)])
    mix = mix_sources(d, t)
    shares = {r["source"]: r for r in mix.shares.collect()}
    assert abs(shares["big"]["actual_share"] - 1 / 3) < 0.002 and abs(shares["small"]["actual_share"] - 2 / 3) < 0.002
    assert shares["empty"]["taken_tokens"] == 0 and shares["empty"]["n_documents"] == 0
    assert shares["big"]["limiting"] != shares["small"]["limiting"] and shares["big"]["tokens_asked"] == min(shares[x]["possible_tokens"] for x in ("big", "small"))
    assert shares["empty"]["possible_tokens"] is None and not shares["empty"]["limiting"]
    lines = mix.marginals.collect()
    assert {(r["marginal"], r["value"]) for r in lines} >= {("source", "big"), ("language", "en"), ("language", "zz"), ("language", ""), ("topic", "k"), ("topic", "")}
    for name in ("source", "language", "topic"):
        assert all(abs(sum(r[c] for r in lines if r["marginal"] == name) - 1) < 1e-6 for c in ("target_share", "fitted_share", "actual_share"))
    assert all(abs(r["actual_share"] - r["fitted_share"]) < 0.03 for r in lines)
    taken = mix.documents.collect()
    assert all(1 <= r["copies"] <= {"big": 1, "small": 4}[r["source"]] for r in taken)
    assert len({r["doc_id"] for r in taken}) == len(taken) and not {r["doc_id"] for r in taken} & {9000, 9001, 9002, 9003}
    again = mix_sources(d, t).documents.collect()
    assert sorted((r["doc_id"], r["copies"]) for r in taken) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_a_set_total_leaves_small_sources_at_their_limit(spark):
    d, t = frames(spark, [(1, "a", "en", "k", 100), (2, "b", "en", "k", 1000)], [("a", 0.5, 2), ("b", 0.5, 1)])
    shares = {r["source"]: r for r in mix_sources(d, t, total_tokens=2000).shares.collect()}
    assert shares["a"]["taken_tokens"] == 200 and shares["a"]["at_limit"] and shares["b"]["taken_tokens"] == 1000


def test_empty_tables(spark):
    d, t = frames(spark, [], [("a", 1.0, 1)])
    mix = mix_sources(d, t)
    assert mix.documents.count() == 0 and mix.shares.first()["actual_share"] == 0.0
    d, t = frames(spark, [(1, "a", "en", "k", 5)], [])
    assert mix_sources(d, t).documents.count() == 0


def test_contradicting_marginals_are_told(spark):
    docs = [(i, "a", "en", "memo", 100) for i in range(20)] + [(100 + i, "b", "de", "log", 100) for i in range(80)]
    d, t = frames(spark, docs, [("a", 0.5, 4), ("b", 0.5, 1)])
    lines = {(r["marginal"], r["value"]): r for r in mix_sources(d, t).marginals.collect()}
    assert abs(lines["source", "a"]["residual"]) < 0.01 and not lines["source", "a"]["converged"]
    assert abs(lines["topic", "memo"]["target_share"] - 0.2) < 1e-9 and abs(lines["topic", "memo"]["residual"] - 0.3) < 0.01
