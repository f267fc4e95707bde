"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until the
source marginals are the target shares and the language and topic marginals
those of the corpus, as far as the repeat limits let them. A cell's weight
over its tokens is the expected number of copies of each of its documents; the
whole part is given to all, the rest by sampling. The sample is calibrated: per
source, the documents with the least random rank per probability are taken up
to the point where their tokens meet the source's share, found by counting
ranks in bins and never by sorting a source in one place.

Sources, languages and topics can contradict each other, so that no weights
meet all marginals. Sources always hold; what is left of the others, and
whether the fit came to rest, is reported.

Only tables of bounded size reach the driver: cells (at most MOST_CELLS) and
bins (sources x BINS).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.session import written

#: Languages and topics kept apart: those with the most tokens; all others, NULL included, are one.
MOST_LANGUAGES = MOST_TOPICS = 64
#: A larger target table, or more cells with documents, is an error.
MOST_SOURCES, MOST_CELLS = 1_000, 200_000
BINS = 1024


@dataclass
class Mix:
    documents: DataFrame
    shares: DataFrame
    marginals: DataFrame


def rake(tokens: np.ndarray, source_mass: np.ndarray, most: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, bool]:
    """(copies per document of each cell of ``tokens`` (source x language x topic), whether the rounds came to rest on all marginals).

    Marginals over languages and topics are those of ``tokens``; sources get
    ``source_mass``, which must not exceed most x tokens. No cell is copied
    more than its source's ``most``; the source marginals hold exactly, the
    others as nearly as this allows.
    """
    have = tokens > 0
    total = source_mass.sum()
    lang, topic = (tokens.sum(axis=(0, 2)), tokens.sum(axis=(0, 1)))
    lang, topic = (x / max(x.sum(), 1e-300) * total for x in (lang, topic))
    cap = tokens * most[:, None, None]
    w = tokens.astype(float).copy()

    def to_source(w: np.ndarray) -> np.ndarray:
        # Scale each source to its mass; what a full cell cannot take goes to the source's other cells.
        w = np.where(have, np.maximum(w, 1e-12), 0.0)
        for _ in range(50):
            full = w >= cap * (1 - 1e-12)
            free = (w * ~full).sum(axis=(1, 2))
            want = source_mass - (np.where(full, cap, 0.0)).sum(axis=(1, 2))
            factor = np.where(free > 0, np.maximum(want, 0) / np.maximum(free, 1e-300), 1.0)
            new = np.minimum(np.where(full, cap, w * factor[:, None, None]), cap)
            if np.allclose(new, w, rtol=1e-12, atol=0):
                break
            w = new
        return w

    for _ in range(rounds):
        before = w
        w = to_source(w)
        m = w.sum(axis=(0, 2))
        w = w * np.where(m > 0, lang / np.maximum(m, 1e-300), 1.0)[None, :, None]
        m = w.sum(axis=(0, 1))
        w = w * np.where(m > 0, topic / np.maximum(m, 1e-300), 1.0)[None, None, :]
        if np.allclose(w, before, rtol=1e-9):
            break
    w = to_source(w)
    met = all(np.allclose(got, want, atol=1e-6 * max(total, 1)) for got, want in ((w.sum(axis=(0, 2)), lang), (w.sum(axis=(0, 1)), topic)))
    return np.where(have, w / np.maximum(tokens, 1), 0.0), met


def _largest(rows: DataFrame, column: str, most: int) -> list[str]:
    """The values of a column with the most tokens, in order of name."""
    top = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n_tokens").alias("t")).orderBy(F.desc("t"), column).limit(most).collect()
    return sorted(r[column] for r in top)


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7) -> Mix:
    """Documents with the number of times each is taken, the shares that come out, and how well all marginals are met.

    ``docs``: doc_id, source, lang, kind, n_tokens. ``targets``: source,
    target_share, max_repeats; sources are unique there.

    - Documents of other sources or NULL source are not taken, nor are those without tokens.
    - ``total_tokens`` defaults to the most at which every source that has tokens meets its share within its repeats;
      a larger total leaves small sources at their limit and says so in the report.
    - A source without documents gets 0; the others keep their shares relative to each other.
    - No document is taken more than max_repeats times; a document's row is given once, with its ``copies``.
    - Language spellings are read by their first two letters. Languages and topics aim at their shares of the documents of the target sources.

    ``documents``: doc_id, source, lang, kind, n_tokens, expected (copies before sampling), copies (at least 1).
    ``shares``: source, target_share, max_repeats, n_documents, source_tokens, taken_documents, taken_tokens, actual_share, at_limit,
    tokens_asked (the total used), possible_tokens (the total up to which this source meets its share; NULL without documents) and
    limiting (whether it is the least of these, that of the default total).
    ``marginals``: marginal (source, language, topic), value ('' for the rest), target_share, fitted_share, actual_share, residual (actual - target), converged.
    """
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").limit(MOST_SOURCES + 1).collect()}
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"a target table names at most {MOST_SOURCES} sources")
    spark, names = docs.sparkSession, sorted(goal)
    # Counted once, read in each pass below.
    rows = written(docs.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).select(
        "doc_id", "source", "lang", "kind", F.col("n_tokens").cast("long").alias("n_tokens"), F.lower(F.substring("lang", 1, 2)).alias("short"), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**40)) + 1).alias("u"),
    ))
    languages, kinds = _largest(rows, "short", MOST_LANGUAGES), _largest(rows, "kind", MOST_TOPICS)
    number = lambda c, values: F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))
    rows = rows.withColumns({"l": number("short", languages), "k": number("kind", kinds)})
    tokens = np.zeros((len(names), len(languages) + 1, len(kinds) + 1))
    where = {s: i for i, s in enumerate(names)}
    cells = rows.groupBy("source", "l", "k").agg(F.sum("n_tokens").alias("t")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic")
    for r in cells:
        tokens[where[r["source"]], r["l"], r["k"]] = r["t"]
    share = np.array([goal[s][0] for s in names])
    most = np.array([goal[s][1] for s in names], float)
    room = tokens.sum(axis=(1, 2)) * most
    live = (room > 0) & (share > 0)
    possible = np.full(len(names), np.inf)
    total, met = 0.0, True
    if not live.any():
        copies, mass = np.zeros_like(tokens), np.zeros(len(names))
    else:
        share_of = np.where(live, share, 0) / share[live].sum()
        possible[live] = room[live] / share_of[live]
        total = float(total_tokens) if total_tokens is not None else float(possible.min())
        mass = np.minimum(share_of * total, np.where(live, room, 0))
        copies, met = rake(tokens, mass, most)
    # Cells are bounded by MOST_CELLS, whatever the corpus.
    fitted = spark.createDataFrame(
        [(s, int(l), int(k), float(copies[i, l, k])) for i, s in enumerate(names) for l, k in zip(*np.nonzero(copies[i] > 0))] or [("", 0, 0, 0.0)], "source string, l int, k int, expected double"
    )
    drawn = rows.join(F.broadcast(fitted), ["source", "l", "k"]).withColumn("whole", F.floor("expected").cast("int")).withColumn("p", F.col("expected") - F.col("whole"))
    drawn = drawn.withColumn("rank", F.when(F.col("p") > 1e-12, F.col("u") / 2.0**40 / F.col("p")))
    given = {r["source"]: float(r["t"]) for r in drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("t")).collect()}
    bounds = _rank_bounds(drawn, names, {s: mass[i] - given.get(s, 0.0) for i, s in enumerate(names)})
    limit = spark.createDataFrame([(s, float(bounds[s])) for s in names] or [("", 0.0)], "source string, bound double")
    out = drawn.join(F.broadcast(limit), "source").withColumn("copies", F.col("whole") + F.when(F.col("rank") <= F.col("bound"), 1).otherwise(0))
    taken_tokens = F.sum(F.col("copies") * F.col("n_tokens"))
    taken = out.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("source_tokens"), F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("taken_documents"), taken_tokens.alias("taken_tokens")
    )
    all_taken = F.broadcast(taken.agg(F.sum("taken_tokens").alias("all_tokens")))
    said = spark.createDataFrame(
        [(s, bool(live[i] and mass[i] >= room[i] * (1 - 1e-9)), total, float(possible[i]) if live[i] else None, bool(live[i] and possible[i] == possible.min())) for i, s in enumerate(names)] or [("", False, 0.0, None, False)],
        "source string, at_limit boolean, tokens_asked double, possible_tokens double, limiting boolean",
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    shares = (
        targets.where("source is not null").select("source", "target_share", "max_repeats").join(taken, "source", "left").join(F.broadcast(said), "source").crossJoin(all_taken)
        .select(
            "source", "target_share", "max_repeats", *[zero(c) for c in ("n_documents", "source_tokens", "taken_documents", "taken_tokens")],
            F.coalesce(F.col("taken_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), "at_limit", "tokens_asked", "possible_tokens", "limiting",
        )
    )
    weight = tokens * copies
    every, lines = max(weight.sum(), 1e-300), []
    for name, labels, axes, want in (("source", names, (1, 2), mass), ("language", [*languages, ""], (0, 2), tokens.sum(axis=(0, 2))), ("topic", [*kinds, ""], (0, 1), tokens.sum(axis=(0, 1)))):
        lines += [(name, v, float(t), float(w)) for v, t, w in zip(labels, want / max(want.sum(), 1e-300), weight.sum(axis=axes) / every)]
    wanted = spark.createDataFrame(lines or [("", "", 0.0, 0.0)], "marginal string, value string, target_share double, fitted_share double")
    kept = lambda c, values: F.when(F.col(c).isin(values), F.col(c)).otherwise(F.lit(""))
    told = F.explode(F.array(*[F.struct(F.lit(m).alias("marginal"), v.alias("value")) for m, v in (("source", F.col("source")), ("language", kept("short", languages)), ("topic", kept("kind", kinds)))]))
    real = out.select(told.alias("m"), (F.col("copies") * F.col("n_tokens")).alias("t")).groupBy("m").agg(F.sum("t").alias("t")).select("m.*", "t")
    marginals = wanted.join(F.broadcast(real), ["marginal", "value"], "left").crossJoin(all_taken).where("target_share > 0 or t > 0")
    actual = F.coalesce(F.col("t") / F.col("all_tokens"), F.lit(0.0))
    marginals = marginals.select("marginal", "value", "target_share", "fitted_share", actual.alias("actual_share"), (actual - F.col("target_share")).alias("residual"), F.lit(bool(met)).alias("converged"))
    return Mix(out.where("copies > 0").select("doc_id", "source", "lang", "kind", "n_tokens", "expected", "copies"), shares, marginals)


def _rank_bounds(drawn: DataFrame, names: list[str], want: dict[str, float], passes: int = 4) -> dict[str, float]:
    """Per source the rank up to which documents are taken so that their tokens come nearest to ``want``.

    Each pass counts the tokens of BINS bins of the interval in question and
    narrows it to one bin; four passes leave no two ranks of 2^40 together.
    """
    top = drawn.groupBy("source").agg(F.max("rank").alias("r"))
    high = {r["source"]: float(r["r"]) for r in top.collect() if r["r"] is not None}
    lo, hi = {s: 0.0 for s in names}, {s: high.get(s, 0.0) for s in names}
    base = {s: 0.0 for s in names}
    near: dict[str, tuple[float, float]] = {s: (0.0, abs(want[s])) for s in names}
    for _ in range(passes):
        edges = drawn.sparkSession.createDataFrame([(s, lo[s], hi[s]) for s in names if hi[s] > lo[s]] or [("", 0.0, 1.0)], "source string, lo double, hi double")
        inside = drawn.where("rank is not null").select("source", "rank", "n_tokens").join(F.broadcast(edges), "source").where("rank > lo and rank <= hi")
        b = F.least(F.ceil((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS)).cast("int")
        bins: dict[str, dict[int, float]] = {}
        for r in inside.groupBy("source", b.alias("b")).agg(F.sum("n_tokens").alias("t")).collect():
            bins.setdefault(r["source"], {})[r["b"]] = float(r["t"])
        for s in names:
            width, at, narrowed = (hi[s] - lo[s]) / BINS, base[s], False
            left = lo[s]
            for i in sorted(bins.get(s, {})):
                upper, after = left + width * i, at + bins[s][i]
                if abs(after - want[s]) < near[s][1]:
                    near[s] = (upper, abs(after - want[s]))
                if after > want[s]:
                    lo[s], hi[s], base[s], narrowed = left + width * (i - 1), upper, at, True
                    break
                at = after
            if not narrowed:
                lo[s] = hi[s]
        if all(hi[s] <= lo[s] for s in names):
            break
    return {s: near[s][0] for s in names}
