"""All pairs of sets whose Jaccard similarity reaches a threshold, by metric pivot partitioning.

Equal sets are joined once, as classes. Sampled classes are pivots. Distances
to pivots are Jaccard distances of coarsened sets: elements fall into buckets
of neighbouring indices, and buckets are compared by how many elements each
set has there (weighted Jaccard). That distance is a metric too and is never
above the true one, so every bound below holds for the true distance; and
where true sets are all disjoint and equally far, coarse ones still lie near
or far.

With eps = 1 - threshold:

- a set's home is the cell of its nearest pivot, if that is nearer than the
  threshold; else the cell's rest;
- it visits cell q if its distance to pivot q is at most its least distance
  + 2 eps, and at most q's radius + eps (both by the triangle inequality), and
  the rest if its least distance is at least the threshold - eps. Of two homes
  only the later visits the earlier, so no pair is found twice;
- cells that are still large are cut again, by pivots of their own: rests with
  coarser buckets, others with finer ones. What no pivots can cut is joined in
  blocks of bounded size, every block with every other.

A cell is then joined exactly in memory: sets that share one of their rarest
elements there, of fitting sizes and places, are compared in full. Sets travel
to their cells once; no candidate leaves a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.session import written

#: Sets per pivot, and the most pivots of a level: the tables below that are sent to all tasks have so many rows.
TARGET, MOST_PIVOTS = 16, 4096
#: Buckets of a pivot at most, so that what is sent is bounded.
MOST_BUCKETS = 1024
#: A cell whose homes have more elements than this is cut again, by up to LEVELS rounds of pivots.
MOST_PLACES, LEVELS = 500_000, 5
#: Bits of an index that a bucket leaves out: at first, and how many more for rests, fewer for other cells.
SHIFT, COARSER, FINER = 13, 4, 4
#: Elements, and pairs, worked on at once.
STEP, PAIRS = 1_000_000, 2_000_000

_SETS = "id string, n int, spaces array<long>, indices array<long>, digest binary"
_ROWS = "cell long, sid string, home boolean, n int, spaces array<long>, indices array<long>"


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column without NULLs inside."""
    off = column.offsets.to_numpy()
    return np.diff(off), column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)


def _list_array(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start .. start + length - 1, laid end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _united(owner: np.ndarray, spaces: np.ndarray, indices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, space, index), sorted."""
    order = np.lexsort((indices, spaces, owner))
    owner, spaces, indices = owner[order], spaces[order], indices[order]
    keep = _runs(owner, spaces, indices)
    return owner[keep], spaces[keep], indices[keep]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, space, indices) to one row an id and batch, repeats dropped: the half of the union that needs no shuffle."""
    for b in batches:
        code, names = pd.factorize(b.column(0).to_numpy(zero_copy_only=False))
        lists = b.column(2)
        off = lists.offsets.to_numpy()
        values = lists.values.slice(off[0], off[-1] - off[0])
        there = values.is_valid().to_numpy(zero_copy_only=False)
        n = np.diff(off)
        owner, space = np.repeat(code, n)[there], np.repeat(b.column(1).to_numpy(), n)[there]
        owner, space, index = _united(owner, space, values.drop_null().to_numpy(zero_copy_only=False))
        first = np.flatnonzero(_runs(owner)) if len(owner) else np.empty(0, np.int64)
        n = np.diff(first, append=len(owner))
        yield pa.RecordBatch.from_arrays([pa.array(names[owner[first]], pa.string()), _list_array(n, space), _list_array(n, index)], ["id", "spaces", "indices"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, spaces, indices), repeats allowed, to sets with their size and a digest."""
    for b in batches:
        n, spaces = _lists(b.column(1))
        owner, spaces, indices = _united(np.repeat(np.arange(len(n)), n), spaces, _lists(b.column(2))[1])
        n = np.bincount(owner, minlength=b.num_rows)
        both = np.stack([spaces, indices], 1)
        to = np.cumsum(n)
        digests = [hashlib.blake2b(both[i:j].tobytes(), digest_size=32).digest() for i, j in zip(to - n, to)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), _list_array(n, spaces), _list_array(n, indices), pa.array(digests, pa.binary())], ["id", "n", "spaces", "indices", "digest"])


def united_sets(members: DataFrame) -> DataFrame:
    """The set of each id of ``members`` (id string, space long, indices array<long>), written: id, n, spaces, indices, digest.

    An element is a pair (space, index), kept exactly. Rows of an id are
    united, repeats and NULL indices dropped; NULL ids, NULL spaces and empty
    sets are left out. Repeats within a batch go before the shuffle. A set is
    one value of one row, as in the input.
    """
    rows = members.where("id is not null and space is not null and indices is not null").select(F.col("id").cast("string").alias("id"), F.col("space").cast("long").alias("space"), F.col("indices").cast("array<long>").alias("indices"))
    part = rows.mapInArrow(_combine, "id string, spaces array<long>, indices array<long>")
    whole = part.groupBy("id").agg(F.flatten(F.collect_list("spaces")).alias("spaces"), F.flatten(F.collect_list("indices")).alias("indices"))
    return written(whole.mapInArrow(_finish, _SETS))


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: sid, n, spaces, indices), (membership: id, sid) of ``united_sets``; equal sets are told by a 256-bit digest.

    ``sid`` is the least id of a class. Only classes of several sets take part
    in a join; one of very many is split by adaptive execution.
    """
    keyed = sets.select("id", "digest")
    many = keyed.groupBy("digest").agg(F.min("id").alias("sid"), F.count(F.lit(1)).alias("k")).where("k > 1").select("digest", "sid")
    copies = written(keyed.join(many, "digest").select("id", "sid"))
    classes = sets.join(copies.where("id <> sid").select("id"), "id", "left_anti").select(F.col("id").alias("sid"), "n", "spaces", "indices")
    alone = keyed.select("id").join(copies.select("id"), "id", "left_anti")
    return classes, copies.unionByName(alone.select("id", F.col("id").alias("sid")))


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """64 bits of several longs. Where two differ and mix alike, buckets fall together, which only makes them coarser."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _profiles(b: pa.RecordBatch, shift: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the coarsened sets of a batch (cell, ..., spaces, indices); buckets of other cells differ."""
    n, spaces = _lists(b.column("spaces"))
    row, cell = np.repeat(np.arange(len(n)), n), b.column("cell").to_numpy()
    bits = np.array([shift[c] for c in cell.tolist()], np.int64) if len(cell) else np.empty(0, np.int64)
    bucket = _mixed(cell[row], spaces, _lists(b.column("indices"))[1] >> bits[row])
    order = np.lexsort((bucket, row))
    row, bucket = row[order], bucket[order]
    first = np.flatnonzero(_runs(row, bucket)) if len(row) else np.empty(0, np.int64)
    return row[first], bucket[first], np.diff(first, append=len(row))


@dataclass
class Pivots:
    """The pivots of a level: their buckets, sorted, with the pivot and its count; sizes of pivots; the bits their cells leave out."""

    bucket: np.ndarray
    pivot: np.ndarray
    count: np.ndarray
    size: np.ndarray
    shift: dict[int, int]

    def distances(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, distance) of all rows and pivots of their cells that share a bucket; the others are 1 apart."""
        row, bucket, count = _profiles(b, self.shift)
        lo, hi = np.searchsorted(self.bucket, bucket), np.searchsorted(self.bucket, bucket, "right")
        at = _spread(lo, hi - lo)
        both = np.minimum(np.repeat(count, hi - lo), self.count[at])
        pair, code = np.unique(np.repeat(row, hi - lo) * len(self.size) + self.pivot[at], return_inverse=True)
        row, pivot = pair // max(len(self.size), 1), pair % max(len(self.size), 1)
        common = np.bincount(code, both, len(pair))
        return row, pivot, 1 - common / (b.column("n").to_numpy()[row] + self.size[pivot] - common)

    def homes(self, b: pa.RecordBatch, row: np.ndarray, pivot: np.ndarray, d: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
        """(home pivot or -1 for the rest, least distance) of each row."""
        home, least = np.full(b.num_rows, -1), np.ones(b.num_rows)
        order = np.lexsort((pivot, d, row))
        first = order[_runs(row[order])] if len(order) else order
        least[row[first]] = d[first]
        home[row[first]] = np.where(d[first] < within - 1e-6, pivot[first], -1)
        return home, least


def _pivots(rows: DataFrame, shift: dict[int, int], n: int, seed: int) -> Pivots:
    """Pivots of the homes among ``rows``, as many of a cell as its share of them."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, bucket, count = _profiles(b, shift)
            k = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("n"), _list_array(k, bucket), _list_array(k, count.astype(np.int64))], ["sid", "n", "buckets", "counts"])

    k = min(MOST_PIVOTS, -(-n // TARGET))
    all_ = rows.where("home").select("cell", "sid", "n", "spaces", "indices").mapInArrow(profile, "sid string, n int, buckets array<long>, counts array<long>")
    got = all_.where(F.size("buckets") <= MOST_BUCKETS).orderBy(F.xxhash64("sid", F.lit(seed)), "sid").limit(k).collect()
    bucket = np.array([x for r in got for x in r["buckets"]], np.int64)
    order = np.argsort(bucket, kind="stable")
    pivot = np.repeat(np.arange(len(got)), [len(r["buckets"]) for r in got]).astype(np.int64)
    count = np.array([x for r in got for x in r["counts"]], np.int64)
    return Pivots(bucket[order], pivot[order], count[order], np.array([r["n"] for r in got], np.int64), shift)


def _radii(rows: DataFrame, pivots: Pivots, threshold: float) -> list:
    """(cell, pivot or -1, radius, sets, places) of the new cells' homes: at most a row a pivot and a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            home, least = pivots.homes(b, *pivots.distances(b), threshold)
            df = pd.DataFrame({"cell": b.column("cell").to_numpy(), "pivot": home, "radius": least, "places": b.column("n").to_numpy().astype(np.int64), "sets": 1})
            yield pa.RecordBatch.from_pandas(df.groupby(["cell", "pivot"], as_index=False).agg({"radius": "max", "sets": "sum", "places": "sum"}), preserve_index=False)

    part = rows.where("home").select("cell", "sid", "n", "spaces", "indices").mapInArrow(run, "cell long, pivot long, radius double, sets long, places long")
    return part.groupBy("cell", "pivot").agg(F.max("radius").alias("radius"), F.sum("sets").alias("sets"), F.sum("places").alias("places")).collect()


def _placed(rows: DataFrame, pivots: Pivots, radius: np.ndarray, rests: dict[int, int], level: int, threshold: float) -> DataFrame:
    """``rows`` sent to their new cells, as home or visitor."""
    eps = 1 - threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, pivot, d = pivots.distances(b)
            home, least = pivots.homes(b, row, pivot, d, threshold)
            at_home = b.column("home").to_numpy(zero_copy_only=False)
            # Homes visit earlier cells only, those of the rest (-1) none; visitors have no home here and go to all.
            last = np.where(at_home, home, len(pivots.size))
            visit = (d <= np.minimum(least[row] + 2 * eps, radius[pivot] + eps) + 1e-9) & (pivot < last[row])
            rest = np.array([rests[c] for c in b.column("cell").to_numpy().tolist()])
            cell_of = lambda p: (np.int64(level + 1) << 32) + p
            at_rest = np.flatnonzero(at_home & (home < 0))
            to_rest = np.flatnonzero(~(at_home & (home < 0)) & (least >= threshold - eps - 1e-9))
            in_cell = np.flatnonzero(at_home & (home >= 0))
            take = np.concatenate([in_cell, row[visit], at_rest, to_rest])
            cell = np.concatenate([cell_of(home[in_cell]), cell_of(pivot[visit]), rest[at_rest], rest[to_rest]])
            own = np.concatenate([np.ones(len(in_cell), bool), np.zeros(visit.sum(), bool), np.ones(len(at_rest), bool), np.zeros(len(to_rest), bool)])
            out = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(cell), out.column("sid"), pa.array(own), *[out.column(c) for c in ("n", "spaces", "indices")]], ["cell", "sid", "home", "n", "spaces", "indices"])

    return rows.mapInArrow(run, _ROWS)


def partition(classes: DataFrame, threshold: float, shift: int = SHIFT, most_places: int = MOST_PLACES, levels: int = LEVELS) -> tuple[DataFrame, dict[int, int]]:
    """(rows: cell, sid, home, n, spaces, indices; cells still too large with the elements of their homes) of the classes."""
    rows = classes.select(F.lit(0).cast("long").alias("cell"), "sid", F.lit(True).alias("home"), "n", "spaces", "indices")
    rows = written(rows)
    size = rows.count()
    open_, done = {0: (shift, size)}, None
    large: dict[int, int] = {}
    for level in range(levels):
        pivots = _pivots(rows, {c: s for c, (s, _) in open_.items()}, sum(k for _, k in open_.values()), level)
        stats = _radii(rows, pivots, threshold)
        radius = np.zeros(len(pivots.size))
        rests = {c: (level + 1 << 32) + (1 << 31) + i for i, c in enumerate(sorted(open_))}
        bits, now, large = open_, {}, {}
        for r in stats:
            p = r["pivot"]
            if p >= 0:
                radius[p] = r["radius"]
            if r["places"] > most_places:
                s = bits[r["cell"]][0]
                cell = (level + 1 << 32) + p if p >= 0 else rests[r["cell"]]
                now[cell] = (max(0, s - FINER) if p >= 0 else min(62, s + COARSER), r["sets"])
                large[cell] = r["places"]
        placed = _placed(rows, pivots, radius, rests, level, threshold)
        if not now:
            return placed if done is None else done.unionByName(placed), {}
        placed = written(placed)
        again = F.col("cell").isin(list(now))
        if level == levels - 1:
            return placed if done is None else done.unionByName(placed), large
        closed = placed.where(~again)
        done = closed if done is None else done.unionByName(closed)
        rows, open_ = placed.where(again), now
    raise AssertionError("unreachable")


def _join_cells(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps rows (cell, lo, hi, g, sid, home, n, spaces, indices), sorted by cell, lo and hi, to (a, b, similarity)."""

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = t.column("n").to_numpy().astype(np.int64)
        lo, hi, g = (t.column(c).to_numpy() for c in ("lo", "hi", "g"))
        home = t.column("home").to_numpy()
        block = np.cumsum(_runs(t.column("cell").to_numpy(), lo, hi)) - 1
        flat = lambda c: np.concatenate([_lists(x)[1] for x in t.column(c).chunks])
        spaces, indices = flat("spaces"), flat("indices")
        owner = np.repeat(np.arange(len(n)), n)
        # Numbers for the elements, their frequency in the block, and each set's elements from the rarest.
        order = np.lexsort((indices, spaces))
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(_runs(spaces[order], indices[order])) - 1
        many = code.max() + 1
        key, place, freq = np.unique(block[owner] * many + code, return_inverse=True, return_counts=True)
        mine = np.sort(owner * many + code)
        order = np.lexsort((code, freq[place], owner))
        start = np.cumsum(n) - n
        at = np.arange(len(owner)) - start[owner]  # ``order`` keeps owners in their places
        prefix = at < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[owner]
        p_row, p_at, p_key = owner[prefix], at[prefix], place[order][prefix]
        order = np.lexsort((p_row, n[p_row], p_key))
        p_row, p_at, p_key = p_row[order], p_at[order], p_key[order]
        # Entries of one element are sorted by size, so the partners of fitting size follow without a gap.
        wide = n.max() + 2
        rank = p_key * wide + n[p_row]
        stop = np.searchsorted(rank, p_key * wide + np.minimum(np.floor(n[p_row] / threshold + 1e-9), wide - 1).astype(np.int64), "right")
        count = stop - np.arange(len(p_row)) - 1
        found = []
        total, i = np.cumsum(count), 0
        while i < len(count):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
            x = np.repeat(np.arange(i, j), count[i:j])
            y = _spread(np.arange(i, j) + 1, count[i:j])
            r, s = p_row[x], p_row[y]
            need = np.ceil(threshold / (1 + threshold) * (n[r] + n[s]) - 1e-9)
            good = (home[r] | home[s]) & ((lo[r] == hi[r]) | (g[r] != g[s])) & (1 + np.minimum(n[r] - p_at[x], n[s] - p_at[y]) - 1 >= need)
            found.append(np.unique(np.minimum(r, s)[good] * len(n) + np.maximum(r, s)[good]))
            i = j
        pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        sid, i = t.column("sid"), 0
        weight = np.cumsum(n[pair // len(n)])
        while i < len(pair):
            j = max(i + 1, int(np.searchsorted(weight, (weight[i - 1] if i else 0) + PAIRS, "right")))
            r, s = pair[i:j] // len(n), pair[i:j] % len(n)
            # Elements of r, asked for in s.
            ask = np.repeat(s, n[r]) * many + mine[_spread(start[r], n[r])] % many
            hit = mine[np.minimum(np.searchsorted(mine, ask), len(mine) - 1)] == ask
            both = np.bincount(np.repeat(np.arange(len(r)), n[r])[hit], minlength=len(r))
            similarity = both / (n[r] + n[s] - both)
            keep = similarity >= threshold
            a, b = (sid.take(pa.array(v[keep])).combine_chunks() for v in (r, s))
            first = pa.compute.less(a, b)
            yield pa.RecordBatch.from_arrays([pa.compute.if_else(first, a, b), pa.compute.if_else(first, b, a), pa.array(similarity[keep])], ["a", "b", "similarity"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        places = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            places += int(pa.compute.sum(b.column("n")).as_py())
            if places < STEP:
                continue
            # Whole blocks only; the last one may go on.
            t = pa.Table.from_batches(held)
            ends = np.flatnonzero(_runs(*[t.column(c).to_numpy() for c in ("cell", "lo", "hi")]))
            if ends[-1]:
                yield from pairs_of(t.slice(0, ends[-1]).combine_chunks())
                t = t.slice(ends[-1]).combine_chunks()
                held, places = t.to_batches(), int(pa.compute.sum(t.column("n")).as_py())
        if held:
            yield from pairs_of(pa.Table.from_batches(held).combine_chunks())

    return run


def similar_classes(classes: DataFrame, threshold: float, shift: int = SHIFT, most_places: int = MOST_PLACES, levels: int = LEVELS) -> DataFrame:
    """(a, b, similarity) of all pairs of different classes at or above ``threshold`` (above 0, at most 1), a < b.

    ``shift`` is how many bits of an index the first buckets leave out: sets of near indices should share buckets. Results do not depend on it.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be above 0 and at most 1: {threshold}")
    rows, large = partition(classes, threshold, shift, most_places, levels)
    if large:
        blocks = classes.sparkSession.createDataFrame([(c, -(-2 * k // most_places)) for c, k in large.items()], "cell long, f int")
        # Every set of such a cell goes to the f blocks its own part has with all parts; at most LEVELS x MOST_PIVOTS cells are named.
        rows = rows.join(F.broadcast(blocks), "cell", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("g", F.pmod(F.xxhash64("sid"), F.col("f")).cast("int"))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("f") - 1))).withColumns({"lo": F.least("g", "j"), "hi": F.greatest("g", "j")})
    else:
        rows = rows.withColumns({c: F.lit(0) for c in ("lo", "hi", "g")})
    rows = rows.select("cell", "lo", "hi", "g", "sid", "home", "n", "spaces", "indices").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return rows.mapInArrow(_join_cells(threshold), "a string, b string, similarity double")


def expand_pairs(class_pairs: DataFrame, membership: DataFrame, salts: int = 16) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all members of similar classes and of each class with itself.

    Left members are dealt to ``salts`` tasks and right ones sent to each, so
    that a class with very many members is spread.
    """
    both = class_pairs.select("a", "b").unionByName(membership.groupBy(F.col("sid").alias("a")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a", F.col("a").alias("b")))
    left = membership.select(F.col("sid").alias("a"), F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    right = membership.select(F.col("sid").alias("b"), F.col("id").alias("id_b"))
    out = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(left, ["a", "salt"]).join(right, "b")
    return out.where("a <> b or id_a < id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def similar_pairs(members: DataFrame, threshold: float, shift: int = SHIFT) -> DataFrame:
    """(id_a, id_b) of all pairs of records whose sets are ``threshold`` similar, id_a < id_b in binary order.

    ``members`` as in ``united_sets``: NULL ids, NULL and empty sets are in no pair. No pair is dropped whatever the skew.
    """
    classes, membership = set_classes(united_sets(members))
    return expand_pairs(similar_classes(classes, threshold, shift), membership)
