"""Splitting texts over a token limit at their natural boundaries, with a set overlap.

Every token position has a boundary strength. A sparse table answers, for a
piece that starts at a position, which cut in the permissible window of
lengths is the strongest, the last of equals; the next piece steps back from
it by the overlap. A text is one row and is cut where it lies: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast

from facetlake.llm.tokens import _WS, ChunkEncoder, _encoder, agreed, steps

#: Strengths: a place between two characters, words, clauses, sentences, lines, paragraphs.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(1, 7)
NAMES = ["", "character", "word", "clause", "sentence", "line", "paragraph"]
PIECES = "doc_id long, kind string, piece_no int, token_from int, token_to int, n_tokens int, overlap int, boundary string, text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("piece_no", pa.int32()), ("token_from", pa.int32()), ("token_to", pa.int32()), ("n_tokens", pa.int32()), ("overlap", pa.int32()), ("boundary", pa.string()), ("text", pa.string())])
_ROWS = 5_000


def strengths(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strength, whether the join is agreed) of cuts before the bytes ``at`` of a text; 0 inside a character.

    White space stands with what follows, so its whole run counts: two line
    feeds in it are a paragraph, one a line; else the character before decides.
    """
    n = len(b)
    join = agreed(b, np.array([n]))[at]
    out = np.where((b[at] & 0xC0) != 0x80, INSIDE, 0)
    feeds = np.cumsum(b == 10)
    solid = np.maximum.accumulate(np.where(_WS[b], -1, np.arange(n)))  # the last byte that is no white space
    before = solid[np.maximum(at - 1, 0)]
    last = b[np.maximum(before, 0)]
    end3 = lambda x, y, z: (before >= 2) & (b[np.maximum(before - 2, 0)] == x) & (b[np.maximum(before - 1, 0)] == y) & (last == z)
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8)) | end3(0xE3, 0x80, 0x82) | end3(0xEF, 0xBC, 0x81) | end3(0xEF, 0xBC, 0x9F)
    pause = np.isin(last, np.frombuffer(b",;:", np.uint8)) | end3(0xE3, 0x80, 0x81)
    kind = np.where(stop, SENTENCE, np.where(pause, CLAUSE, WORD))
    lines = feeds[at] - np.where(before >= 0, feeds[np.maximum(before, 0)], 0)
    kind = np.where(lines >= 2, PARAGRAPH, np.where(lines == 1, LINE, kind))
    # An ideographic mark that follows is no place to cut before.
    mark_next = (b[at] == 0xE3) & (at + 2 < n) & (b[np.minimum(at + 1, n - 1)] == 0x80) & np.isin(b[np.minimum(at + 2, n - 1)], (0x81, 0x82))
    return np.where(join & ~mark_next, kind, out), join & ~mark_next


class RangeMax:
    """Sparse table over ``keys``: the place of the largest key in a range, the rightmost of equals."""

    def __init__(self, keys: np.ndarray, longest: int):
        level = np.asarray(keys, np.int64) * len(keys) + np.arange(len(keys))
        self.n, self.levels, width = len(keys), [level], 1
        while 2 * width <= min(longest, self.n):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """The place of the largest key in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[lo], row[hi - (1 << k) + 1]) % self.n)


def cut_text(enc: ChunkEncoder, b: np.ndarray, ids: np.ndarray, most: int, overlap: int) -> list[tuple[int, int, int, int, str, bytes]]:
    """Pieces (token_from, token_to, n_tokens, overlap, boundary, text) of one text of more than ``most`` tokens.

    A piece has at most ``most`` tokens, counted on its own text. The strongest
    cut that leaves it more than half of that and more than ``overlap`` is
    taken; where that half has no natural one, the strongest natural one of
    fewer tokens, and only without any a cut inside a run. Of equals those come
    first whose overlap starts at an agreed join, so that a piece's own ids are
    the slice of the text's, then those whose overlap starts between
    characters; where it starts inside one, the overlap grows to the whole
    character. A piece whose ends are not agreed shrinks until its own count
    fits; where it does not fit past the overlap, the overlap gets shorter. Any
    ``overlap`` below ``most`` is kept, a larger one is ``most - 1``. A single
    character of more than ``most`` tokens is a piece over the limit.
    """
    n = len(ids)
    overlap = max(0, min(overlap, most - 1))
    start = np.concatenate([[0], np.cumsum(enc.width[ids])])
    kind, join = strengths(b, start[:-1])
    back_join, back_whole = np.zeros(n, bool), np.zeros(n, bool)
    back_join[overlap:], back_whole[overlap:] = join[: n - overlap], kind[: n - overlap] > 0
    table = RangeMax(3 * kind + np.where(join & back_join, 2, np.where((kind > 0) & back_whole, 1, 0)), most)
    raw = b.tobytes()

    def fit(s: int, least: int, hi: int) -> tuple[int, int] | None:
        """(cut, tokens) of the best piece from ``s`` that is cut in least..hi and fits; None without any."""
        exact, lo = s == 0 or join[s], max(least, s + most // 2 + 1)
        while hi >= least:
            e = table.query(min(lo, hi), hi)
            if kind[e] < WORD and least < min(lo, hi):
                low = table.query(least, min(lo, hi) - 1)
                e = low if kind[low] >= WORD or kind[e] == 0 else e
            if kind[e] == 0:  # the window lies inside one character
                return None
            count = e - s if exact and join[e] else enc.count(raw[start[s] : start[e]].decode())
            if count <= most:
                return e, count
            # Nothing after a cut that does not fit is any shorter.
            hi = min(hi, e) - max(1, count - most)
        return None

    out, s, shared = [], 0, 0
    while True:
        left, exact = n - s, s == 0 or join[s]
        if left <= most and (exact or enc.count(raw[start[s] :].decode()) <= most):
            text = raw[start[s] :]
            out.append((s, n, left if exact else enc.count(text.decode()), shared, "end", text))
            return out
        hi = s + min(most, left - 1)
        found = fit(s, s + max(shared, overlap) + 1, hi) or (shared < overlap and fit(s, s + shared + 1, hi))
        if not found and shared:
            # No cut past the shared part fits: the piece starts later, at the next whole character.
            end, s = s + shared, s + 1
            while s < end and kind[s] == 0:
                s += 1
            shared = end - s
            continue
        if not found:  # a single character of more tokens than ``most``
            e = s + 1
            while e < n and kind[e] == 0:
                e += 1
            if e == n:
                text = raw[start[s] :]
                out.append((s, n, enc.count(text.decode()), shared, "end", text))
                return out
            found = e, enc.count(raw[start[s] : start[e]].decode())
        e, count = found
        out.append((s, e, count, shared, NAMES[kind[e]], raw[start[s] : start[e]]))
        nxt = back = max(e - overlap, s + 1)
        while nxt > s + 1 and kind[nxt] == 0:
            nxt -= 1
        if kind[nxt] == 0:
            nxt = back
            while kind[nxt] == 0:
                nxt += 1
        s, shared = nxt, e - nxt


def pieces_mapper(shared: Broadcast, limits: dict[str, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps batches (doc_id, kind, text) to the pieces of the texts over the limit of their kind.

    Texts of a kind without limit, NULL and empty texts, and texts within
    their limit give no piece. ``limits`` is kind -> (max_tokens, overlap); an
    overlap of max_tokens or more is an error.
    """
    wrong = sorted(kind for kind, (most, overlap) in limits.items() if overlap >= most)
    if wrong:
        raise ValueError(f"the overlap must be below max_tokens, for kinds {wrong}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        rows: list[tuple] = []
        for batch in batches:
            names, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, b, off in steps(batch.column(2)):
                ids, n = enc.encode(b, off)
                to = np.cumsum(n)
                for j in range(len(n)):
                    limit = limits.get(kinds[i + j])
                    if limit and n[j] > limit[0]:
                        for k, piece in enumerate(cut_text(enc, b[off[j] : off[j + 1]], ids[to[j] - n[j] : to[j]], *limit)):
                            rows.append((names[i + j], kinds[i + j], k, *piece[:5], piece[5].decode()))
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run
