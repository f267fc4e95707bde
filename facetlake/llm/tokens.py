"""Byte-level BPE over whole corpora by content-defined chunk reuse.

A rolling hash over the eight bytes before a position makes cuts, so equal
passages are cut alike in whatever document they stand, be it inside a word. A
chunk is encoded by itself, once in a task; its ids are copied wherever it
stands again. At every join the ids near the cut are not to be trusted: the
text from the last agreed place before it (one whose ids are the same whatever
surrounds them, see ``agreed``) to the first agreed place after it is encoded
again as one run, over further chunks where one has no such place, and takes
the place of what the two sides said there.

Chunks are found by their bytes, so no two are mistaken for each other, and no
text becomes a Python string unless it is a chunk or a run not seen before.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A place is a cut if BITS bits of its hash are zero: chunks have some 2^BITS bytes.
BITS = 10
#: Bytes of chunks and runs that a task remembers; beyond that, those not met since as many bytes ago are forgotten and encoded again.
MOST_BYTES = 48 << 20
#: Bytes of text worked on at once.
STEP = 1 << 20

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of characters that are no white space for certain: visible ASCII, Latin letters, CJK.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[[0xC3, *range(0xE4, 0xEA)]] = True
_CJK = np.zeros(256, bool)
_CJK[0xE5:0xEA] = True


def agreed(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions before which a cut changes no id of either side, but for the starts of texts.

    ``b``: bytes of texts laid end to end; ``ends``: where each ends. Two kinds
    of places qualify under the pattern:
    - before the last white space of a run that a visible character follows:
      the run before it and the rest match apart in any case;
    - between a kanji or hiragana and an ideographic comma or full stop, and
      after such a mark before one of them: a letter and a mark never match
      together (only an apostrophe joins letters).
    """
    n = len(b)
    ok = np.zeros(n, bool)
    if n < 2:
        return ok
    ok[:-1] = _WS[b[:-1]] & _VISIBLE[b[1:]]
    # The last byte of a text has no follower of its own.
    ok[ends[(ends > 0) & (ends <= n)] - 1] = False
    if n >= 6:
        letter = _CJK[b[:-5]] | ((b[:-5] == 0xE3) & (b[1:-4] == 0x81))
        mark = (b[:-5] == 0xE3) & (b[1:-4] == 0x80) & ((b[2:-3] == 0x81) | (b[2:-3] == 0x82))
        mark_next = (b[3:-2] == 0xE3) & (b[4:-1] == 0x80) & ((b[5:] == 0x81) | (b[5:] == 0x82))
        letter_next = _CJK[b[3:-2]] | ((b[3:-2] == 0xE3) & (b[4:-1] == 0x81))
        ok[3:-2] |= (letter & mark_next) | (mark & letter_next)
    return ok


#: The agreed places of ``agreed``, as a pattern.
_PLACE = re.compile(
    rb"[\t-\r ](?=[\x21-\x7e\xc3\xe4-\xe9])|(?<=[\xe5-\xe9]..)\xe3\x80[\x81\x82]|(?<=\xe3\x81.)\xe3\x80[\x81\x82]|(?<=\xe3\x80[\x81\x82])(?:[\xe5-\xe9]..|\xe3\x81.)", re.DOTALL
)


def _last_place(chunk: bytes) -> int:
    """The last agreed place, looked for from the end; there is one."""
    back = 32
    while True:
        # The look-behind of a place may reach back three bytes.
        at = max(0, len(chunk) - back)
        places = [m.start() for m in _PLACE.finditer(chunk, at)]
        if places:
            return places[-1]
        back *= 4


class _Memory:
    """Values by bytes, about the ``most`` bytes of keys met last: two generations, the older dropped when the younger is half of it."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.held = most, {}, {}, 0

    def get(self, key: bytes):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value) -> None:
        self.young[key] = value
        self.held += len(key)
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0


class ChunkEncoder:
    """Encodes batches of texts with one tokenizer and remembers the chunks it has seen.

    ``stats`` counts bytes and chunks met, and bytes of chunks and of runs that had to be encoded.
    """

    def __init__(self, ranks: dict[bytes, int], bits: int = BITS, most_bytes: int = MOST_BYTES):
        import tiktoken

        self.tokenizer = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.bits = bits
        self._chunks, self._runs = _Memory(most_bytes // 2), _Memory(most_bytes // 2)
        self.stats = {"bytes": 0, "chunks": 0, "encoded": 0, "runs": 0, "run_bytes": 0}

    def cuts(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chunk borders: all starts of texts, and the places between characters that the rolling hash picks."""
        marks = [offsets]
        if len(b) > 8:
            window = np.ndarray((len(b) - 8,), np.uint64, np.ascontiguousarray(b), 0, (1,))
            pos = np.flatnonzero((window * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits) == 0) + 8 if self.bits else np.arange(8, len(b))
            pos = pos[(b[pos] & 0xC0) != 0x80]
            # What lies before a text is not its own.
            marks.append(pos[pos - offsets[np.searchsorted(offsets, pos, "right") - 1] >= 8])
        return np.unique(np.concatenate(marks))

    def _ids_of(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_ordinary(raw.decode()), np.int32)

    def _chunk(self, raw: bytes) -> tuple:
        """(first agreed place, last one, ids of the chunk, number of ids before each place); no ids where there is no place."""
        known = self._chunks.get(raw)
        if known is None:
            first = _PLACE.search(raw)
            if first is None:
                known = (-1, -1, None, 0, 0)
            else:
                f, l, ids = first.start(), _last_place(raw), self._ids_of(raw)
                ends = np.cumsum(self.width[ids])
                known = (f, l, ids, int(np.searchsorted(ends, f, "right")), int(np.searchsorted(ends, l, "right")))
                self.stats["encoded"] += len(raw)
            self._chunks.put(raw, known)
        return known

    def _run(self, raw: bytes) -> np.ndarray:
        """Ids of a run between agreed places."""
        if not raw:
            return _NO_IDS
        ids = self._runs.get(raw)
        if ids is None:
            ids = self._ids_of(raw)
            self.stats["run_bytes"] += len(raw)
            self._runs.put(raw, ids)
        self.stats["runs"] += 1
        return ids

    def encode(self, b: np.ndarray, offsets: np.ndarray, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text) of texts laid end to end in ``b``."""
        texts = len(offsets) - 1
        counts = np.zeros(texts, np.int64)
        if not len(b):
            return np.empty(0, np.int32), counts
        raw, border = b.tobytes(), self.cuts(b, offsets)
        of_text = np.searchsorted(border, offsets).tolist()
        border = border.tolist()
        self.stats["bytes"] += len(b)
        self.stats["chunks"] += len(border) - 1
        out: list[np.ndarray] = []
        for i in range(texts):
            lo, hi = of_text[i], of_text[i + 1]
            if lo == hi:
                continue
            begin, end, before = border[lo], border[hi], len(out)
            if hi == lo + 1:
                # Both ends are the text's own, so all ids are its own too.
                f, _, ids, _, _ = self._chunk(raw[begin:end])
                out.append(ids if f >= 0 else self._run(raw[begin:end]))
            else:
                at = begin
                for k in range(lo, hi):
                    f, l, ids, tf, tl = self._chunk(raw[border[k] : border[k + 1]])
                    if f < 0:  # no agreed place: the run goes on
                        continue
                    if k == lo:
                        tf = 0
                    else:
                        out.append(self._run(raw[at : border[k] + f]))
                    if k == hi - 1:
                        tl, l = len(ids), end - border[k]
                    out.append(ids[tf:tl])
                    at = border[k] + l
                if at < end:
                    out.append(self._run(raw[at:end]))
            counts[i] = sum(map(len, out[before:]))
            if not want_ids:
                out.clear()
        return np.concatenate(out) if out else np.empty(0, np.int32), counts

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode_ordinary(text))


_NO_IDS = np.empty(0, np.int32)


def steps(texts: pa.Array, most: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; NULL is like the empty text."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and off[-1] else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> ChunkEncoder:
    return ChunkEncoder({base64.b64decode(a): int(r) for a, r in map(bytes.split, vocabulary.splitlines()) if a})


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file (a public one, under a megabyte) for all workers, so no executor needs the file."""
    with open(path or f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def ids_mapper(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps batches (doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for batch in batches:
            for i, b, off in steps(batch.column(1)):
                ids, n = enc.encode(b, off)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(n)), lists], ["doc_id", "ids"])

    return run


def counts_mapper(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps batches (text, other columns) to (n_tokens, other columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for batch in batches:
            n = [enc.encode(b, off, want_ids=False)[1] for _, b, off in steps(batch.column(0))]
            names = ["n_tokens", *batch.schema.names[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*n, np.empty(0, np.int64)]).astype(np.int64)), *batch.columns[1:]], names)

    return run
