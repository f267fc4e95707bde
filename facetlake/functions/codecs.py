"""Payload codecs for exchange with other stores: portable roaring bitmaps, deflated values and sequences, bounding boxes.

Inside this engine payloads are arrays; these functions are used only where
bytes come in or go out, as Arrow functions over whole batches.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.schema import DTYPES, MAX_INDEX, StoreError

#: A payload never inflates beyond this many bytes.
MOST_BYTES = 256 << 20
# Fixed values of the portable roaring format.
_NO_RUNS, _WITH_RUNS, _ARRAY_MOST = 12346, 12347, 4096


def index_array(values) -> np.ndarray:
    """Sorted distinct unsigned 32-bit indices; what is no whole number in range raises."""
    a = np.asarray(list(values) if not isinstance(values, np.ndarray) else values)
    if a.size and a.dtype.kind not in "iu":
        if a.dtype.kind != "f" or not np.all(np.isfinite(a)) or np.any(a != np.floor(a)):
            raise StoreError("element indices are whole numbers")
    if a.size and (a.min() < 0 or a.max() > MAX_INDEX):
        raise StoreError("element index out of range")
    return np.unique(a.astype(np.int64)).astype(np.uint32)


def sequence_array(values) -> np.ndarray:
    """As ``index_array``, in the given order and with repeats."""
    a = np.asarray(values, np.int64)
    index_array(a)
    return a.astype(np.uint32)


def roaring_encode(values) -> bytes:
    """A set of 32-bit numbers in the portable roaring format, without run containers."""
    a = index_array(values)
    keys, first = np.unique(a >> 16, return_index=True)
    groups = np.split((a & 0xFFFF).astype("<u2"), first[1:]) if len(a) else []
    head, body, sizes = bytearray(struct.pack("<II", _NO_RUNS, len(groups))), [], []
    for key, low in zip(keys.tolist(), groups):
        head += struct.pack("<HH", key, len(low) - 1)
        if len(low) <= _ARRAY_MOST:
            body.append(low.tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            body.append(np.packbits(bits, bitorder="little").tobytes())
        sizes.append(len(body[-1]))
    at = len(head) + 4 * len(groups)
    for n in sizes:
        head += struct.pack("<I", at)
        at += n
    return bytes(head) + b"".join(body)


def roaring_decode(blob: bytes) -> np.ndarray:
    """The numbers of a portable roaring bitmap, ascending; any container kind."""
    try:
        (cookie,) = struct.unpack_from("<I", blob, 0)
        if cookie & 0xFFFF == _WITH_RUNS:
            n, at = (cookie >> 16) + 1, 4 + ((cookie >> 16) + 8) // 8
            runs = np.unpackbits(np.frombuffer(blob, np.uint8, at - 4, 4), bitorder="little")[:n]
        elif cookie == _NO_RUNS:
            (n,), at = struct.unpack_from("<I", blob, 4), 8
            runs = np.zeros(n, np.uint8)
        else:
            raise StoreError("no roaring bitmap")
        keys = np.frombuffer(blob, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
        at += 4 * n
        if cookie == _NO_RUNS or n >= 4:
            at += 4 * n  # the offsets repeat what the sizes say
        out = []
        for (key, less), is_run in zip(keys.tolist(), runs.tolist()):
            if is_run:
                (m,) = struct.unpack_from("<H", blob, at)
                pairs = np.frombuffer(blob, "<u2", 2 * m, at + 2).reshape(m, 2).astype(np.int64)
                low = np.concatenate([np.arange(a, a + k + 1) for a, k in pairs.tolist()]) if m else np.empty(0, np.int64)
                at += 2 + 4 * m
            elif less + 1 <= _ARRAY_MOST:
                low = np.frombuffer(blob, "<u2", less + 1, at).astype(np.int64)
                at += 2 * (less + 1)
            else:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, 8192, at), bitorder="little"))
                at += 8192
            out.append(low + (key << 16))
    except (struct.error, ValueError) as e:
        raise StoreError("corrupt bitmap") from e
    return np.concatenate(out).astype(np.uint32) if out else np.empty(0, np.uint32)


def inflate(blob: bytes, most: int = MOST_BYTES) -> bytes:
    """A deflated payload, whole and within bounds; a cut-off or oversized one raises."""
    z = zlib.decompressobj()
    try:
        data = z.decompress(blob, most + 1)
    except zlib.error as e:
        raise StoreError("corrupt payload") from e
    if len(data) > most:
        raise StoreError("payload too large")
    if not z.eof:
        raise StoreError("payload cut off")
    return data


def path_encode(values) -> bytes:
    return zlib.compress(sequence_array(values).astype("<u4").tobytes())


def path_decode(blob: bytes) -> np.ndarray:
    data = inflate(blob)
    if len(data) % 4:
        raise StoreError("corrupt path")
    return np.frombuffer(data, "<u4")


def value_encode(values, dtype: str) -> bytes:
    if dtype not in DTYPES:
        raise StoreError(f"no value dtype: {dtype!r}")
    return zlib.compress(np.asarray(values).astype("<" + dtype).tobytes())


def value_decode(blob: bytes, dtype: str, count: int | None = None) -> np.ndarray:
    if dtype not in DTYPES:
        raise StoreError(f"no value dtype: {dtype!r}")
    data = inflate(blob)
    if len(data) % np.dtype(dtype).itemsize:
        raise StoreError("corrupt values")
    out = np.frombuffer(data, "<" + dtype)
    if count is not None and len(out) != count:
        raise StoreError("corrupt values")
    return out


def bbox_encode(minx: float, miny: float, maxx: float, maxy: float, srs_id: int) -> bytes:
    """A rectangle as a GeoPackage geometry: header with envelope, then a polygon ring."""
    ring = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    head = b"GP" + struct.pack("<BBi4d", 0, 0b00000011, srs_id, minx, maxx, miny, maxy)
    return head + struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<2d", *p) for p in ring)


def bbox_decode(blob: bytes) -> tuple[float, float, float, float, int]:
    """(minx, miny, maxx, maxy, srs id) of a GeoPackage geometry's envelope."""
    if blob[:2] != b"GP" or len(blob) < 40 or (blob[3] >> 1) & 7 != 1:
        raise StoreError("no envelope")
    order = "<" if blob[3] & 1 else ">"
    srs, minx, maxx, miny, maxy = struct.unpack_from(order + "i4d", blob, 4)
    return minx, miny, maxx, maxy, srs


@F.pandas_udf(T.BinaryType())
def roaring_of(offsets: pd.Series) -> pd.Series:
    return offsets.map(roaring_encode, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def offsets_of(payload: pd.Series) -> pd.Series:
    """Offsets of a bitmap; NULL for a corrupt one, which validation reports."""

    def one(blob: bytes) -> np.ndarray | None:
        try:
            return roaring_decode(blob).astype(np.int32)
        except StoreError:
            return None

    return payload.map(one, na_action="ignore")
