"""Point clouds and meshes as index spaces: element counts, bounds and reference system, never geometry.

Files are opened where a worker runs and read in pieces: a header is enough
for a point cloud, vertices are only reduced to their bounds.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from facetlake.schema import StoreError

PARTS = "path string, part_path string, element_kind int, element_count long, minx double, miny double, minz double, maxx double, maxy double, maxz double, crs_wkt string"
_PIECE = 1 << 20
# Media types and indexing profiles by suffix.
MEDIA_TYPES = {".las": "application/vnd.las", ".laz": "application/vnd.laszip", ".ply": "model/ply", ".obj": "model/obj", ".stl": "model/stl", ".gml": "application/gml+xml"}
_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def epsg_of_wkt(wkt: str | None) -> int | None:
    """The code of the last EPSG authority or id in a reference system's text, which is that of the whole."""
    found = re.findall(r'(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?', wkt or "", re.I)
    return int(found[-1]) if found else None


def _wkt_of_keys(keys: bytes, path: str) -> str:
    """A reference to the EPSG code of a GeoTIFF key directory; a system that only its parameters describe cannot be read, which is an error and not "none"."""
    values = struct.unpack(f"<{len(keys) // 2}H", keys[: len(keys) // 2 * 2])
    known = {values[i]: values[i + 3] for i in range(4, len(values) - 3, 4) if values[i + 1] == 0}
    # The keys of the projected and the geographic system; 32767 stands for one of its own.
    for key in (3072, 2048):
        if known.get(key) not in (None, 0, 32767):
            return f'ID["EPSG",{known[key]}]'
    raise StoreError(f"the reference system of {path} cannot be read")


def read_las(path: str) -> list[tuple]:
    """The one part of a LAS file from its header and its variable records."""
    with open(path, "rb") as f:
        head = f.read(375)
        if head[:4] != b"LASF":
            raise StoreError(f"no LAS file: {path}")
        minor, header_size = head[25], struct.unpack_from("<H", head, 94)[0]
        records = struct.unpack_from("<I", head, 100)[0]
        count = struct.unpack_from("<I", head, 107)[0]
        if minor >= 4 and len(head) >= 255:
            count = struct.unpack_from("<Q", head, 247)[0] or count
        maxx, minx, maxy, miny, maxz, minz = struct.unpack_from("<6d", head, 179)
        # Variable records follow the header; since 1.4 there may be extended ones at the end of the file.
        places = [(header_size, records, 54, "<H")]
        if minor >= 4 and len(head) >= 247:
            places.append((*struct.unpack_from("<QI", head, 235), 60, "<Q"))
        wkt = keys = None
        for start, many, size, length in places:
            f.seek(start)
            for _ in range(many):
                h = f.read(size)
                if len(h) < size:
                    raise StoreError(f"the records of {path} are cut off")
                user, record, n = h[2:18].rstrip(b"\0"), struct.unpack_from("<H", h, 18)[0], struct.unpack_from(length, h, 20)[0]
                body = f.read(n)
                if user == b"LASF_Projection" and record == 2112:
                    wkt = body.rstrip(b"\0").decode("utf-8", "replace") or wkt
                elif user == b"LASF_Projection" and record == 34735:
                    keys = body
    if wkt is None and keys is not None:
        wkt = _wkt_of_keys(keys, path)
    bounds = (minx, miny, minz, maxx, maxy, maxz) if count else (None,) * 6
    return [("points/all", 2, count, *bounds, wkt)]


class _Bounds:
    def __init__(self) -> None:
        self.lo, self.hi = np.full(3, np.inf), np.full(3, -np.inf)

    def add(self, xyz: np.ndarray) -> None:
        xyz = xyz[np.isfinite(xyz).all(axis=1)]
        if len(xyz):
            self.lo, self.hi = np.minimum(self.lo, xyz.min(axis=0)), np.maximum(self.hi, xyz.max(axis=0))

    def values(self) -> tuple:
        return (*map(float, self.lo), *map(float, self.hi)) if np.isfinite(self.lo).all() else (None,) * 6


def read_ply(path: str) -> list[tuple]:
    """The one part of a PLY file, ascii or binary of either order; vertices are read in pieces."""
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise StoreError(f"no PLY file: {path}")
        form, elements = "", []
        while (line := f.readline().decode("ascii", "replace").split()) != ["end_header"]:
            if not line:
                raise StoreError(f"PLY header ends early: {path}")
            if line[0] == "format":
                form = line[1]
            elif line[0] == "element":
                elements.append((line[1], int(line[2]), []))
            elif line[0] == "property":
                elements[-1][2].append(line[1:])
        faces = next((n for name, n, _ in elements if name == "face"), 0)
        bounds = _Bounds()
        for name, n, props in elements:
            if name != "vertex":
                break  # vertices come first in every file that has faces on them
            if any(p[0] == "list" for p in props):
                raise StoreError(f"vertices with lists: {path}")
            names = [p[-1] for p in props]
            if form == "ascii":
                at = [names.index(c) for c in "xyz"]
                for lo in range(0, n, _PIECE):
                    rows = [f.readline().split() for _ in range(min(_PIECE, n - lo))]
                    if any(len(r) < len(names) for r in rows):
                        raise StoreError(f"PLY ends early: {path}")
                    bounds.add(np.array([[float(r[i]) for i in at] for r in rows]))
            else:
                order = "<" if "little" in form else ">"
                row = np.dtype([(p[-1], order + _PLY[p[0]]) for p in props])
                for lo in range(0, n, _PIECE):
                    k = min(_PIECE, n - lo)
                    data = np.frombuffer(f.read(k * row.itemsize), row)
                    if len(data) < k:
                        raise StoreError(f"PLY ends early: {path}")
                    bounds.add(np.stack([data[c].astype(float) for c in "xyz"], axis=1))
    return [("geometry/0:default", 1, faces, *bounds.values(), None)] if faces else []


def read_obj(path: str, single: bool = False) -> list[tuple]:
    """A part per group of an OBJ file that has faces, counted as triangles of a fan; ``single`` refuses several groups."""
    vertices = array("d")
    groups: list[tuple[str, int, _Bounds]] = []
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            w = line.split()
            if not w:
                continue
            if w[0] == "v":
                vertices.extend(float(x) for x in w[1:4])
            elif w[0] in ("o", "g"):
                groups.append((" ".join(w[1:]) or "default", 0, _Bounds()))
            elif w[0] == "f":
                if not groups:
                    groups.append(("default", 0, _Bounds()))
                name, n, b = groups[-1]
                at = [int(x.split("/")[0]) for x in w[1:]]
                first = [3 * (i - 1) if i > 0 else len(vertices) + 3 * i for i in at]
                b.add(np.array([vertices[i : i + 3] for i in first]))
                groups[-1] = (name, n + len(at) - 2, b)
    if single and sum(1 for _, n, _ in groups if n) > 1:
        raise StoreError(f"more than one group: {path}")
    return [(f"geometry/{i}:{name}", 1, n, *b.values(), None) for i, (name, n, b) in enumerate(groups) if n]


def read_streamed_obj(path: str) -> list[tuple]:
    """The one part of a large OBJ file: faces are counted and bounds run over all vertices, of which a piece is held at a time; several groups with faces are refused."""
    bounds, faces, name, found, piece = _Bounds(), 0, "default", {}, array("d")
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            w = line.split()
            if not w:
                continue
            if w[0] == "v":
                piece.extend(float(x) for x in w[1:4])
                if len(piece) >= 3 * _PIECE:
                    bounds.add(np.array(piece).reshape(-1, 3))
                    piece = array("d")
            elif w[0] in ("o", "g"):
                name = " ".join(w[1:]) or "default"
            elif w[0] == "f":
                faces += len(w) - 3
                found.setdefault(name, len(found))
    bounds.add(np.array(piece).reshape(-1, 3))
    if len(found) > 1:
        raise StoreError(f"more than one group in a file that is read as a stream: {path}")
    return [(f"geometry/0:{n}", 1, faces, *bounds.values(), None) for n in found]


#: OBJ files of more bytes are read as a stream.
STREAM_BYTES = 256 << 20


def read_any_obj(path: str) -> list[tuple]:
    return read_streamed_obj(path) if os.path.getsize(path) > STREAM_BYTES else read_obj(path)


def read_stl(path: str) -> list[tuple]:
    """The one part of a binary or ascii STL file."""
    bounds = _Bounds()
    with open(path, "rb") as f:
        head = f.read(84)
        n = struct.unpack_from("<I", head, 80)[0] if len(head) == 84 else 0
        f.seek(0, 2)
        if f.tell() == 84 + 50 * n and n:
            f.seek(84)
            row = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
            for lo in range(0, n, _PIECE):
                bounds.add(np.frombuffer(f.read(min(_PIECE, n - lo) * 50), row)["v"].reshape(-1, 3).astype(float))
        else:
            f.seek(0)
            n, rows = 0, []
            for line in f:
                w = line.split()
                if w[:1] == [b"vertex"]:
                    rows.append([float(x) for x in w[1:4]])
                n += w[:1] == [b"facet"]
            bounds.add(np.array(rows).reshape(-1, 3))
    return [("geometry/0:default", 1, n, *bounds.values(), None)] if n else []


READERS = {".las": read_las, ".laz": read_las, ".ply": read_ply, ".obj": read_any_obj, ".stl": read_stl}


def suffix_of(path: str) -> str:
    return path[path.rfind(".") :].lower() if "." in path.rpartition("/")[2] else ""


def read_parts(spark: SparkSession, files: list[str]) -> DataFrame:
    """The index spaces of point clouds and meshes, a file a task; scene formats that flatten parts (glTF, GLB) are refused."""
    for p in files:
        if suffix_of(p) not in READERS:
            raise StoreError(f"no source for {p}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                yield pd.DataFrame([(p, *part) for part in READERS[suffix_of(p)](p)], columns=[c.split()[0] for c in PARTS.split(", ")])

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files))).mapInPandas(run, PARTS)


def given_parts(spark: SparkSession, path: str, facts: list[dict]) -> DataFrame:
    """Parts stated by the caller: name, face_count, bounds (six numbers or None); names are unique, bounds finite and ordered."""
    names = [f["name"] for f in facts]
    if len(set(names)) != len(names):
        raise StoreError("geometry names repeat")
    rows = []
    for i, f in enumerate(facts):
        b = f.get("bounds")
        if b is not None and (len(b) != 6 or not all(np.isfinite(b)) or any(b[k] > b[k + 3] for k in range(3))):
            raise StoreError(f"bounds of {f['name']!r} are no box")
        if f["face_count"] > 0:
            rows.append((path, f"geometry/{i}:{f['name']}", 1, int(f["face_count"]), *(map(float, b) if b else (None,) * 6), f.get("crs_wkt")))
    return spark.createDataFrame(rows, PARTS)
