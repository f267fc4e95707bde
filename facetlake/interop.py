"""Exchange with GeoPackage files: a header and catalogue that GIS tools open, tables as attribute layers."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.functions.codecs import bbox_decode, bbox_encode, offsets_of, path_decode, path_encode, roaring_encode, value_decode, value_encode
from facetlake.functions.crs import wkt_for_epsg
from facetlake.operators.catalog import asset_extents
from facetlake.schema import TABLES, StoreError
from facetlake.store import Store

# Fixed values of the public GeoPackage standard.
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300
_SQL = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "boolean": "INTEGER", "binary": "BLOB", "array<int>": "BLOB", "array<bigint>": "BLOB", "array<double>": "BLOB"}
_CATALOGUE = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
"""


def _payload(table: str, row: dict) -> dict:
    if table == "membership_block" and row["offsets"] is not None:
        row["offsets"] = roaring_encode(row["offsets"])
    if table == "value_block" and row["values"] is not None:
        row["values"] = value_encode(row["values"], row["value_dtype"])
    if table == "path_block" and row["indices"] is not None:
        row["indices"] = path_encode(row["indices"])
    return row


def export_geopackage(store: Store, path: str, srs_id: int = 0, definition: str | None = None) -> None:
    """Writes a new file; an existing one is refused. Rows stream through the driver one at a time. A system whose text does not follow from its code needs a ``definition``."""
    if srs_id not in (-1, 0) and definition is None and (definition := wkt_for_epsg(srs_id)) is None:
        raise StoreError(f"the definition of reference system {srs_id} is needed")
    conn = sqlite3.connect(f"file:{path}?mode=rwc", uri=True)
    try:
        if conn.execute("SELECT count(*) FROM sqlite_master").fetchone()[0]:
            raise StoreError(f"not empty: {path}")
        conn.executescript(f"PRAGMA application_id = {APPLICATION_ID}; PRAGMA user_version = {USER_VERSION};" + _CATALOGUE)
        srs = [("Undefined Cartesian", -1, "NONE", -1, "undefined"), ("Undefined geographic", 0, "NONE", 0, "undefined"), ("WGS 84", 4326, "EPSG", 4326, wkt_for_epsg(4326))]
        if srs_id not in (-1, 0, 4326):
            srs.append((f"EPSG:{srs_id}", srs_id, "EPSG", srs_id, definition))
        conn.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", srs)
        with conn:
            for name in TABLES:
                df = store.table(name)
                cols = ", ".join(f'"{c}" {_SQL[t]}' for c, t in df.dtypes)
                conn.execute(f"CREATE TABLE {name} (OGC_FID INTEGER PRIMARY KEY, {cols})")
                marks = ", ".join("?" * len(df.columns))
                conn.executemany(f"INSERT INTO {name} ({', '.join(chr(34) + c + chr(34) for c in df.columns)}) VALUES ({marks})", (tuple(_payload(name, r.asDict()).values()) for r in df.toLocalIterator()))
                conn.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier) VALUES (?, 'attributes', ?)", (name, name))
                conn.execute("INSERT INTO gpkg_extensions VALUES (?, NULL, 'facetlake', 'README.md', 'read-write')", (name,))
            conn.execute("CREATE TABLE asset_extent (asset_id INTEGER PRIMARY KEY, geom BLOB)")
            boxes = ((r["asset_id"], bbox_encode(r["minx"], r["miny"], r["maxx"], r["maxy"], srs_id)) for r in asset_extents(store.table("asset_part")).toLocalIterator())
            conn.executemany("INSERT INTO asset_extent VALUES (?, ?)", boxes)
            conn.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES ('asset_extent', 'features', 'asset_extent', ?)", (srs_id,))
            conn.execute("INSERT INTO gpkg_geometry_columns VALUES ('asset_extent', 'geom', 'POLYGON', ?, 0, 0)", (srs_id,))
    finally:
        conn.close()


def header_problems(path: str) -> list[tuple[str, str]]:
    """(severity, code) of what a file's header and catalogue lack."""
    conn = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        out = []
        if conn.execute("PRAGMA application_id").fetchone()[0] != APPLICATION_ID:
            out.append(("error", "INVALID_GPKG_APPLICATION_ID"))
        if conn.execute("PRAGMA user_version").fetchone()[0] < USER_VERSION:
            out.append(("warning", "OLD_GPKG_USER_VERSION"))
        names = {r[0] for r in conn.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        missing = {"gpkg_spatial_ref_sys", "gpkg_contents", "gpkg_extensions"} - names
        out += [("error", "MISSING_GPKG_TABLE")] * len(missing)
        if "gpkg_spatial_ref_sys" in names:
            have = {r[0] for r in conn.execute("SELECT srs_id FROM gpkg_spatial_ref_sys")}
            out += [("error", "MISSING_GPKG_SRS")] * len({-1, 0, 4326} - have)
        if "gpkg_extensions" in names:
            registered = {r[0] for r in conn.execute("SELECT table_name FROM gpkg_extensions")}
            out += [("warning", "MISSING_EXTENSION_ROW")] * len(set(TABLES) - registered)
        if "gpkg_contents" in names:
            layers = {r[0] for r in conn.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'attributes'")}
            out += [("warning", "MISSING_GIS_ATTRIBUTE_LAYER")] * len(set(TABLES) - layers)
            feature = {r[0]: r[1] for r in conn.execute("SELECT table_name, srs_id FROM gpkg_contents WHERE data_type = 'features'")}
            geom = {r[0]: r[1] for r in conn.execute("SELECT table_name, srs_id FROM gpkg_geometry_columns")} if "gpkg_geometry_columns" in names else {}
            if not feature and not geom:
                out.append(("warning", "MISSING_GIS_FEATURES_LAYER"))
            out += [("error", "INCONSISTENT_FEATURES_LAYER")] * len(set(feature) ^ set(geom))
            out += [("error", "FEATURES_LAYER_SRS_MISMATCH") for n in set(feature) & set(geom) if feature[n] != geom[n]]
        return out
    finally:
        conn.close()


def import_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One exported table, payloads decoded by workers; a corrupt payload is NULL, which validation reports."""
    schema = T._parse_datatype_string(TABLES[table])
    raw = T.StructType([T.StructField(f.name, T.BinaryType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema.fields])
    conn = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        cursor = conn.execute(f"SELECT {', '.join(chr(34) + f.name + chr(34) for f in schema.fields)} FROM {table}")
        flags = [isinstance(f.dataType, T.BooleanType) for f in schema.fields]
        rows = [tuple(bool(v) if b and v is not None else v for v, b in zip(r, flags)) for r in cursor]
    finally:
        conn.close()
    df = spark.createDataFrame(rows, raw)
    if table == "membership_block":
        return df.withColumn("offsets", offsets_of("offsets"))
    if table == "value_block":
        return df.withColumn("values", _values_of("values", "value_dtype"))
    return df.withColumn("indices", _indices_of("indices")) if table == "path_block" else df


def _safe(decode):
    def run(*args):
        try:
            return None if args[0] is None else decode(*args)
        except StoreError:
            return None

    return run


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _values_of(payload: pd.Series, dtype: pd.Series) -> pd.Series:
    one = _safe(lambda b, d: value_decode(b, d).astype(float))
    return pd.Series([one(b, d) for b, d in zip(payload, dtype)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _indices_of(payload: pd.Series) -> pd.Series:
    return payload.map(_safe(lambda b: path_decode(b).astype("int64")))


def extent_problems(blobs: dict[int, bytes], srs_id: int) -> list[tuple[int, str]]:
    """(asset_id, code) of extents that do not decode or lie in another reference system."""
    out = []
    for asset, blob in blobs.items():
        try:
            if bbox_decode(blob)[4] != srs_id:
                out.append((asset, "EXTENT_SRS_MISMATCH"))
        except StoreError:
            out.append((asset, "CORRUPT_EXTENT_BLOB"))
    return out


def header_table(spark: SparkSession, path: str) -> DataFrame:
    """What a file's header, catalogue and extents lack, as the table ``header`` of ``validate.run``: code, row_id, details. Extents are one row an asset."""
    conn = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        names = {r[0] for r in conn.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        srs = [r[0] for r in conn.execute("SELECT srs_id FROM gpkg_geometry_columns WHERE table_name = 'asset_extent'")] if "gpkg_geometry_columns" in names else []
        blobs = dict(conn.execute("SELECT asset_id, geom FROM asset_extent")) if "asset_extent" in names else {}
    finally:
        conn.close()
    rows = [(code, path, "") for _, code in header_problems(path)] + [(code, str(asset), "") for asset, code in (extent_problems(blobs, srs[0]) if srs else [])]
    return spark.createDataFrame(rows, "code string, row_id string, details string")
