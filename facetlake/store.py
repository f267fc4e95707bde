"""A store: a folder of Parquet tables under versioned snapshots and one manifest.

A commit writes the changed tables as new versions and then replaces the
manifest in one rename, so readers see all of a change or none of it. Files
are reached through the file system API of the session, so a store may lie
wherever the cluster's data lie.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.schema import BLOCK_SIZE, TABLES, StoreError

PROFILE = "1.0"
#: Tables written in the order in which they are read.
CLUSTERED = {"membership_block": ["asset_part_id", "block_start"], "value_block": ["asset_part_id", "block_start"], "path_block": ["assessment_id", "segment_ordinal"]}


class Store:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self._staged: dict[str, DataFrame] = {}
        self._stamped: dict = {}
        self._depth = 0

    # --- files

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _write_manifest(self, manifest: dict) -> None:
        fs, tmp = self._fs(self.spark, f"{self.path}/manifest-{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        version = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{manifest['version']:010d}.json")
        # Two writers cannot both make the same version: rename does not replace.
        if fs.exists(version) or not fs.rename(tmp, version):
            fs.delete(tmp, False)
            raise StoreError("another writer committed first")

    @classmethod
    def create(cls, spark: SparkSession, path: str, package_iri: str | None = None, block_size: int = BLOCK_SIZE, srs_id: int | None = None) -> Store:
        """An empty store; a folder that already holds one is refused."""
        fs, p = cls._fs(spark, path)
        if fs.exists(p) and len(fs.listStatus(p)):
            raise StoreError(f"not empty: {path}")
        iri = package_iri or f"urn:uuid:{uuid.uuid4()}"
        if not iri.strip() or ":" not in iri:
            raise StoreError(f"no package IRI: {iri!r}")
        store = cls(spark, path, {"profile": PROFILE, "package_iri": iri, "block_size": block_size, "srs_id": srs_id, "version": -1, "tables": {}})
        fs.mkdirs(p)
        with store.transaction():
            for name, schema in TABLES.items():
                store.stage(name, spark.createDataFrame([], schema))
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """The latest committed version; another profile than this one is refused."""
        fs, p = cls._fs(spark, path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []
        if not names:
            raise FileNotFoundError(path)
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{names[-1]}"))
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        manifest = json.loads(text)
        if manifest["profile"] != PROFILE:
            raise StoreError(f"profile {manifest['profile']} is not {PROFILE}")
        return cls(spark, path, manifest)

    def close(self) -> None:
        """Nothing is held open."""

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def problems(self) -> list[tuple[str, str]]:
        """(severity, code) of what is wrong with the manifest itself."""
        out = []
        if self.manifest.get("profile") != PROFILE:
            out.append(("error", "MISSING_PROFILE"))
        iri = self.manifest.get("package_iri") or ""
        if not iri.strip() or ":" not in iri:
            out.append(("error", "INVALID_PACKAGE_IRI"))
        return out

    def header(self) -> DataFrame:
        """``problems`` as the table ``header`` of the validation."""
        return self.spark.createDataFrame([(code, self.path, "") for _, code in self.problems()], "code string, row_id string, details string")

    # --- reading

    def table(self, name: str) -> DataFrame:
        if name in self._staged:
            return self._staged[name]
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{self.manifest['tables'][name]}")

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}

    # --- writing

    def stage(self, name: str, df: DataFrame) -> None:
        """The next content of a table; seen by this store at once, by others after the commit."""
        if not self._depth:
            raise StoreError("no transaction is open")
        schema = T._parse_datatype_string(TABLES[name])
        self._staged[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])

    def restamp(self, **facts) -> None:
        """Manifest facts (srs_id) that change with the commit of the open transaction, and not before."""
        if not self._depth:
            raise StoreError("no transaction is open")
        self._stamped |= facts

    @contextmanager
    def transaction(self):
        """All or nothing; an inner transaction belongs to the outer one."""
        self._depth += 1
        try:
            yield self
        except BaseException:
            self._staged, self._stamped = {}, {}
            raise
        else:
            if self._depth == 1 and self._staged:
                self._commit()
        finally:
            self._depth -= 1

    def _commit(self) -> None:
        version = self.manifest["version"] + 1
        places = dict(self.manifest["tables"])
        for name, df in self._staged.items():
            places[name] = f"{name}/v={version}-{uuid.uuid4().hex[:8]}"
            order = CLUSTERED.get(name)
            rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
            rows.write.parquet(f"{self.path}/{places[name]}")
        manifest = {**self.manifest, **self._stamped, "version": version, "tables": places}
        self._write_manifest(manifest)
        self.manifest, self._staged, self._stamped = manifest, {}, {}

    def log_edit(self, operation: str, target_table: str, target_id: int | None = None, details: dict | None = None) -> None:
        row = self.spark.createDataFrame([(None, operation, target_table, target_id, json.dumps(details) if details is not None else None)], "edit_id long, operation string, target_table string, target_id long, details_json string")
        self.stage("edit_log", self.table("edit_log").unionByName(row.withColumn("edit_id", F.expr("unix_micros(current_timestamp())")).withColumn("created_at", utc_now())))


def utc_now():
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
