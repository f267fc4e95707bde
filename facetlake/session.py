"""Session helpers: local sessions for tests and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 4, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("facetlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        # Only a session of one process (a test) gets a folder of its own; on a cluster it would be the driver's alone.
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="facetlake-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its history.

    The files lie in the folder all executors share, so a lost executor costs
    a re-read, not a wrong or failed result.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the application ends."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, as a compressed columnar table in the same folder, for tables that are read in parts.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_from: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join many ``left`` rows with at most one ``right`` row per key, a hot key spread over ``salts`` tasks.

    Every right row is sent once per salt, so no task gets all rows of one
    key whatever its share. ``right`` must be unique on ``keys``.
    """
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
