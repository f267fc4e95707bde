"""References to records that do not exist, are deleted, or arrive later.

Keys are encoded as integers: a hash gives the key range, the rank of a key
among the distinct keys of its range gives the bit. Per range and period the
referenced keys form a compressed bitmap, per range and period the parents
that became available form another; reference AND-NOT all parents of earlier
periods leaves the keys that can be orphans, and only those are decoded and
looked at row by row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.functions.text import month_of
from facetlake.session import cut_lineage, salted_join, written


def pack_bits(offsets: np.ndarray) -> bytes:
    """A compressed bitmap: whichever is smaller of sorted offsets and bits, deflated."""
    offsets = np.unique(np.asarray(offsets, np.uint32))
    bits = np.zeros(int(offsets[-1]) + 1 if len(offsets) else 0, bool)
    bits[offsets] = True
    sparse, dense = b"s" + zlib.compress(offsets.tobytes(), 1), b"d" + zlib.compress(np.packbits(bits).tobytes(), 1)
    return min(sparse, dense, key=len)


def unpack_bits(blob: bytes) -> np.ndarray:
    """The offsets of a bitmap, ascending."""
    body = zlib.decompress(blob[1:])
    return np.frombuffer(body, np.uint32) if blob[:1] == b"s" else np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8))).astype(np.uint32)


@F.pandas_udf(T.BinaryType())
def _bitmap(offsets: pd.Series) -> pd.Series:
    return offsets.map(pack_bits)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(refs: pd.Series, parents: pd.Series) -> pd.Series:
    def one(ref: bytes, have: np.ndarray | None) -> list[int]:
        left = unpack_bits(ref)
        bits = np.zeros(int(left[-1]) + 1 if len(left) else 0, bool)
        bits[left] = True
        for blob in have if have is not None else ():
            p = unpack_bits(blob)
            bits[p[p < len(bits)]] = False
        return np.flatnonzero(bits).tolist()

    return pd.Series([one(r, h) for r, h in zip(refs, parents)])


def orphan_references(refs: DataFrame, parents: DataFrame, ranges: int = 0) -> DataFrame:
    """Every reference without a parent at its time.

    ``refs``: ref_table, ref_field, row_id, domain, ref_key, at_us; ``parents``:
    domain, key, registered_us, removed (boolean). The result adds
    ``orphan_kind`` and ``period`` (yyyy-MM of ``at_us``):

    - 'missing': no parent row has the key; 'deleted': all that have it are removed; 'late': the earliest that is not removed was registered after the reference;
    - NULL or blank keys are no references; NULL keys are no parents; keys compare exactly;
    - a parent without registration time counts as always there; a reference without time is only missing or deleted, in period '';
    - repeated references give one row; empty tables work on either side.

    ``ranges`` is the number of key ranges a domain is cut into; 0 takes one
    per 16,384 distinct keys, so that a bitmap has few thousand bytes.
    """
    r = refs.select("ref_table", "ref_field", "row_id", "domain", "ref_key", F.col("at_us").cast("long").alias("at_us"))
    r = r.where(F.trim("ref_key") != "").withColumn("period", F.coalesce(month_of(F.floor(F.col("at_us") / 1_000_000)), F.lit("")))
    # Everything that is kept of a key's parents, combined before the shuffle.
    never = F.lit(-(2**62)).cast("long")
    p = parents.where(F.col("key").isNotNull()).groupBy("domain", F.col("key").alias("ref_key")).agg(
        F.min(F.when(~F.col("removed"), F.coalesce(F.col("registered_us").cast("long"), never))).alias("live_us")
    )
    wanted = r.groupBy("domain", "ref_key", "period").agg(F.count(F.lit(1)).alias("n"))
    keys = wanted.select("domain", "ref_key", F.lit(False).alias("is_parent"), F.lit(None).cast("long").alias("live_us")).distinct().unionByName(p.withColumn("is_parent", F.lit(True)))
    keys = keys.groupBy("domain", "ref_key").agg(F.max("is_parent").alias("is_parent"), F.min("live_us").alias("live_us"))
    keys = written(keys)
    if not ranges:
        ranges = max(1, -(-keys.count() // 16_384))
    dictionary = cut_lineage(
        keys.withColumn("rng", F.pmod(F.xxhash64("ref_key"), F.lit(ranges)).cast("int"))
        .withColumn("bit", (F.row_number().over(W.partitionBy("domain", "rng").orderBy("ref_key")) - 1).cast("int"))
    )
    coded = wanted.join(dictionary.select("domain", "ref_key", "rng", "bit"), ["domain", "ref_key"])
    ref_maps = coded.groupBy("domain", "rng", "period").agg(F.collect_set("bit").alias("bits")).select("domain", "rng", "period", _bitmap("bits").alias("ref_map"))
    live = dictionary.where("live_us is not null").withColumn("since", F.when(F.col("live_us") == never, F.lit("")).otherwise(month_of(F.floor(F.col("live_us") / 1_000_000))))
    parent_maps = (
        live.groupBy("domain", "rng", "since").agg(F.collect_set("bit").alias("bits"))
        .select("domain", "rng", F.struct("since", _bitmap("bits").alias("map")).alias("m"))
        .groupBy("domain", "rng").agg(F.collect_list("m").alias("maps"))
    )
    # Parents of an earlier period are there for certain; those of the same one are left to the exact comparison.
    # A reference without time is measured against all of them.
    earlier = F.transform(F.filter("maps", lambda m: (m["since"] < F.col("period")) | (F.col("period") == "")), lambda m: m["map"])
    left = (
        ref_maps.join(parent_maps, ["domain", "rng"], "left")
        .select("domain", "rng", "period", F.explode(_and_not("ref_map", F.coalesce(earlier, F.array().cast("array<binary>")))).alias("bit"))
    )
    suspects = left.join(dictionary, ["domain", "rng", "bit"]).select("domain", "period", "ref_key", "is_parent", "live_us")
    rows = salted_join(r, suspects, ["domain", "ref_key", "period"], F.struct("ref_table", "ref_field", "row_id"))
    kind = F.when(~F.col("is_parent"), "missing").when(F.col("live_us").isNull(), "deleted").when(F.col("live_us") > F.col("at_us"), "late")
    return rows.select("ref_table", "ref_field", "row_id", "ref_key", kind.alias("orphan_kind"), "period").where("orphan_kind is not null").distinct()
