"""Dense value fields: one value per element, in chunks with the range of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetlake.schema import DTYPE_RANGES, DTYPES, FLOAT_LIMITS, VALUE_CHUNK, StoreError, value_dtype

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t, "==": lambda v, t: v == t, "!=": lambda v, t: v != t,
}


def checked_cast(values: DataFrame, dtype: str, column: str = "v") -> DataFrame:
    """``values`` with the column in the type of ``dtype``; raises where the cast would wrap, cut off or overflow."""
    tag, v = value_dtype(dtype), F.col(column)
    if tag in DTYPE_RANGES:
        lo, hi = DTYPE_RANGES[tag]
        bad = v.isNull() | F.isnan(v) | (v < lo) | (v > hi) | (v != F.floor(v))
    else:
        bad = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (F.abs(v) > FLOAT_LIMITS[tag])
    cast = F.coalesce(v, F.lit(float("nan"))).cast(DTYPES[tag]) if tag not in DTYPE_RANGES else v.cast(DTYPES[tag])
    return values.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"no {tag} value: "), F.coalesce(v.cast("string"), F.lit("NULL")))).cast(DTYPES[tag])).otherwise(cast))


def chunk_values(values: DataFrame, keys: list[str], chunk: int = VALUE_CHUNK) -> DataFrame:
    """Chunks of (keys, element_index, v): block_start, element_count, value_min, value_max, values in order. NaN is counted, never in the range."""
    at = F.col("element_index") - F.pmod(F.col("element_index"), F.lit(chunk))
    solid = F.when(~F.isnan("v"), F.col("v"))
    return values.groupBy(*keys, at.alias("block_start")).agg(
        F.count(F.lit(1)).alias("element_count"), F.min(solid).alias("value_min"), F.max(solid).alias("value_max"),
        F.array_sort(F.collect_list(F.struct("element_index", "v")))["v"].alias("values"),
    )


def may_match(op: str, threshold: Column) -> Column:
    """Whether a chunk's range leaves room for a match; false for chunks of NaN only."""
    lo, hi = F.col("value_min"), F.col("value_max")
    room = {">": hi > threshold, ">=": hi >= threshold, "<": lo < threshold, "<=": lo <= threshold, "==": (lo <= threshold) & (hi >= threshold), "!=": ~((lo == hi) & (lo == threshold))}
    if op not in room:
        raise StoreError(f"no comparison: {op!r}")
    return lo.isNotNull() & room[op]


def elements_where(chunks: DataFrame, predicate: str | Callable[[Column], Column], threshold: float | None = None, dtype: str = "f8", keys: list[str] | None = None) -> DataFrame:
    """Elements (keys, element_index) whose value meets a comparison or a Column predicate; NaN never does.

    The threshold is taken in the field's own type. Chunks whose range rules
    a match out are dropped before they are opened.
    """
    keys = keys or []
    if callable(predicate):
        opened, test = chunks, predicate
    else:
        t = F.lit(float(threshold)).cast(DTYPES[value_dtype(dtype)]) if value_dtype(dtype) not in DTYPE_RANGES else F.lit(float(threshold))
        opened, test = chunks.where(may_match(predicate, t)), lambda v: OPERATORS[predicate](v, t)
    rows = opened.select(*keys, "block_start", F.posexplode("values").alias("o", "v"))
    return rows.where(~F.isnan("v") & F.coalesce(test(F.col("v")), F.lit(False))).select(*keys, (F.col("block_start") + F.col("o")).alias("element_index"))


def field_values(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, element_index, v) of all chunks."""
    return chunks.select(*keys, "block_start", F.posexplode("values").alias("o", "v")).select(*keys, (F.col("block_start") + F.col("o")).alias("element_index"), "v")


def field_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum, maximum, count and chunk count of each field, from the chunk ranges alone."""
    return chunks.groupBy(*keys).agg(
        F.min("value_min").alias("min_value"), F.max("value_max").alias("max_value"), F.sum("element_count").cast("long").alias("value_count"), F.count(F.lit(1)).alias("block_count")
    )


def field_problems(chunks: DataFrame, parts: DataFrame, keys: list[str], part: str = "asset_part_id") -> DataFrame:
    """(keys, problem) of fields that have overlaps, gaps or do not cover their part; readers refuse such fields."""
    w = W.partitionBy(*keys).orderBy("block_start")
    ends = chunks.select(*keys, part, "block_start", (F.col("block_start") + F.col("element_count")).alias("stop"))
    ends = ends.withColumn("reached", F.coalesce(F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = ends.groupBy(*keys, part).agg(F.max("stop").alias("stop"), F.max(F.col("block_start") < F.col("reached")).alias("overlap"), F.max(F.col("block_start") > F.col("reached")).alias("gap"))
    whole = whole.join(parts.select(part, "element_count"), part, "left")
    problem = F.when(F.col("overlap"), "overlap").when(F.col("gap"), "gap").when(~(F.col("stop") == F.col("element_count")), "partial")
    return whole.select(*keys, problem.alias("problem")).where("problem is not null")


def whole_field(chunks: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks`` (with value_dtype) if every field is of one dtype and covers its part without gap or overlap; raises else.

    No chunks at all are no field, which raises too.
    """
    if chunks.isEmpty():
        raise StoreError("no value field")
    mixed = chunks.groupBy(*keys).agg(F.count_distinct("value_dtype").alias("k")).where("k > 1").select(*keys).take(1)
    if mixed:
        raise StoreError(f"a field of several dtypes: {mixed[0].asDict()}")
    bad = field_problems(chunks, parts, keys).take(1)
    if bad:
        raise StoreError(f"no whole field: {bad[0].asDict()}")
    return chunks
