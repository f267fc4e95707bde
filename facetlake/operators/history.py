"""Versions of changing attributes with the period each was valid.

Event-sourced: every restatement is an event, each attribute gets its own
change log, and versions come from splitting time at the union of all logged
boundaries and dropping boundaries at which nothing visible changes.

A hot key never lands in one task: rows are windowed by (key, time bucket),
and what reaches into a bucket from earlier or later ones travels as one
summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetlake.session import written

BUCKET_SECONDS = 30 * 86_400


def latest_statements(df: DataFrame, key: str, at: str, recency: list[str], attrs: list[str]) -> DataFrame:
    """One event per (key, at): of several, the one greatest by ``recency`` (NULLs lowest), then by its attributes.

    Rows without key or instant are ignored. Combined before the shuffle.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    best = F.max(F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(recency)], *[F.col(a).alias(f"a{i}") for i, a in enumerate(attrs)])).alias("__e")
    return rows.groupBy(F.col(key), F.col(at)).agg(best).select(key, at, *[F.col(f"__e.a{i}").alias(a) for i, a in enumerate(attrs)])


def change_log(events: DataFrame, key: str, at: str, attrs: list[str], bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The per-attribute change log: a row (key, at, attribute, one struct per attribute) where an attribute takes a new value.

    ``events`` is unique on (key, at). Only the struct of the row's own
    attribute is set; a NULL inside it is a value. ``__b`` is the time bucket
    and ``__in`` the state with which the bucket begins (NULL in the first).
    """
    state = F.struct(*[F.struct(F.col(a).alias("v")).alias(f"s{i}") for i, a in enumerate(attrs)])
    ev = events.select(key, at, F.floor(F.col(at) / bucket_seconds).alias("__b"), state.alias("__s")).repartition(F.col(key), F.col("__b"))
    carried = (
        ev.groupBy(key, "__b").agg(F.max_by("__s", at).alias("__last"))
        .withColumn("__in", F.lag("__last").over(W.partitionBy(key).orderBy("__b")))
        .drop("__last")
    )
    before = F.coalesce(F.lag("__s").over(W.partitionBy(key, "__b").orderBy(at)), F.col("__in"))
    ev = ev.join(carried, [key, "__b"]).withColumn("__p", before)
    entry = lambda i: F.when(
        F.col("__p").isNull() | ~F.col(f"__p.s{i}.v").eqNullSafe(F.col(f"__s.s{i}.v")),
        F.struct(F.lit(attrs[i]).alias("attribute"), *[(F.col(f"__s.s{j}") if i == j else F.lit(None)).alias(f"s{j}") for j in range(len(attrs))]),
    )
    entries = F.array_compact(F.array(*[entry(i) for i in range(len(attrs))]))
    return ev.select(key, "__b", at, "__in", F.explode(entries).alias("__c")).select(key, "__b", at, "__in", "__c.*")


def versions(log: DataFrame, key: str, at: str, attrs: list[str], absent: Column | None = None) -> DataFrame:
    """Versions (key, valid_from, valid_to, attributes) from a change log; ``valid_to`` is NULL while open.

    A boundary is an instant at which any attribute changes; between
    boundaries each attribute has the value last logged. ``absent`` tells the
    states that end a version and are none.
    """
    n = range(len(attrs))
    cuts = log.groupBy(key, "__b", at).agg(F.first("__in").alias("__in"), *[F.max(f"s{i}").alias(f"s{i}") for i in n])
    w = W.partitionBy(key, "__b").orderBy(at)
    filled = cuts.select(
        key, "__b", at, F.lead(at).over(w).alias("__next"),
        *[F.coalesce(F.last(f"s{i}", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col(f"__in.s{i}"))["v"].alias(attrs[i]) for i in n],
    )
    later = (
        cuts.groupBy(key, "__b").agg(F.min(at).alias("__first"))
        .withColumn("__after", F.lead("__first").over(W.partitionBy(key).orderBy("__b")))
        .drop("__first")
    )
    out = filled.join(later, [key, "__b"])
    if absent is not None:
        out = out.where(~F.coalesce(absent, F.lit(False)))
    return out.select(key, F.col(at).alias("valid_from"), F.coalesce("__next", "__after").alias("valid_to"), *attrs)


def attribute_history(df: DataFrame, key: str, at: str, recency: list[str], attrs: list[str], absent: Column | None = None, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Versions of every key of ``df``, from restatements in any order.

    - ``at``: whole seconds; rows without it, or without key, are ignored;
    - equal instants: the row greatest by ``recency`` counts, ties go to the greatest attribute values;
    - NULL is a value like any other; NaN equals NaN;
    - an empty table gives no versions; other columns of ``df`` are not touched, whatever their names.
    """
    # Read twice below, aggregated once.
    events = written(latest_statements(df, key, at, recency, attrs))
    return versions(change_log(events, key, at, attrs, bucket_seconds), key, at, attrs, absent)
