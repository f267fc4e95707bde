"""The typed, directed object graph: hops, incident edges, reachability, roots, loops, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.schema import CATEGORIES, DIRECTIONS, StoreError
from facetlake.session import cut_lineage


def typed_edges(edges: DataFrame, categories: list[str] | None = None, types: list[str | tuple[str, str]] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Edges of the categories and of the types, in union; both None means all, an empty list nothing.

    A type is a name, or a name and its code space (NULL and empty alike;
    edges then have ``code_space``). One that ``known`` (rel_type, and
    code_space where such are asked for; the edges themselves without it) does
    not have raises, as does a category that is none: a slip of the pen is no
    empty result.
    """
    for c in categories or []:
        if c not in CATEGORIES:
            raise StoreError(f"no relationship category: {c!r}")
    if categories is None and types is None:
        return edges
    space = lambda: F.coalesce("code_space", F.lit(""))
    keep = F.lit(False)
    if categories:
        keep = keep | F.coalesce(F.col("category").isin(categories), F.lit(False))
    for t in types or []:
        test = lambda t=t: F.col("rel_type") == t if isinstance(t, str) else (F.col("rel_type") == t[0]) & (space() == (t[1] or ""))
        if (known if known is not None else edges).where(test()).isEmpty():
            raise StoreError(f"no relationship type: {t!r}")
        keep = keep | F.coalesce(test(), F.lit(False))
    return edges.where(keep)


def hops(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst) pairs as traversed: 'out' as given, 'in' turned round, 'both' either way; external targets are no hop."""
    if direction not in DIRECTIONS:
        raise StoreError(f"no direction: {direction!r}")
    local = edges.where("src is not null and dst is not null")
    out = local.select("src", "dst")
    back = local.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(object_id, neighbour_id) one hop away, distinct."""
    return hops(edges, direction).select(F.col("src").alias("object_id"), F.col("dst").alias("neighbour_id"))


def incident_edges(edges: DataFrame, direction: str = "both", include_external: bool = True) -> DataFrame:
    """One row per end of an edge: object_id, direction, other_id, ext, rel_type, category; a self-loop shows twice."""
    rows = edges if include_external else edges.where("ext is null")
    cols = ["ext", "rel_type", "category"]
    out = rows.select(F.col("src").alias("object_id"), F.lit("out").alias("direction"), F.col("dst").alias("other_id"), *cols)
    into = rows.where("dst is not null").select(F.col("dst").alias("object_id"), F.lit("in").alias("direction"), F.col("src").alias("other_id"), *cols)
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def roots(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that no hop of ``edges`` leads to."""
    return objects.select("object_id").join(edges.where("dst is not null").select(F.col("dst").alias("object_id")), "object_id", "left_anti")


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "out", include_start: bool = True) -> DataFrame:
    """(root, object_id, depth): everything reached from each start, with its least number of hops.

    Breadth first with a visited set, so it ends on cycles. Each round joins
    the frontier with the hops and drops what was seen; lineage is cut each
    round, and what was seen is one table again after every eight.
    """
    step = cut_lineage(hops(edges, direction).withColumnRenamed("src", "object_id"))
    frontier = cut_lineage(starts.select(F.col("object_id").alias("root"), "object_id", F.lit(0).cast("long").alias("depth")).distinct())
    seen, rounds = frontier, 0
    while not frontier.isEmpty():
        nxt = frontier.join(step, "object_id").select("root", F.col("dst").alias("object_id"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = cut_lineage(nxt.join(seen.select("root", "object_id"), ["root", "object_id"], "left_anti"))
        rounds += 1
        seen = seen.unionByName(frontier)
        if rounds % 8 == 0:
            seen = cut_lineage(seen)
    # A start is reached at depth 0 only; a cycle back to it adds no row.
    return seen if include_start else seen.where("depth > 0")


def closure(parents: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of a class tree (class_id, parent_id), self rows included; a loop ends at its first repeat."""
    edges = parents.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("class_id").alias("dst"))
    return reachable(edges, parents.select(F.col("class_id").alias("object_id"))).select(F.col("root").alias("ancestor"), F.col("object_id").alias("descendant"), "depth")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes (object_id) that no peeling from the sources removes: those on cycles and those below them.

    Several peeling rounds a job; a round is one anti-join of few columns.
    """
    left = cut_lineage(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = left.select(F.col("src").alias("object_id")).union(left.select("dst")).distinct()
    state = cut_lineage(nodes)
    n = state.count()
    while n:
        for _ in range(2):
            # A node stays while an edge from a node that stays leads to it.
            state = left.join(state.select(F.col("object_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("object_id")).distinct()
        state = cut_lineage(state)
        after = state.count()
        if after == n:
            break
        n = after
    return state
