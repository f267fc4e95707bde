"""Full hierarchies of parent-child links of unknown depth, loops told apart.

Bottom-up leaf peeling: in each round the nodes without children send the size
of what is below them to their parents and leave. Bushy trees lose most nodes
in the first rounds, so PEELS of them are run, in one job. A round a level
would be as many jobs as the tallest chain is long, so what then still stands
(the core) is peeled in strides that quadruple: every node sends what lies
less than a stride below it to its ancestors one, two and three strides up,
and its pointer moves four strides. A node whose pointer passes its root is
done. When a stride ends no node's walk, what is left hangs on cycles: by then
no tree is that deep.

The order is then reversed: core nodes get their trails, stride by stride,
and peeled nodes hang theirs below. Names travel only there, on nodes known to
be in trees. The number of jobs is logarithmic in the depth at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.session import written

#: Rounds of single levels before strides are taken.
PEELS = 3


def _numbered(links: DataFrame) -> DataFrame:
    """(hierarchy, scope, node, parent_name, id), one row per node; ids are fixed by the writing and differ by construction."""
    given = links.where("node is not null").select("hierarchy", F.coalesce("scope", F.lit("")).alias("scope"), "node", "parent")
    both = given.unionByName(given.where("parent is not null").select("hierarchy", "scope", F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    nodes = both.groupBy("hierarchy", "scope", "node").agg(F.min("parent").alias("parent_name"))
    return written(nodes.withColumn("id", F.monotonically_increasing_id()))


def _linked(nodes: DataFrame) -> DataFrame:
    """(id, parent) of the nodes; roots have NULL and take no part in the join, where they would be one key."""
    ids = nodes.select("hierarchy", "scope", F.col("node").alias("parent_name"), F.col("id").alias("parent"))
    inner = nodes.where("parent_name is not null").join(ids, ["hierarchy", "scope", "parent_name"]).select("id", "parent")
    return inner.unionByName(nodes.where("parent_name is null").select("id", F.lit(None).cast("long").alias("parent")))


def peel(links: DataFrame, rounds: int = PEELS) -> DataFrame:
    """``links`` (id, parent) after some rounds: id, parent, size (nodes below, as far as they left), round (NULL in the core).

    A node and the messages to it meet in one combined aggregation, so a round is one shuffle of few numbers.
    """
    kids = links.where("parent is not null").select(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(1).cast("long").alias("pending"))
    state = links.select("id", "parent", F.lit(0).cast("long").alias("pending")).unionByName(kids).groupBy("id").agg(F.max("parent").alias("parent"), F.sum("pending").alias("pending"))
    state = state.select("id", "parent", "pending", F.lit(0).cast("long").alias("size"), F.lit(None).cast("int").alias("round"))
    for tick in range(rounds):
        leaf = (F.col("pending") == 0) & F.col("round").isNull()
        own = F.struct("id", "parent", "pending", "size", F.when(leaf, F.lit(tick)).otherwise(F.col("round")).alias("round"))
        note = F.struct(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(-1).cast("long").alias("pending"), (F.col("size") + 1).alias("size"), F.lit(None).cast("int").alias("round"))
        state = state.select(F.explode(F.when(leaf & F.col("parent").isNotNull(), F.array(own, note)).otherwise(F.array(own))).alias("x")).select("x.*")
        state = state.groupBy("id").agg(F.max("parent").alias("parent"), F.sum("pending").alias("pending"), F.sum("size").alias("size"), F.max("round").alias("round"))
    return written(state.drop("pending"))


def _above(rows: DataFrame, at: str, known: DataFrame) -> DataFrame:
    """``rows`` with what ``known`` (__at, ...) says of the node in column ``at``; rows whose walk is over (NULL) ask for nodes that do not exist, each for another."""
    return rows.withColumn("__at", F.coalesce(at, -1 - F.col("id"))).join(known, "__at", "left").drop("__at")


def _strides(core: DataFrame) -> tuple[DataFrame, int, int]:
    """((id, anc, below) of the core, rounds, nodes left on or below cycles): strides until none ends a walk.

    ``anc`` is NULL for nodes of trees; ``below`` counts the nodes below, right for those only.
    """
    state = core.select("id", F.col("parent").alias("anc"), (F.col("size") + 1).alias("below"))
    left, rounds = state.where("anc is not null").count(), 0
    while left:
        # The ancestors one, two and three strides up; the pointer moves to the fourth.
        walk = state.where("anc is not null").select("id", F.col("anc").alias("a1"))
        for k in (1, 2, 3):
            walk = _above(walk, f"a{k}", state.select(F.col("id").alias("__at"), F.col("anc").alias(f"a{k + 1}")))
        none = F.lit(None).cast("long")
        told = state.join(walk, "id", "left").select(
            F.explode(F.array(
                F.struct("id", F.col("a4").alias("anc"), "below"), *[F.struct(F.col(a).alias("id"), none.alias("anc"), "below") for a in ("a1", "a2", "a3")]
            )).alias("x")
        ).select("x.*").where("id is not null")
        state = written(told.groupBy("id").agg(F.max("anc").alias("anc"), F.sum("below").alias("below")))
        before, left = left, state.where("anc is not null").count()
        if left == before:
            break
        rounds += 1
    return state, rounds, left


def _on_cycles(core: DataFrame, stuck: DataFrame) -> DataFrame:
    """Of the nodes ``stuck`` (id) on or below cycles, those on one.

    The nodes that something points to over 2^k links shrink with k to those
    on cycles, and on these every stride is one to one: once longer strides
    drop none, they are left.
    """
    hop, before = written(core.join(stuck, "id", "left_semi").select("id", F.col("parent").alias("anc"))), -1
    while True:
        hit = hop.select(F.col("anc").alias("id")).distinct()
        n = hit.count()
        if n == before:
            return hit
        before = n
        for k in range(2):  # four strides of this length
            up = hop.select(F.col("id").alias("anc"), F.col("anc").alias("next"))
            hop = hop.join(up, "anc").select("id", F.col("next").alias("anc"))
        hop = written(hop)


def _trails(tree: DataFrame, rounds: int) -> DataFrame:
    """(id, trail) of the core nodes ``tree`` (id, parent, node), all in trees of at most 4^rounds levels."""
    state = written(tree.select("id", F.col("parent").alias("anc"), F.array("node").alias("trail")))
    for _ in range(rounds):
        # Three looks at one table, so the stride quadruples in one job; walks that ended are not sent again.
        up = state.select(F.col("id").alias("__at"), F.col("anc").alias("next"), F.col("trail").alias("head"))
        rest = state.where("anc is not null")
        for _ in range(3):
            rest = _above(rest, "anc", up).select("id", F.col("next").alias("anc"), F.when(F.col("head").isNull(), F.col("trail")).otherwise(F.concat("head", "trail")).alias("trail"))
        state = written(state.where("anc is null").unionByName(rest))
    return state.select("id", "trail")


def hierarchies(links: DataFrame, peels: int = PEELS) -> DataFrame:
    """Every node of ``links`` (hierarchy, scope, node, parent): hierarchy, scope, node, trail, status, size.

    ``trail`` names the nodes from the root to the node; ``status`` is 0 in a
    tree, -1 on a cycle, -2 below one, where the trail is empty; ``size``
    counts the nodes below. ``links`` may repeat rows and name a node with and
    without its parent; a node has at most one parent (of several, which would
    break that rule, the smallest is taken). Parents are nodes too. NULL nodes
    are left out, a NULL scope is ''. Empty input gives no rows. Joins on a
    parent with very many children are split by adaptive execution.
    """
    nodes = _numbered(links)
    state = peel(_linked(nodes), peels)
    core = state.where("round is null").select("id", "parent", "size")
    strode, rounds, left = _strides(core)
    names = nodes.select("id", "node")
    empty = F.array().cast("array<string>")
    tree = strode.where("anc is null").select("id", (F.col("below") - 1).alias("size"))
    trails = _trails(core.join(tree, "id", "left_semi").select("id", "parent").join(names, "id"), rounds)
    known = trails.join(tree, "id").select("id", "trail", F.lit(0).alias("status"), "size")
    if left:
        stuck = strode.where("anc is not null").select("id")
        cyclic = _on_cycles(core, stuck).withColumn("on", F.lit(-1))
        known = known.unionByName(stuck.join(cyclic, "id", "left").select("id", empty.alias("trail"), F.coalesce("on", F.lit(-2)).alias("status"), F.lit(0).cast("long").alias("size")))
    # Peeled nodes: the names up to the core, or to a root that was peeled itself, then one join with the core.
    gone = written(state.where("round is not null").join(names, "id").select("id", "parent", "size", "node"))
    walk, roots = gone.select("id", "size", F.col("parent").alias("at"), F.array("node").alias("names")), []
    step = gone.select(F.col("id").alias("at"), F.col("parent").alias("next"), F.col("node").alias("name"))
    for _ in range(peels - 1):
        roots.append(walk.where("at is null"))
        walk = walk.where("at is not null").join(step, "at", "left").select(
            "id", "size", F.when(F.col("name").isNull(), F.col("at")).otherwise(F.col("next")).alias("at"), F.when(F.col("name").isNull(), F.col("names")).otherwise(F.concat(F.array("name"), F.col("names"))).alias("names")
        )
    roots.append(walk.where("at is null"))
    top = known.select(F.col("id").alias("at"), F.col("trail").alias("head"), F.col("status").alias("above"))
    in_tree: Column = F.col("above") == 0
    hung = walk.where("at is not null").join(top, "at").select("id", F.when(in_tree, F.concat("head", "names")).otherwise(empty).alias("trail"), F.when(in_tree, 0).otherwise(-2).alias("status"), "size")
    for part in roots:
        hung = hung.unionByName(part.select("id", F.col("names").alias("trail"), F.lit(0).alias("status"), "size"))
    return known.unionByName(hung).join(nodes.drop("parent_name"), "id").select("hierarchy", "scope", "node", "trail", "status", "size")


def hierarchy_table(links: DataFrame, peels: int = PEELS) -> DataFrame:
    """One row per node: hierarchy, scope, node, root, depth, n_descendants, path.

    On a cycle: root '', depth -1, n_descendants -1, path ''; below a cycle the same with depth -2.
    """
    tree = F.col("status") == 0
    return hierarchies(links, peels).select(
        "hierarchy", "scope", "node", F.when(tree, F.get("trail", F.lit(0))).otherwise("").alias("root"),
        F.when(tree, F.size("trail") - 1).otherwise(F.col("status")).cast("int").alias("depth"),
        F.when(tree, F.col("size")).otherwise(-1).cast("int").alias("n_descendants"),
        F.when(tree, F.array_join("trail", "/")).otherwise("").alias("path"),
    )


def descendants(links: DataFrame) -> DataFrame:
    """(hierarchy, scope, ancestor, descendant, distance) of all trees, one row per pair: as many as all paths have nodes."""
    return hierarchies(links).where("status = 0").select("hierarchy", "scope", F.col("node").alias("descendant"), F.size("trail").alias("n"), F.posexplode(F.slice("trail", 1, F.size("trail") - 1)).alias("i", "ancestor")).select(
        "hierarchy", "scope", "ancestor", "descendant", (F.col("n") - 1 - F.col("i")).cast("long").alias("distance")
    )
