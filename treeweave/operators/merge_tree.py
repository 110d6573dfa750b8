"""Merge trees of many graphs at once: ancestors, order, region costs, re-rooting and rotations.

A merge tree is a table ``graph_id, left_id, right_id, new_id``, a row for each
merge: leaves are the graph's vertices, inner nodes the merged clusters. A graph
of several components has a tree for each. What hangs on a node's ancestors or
descendants is found by pointer doubling: a tree of depth d takes about log d
rounds of one join and one aggregation over all trees, so a chain of merges is
no longer than a balanced tree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.functions.partitions import merge_price, region_size
from treeweave.operators.graph import degrees
from treeweave.operators.ranking import number_rows
from treeweave.runtime import forget, materialize

MERGE = "graph_id string, left_id long, right_id long, new_id long"


def parents(merges: DataFrame) -> DataFrame:
    """``graph_id, node, parent, sibling, right``: every node that was merged, right for the second of a pair."""
    side = lambda a, b, r: F.struct(F.col(a).alias("node"), F.col("new_id").alias("parent"), F.col(b).alias("sibling"), F.lit(r).alias("right"))
    return merges.select("graph_id", F.inline(F.array(side("left_id", "right_id", False), side("right_id", "left_id", True))))


def jumps(up: DataFrame) -> list[DataFrame]:
    """``graph_id, node, up``: for k = 0, 1 ..., the ancestors 2^k above, each a written table; ``up`` has graph_id, node and parent."""
    found = []
    now = materialize(up.select("graph_id", "node", F.col("parent").alias("up")), "jumps")
    while not now.isEmpty():
        found.append(now)
        onward = now.select("graph_id", F.col("node").alias("up"), F.col("up").alias("__up"))
        now = materialize(now.join(onward, ["graph_id", "up"]).select("graph_id", "node", F.col("__up").alias("up")), "jumps")
    forget(now)
    return found


@dataclass(frozen=True)
class MergeTree:
    """Merges with the tables that follow from them, each made once and written."""

    merges: DataFrame
    vertices: DataFrame

    @cached_property
    def up(self) -> DataFrame:
        return materialize(parents(self.merges), "parents")

    @cached_property
    def jumps(self) -> list[DataFrame]:
        return jumps(self.up)

    @cached_property
    def nodes(self) -> DataFrame:
        """``graph_id, node``: leaves and merged clusters."""
        own = self.vertices.select("graph_id", F.col("vertex_id").cast("long").alias("node"))
        return materialize(own.unionByName(self.merges.select("graph_id", F.col("new_id").alias("node"))).distinct(), "nodes")

    @cached_property
    def depth(self) -> DataFrame:
        """``graph_id, node, depth``: 0 for roots."""
        each = path_sums(self.nodes.withColumn("value", F.lit(1).cast("long")), self.jumps)
        return materialize(each.select("graph_id", "node", (F.col("value") - 1).alias("depth")), "depth")

    def forget(self) -> None:
        """Delete the tables of a tree that is no longer read."""
        made = self.__dict__
        forget(*[made[k] for k in ("up", "nodes", "depth") if k in made], *made.get("jumps", ()))


def merge_tree(edges: DataFrame, merges: DataFrame) -> MergeTree:
    """The merge tree of ``merges`` over the vertices of ``edges`` and those that were merged without having an edge."""
    merges = merges.select("graph_id", *[F.col(c).cast("long").alias(c) for c in ("left_id", "right_id", "new_id")])
    seen = [t.select("graph_id", F.explode(F.array(F.col(a).cast("long"), F.col(b).cast("long"))).alias("vertex_id")) for t, a, b in ((edges, "u", "v"), (merges, "left_id", "right_id"))]
    vertices = seen[0].unionByName(seen[1]).distinct().join(merges.select("graph_id", F.col("new_id").alias("vertex_id")), ["graph_id", "vertex_id"], "left_anti")
    return MergeTree(merges, materialize(vertices, "vertices"))


def _summed(values: DataFrame, steps: list[DataFrame], give: str, take: str, how: Callable = F.sum) -> DataFrame:
    for step in steps:
        moved = values.withColumnRenamed("node", give).join(step, ["graph_id", give]).select("graph_id", F.col(take).alias("node"), "value")
        spent, values = values, materialize(values.unionByName(moved).groupBy("graph_id", "node").agg(how("value").alias("value")), "sums")
        if step is not steps[0]:
            forget(spent)
    return values


def path_sums(values: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``graph_id, node, value`` with the sum over each node and all its ancestors; every node has one row in ``values``."""
    return _summed(values, steps, "up", "node")


def subtree_sums(values: DataFrame, steps: list[DataFrame], how: Callable = F.sum) -> DataFrame:
    """``graph_id, node, value`` with the sum over each node and all below it, or another aggregate of theirs (``how``); every node has one row in ``values``."""
    return _summed(values, steps, "node", "up", how)


def node_extremes(tree: MergeTree) -> DataFrame:
    """``graph_id, node, least, height``: each node's smallest leaf, and how far its deepest leaf lies below it."""
    leaf = tree.vertices.select("graph_id", F.col("vertex_id").alias("node"), F.col("vertex_id").alias("value"))
    least = subtree_sums(tree.nodes.join(leaf, ["graph_id", "node"], "left"), tree.jumps, F.min)
    deepest = subtree_sums(tree.depth.withColumnRenamed("depth", "value"), tree.jumps, F.max)
    told = least.withColumnRenamed("value", "least").join(deepest, ["graph_id", "node"]).join(tree.depth, ["graph_id", "node"])
    return told.select("graph_id", "node", "least", (F.col("value") - F.col("depth")).alias("height"))


def with_ancestor(rows: DataFrame, node: str, height: str, steps: list[DataFrame], out: str) -> DataFrame:
    """Add ``out``: the ancestor of ``node`` that lies ``height`` above it; null where height is null, negative or too great."""
    rows = rows.withColumn(out, F.when(F.col(height) >= 0, F.col(node)))
    for k, step in enumerate(steps):
        s = step.select("graph_id", F.col("node").alias(out), F.col("up").alias("__up"))
        rows = rows.join(s, ["graph_id", out], "left")
        rows = rows.withColumn(out, F.when(F.shiftright(height, k).bitwiseAND(F.lit(1)) == 1, F.col("__up")).otherwise(F.col(out))).drop("__up")
        if k % 4 == 3:
            rows = materialize(rows, "ancestors")
    return rows.withColumn(out, F.when(F.shiftright(height, len(steps)) <= 0, F.col(out)))


def with_common_ancestor(rows: DataFrame, a: str, b: str, tree: MergeTree) -> DataFrame:
    """Add ``lca``, the lowest node above both ``a`` and ``b``, ``lca_depth``, and ``a_child`` and ``b_child``, its children on either side.

    Both nodes are lifted to one depth, then as far as they differ, by falling
    powers of two. Nodes of different trees have no lca: null, as are their
    children; the children are null too where one node is above the other.
    """
    depth = tree.depth
    for c in (a, b):
        rows = rows.join(depth.select("graph_id", F.col("node").alias(c), F.col("depth").alias(f"__{c}")), ["graph_id", c])
    rows = rows.withColumn("__ha", F.greatest(F.col(f"__{a}") - F.col(f"__{b}"), F.lit(0))).withColumn("__hb", F.greatest(F.col(f"__{b}") - F.col(f"__{a}"), F.lit(0)))
    rows = with_ancestor(rows, a, "__ha", tree.jumps, "a_child")
    rows = materialize(with_ancestor(rows, b, "__hb", tree.jumps, "b_child"), "ancestors")
    for k, step in enumerate(reversed(tree.jumps)):
        for c in ("a_child", "b_child"):
            rows = rows.join(step.select("graph_id", F.col("node").alias(c), F.col("up").alias(f"__up_{c}")), ["graph_id", c], "left")
        far = F.col("__up_a_child").isNotNull() & F.col("__up_b_child").isNotNull() & (F.col("__up_a_child") != F.col("__up_b_child"))
        rows = rows.select(*[c for c in rows.columns if not c.startswith("__up") and c not in ("a_child", "b_child")], *[F.when(far, F.col(f"__up_{c}")).otherwise(F.col(c)).alias(c) for c in ("a_child", "b_child")])
        if k % 4 == 3:
            rows = materialize(rows, "ancestors")
    above = tree.up.select("graph_id", F.col("node").alias("a_child"), F.col("parent").alias("__pa"))
    other = tree.up.select("graph_id", F.col("node").alias("b_child"), F.col("parent").alias("__pb"))
    rows = rows.join(above, ["graph_id", "a_child"], "left").join(other, ["graph_id", "b_child"], "left")
    same = F.col("a_child") == F.col("b_child")
    rows = rows.withColumn("lca", F.when(same, F.col("a_child")).when(F.col("__pa") == F.col("__pb"), F.col("__pa")))
    for c in ("a_child", "b_child"):
        rows = rows.withColumn(c, F.when(~same & F.col("lca").isNotNull(), F.col(c)))
    rows = rows.drop("__pa", "__pb", "__ha", "__hb", f"__{a}", f"__{b}")
    return rows.join(depth.select("graph_id", F.col("node").alias("lca"), F.col("depth").alias("lca_depth")), ["graph_id", "lca"], "left")


def tree_order(tree: MergeTree) -> DataFrame:
    """``graph_id, node, parent, level, preorder, place``: parents, levels and orders of all nodes.

    ``level`` counts from the roots, ``preorder`` from 1 along each tree, a left
    child before a right one; ``place`` numbers each graph's nodes in reverse
    breadth-first order, so that it gives children before their parents and the
    last root the last place. Places come from levels and preorder: within a
    level both orders agree.
    """
    one = F.lit(1).cast("long")
    size = subtree_sums(tree.nodes.withColumn("value", one), tree.jumps)
    # before a node come its parent and, if it is the right child, its sibling's whole tree
    up = tree.up.join(size.select("graph_id", F.col("node").alias("sibling"), F.col("value").alias("beside")), ["graph_id", "sibling"])
    step = up.select("graph_id", "node", "parent", (one + F.when(F.col("right"), F.col("beside")).otherwise(0)).alias("value"))
    all_nodes = tree.nodes.join(step, ["graph_id", "node"], "left")
    pre = path_sums(all_nodes.select("graph_id", "node", F.coalesce("value", one).alias("value")), tree.jumps).withColumnRenamed("value", "preorder")
    rooted = tree.nodes.join(tree.depth, ["graph_id", "node"])
    top = with_ancestor(rooted, "node", "depth", tree.jumps, "root")
    told = all_nodes.select("graph_id", "node", "parent").join(top, ["graph_id", "node"]).join(pre, ["graph_id", "node"])
    told = told.withColumn("__level", -F.col("depth")).withColumn("__top", -F.col("root")).withColumn("__pre", -F.col("preorder"))
    placed = number_rows(told, ["graph_id"], ["__level", "__top", "__pre"], "place")
    return placed.select("graph_id", "node", "parent", F.col("depth").alias("level"), "preorder", "place")


def sequence_of(tree: MergeTree) -> DataFrame:
    """``graph_id, step, left_id, right_id, new_id``: the tree's merges in reverse breadth-first order, new nodes numbered on from the graph's greatest vertex id."""
    order = tree_order(tree)
    inner = order.join(tree.merges.select("graph_id", F.col("new_id").alias("node")), ["graph_id", "node"], "left_semi")
    top = tree.vertices.groupBy("graph_id").agg(F.max("vertex_id").alias("top"))
    numbered = number_rows(inner.select("graph_id", "node", "place"), ["graph_id"], ["place"], "step").join(top, "graph_id")
    called = materialize(numbered.select("graph_id", "node", "step", (F.col("top") + F.col("step")).cast("long").alias("called")), "called")
    out = tree.merges.join(called.select("graph_id", F.col("node").alias("new_id"), "step", F.col("called").alias("__new")), ["graph_id", "new_id"])
    for c in ("left_id", "right_id"):
        out = out.join(called.select("graph_id", F.col("node").alias(c), F.col("called").alias(f"__{c}")), ["graph_id", c], "left")
    return out.select("graph_id", "step", *[F.coalesce(f"__{c}", c).alias(c) for c in ("left_id", "right_id")], F.col("__new").alias("new_id"))


def trigraph(merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merge trees without their roots: links ``graph_id, a, b`` (a < b) and the links that held a root.

    A root's two children are linked with each other, so that every inner node
    has three links; any link can hold the root again.
    """
    up = parents(merges)
    roots = merges.join(up.select("graph_id", F.col("node").alias("new_id")), ["graph_id", "new_id"], "left_anti")
    held = roots.select("graph_id", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"))
    inner = up.join(roots.select("graph_id", F.col("new_id").alias("parent")), ["graph_id", "parent"], "left_anti")
    links = inner.select("graph_id", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    return links.unionByName(held), held


def rooted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``graph_id, node, parent``: trees (``graph_id, a, b``) directed away from their roots (``graph_id, node``).

    An Euler tour goes along every link both ways: after coming from u to v it
    goes on to the neighbour of v that follows u in order of id, and ends where
    it would leave the root once more. Its places come from list ranking by
    pointer doubling, so a deep tree takes a logarithmic number of rounds. A
    link leads down where the tour goes along it for the first time. Trees
    without a root have no rows.
    """
    arcs = links.select("graph_id", F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
    around = W.partitionBy("graph_id", "x").orderBy("y")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = materialize(arcs.withColumn("next", F.lead("y").over(around)).withColumn("first", F.min("y").over(whole)), "arcs")
    root = roots.select("graph_id", F.col("node").alias("y"), F.lit(True).alias("at_root"))
    # coming along (y, x) the tour leaves along (x, next): rows of turn, read from the arc that came in
    tour = turn.select("graph_id", F.col("y").alias("x"), F.col("x").alias("y"), F.coalesce("next", "first").alias("next"), F.col("next").isNull().alias("round")).join(root, ["graph_id", "y"], "left")
    ends = F.col("round") & F.coalesce("at_root", F.lit(False))
    now = materialize(tour.select("graph_id", "x", "y", F.when(~ends, F.col("y")).alias("nx"), F.when(~ends, F.col("next")).alias("ny"), F.when(ends, 0).otherwise(1).cast("long").alias("left")), "tour")
    open_ = now.where("nx is not null").count()
    while open_:
        onward = now.select("graph_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("__nx"), F.col("ny").alias("__ny"), F.col("left").alias("__left"))
        step = now.join(onward, ["graph_id", "nx", "ny"], "left").select("graph_id", "x", "y", F.col("__nx").alias("nx"), F.col("__ny").alias("ny"), (F.col("left") + F.coalesce("__left", F.lit(0))).alias("left"))
        spent, now = now, materialize(step, "tour")
        forget(spent)
        still = now.where("nx is not null").count()
        if still == open_:  # only trees without a root go round for ever
            break
        open_ = still
    settled = now.where("nx is null")
    back = settled.select("graph_id", F.col("x").alias("y"), F.col("y").alias("x"), F.col("left").alias("__back"))
    return settled.join(back, ["graph_id", "x", "y"]).where(F.col("left") > F.col("__back")).select("graph_id", F.col("y").alias("node"), F.col("x").alias("parent"))


def merges_of(links: DataFrame, held: DataFrame, top: DataFrame) -> DataFrame:
    """The merges of trigraphs (``graph_id, a, b``) whose root goes into the link ``held``; ``top`` (graph_id, top) is above all ids, and roots are numbered from it on."""
    mine = number_rows(held.select("graph_id", "a", "b"), ["graph_id"], ["a", "b"], "n").join(top, "graph_id").select("graph_id", "a", "b", (F.col("top") + F.col("n")).alias("root"))
    mine = materialize(mine, "roots")
    rest = links.join(mine, ["graph_id", "a", "b"], "left_anti").select("graph_id", "a", "b")
    new = mine.select("graph_id", F.explode(F.array("a", "b")).alias("a"), F.col("root").alias("b"))
    up = rooted(rest.unionByName(new), mine.select("graph_id", F.col("root").alias("node")))
    return up.groupBy("graph_id", F.col("parent").alias("new_id")).agg(F.min("node").alias("left_id"), F.max("node").alias("right_id")).select("graph_id", "left_id", "right_id", "new_id")


def _edge_ancestors(edges: DataFrame, tree: MergeTree) -> DataFrame:
    ends = edges.where("u <> v").select("graph_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    return with_common_ancestor(ends, "u", "v", tree)


def outdegrees(edges: DataFrame, tree: MergeTree, met: DataFrame | None = None) -> DataFrame:
    """``graph_id, node, outdegree``: the edges that leave each cluster of the tree.

    An edge counts at both its vertices and is inside every cluster above both:
    it takes off two at their lowest common ancestor, and sums up the tree do
    the rest. No vertex sets are made. ``met``: the edges with their lca, if known.
    """
    met = _edge_ancestors(edges, tree) if met is None else met
    own = degrees(edges.where("u <> v")).select("graph_id", F.col("vertex_id").cast("long").alias("node"), F.col("degree").alias("value"))
    inside = met.where("lca is not null").select("graph_id", F.col("lca").alias("node"), F.lit(-2).cast("long").alias("value"))
    none = tree.nodes.withColumn("value", F.lit(0).cast("long"))
    values = materialize(own.unionByName(inside).unionByName(none).groupBy("graph_id", "node").agg(F.sum("value").alias("value")), "values")
    return subtree_sums(values, tree.jumps).withColumnRenamed("value", "outdegree")


def with_children(merges: DataFrame, out: DataFrame) -> DataFrame:
    """Merges with ``outdegree``, ``left_out`` and ``right_out``."""
    for c, name in (("new_id", "outdegree"), ("left_id", "left_out"), ("right_id", "right_out")):
        merges = merges.join(out.select("graph_id", F.col("node").alias(c), F.col("outdegree").alias(name)), ["graph_id", c])
    return merges


def region_costs(edges: DataFrame, tree: MergeTree, measure: str = "outdegree") -> DataFrame:
    """``graph_id, node, outdegree, cost`` of every node of a merge tree.

    A merge costs f(l) f(r), where l and r are the outdegrees of what it merges;
    a leaf f of its degree. ``measure`` names f: ``outdegree`` (the number
    itself), ``bell`` (its set partitions) or ``directed`` (its directed
    partitions); the latter two are doubles.
    """
    out = materialize(outdegrees(edges, tree), "outdegrees")
    f = lambda c: region_size(F.col(c), measure)
    inner = with_children(tree.merges, out).select("graph_id", F.col("new_id").alias("node"), "outdegree", (f("left_out") * f("right_out")).alias("cost"))
    leaves = out.join(tree.vertices.select("graph_id", F.col("vertex_id").cast("long").alias("node")), ["graph_id", "node"], "left_semi")
    return inner.unionByName(leaves.select("graph_id", "node", "outdegree", f("outdegree").alias("cost")))


def sequence_costs(costs: DataFrame) -> DataFrame:
    """``graph_id, cost, widest``: a merge tree's total, and its greatest outdegree, from ``region_costs``."""
    return costs.groupBy("graph_id").agg(F.sum("cost").alias("cost"), F.max("outdegree").alias("widest"))


def root_gains(edges: DataFrame, tree: MergeTree, measure: str = "outdegree") -> DataFrame:
    """``graph_id, node, root, gain``: how the cost of all merges changes if the root moves to the link above ``node``.

    Merging l and r costs ``merge_price``. A move of the root by one link changes
    two merges, those at the link's two ends; changes add up along the way from
    the root, so one pass of path sums gives them for all links. Roots have no
    row; the links below the root are one link, at no gain.
    """
    out = materialize(outdegrees(edges, tree), "outdegrees")
    p = lambda a, b: merge_price(F.col(a), F.col(b), measure)
    each = tree.up
    for c, name in (("node", "b"), ("sibling", "c"), ("parent", "a")):
        each = each.join(out.select("graph_id", F.col("node").alias(c), F.col("outdegree").alias(name)), ["graph_id", c])
    grand = tree.up.select("graph_id", F.col("node").alias("parent"), F.lit(True).alias("below"))
    each = each.join(grand, ["graph_id", "parent"], "left")
    change = p("c", "a") + p("b", "b") - p("c", "b") - p("a", "a")
    step = each.select("graph_id", "node", F.when(F.col("below"), change).otherwise(F.lit(0)).alias("value"))
    zero = F.lit(0).cast(step.schema["value"].dataType)
    values = materialize(tree.nodes.join(step, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("value", zero).alias("value")), "values")
    gains = path_sums(values, tree.jumps).join(tree.depth.where("depth > 0"), ["graph_id", "node"])
    return with_ancestor(gains, "node", "depth", tree.jumps, "root").select("graph_id", "node", "root", F.col("value").alias("gain"))


def rerooted(edges: DataFrame, tree: MergeTree, measure: str = "outdegree") -> DataFrame:
    """Merges of each tree with its root on the link that makes all its merges cheapest, and no other change to it.

    Ties fall to the root as it is, then to the smaller node. On the way from
    the old root to the new one every cluster turns into what lay outside of the
    one below it; it keeps its id.
    """
    gains = materialize(root_gains(edges, tree, measure), "gains")
    best = gains.groupBy("graph_id", "root").agg(F.min(F.struct("gain", "node")).alias("b")).where("b.gain < 0").select("graph_id", "root", F.col("b.node").alias("x"))
    way = best.join(tree.depth.select("graph_id", F.col("node").alias("x"), "depth"), ["graph_id", "x"])
    steps = way.select("graph_id", "root", "x", "depth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth"))).alias("i"))
    on_way = materialize(with_ancestor(steps, "x", "i", tree.jumps, "at").select("graph_id", "root", "x", "depth", "i", "at"), "way")
    below = on_way.select("graph_id", "x", (F.col("i") + 1).alias("i"), F.col("at").alias("came"))
    above = on_way.select("graph_id", "x", (F.col("i") - 1).alias("i"), F.col("at").alias("goes"))
    turned = on_way.join(below, ["graph_id", "x", "i"]).join(above, ["graph_id", "x", "i"], "left")
    turned = turned.join(tree.up.select("graph_id", F.col("node").alias("came"), F.col("sibling").alias("kept")), ["graph_id", "came"])
    old = turned.where("i = depth").select("graph_id", "x", F.col("kept").alias("far"))  # the root's other child
    rows = turned.join(old, ["graph_id", "x"])
    last = F.col("i") == F.col("depth") - 1
    inner = rows.where("i < depth").select("graph_id", F.col("at").alias("new_id"), F.col("kept").alias("one"), F.when(last, F.col("far")).otherwise(F.col("goes")).alias("two"))
    first = on_way.where("i = 1").select("graph_id", F.col("root").alias("new_id"), F.col("x").alias("one"), F.col("at").alias("two"))
    new = materialize(inner.unionByName(first), "turned")
    kept = tree.merges.join(new, ["graph_id", "new_id"], "left_anti").select("graph_id", "left_id", "right_id", "new_id")
    return kept.unionByName(new.select("graph_id", F.least("one", "two").alias("left_id"), F.greatest("one", "two").alias("right_id"), "new_id"))


def rotations(edges: DataFrame, tree: MergeTree, measure: str = "outdegree") -> DataFrame:
    """``graph_id, u, v, a, b, c, change``: every rotation of a merge tree, and what it does to the cost of all merges.

    u merges a with v, and v merges b with c; then v merges a with b, and u merges
    v with c. Only these two prices change. The boundary of a and b follows from
    theirs and the edges between them: those that meet in u and come from below b.
    """
    met = materialize(_edge_ancestors(edges, tree), "met")
    out = materialize(outdegrees(edges, tree, met), "outdegrees")
    up = tree.up
    # each edge as seen from either side: it leads from the child a of its lca to the grandchild b on the other side
    both = met.where("lca is not null").select("graph_id", "lca", "lca_depth", F.inline(F.array(
        F.struct(F.col("a_child").alias("a"), F.col("v").alias("far")), F.struct(F.col("b_child").alias("a"), F.col("u").alias("far")))))
    both = both.join(tree.depth.select("graph_id", F.col("node").alias("far"), "depth"), ["graph_id", "far"]).withColumn("height", F.col("depth") - F.col("lca_depth") - 2)
    crossing = with_ancestor(both.where("height >= 0"), "far", "height", tree.jumps, "b").groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("m"))
    upper = up.select("graph_id", F.col("parent").alias("u"), F.col("node").alias("v"), F.col("sibling").alias("a"))
    lower = up.select("graph_id", F.col("parent").alias("v"), F.col("node").alias("b"), F.col("sibling").alias("c"))
    moves = upper.join(lower, ["graph_id", "v"]).join(crossing, ["graph_id", "a", "b"], "left")
    for c in "abcv":
        moves = moves.join(out.select("graph_id", F.col("node").alias(c), F.col("outdegree").alias(f"__{c}")), ["graph_id", c])
    p = lambda x, y: merge_price(x, y, measure)
    a, b, c, v = (F.col(f"__{x}") for x in "abcv")
    ab = a + b - 2 * F.coalesce("m", F.lit(0))
    return moves.select("graph_id", "u", "v", "a", "b", "c", (p(ab, c) + p(a, b) - p(a, v) - p(b, c)).alias("change"))


def rotated(edges: DataFrame, merges: DataFrame, measure: str = "outdegree", max_rounds: int = 10_000) -> DataFrame:
    """Merges after rotations until none makes them cheaper: a local optimum.

    A round takes the cheapening rotations that are the best of all that touch
    their two clusters u and v, ties to the smaller ids. They share no cluster,
    so their changes add up and the cost falls every round; each tree's best
    rotation is among them. Trees at their optimum are set aside.
    """
    done: list[DataFrame] = []
    now = materialize(merges.select("graph_id", "left_id", "right_id", "new_id"), "merges")
    for _ in range(max_rounds):
        open_edges = edges.join(now.select("graph_id").distinct(), "graph_id", "left_semi")
        tree = merge_tree(open_edges, now)
        found = rotations(open_edges, tree, measure).where("change < 0").withColumn("rank", F.struct("change", "u", "v", "b"))
        found = materialize(found, "rotations")
        touched = found.select("graph_id", "rank", F.explode(F.array("u", "v")).alias("node"))
        best = touched.groupBy("graph_id", "node").agg(F.min("rank").alias("rank")).groupBy("graph_id", "rank").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        moves = materialize(found.join(best, ["graph_id", "rank"], "left_semi").select("graph_id", "u", "v", "a", "b", "c"), "moves")
        pair = lambda x, y, z: F.struct(F.least(x, y).alias("left_id"), F.greatest(x, y).alias("right_id"), F.col(z).alias("new_id"))
        new = moves.select("graph_id", F.inline(F.array(pair("v", "c", "u"), pair("a", "b", "v"))))
        going = moves.select("graph_id").distinct()
        done.append(materialize(now.join(going, "graph_id", "left_anti"), "settled"))
        step = now.join(going, "graph_id", "left_semi").join(new.select("graph_id", "new_id"), ["graph_id", "new_id"], "left_anti").select(now.columns).unionByName(new)
        spent, now = now, materialize(step, "merges")
        tree.forget()
        empty = moves.isEmpty()
        forget(spent, found, moves)
        if empty:
            break
    else:
        raise RuntimeError(f"rotations did not settle in {max_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def tree_prices(edges: DataFrame, tree: MergeTree, measure: str = "outdegree") -> DataFrame:
    """``graph_id, price``: the sum of ``merge_price`` over all merges, which re-rooting and rotations lower."""
    both = with_children(tree.merges, materialize(outdegrees(edges, tree), "outdegrees"))
    return both.groupBy("graph_id").agg(F.sum(merge_price(F.col("left_out"), F.col("right_out"), measure)).alias("price"))
