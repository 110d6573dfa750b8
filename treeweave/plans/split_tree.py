"""Merge orders from the top down: graphs are cut in two, and their parts again, until single vertices are left.

All parts of all graphs are cut in the same round: a spectral order of each
part says which vertices lie far apart, a minimum cut between its first and
last third parts it where it is thinnest. A part keeps the rest of its graph as
one more vertex, so the cut counts the edges that lead out of the part too. As
either side gets a third at least, the rounds number about the logarithm of the
greatest graph's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.operators.cuts import minimum_cut
from treeweave.operators.graph import graph_components
from treeweave.operators.merge_tree import merge_tree, node_extremes, outdegrees, rerooted, rotated, with_common_ancestor
from treeweave.operators.ranking import number_rows
from treeweave.operators.spectral import spectral_order
from treeweave.runtime import forget, materialize

#: The vertex that stands for the rest of a part's graph; ids of vertices are greater.
OUTSIDE = -(1 << 62)
#: Accuracy and rounds of the spectral orders, which only say where to look for a cut.
TOLERANCE, ROUNDS = 1e-3, 6


def split_parts(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``graph_id, vertex_id, path``: for each vertex the turns, 0 or 1, that lead to it from the top; a component's smallest vertex and a colon come first.

    Parts of two vertices are parted by id, whole graphs of three part with
    their vertex of least degree. ``edges``: graph_id, u, v; self loops don't count.
    """
    usable = materialize(edges.where("u <> v").select("graph_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "edges")
    seen = edges.select("graph_id", F.explode(F.array(F.col("u").cast("long"), F.col("v").cast("long"))).alias("vertex_id")).distinct()
    parts = seen.join(graph_components(usable), ["graph_id", "vertex_id"], "left").select("graph_id", "vertex_id", F.concat(F.coalesce("component", "vertex_id").cast("string"), F.lit(":")).alias("path"))
    now = materialize(parts, "parts")
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        size = now.groupBy("graph_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("vertex_id").alias("least"))
        sized = materialize(now.join(size, ["graph_id", "path"]), "parts")
        done.append(sized.where("n = 1").select("graph_id", "vertex_id", "path"))
        top = F.col("path").endswith(":")
        twos = sized.where("n = 2").select("graph_id", "vertex_id", "path", (F.col("vertex_id") != F.col("least")).alias("turn"))
        threes = sized.where((F.col("n") == 3) & top).select("graph_id", "vertex_id", "path")
        degree = usable.select("graph_id", F.explode(F.array("u", "v")).alias("vertex_id")).groupBy("graph_id", "vertex_id").agg(F.count(F.lit(1)).alias("d"))
        threes = threes.join(degree, ["graph_id", "vertex_id"])
        least = threes.groupBy("graph_id", "path").agg(F.min(F.struct("d", "vertex_id")).alias("b")).select("graph_id", "path", F.col("b.vertex_id").alias("off"))
        threes = threes.join(least, ["graph_id", "path"]).select("graph_id", "vertex_id", "path", (F.col("vertex_id") != F.col("off")).alias("turn"))
        wide = materialize(sized.where((F.col("n") > 3) | ((F.col("n") == 3) & ~top)).select("graph_id", "vertex_id", "path"), "wide")
        turned = twos.unionByName(threes)
        if not wide.isEmpty():
            turned = turned.unionByName(_cut_parts(usable, wide))
        spent, now = now, materialize(turned.select("graph_id", "vertex_id", F.concat("path", F.col("turn").cast("int").cast("string")).alias("path")), "parts")
        forget(spent, wide)
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"parts did not settle in {max_rounds} rounds")


def _cut_parts(usable: DataFrame, wide: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, path, turn`` of parts that a spectral order and a minimum cut part in two."""
    key = F.to_json(F.struct(F.col("graph_id").alias("g"), F.col("path").alias("p")))
    own = materialize(wide.select("graph_id", "vertex_id", key.alias("key")), "own")
    ends = usable
    for end in ("u", "v"):
        ends = ends.join(own.select("graph_id", F.col("vertex_id").alias(end), F.col("key").alias("k" + end)), ["graph_id", end], "left")
    # an edge within a part is one of it; any other is one of each part that holds an end
    outside = F.lit(OUTSIDE)
    inner = F.coalesce(F.col("ku") == F.col("kv"), F.lit(False))
    row = lambda k, u, v: F.struct(F.col(k).alias("graph_id"), u.alias("u"), v.alias("v"))
    rows = F.when(inner, F.array(row("ku", F.col("u"), F.col("v")))).otherwise(F.array(row("ku", F.col("u"), outside), row("kv", F.col("v"), outside)))
    part_edges = materialize(ends.select(F.inline(rows)).where("graph_id is not null"), "part_edges")
    vertices = own.select(F.col("key").alias("graph_id"), "vertex_id").unionByName(part_edges.where(F.col("v") == outside).select("graph_id", F.col("v").alias("vertex_id")).distinct())
    order = materialize(spectral_order(part_edges, materialize(vertices, "vertices"), TOLERANCE, ROUNDS)[0], "order")
    count = order.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    third = F.ceil(F.col("n") / 3)
    ranked = order.join(count, "graph_id").select("graph_id", "vertex_id", F.when(F.col("place") <= third, "source").when(F.col("place") > F.col("n") - third, "target").alias("side"))
    sides = minimum_cut(part_edges, materialize(ranked.where("side is not null"), "terminals")).sides
    # free vertices without an edge lie nowhere: on the source's side
    placed = own.join(sides.select(F.col("graph_id").alias("key"), "vertex_id", "side"), ["key", "vertex_id"], "left")
    back = F.from_json("key", "g string, p string")["p"]
    return placed.select("graph_id", "vertex_id", back.alias("path"), F.coalesce(F.col("side") == "target", F.lit(False)).alias("turn"))


def split_merges(edges: DataFrame) -> DataFrame:
    """Merges (graph_id, left_id, right_id, new_id) that undo ``split_parts`` from the bottom up, new nodes numbered on from the graph's greatest vertex."""
    leaves = materialize(split_parts(edges), "paths")
    start = F.instr("path", ":")
    cuts = leaves.where(F.length("path") > start).select("graph_id", F.explode(F.transform(F.sequence(start, F.length("path") - 1), lambda k: F.substring(F.col("path"), F.lit(1), k))).alias("path")).distinct()
    depth = (-F.length("path")).alias("depth")
    top = leaves.groupBy("graph_id").agg(F.max("vertex_id").alias("top"))
    inner = number_rows(cuts.select("graph_id", "path", depth), ["graph_id"], ["depth", "path"], "n").join(top, "graph_id")
    inner = materialize(inner.select("graph_id", "path", (F.col("top") + F.col("n")).alias("node")), "inner")
    nodes = inner.unionByName(leaves.select("graph_id", "path", F.col("vertex_id").alias("node")))
    child = nodes.where(~F.col("path").endswith(":")).select("graph_id", F.expr("substring(path, 1, length(path) - 1)").alias("path"), F.col("node").alias("child"))
    pairs = child.groupBy("graph_id", "path").agg(F.min("child").alias("left_id"), F.max("child").alias("right_id"))
    return pairs.join(inner, ["graph_id", "path"]).select("graph_id", "left_id", "right_id", F.col("node").alias("new_id"))


def planned_merges(edges: DataFrame, measure: str = "outdegree") -> DataFrame:
    """Merges of ``split_merges`` with the cheapest root, rotated until nothing gets cheaper."""
    merges = materialize(split_merges(edges), "merges")
    if merges.isEmpty():
        return merges
    tree = merge_tree(edges, merges)
    best = materialize(rerooted(edges, tree, measure), "rerooted")
    tree.forget()
    return rotated(edges, best, measure)


def rounds_of(edges: DataFrame, merges: DataFrame) -> list[DataFrame]:
    """A merge tree as rounds, as ``merge_rounds`` gives them: ``graph_id, left_id, right_id, shared, boundary``, a cluster going on under its smallest vertex.

    A round holds the merges of one height, of all graphs; so they number as the
    highest tree's levels.
    """
    tree = merge_tree(edges, merges)
    names = materialize(node_extremes(tree), "nodes")
    ends = edges.where("u <> v").select("graph_id", "edge_name", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    met = with_common_ancestor(ends, "u", "v", tree).where("lca is not null").groupBy("graph_id", F.col("lca").alias("new_id")).agg(F.sort_array(F.collect_set("edge_name")).alias("shared"))
    flat = tree.merges.join(names.select("graph_id", F.col("node").alias("new_id"), "height"), ["graph_id", "new_id"])
    for c in ("left_id", "right_id"):
        flat = flat.join(names.select("graph_id", F.col("node").alias(c), F.col("least").alias("__" + c)), ["graph_id", c])
    flat = flat.join(met, ["graph_id", "new_id"], "left").join(outdegrees(edges, tree).select("graph_id", F.col("node").alias("new_id"), F.col("outdegree").alias("boundary")), ["graph_id", "new_id"])
    none = F.array().cast(edges.select(F.array("edge_name")).schema[0].dataType)
    flat = materialize(flat.select("graph_id", "height", F.least("__left_id", "__right_id").alias("left_id"), F.greatest("__left_id", "__right_id").alias("right_id"), F.coalesce("shared", none).alias("shared"), "boundary"), "rounds")
    tree.forget()
    most = flat.agg(F.max("height")).first()[0] or 0
    return [flat.where(F.col("height") == h).drop("height") for h in range(1, most + 1)]

