"""The fast approximation: orient by shortest paths, then take each vertex's cheapest fitting candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.operators.candidates import canonicalised, with_fixed_directions, without_triangles
from treeweave.operators.graph import ends
from treeweave.operators.paths import orient, repair, shortest_paths


def cheapest(candidates: DataFrame) -> DataFrame:
    """For each vertex its candidate of least (cost, blocks, incoming): an aggregation that combines before the shuffle."""
    best = candidates.groupBy("graph_id", "vertex_id").agg(F.min(F.struct("cost", "blocks", "incoming")).alias("b"))
    return best.select("graph_id", "vertex_id", "b.blocks", "b.incoming", "b.cost")


def greedy(edges: DataFrame, candidates: DataFrame, roots: DataFrame, length: str = "len") -> DataFrame:
    """``graph_id, vertex_id, blocks, incoming, cost, status``: the greedy choice of each vertex.

    Edges lead away from the root along shortest paths, with chains repaired. A
    vertex takes the cheapest candidate with those directions that closes no
    degree-2 triangle (status chosen). A root takes one block of its outgoing
    edges and one for each incoming edge; its cost is that of the equal
    candidate, or null. A vertex without a fitting candidate has status
    infeasible and no choice: nothing is raised, so other graphs go on.
    """
    dist = shortest_paths(edges, roots, length)
    ways = repair(orient(edges, dist), dist, roots)
    c = canonicalised(candidates)
    at_root = roots.select("graph_id", "vertex_id").distinct()
    others = c.join(at_root, ["graph_id", "vertex_id"], "left_anti")
    best = cheapest(without_triangles(with_fixed_directions(others, ways), edges)).withColumn("status", F.lit("chosen"))
    into = ways.select("graph_id", F.col("child").alias("vertex_id"), "edge_name", F.lit(True).alias("inward"))
    own = ends(edges).join(at_root, ["graph_id", "vertex_id"], "left_semi").join(into, ["graph_id", "vertex_id", "edge_name"], "left")
    split = own.groupBy("graph_id", "vertex_id").agg(F.sort_array(F.collect_set(F.when(F.col("inward"), F.col("edge_name")))).alias("incoming"), F.sort_array(F.collect_set(F.when(F.col("inward").isNull(), F.col("edge_name")))).alias("out"))
    singles = F.transform("incoming", lambda e: F.array(e))
    blocks = F.sort_array(F.filter(F.concat(singles, F.array("out")), lambda b: F.size(b) > 0))
    root_choice = split.select("graph_id", "vertex_id", blocks.alias("blocks"), "incoming").join(c, ["graph_id", "vertex_id", "blocks", "incoming"], "left")
    root_choice = root_choice.select("graph_id", "vertex_id", "blocks", "incoming", "cost", F.lit("chosen").alias("status"))
    made = best.unionByName(root_choice)
    every = ends(edges).select("graph_id", "vertex_id").distinct().join(made.select("graph_id", "vertex_id"), ["graph_id", "vertex_id"], "left_anti")
    none = [F.lit(None).cast(made.schema[x].dataType).alias(x) for x in ("blocks", "incoming", "cost")]
    return made.unionByName(every.select("graph_id", "vertex_id", *none, F.lit("infeasible").alias("status")))
