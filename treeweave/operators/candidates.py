"""Candidates of vertices: which edges stay together, which point inwards, and at what cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.functions.partitions import canonical, cost_milli, incoming_choices, partitions_of
from treeweave.operators.graph import degrees, ends, incident, simple_edges


def set_partitions(vertices: DataFrame, edges: str = "edges") -> DataFrame:
    """A row with ``blocks`` for each set partition of the edges of each row; the other columns stay."""
    return vertices.withColumn("blocks", F.explode(partitions_of(F.col(edges))))


def directed_candidates(partitions: DataFrame, root: str = "is_root", only_full: bool = True) -> DataFrame:
    """Choose directions: one incoming edge in each block; a root gets all its edges in one block, all outgoing.

    ``only_full=False`` gives roots the other partitions too, with one block of
    outgoing edges only and one incoming edge in each of the rest.
    """
    none = F.array().cast("array<int>")
    usual = incoming_choices(F.col("blocks"))
    if only_full:
        at_root = F.when(F.size("blocks") == 1, F.array(none)).otherwise(F.array().cast("array<array<int>>"))
    else:
        at_root = F.flatten(F.transform("blocks", lambda b: incoming_choices(F.filter("blocks", lambda x: x != b))))
    return partitions.withColumn("incoming", F.explode(F.when(F.col(root), at_root).otherwise(usual)))


def all_candidates(edges: DataFrame, roots: DataFrame, max_degree: int = 9) -> DataFrame:
    """``graph_id, vertex_id, blocks, incoming, cost`` with every choice of every vertex and its deterministic test cost.

    Their number grows faster than exponentially with the degree; a vertex above
    ``max_degree`` raises an error rather than dropping choices. Blocks are built
    a vertex at a time on the executors.
    """
    own = incident(edges)
    root = roots.select("graph_id", "vertex_id", F.lit(True).alias("r")).distinct()
    flagged = own.join(root, ["graph_id", "vertex_id"], "left").withColumn("is_root", F.coalesce("r", F.lit(False)))
    checked = flagged.withColumn("edges", F.when(F.size("edges") <= max_degree, F.col("edges")).otherwise(F.raise_error(F.lit(f"a vertex has more than {max_degree} edges"))))
    made = directed_candidates(set_partitions(checked))
    return made.select("graph_id", "vertex_id", "blocks", "incoming", cost_milli(F.col("blocks"), F.col("incoming"), F.col("vertex_id")).alias("cost"))


def default_candidates(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Free candidates of vertices that leave no real choice: one edge points in; of two, either points in and the other out. Roots have none here."""
    small = incident(edges).where("size(edges) <= 2").join(roots.select("graph_id", "vertex_id"), ["graph_id", "vertex_id"], "left_anti")
    return small.select("graph_id", "vertex_id", F.array("edges").alias("blocks"), F.explode("edges").alias("e")).select(
        "graph_id", "vertex_id", "blocks", F.array("e").alias("incoming"), F.lit(0).cast("long").alias("cost")
    )


def with_fixed_directions(candidates: DataFrame, directions: DataFrame) -> DataFrame:
    """Candidates whose incoming edges are exactly those that ``directions`` (graph_id, edge_name, parent, child) leads to the vertex."""
    into = directions.groupBy("graph_id", F.col("child").alias("vertex_id")).agg(F.sort_array(F.collect_set("edge_name")).alias("given"))
    both = candidates.join(into, ["graph_id", "vertex_id"], "left")
    return both.where(F.sort_array("incoming") == F.coalesce("given", F.array().cast("array<int>"))).drop("given")


def without_triangles(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that part the two edges of each degree-2 triangle.

    At a vertex of degree above 2, two neighbours of degree 2 that are adjacent
    form a triangle with it; a block that holds the edges to both would close it.
    """
    d = degrees(edges)
    two = d.where("degree = 2").select("graph_id", "vertex_id")
    # the vertices of degree 2 have two edges, so pairs are found from the edge between them: no hub lists its pairs
    base = edges.where("u <> v").select("graph_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    for end in ("a", "b"):
        base = base.join(two.withColumnRenamed("vertex_id", end), ["graph_id", end], "left_semi")
    out = ends(edges)
    reach = lambda end: out.select("graph_id", F.col("vertex_id").alias(end), F.col("other").alias("vertex_id"), F.col("edge_name").alias(f"e{end}"))
    tips = base.join(reach("a"), ["graph_id", "a"]).where("vertex_id <> b").join(reach("b"), ["graph_id", "b", "vertex_id"])
    wide = d.where("degree > 2").select("graph_id", "vertex_id")
    pairs = tips.join(wide, ["graph_id", "vertex_id"], "left_semi").groupBy("graph_id", "vertex_id").agg(F.collect_set(F.array("ea", "eb")).alias("pairs"))
    both = candidates.join(pairs, ["graph_id", "vertex_id"], "left")
    bad = F.exists("pairs", lambda p: F.exists("blocks", lambda b: F.array_contains(b, p[0]) & F.array_contains(b, p[1])))
    return both.where(~F.coalesce(bad, F.lit(False))).drop("pairs")


def free_at_roots(candidates: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Set the cost to 0 at roots and at vertices of degree 2 or less."""
    d = degrees(edges).join(roots.select("graph_id", "vertex_id", F.lit(True).alias("r")).distinct(), ["graph_id", "vertex_id"], "full")
    free = d.where("coalesce(r, false) or degree <= 2").select("graph_id", "vertex_id", F.lit(True).alias("free"))
    both = candidates.join(free, ["graph_id", "vertex_id"], "left")
    return both.withColumn("cost", F.when(F.col("free"), F.lit(0).cast(candidates.schema["cost"].dataType)).otherwise(F.col("cost"))).drop("free")


def problems(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, kind`` of candidates that can't be solved as they are.

    wrong_edges: a candidate's edges aren't the vertex's edges; no_candidate: a
    vertex without one; no_root and several_roots: not exactly one vertex of the
    graph has an all-outgoing candidate (vertex_id is null).
    """
    own = incident(edges)
    used = candidates.select("graph_id", "vertex_id", F.sort_array(F.flatten("blocks")).alias("used"), F.size("incoming").alias("n"))
    wrong = used.join(own, ["graph_id", "vertex_id"], "left").where("edges is null or edges <> used").select("graph_id", "vertex_id", F.lit("wrong_edges").alias("kind")).distinct()
    bare = own.join(candidates.select("graph_id", "vertex_id"), ["graph_id", "vertex_id"], "left_anti").select("graph_id", "vertex_id", F.lit("no_candidate").alias("kind"))
    n_roots = F.count_distinct(F.when(F.col("n") == 0, F.col("vertex_id")))
    rooted = used.groupBy("graph_id").agg(n_roots.alias("k")).where("k <> 1")
    roots = rooted.select("graph_id", F.lit(None).cast("long").alias("vertex_id"), F.when(F.col("k") == 0, "no_root").otherwise("several_roots").alias("kind"))
    return wrong.unionByName(bare).unionByName(roots)


def canonicalised(candidates: DataFrame) -> DataFrame:
    """Blocks and incoming edges in sorted form, one row for each choice with its least cost."""
    sorted_ = candidates.select("graph_id", "vertex_id", canonical(F.col("blocks")).alias("blocks"), F.sort_array("incoming").alias("incoming"), "cost")
    return sorted_.groupBy("graph_id", "vertex_id", "blocks", "incoming").agg(F.min("cost").alias("cost"))


__all__ = ["all_candidates", "canonicalised", "default_candidates", "directed_candidates", "free_at_roots", "problems", "set_partitions", "simple_edges", "with_fixed_directions", "without_triangles"]
