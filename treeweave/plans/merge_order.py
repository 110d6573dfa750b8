"""In which order vertices merge: rounds of pairs that merge at the same time.

Any order gives the same optimum; a good one keeps few edges on the clusters'
boundaries, as the number of a cluster's states grows fast with them. A round
takes, in all graphs at once, pairs of which each is the other's cheapest
partner, and of these only merges that are free (the boundary is no greater than
the greater of the two before, as with vertices of degree 1 and 2) and those of
the graph's least boundary. They are disjoint, so one round is one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.operators.graph import contract, merge_priorities
from treeweave.runtime import forget, materialize

PRIORITIES = ("outdegree", "product", "indegree", "maxdegree", "degrees", "diff", "diffinv", "boundary", "random")


def merge_round(edges: DataFrame, priority: str | tuple[str, ...] = "outdegree", salt: int = 0, merged: DataFrame | None = None) -> DataFrame:
    """``graph_id, left_id, right_id, shared, boundary``: pairs that are each other's cheapest merge, left < right, the sorted names of the edges between them and the number of edges that leave both.

    Ties fall by a hash of the pair, so that a path of equal priorities pairs up
    all along and not from one end. Each graph with an edge between two vertices
    gives a pair at least: of the pairs of its least boundary, or free ones, the
    cheapest of all is mutual. A tuple of priorities orders lexicographically;
    ``merged`` (graph_id, vertex_id) are the clusters that ``boundary`` tells
    from single vertices.
    """
    named = (priority,) if isinstance(priority, str) else tuple(priority)
    if not named or not set(named) <= set(PRIORITIES):
        raise ValueError(f"unknown priority {priority}")
    rank = F.struct(*[(F.lit(0).cast("long") if p == "random" else F.col(p)).alias(f"p{i}") for i, p in enumerate(named)])
    pairs = merge_priorities(edges, merged=merged if "boundary" in named else None)
    if named[0] != "random":
        least = pairs.groupBy("graph_id").agg(F.min("outdegree").alias("least"))
        pairs = pairs.join(least, "graph_id").where("outdegree <= maxdegree or outdegree = least")
    pairs = pairs.withColumn("rank", F.struct(rank.alias("p"), F.xxhash64("graph_id", "u", "v", F.lit(salt)).alias("h"), "u", "v", "outdegree"))
    side = F.explode(F.array("u", "v")).alias("vertex_id")
    best = pairs.select("graph_id", "rank", side).groupBy("graph_id", "vertex_id").agg(F.min("rank").alias("rank"))
    mutual = best.groupBy("graph_id", "rank.u", "rank.v").agg(F.count(F.lit(1)).alias("n"), F.min("rank.outdegree").alias("boundary")).where("n = 2")
    pair = mutual.select("graph_id", F.col("u").alias("left_id"), F.col("v").alias("right_id"), "boundary")
    between = edges.select("graph_id", F.least("u", "v").alias("left_id"), F.greatest("u", "v").alias("right_id"), "edge_name")
    named = between.join(pair, ["graph_id", "left_id", "right_id"]).groupBy("graph_id", "left_id", "right_id", "boundary")
    return named.agg(F.sort_array(F.collect_set("edge_name")).alias("shared")).select("graph_id", "left_id", "right_id", "shared", "boundary")


def merge_rounds(edges: DataFrame, priority: str | tuple[str, ...] = "outdegree", max_rounds: int = 10_000) -> list[DataFrame]:
    """The rounds' pairs, each a written table; a merged pair goes on under the smaller id.

    Self loops take no part. Ends when no edge joins two clusters, so a connected
    graph ends as one cluster and others as one for each component.
    """
    rounds: list[DataFrame] = []
    left = materialize(edges.where("u <> v").select("graph_id", "edge_name", "u", "v"), "edges")
    while not left.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"merging took more than {max_rounds} rounds")
        merged = None
        if rounds and "boundary" in priority:
            merged = reduce(DataFrame.unionByName, [r.select("graph_id", F.col("left_id").alias("vertex_id")) for r in rounds]).distinct()
        pairs = materialize(merge_round(left, priority, len(rounds), merged), "pairs")
        rounds.append(pairs)
        mapping = pairs.select("graph_id", F.col("right_id").alias("vertex_id"), F.col("left_id").alias("new_id"))
        spent, left = left, materialize(contract(left, mapping).select("graph_id", "edge_name", "u", "v"), "edges")
        forget(spent)
    return rounds


def with_origins(rounds: list[DataFrame]) -> DataFrame:
    """All rounds' pairs with ``round``, and ``left_from`` and ``right_from``: the round whose table holds each cluster's states, -1 for a single vertex.

    A cluster keeps its smaller id, so it is the last round before in which that id was merged.
    """
    flat = reduce(DataFrame.unionByName, [r.withColumn("round", F.lit(i)) for i, r in enumerate(rounds)])
    seen = flat.select("graph_id", "round", "left_id", F.explode(F.array("left_id", "right_id")).alias("cluster"))
    came = seen.withColumn("came", F.coalesce(F.lag("round").over(W.partitionBy("graph_id", "cluster").orderBy("round")), F.lit(-1)))
    sides = came.groupBy("graph_id", "round", "left_id").agg(
        F.min(F.when(F.col("cluster") == F.col("left_id"), F.col("came"))).alias("left_from"), F.min(F.when(F.col("cluster") != F.col("left_id"), F.col("came"))).alias("right_from")
    )
    return flat.join(sides, ["graph_id", "round", "left_id"])


def merge_sequence(edges: DataFrame, priority: str | tuple[str, ...] = "outdegree") -> DataFrame:
    """``graph_id, step, left_id, right_id, new_id``: the rounds as one sequence in which each merge makes a new vertex.

    New vertices are numbered from the graph's greatest vertex id on, in order
    of rounds. Graphs are windows of their own.
    """
    rounds = merge_rounds(edges, priority)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "graph_id string, step int, left_id long, right_id long, new_id long")
    flat = rounds[0].drop("shared", "boundary").withColumn("round", F.lit(0))
    for i, r in enumerate(rounds[1:], 1):
        flat = flat.unionByName(r.drop("shared", "boundary").withColumn("round", F.lit(i)))
    top = edges.groupBy("graph_id").agg(F.max(F.greatest("u", "v")).alias("top"))
    step = F.row_number().over(W.partitionBy("graph_id").orderBy("round", "left_id"))
    numbered = flat.withColumn("step", step).join(top, "graph_id").withColumn("new_id", F.col("top") + F.col("step"))
    # a cluster lives under its smallest vertex id; what it is called at a round is its last merge before it
    made = numbered.select("graph_id", F.col("left_id").alias("slot"), F.col("round").alias("r"), F.col("new_id").alias("called"))
    for end in ("left_id", "right_id"):
        m = made.select("graph_id", F.col("slot").alias(end), "r", "called")
        named = numbered.select("graph_id", "step", "round", end).join(m, ["graph_id", end]).where("r < round").groupBy("graph_id", "step").agg(F.max("called").alias("__called"))
        numbered = numbered.join(named, ["graph_id", "step"], "left").withColumn(f"{end}_now", F.coalesce("__called", end)).drop("__called")
    return numbered.select("graph_id", "step", F.col("left_id_now").alias("left_id"), F.col("right_id_now").alias("right_id"), "new_id")
