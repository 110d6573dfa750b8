"""The exact solver: merge clusters round by round, keep the cheapest state of each boundary, then walk back.

A state of a cluster is a directed partition of the edges that leave it, with
the least cost at which its inside can be chosen. Two clusters' states fit if
each shared edge leaves one and enters the other, an equality of two keys and
so a plain join, and if their blocks join without a cycle. The cheapest state of
each boundary survives: a min-plus join and a grouped minimum, for all pairs of
a round and all graphs at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.functions.partitions import code, joined_blocks, outgoing
from treeweave.operators.beam import Beam, prune
from treeweave.operators.candidates import canonicalised
from treeweave.operators.graph import degrees
from treeweave.plans.merge_order import merge_rounds, with_origins
from treeweave.plans.split_tree import planned_merges, rounds_of
from treeweave.runtime import materialize


#: Without a beam, no cluster may have more edges on its boundary: 10 edges have 2,237,921 directed partitions.
MAX_BOUNDARY = 10
#: Rounds that are walked back between two writes.
WALK = 3


@dataclass(frozen=True)
class Solution:
    """status: graph_id, status (solved, infeasible, disconnected or too_wide), cost (null unless solved); choices: graph_id, vertex_id, blocks, incoming, cost of solved graphs."""

    status: DataFrame
    choices: DataFrame


def initial_states(candidates: DataFrame) -> DataFrame:
    """Every candidate as the state of a cluster of one vertex."""
    c = canonicalised(candidates)
    return c.select("graph_id", F.col("vertex_id").alias("cluster"), "blocks", "incoming", "cost", code(F.col("blocks"), F.col("incoming")).alias("key"))


def min_plus_join(states: DataFrame, pairs: DataFrame, directed: bool = True) -> DataFrame:
    """States of the merged clusters, with where they came from.

    ``pairs``: graph_id, left_id, right_id and the shared edges. Returns
    graph_id, cluster (the left id), blocks, incoming, cost, key, left_key,
    right_id and right_key. The direction test is the join key, so it runs
    before the block test; ties fall to the smaller (left_key, right_key). With
    ``directed=False`` directions don't count: only blocks must fit, and states
    of equal blocks are one.
    """
    if not directed:
        plain = states.withColumn("incoming", F.array().cast("array<int>")).withColumn("key", code(F.col("blocks"), F.array().cast("array<int>")))
        states = plain.groupBy("graph_id", "cluster", "blocks", "incoming", "key").agg(F.min("cost").alias("cost"))
    s = F.col("shared")
    left = states.join(pairs.select("graph_id", F.col("left_id").alias("cluster"), "right_id", "shared"), ["graph_id", "cluster"])
    left = left.select("graph_id", "cluster", "right_id", "shared", F.col("blocks").alias("lb"), F.col("incoming").alias("li"), F.col("cost").alias("lc"), F.col("key").alias("left_key"),
                       (F.array_join(F.sort_array(F.array_intersect("incoming", s)).cast("array<string>"), ",") if directed else F.lit("")).alias("way"))
    right = states.join(pairs.select("graph_id", F.col("right_id").alias("cluster"), "shared"), ["graph_id", "cluster"])
    right = right.select("graph_id", F.col("cluster").alias("right_id"), F.col("blocks").alias("rb"), F.col("incoming").alias("ri"), F.col("cost").alias("rc"), F.col("key").alias("right_key"),
                         (F.array_join(F.sort_array(F.array_intersect(outgoing(F.col("blocks"), F.col("incoming")), s)).cast("array<string>"), ",") if directed else F.lit("")).alias("way"))
    both = left.join(right, ["graph_id", "right_id", "way"])
    closed = F.size(F.array_except(F.flatten("lb"), s)) + F.size(F.array_except(F.flatten("rb"), s)) == 0
    joined = both.select(
        "graph_id", "cluster", "right_id", joined_blocks(F.col("lb"), F.col("rb"), s, closed).alias("blocks"),
        F.sort_array(F.array_except(F.array_union("li", "ri"), s)).alias("incoming"), (F.col("lc") + F.col("rc")).alias("cost"), "left_key", "right_key",
    ).where("blocks is not null")
    best = joined.groupBy("graph_id", "cluster", "right_id", "blocks", "incoming").agg(F.min(F.struct("cost", "left_key", "right_key")).alias("b"))
    return best.select("graph_id", "cluster", "blocks", "incoming", "b.cost", code(F.col("blocks"), F.col("incoming")).alias("key"), "b.left_key", "right_id", "b.right_key")


def solve(edges: DataFrame, candidates: DataFrame, priority: str | tuple[str, ...] = "outdegree", beam: Beam | None = None, protected: DataFrame | None = None, max_boundary: int = MAX_BOUNDARY) -> Solution:
    """Choose one candidate for each vertex so that the split graph is one directed tree of least cost.

    ``edges``: graph_id, edge_name (unique in its graph), u, v. ``candidates``:
    graph_id, vertex_id, blocks, incoming, cost. Each round writes the states of
    its merged clusters, and reads those of the rounds in which its clusters were
    made; no state is written twice. A ``beam`` prunes each new cluster's states;
    the result then is a tree, maybe not the cheapest, or infeasible.
    ``protected`` (graph_id, vertex_id, blocks, incoming) is one choice for each
    vertex whose states the beam keeps. Graphs of several components are
    disconnected; graphs without a fitting choice are infeasible. Self loops fit
    no tree: infeasible. The states of a cluster grow with its boundary as
    directed partitions do, so without a beam a graph in whose merge order a
    cluster has more than ``max_boundary`` edges is not solved: its status is
    too_wide, and the others go on. ``priority``: one or more of ``PRIORITIES``,
    or ``split`` for a merge tree from cuts, re-rooted and rotated.
    """
    loops = edges.where("u = v").select("graph_id").distinct().withColumn("loop", F.lit(True))
    rounds = rounds_of(edges, planned_merges(edges)) if priority == "split" else merge_rounds(edges, priority)
    wide = None
    if not beam and rounds:
        planned = reduce(DataFrame.unionByName, [r.select("graph_id", "boundary") for r in rounds])
        wide = materialize(planned.where(F.col("boundary") > max_boundary).select("graph_id").distinct(), "wide")
        if not wide.isEmpty():
            rounds = [materialize(r.join(wide, "graph_id", "left_anti"), "pairs") for r in rounds]
            candidates = candidates.join(wide, "graph_id", "left_anti")
    states = materialize(initial_states(candidates).withColumn("own", F.lit(False)) if protected is None else _marked(candidates, protected), "states")
    tables, history = {-1: states}, []
    plan = materialize(with_origins(rounds), "plan") if rounds else None
    sources: dict[int, list[int]] = {}
    for r in plan.select("round", F.explode(F.array("left_from", "right_from")).alias("made")).distinct().collect() if rounds else ():
        sources.setdefault(r["round"], []).append(r["made"])  # a few numbers for each round
    for i in range(len(rounds)):
        pairs = plan.where(F.col("round") == i)
        sides = pairs.select("graph_id", F.inline(F.array(*[F.struct(F.col(f"{x}_id").alias("cluster"), F.col(f"{x}_from").alias("made")) for x in ("left", "right")])))
        parts = [tables[m].join(sides.where(F.col("made") == m).select("graph_id", "cluster"), ["graph_id", "cluster"], "left_semi") for m in sorted(sources.get(i, ()))]
        if not parts:  # all graphs of this round are too wide
            parts = [states.where("false")]
        now = reduce(DataFrame.unionByName, parts)
        merged = min_plus_join(now.drop("own"), pairs)
        merged = merged.withColumn("own", F.lit(False)) if protected is None else _carry(merged, now, pairs)
        if beam:
            merged = prune(merged, beam, ["graph_id", "cluster"], "cost", ["key"], F.col("own") if protected is not None else None)
        merged = materialize(merged, "merged")
        history.append(merged)
        tables[i] = merged.select(states.columns)
    vertices = edges.select("graph_id", F.explode(F.array("u", "v")).alias("vertex_id")).unionByName(candidates.select("graph_id", "vertex_id")).distinct()
    return _walk_back(vertices, loops, wide, states, history, rounds)


def _walk_back(vertices: DataFrame, loops: DataFrame, wide: DataFrame | None, first: DataFrame, history: list[DataFrame], rounds: list[DataFrame]) -> Solution:
    """Status of each graph from the last states, and the choices by one join a round, last round first.

    A merge makes one cluster of two, so a graph has as many components as
    vertices less merges. The states of a whole component have no edge left.
    """
    n_vertices = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    merges, done = first.select("graph_id").where("false"), first.where(F.size(F.flatten("blocks")) == 0).select("graph_id", "cluster", "key", "cost")
    for pairs, merged in zip(rounds, history):
        merges = merges.unionByName(pairs.select("graph_id"))
        done = done.unionByName(merged.where(F.size(F.flatten("blocks")) == 0).select("graph_id", "cluster", "key", "cost"))
    n_merges = merges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    top = done.groupBy("graph_id").agg(F.min(F.struct("cost", "key", "cluster")).alias("b"))
    graphs = n_vertices.join(n_merges, "graph_id", "left").join(top, "graph_id", "left").join(loops, "graph_id", "left")
    whole = F.col("n") - F.coalesce("m", F.lit(0)) == 1
    solved = F.col("b").isNotNull() & whole & F.col("loop").isNull()
    too_wide = F.lit(False)
    if wide is not None:
        graphs = graphs.join(wide.withColumn("wide", F.lit(True)), "graph_id", "left")
        too_wide = F.col("wide").isNotNull()
    solved = solved & ~too_wide
    state = F.when(too_wide, "too_wide").when(~whole, "disconnected").when(solved, "solved").otherwise("infeasible")
    status = materialize(graphs.select("graph_id", state.alias("status"), *[F.when(solved, F.col(f"b.{c}")).alias(c) for c in ("cost", "key", "cluster")]), "status")
    wanted = status.where("status = 'solved'").select("graph_id", "cluster", "key")
    for i, merged in enumerate(reversed(history), 1):
        hit = wanted.join(merged.select("graph_id", "cluster", "key", "left_key", "right_id", "right_key"), ["graph_id", "cluster", "key"], "left")
        half = lambda c, k: F.struct(F.col(c).alias("cluster"), F.col(k).alias("key"))
        parts = F.when(F.col("left_key").isNotNull(), F.array(half("cluster", "left_key"), half("right_id", "right_key"))).otherwise(F.array(half("cluster", "key")))
        wanted = hit.select("graph_id", F.inline(parts))
        if i % WALK == 0 or i == len(history):
            wanted = materialize(wanted, "wanted")
    chosen = wanted.join(first, ["graph_id", "cluster", "key"]).select("graph_id", F.col("cluster").alias("vertex_id"), "blocks", "incoming", "cost")
    return Solution(status.select("graph_id", "status", "cost"), chosen)


def _marked(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    own = protected.select("graph_id", F.col("vertex_id").alias("cluster"), code(F.col("blocks"), F.col("incoming")).alias("key"), F.lit(True).alias("own")).distinct()
    return initial_states(candidates).join(own, ["graph_id", "cluster", "key"], "left").withColumn("own", F.coalesce("own", F.lit(False)))


def _carry(merged: DataFrame, states: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mark the merged state that the two clusters' own states make."""
    own = materialize(states.where("own").drop("own"), "own")
    made = min_plus_join(own, pairs).select("graph_id", "cluster", "key", F.lit(True).alias("own"))
    return merged.join(made, ["graph_id", "cluster", "key"], "left").withColumn("own", F.coalesce("own", F.lit(False)))


def total_cost(choices: DataFrame, edges: DataFrame, every_vertex: bool = False) -> DataFrame:
    """``graph_id, cost``: the chosen costs' sum; without ``every_vertex`` only of vertices of degree above 2 that aren't roots."""
    counted = choices
    if not every_vertex:
        wide = degrees(edges).where("degree > 2").select("graph_id", "vertex_id")
        counted = choices.where("size(incoming) > 0").join(wide, ["graph_id", "vertex_id"], "left_semi")
    return counted.groupBy("graph_id").agg(F.sum("cost").alias("cost"))


def brute_force(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``graph_id, best_cost, n_feasible`` over all combinations of candidates: a check of ``solve`` for small graphs.

    Vertices enter in order of id, and no state is dropped for a cheaper one, so
    every feasible combination is counted. The work grows with the product of
    the candidates' numbers.
    """
    order = candidates.groupBy("graph_id").agg(F.sort_array(F.collect_set("vertex_id")).alias("vs"))
    n = order.agg(F.max(F.size("vs"))).first()[0] or 0
    states = materialize(initial_states(candidates), "states")
    now = edges.where("u <> v").select("graph_id", "edge_name", "u", "v")
    so_far = order.select("graph_id", F.col("vs")[0].alias("cluster"), "vs").join(states, ["graph_id", "cluster"]).select("graph_id", "vs", "blocks", "incoming", "cost")
    for i in range(1, n):
        here = order.where(F.size("vs") > i).select("graph_id", F.col("vs")[i].alias("v_new"), F.slice("vs", 1, i).alias("before"))
        touch = now.join(here, "graph_id").where((F.array_contains("before", F.col("u")) & (F.col("v") == F.col("v_new"))) | (F.array_contains("before", F.col("v")) & (F.col("u") == F.col("v_new"))))
        shared = here.join(touch.groupBy("graph_id").agg(F.sort_array(F.collect_set("edge_name")).alias("s")), "graph_id", "left").select("graph_id", "v_new", F.coalesce("s", F.array().cast("array<int>")).alias("s"))
        way = lambda x: F.array_join(F.sort_array(F.array_intersect(x, F.col("s"))).cast("array<string>"), ",")
        left = so_far.join(shared, "graph_id").withColumn("way", way(F.col("incoming")))
        right = states.join(shared.withColumnRenamed("v_new", "cluster"), ["graph_id", "cluster"])
        right = right.select("graph_id", F.col("blocks").alias("rb"), F.col("incoming").alias("ri"), F.col("cost").alias("rc"), way(outgoing(F.col("blocks"), F.col("incoming"))).alias("way"))
        both = left.join(right, ["graph_id", "way"])
        s = F.col("s")
        closed = F.size(F.array_except(F.flatten("blocks"), s)) + F.size(F.array_except(F.flatten("rb"), s)) == 0
        grown = both.select("graph_id", "vs", joined_blocks(F.col("blocks"), F.col("rb"), s, closed).alias("blocks"), F.sort_array(F.array_except(F.array_union("incoming", "ri"), s)).alias("incoming"), (F.col("cost") + F.col("rc")).alias("cost")).where("blocks is not null")
        so_far = materialize(so_far.where(F.size("vs") <= i).unionByName(grown), "combinations")
    whole = so_far.where(F.size(F.flatten("blocks")) == 0)
    found = whole.groupBy("graph_id").agg(F.min("cost").alias("best_cost"), F.count(F.lit(1)).alias("n_feasible"))
    return order.select("graph_id").join(found, "graph_id", "left").select("graph_id", "best_cost", F.coalesce("n_feasible", F.lit(0)).cast("long").alias("n_feasible"))
