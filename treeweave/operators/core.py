"""Graphs drawn together to their core: dead ends fall away and chains become edges that know their length and what they stand for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.operators.graph import chains, degrees, ends
from treeweave.operators.ranking import number_rows
from treeweave.runtime import forget, materialize


@dataclass(frozen=True)
class Core:
    """edges: graph_id, edge_name, u, v, len, path (the original edges from u to v, in order); owners: graph_id, vertex_id, owner (the vertex of the core that each vertex has become part of, itself if it stays)."""

    edges: DataFrame
    owners: DataFrame


def _stops(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``graph_id, vertex_id``: roots, vertices of a degree other than 2, and the smallest vertex of each ring that has none of them."""
    fixed = materialize(degrees(edges).where("degree <> 2").select("graph_id", "vertex_id").unionByName(roots).distinct(), "stops")
    named = chains(edges, roots)
    touched = ends(edges).join(named, ["graph_id", "edge_name"]).join(fixed.withColumn("stop", F.lit(True)), ["graph_id", "vertex_id"], "left")
    rings = touched.groupBy("graph_id", "chain_id").agg(F.max("stop").alias("stop"), F.min("vertex_id").alias("vertex_id")).where("stop is null")
    return materialize(fixed.unionByName(rings.select("graph_id", "vertex_id")), "stops")


def _drawn_together(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of which each is a whole chain, and ``graph_id, vertex_id, owner`` of the vertices inside chains.

    Each edge, seen from either end, finds the end of its chain that lies ahead
    and how many edges are left to it, by doubling its way: about log n rounds
    for a chain of n edges. What leads to one last edge is one chain, in order of
    the edges left.
    """
    stops = _stops(edges, roots)
    one = F.lit(1).cast("long")
    half = edges.where("u <> v").select("graph_id", F.col("edge_name").alias("e"), F.inline(F.array(
        F.struct(F.col("u").alias("x"), F.col("v").alias("y"), F.col("path").alias("own")), F.struct(F.col("v").alias("x"), F.col("u").alias("y"), F.reverse("path").alias("own")))), "len")
    half = materialize(half, "half")
    inner = half.join(stops.withColumnRenamed("vertex_id", "x"), ["graph_id", "x"], "left_anti").select("graph_id", F.col("x").alias("y"), F.col("e").alias("next"))
    ways = half.join(inner, ["graph_id", "y"], "left").where("next is null or next <> e").select("graph_id", "e", "x", "y", "next", F.col("e").alias("last"), one.alias("left"))
    ways = materialize(ways, "ways")
    while not ways.where("next is not null").isEmpty():
        onward = ways.select("graph_id", F.col("e").alias("next"), F.col("x").alias("y"), F.col("y").alias("__y"), F.col("next").alias("__next"), F.col("last").alias("__last"), F.col("left").alias("__left"))
        going = ways.where("next is not null").join(onward, ["graph_id", "next", "y"])
        going = going.select("graph_id", "e", "x", F.col("__y").alias("y"), F.col("__next").alias("next"), F.col("__last").alias("last"), (F.col("left") + F.col("__left")).alias("left"))
        spent, ways = ways, materialize(ways.where("next is null").unionByName(going), "ways")
        forget(spent)
    rows = ways.join(half.select("graph_id", "e", "x", "own", "len"), ["graph_id", "e", "x"])
    whole = rows.groupBy("graph_id", F.col("y").alias("v"), "last").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("left"), "e", "x", "own"))).alias("parts"), F.sum("len").alias("len")
    )
    chain = whole.select("graph_id", F.col("parts")[0]["x"].alias("u"), "v", "len", F.flatten("parts.own").alias("path"), F.col("parts")[0]["e"].alias("first"), "last", F.array_min("parts.e").alias("edge_name"), F.expr("transform(slice(parts, 2, size(parts)), p -> p.x)").alias("inside"))
    # either direction gives the chain: the one from the smaller end, or else from the smaller edge, stays
    chain = materialize(chain.where("u < v or (u = v and first <= last)"), "chains")
    owners = chain.select("graph_id", F.explode("inside").alias("vertex_id"), F.col("u").alias("owner"))
    forget(half, ways)
    loops = edges.where("u = v").select("graph_id", "edge_name", "u", "v", "len", "path")  # chains of rounds before
    return chain.select("graph_id", "edge_name", "u", "v", "len", "path").unionByName(loops), owners


def core_graph(edges: DataFrame, roots: DataFrame, length: str = "len", max_rounds: int = 1000) -> Core:
    """Every graph without its dead ends and with each chain of degree-2 vertices as one edge.

    ``edges``: graph_id, edge_name (unique in its graph), u, v and a length;
    ``roots`` (graph_id, vertex_id) are vertices that stay whatever their degree.
    A round makes chains to edges and then takes away the edges that end in a
    vertex of degree 1, so rounds number about the logarithm of the greatest
    graph's size, not its depth. A contracted edge bears the smallest name of its
    path, and lengths add up along the path. Self loops fall away. A ring that
    hangs on nothing keeps its smallest vertex; a graph that is a tree ends as its
    root or, without one, as its smallest vertex of the last edge.

    A leaf becomes part of the vertex that it hangs on, a vertex inside a chain
    of the chain's first end; ``owners`` composes these steps by doubling, so it
    is one map from the vertices to those of the core: ids of a merge order of
    the core need one join to become ids of the graph.
    """
    vertices = materialize(edges.select("graph_id", F.explode(F.array("u", "v")).alias("vertex_id")).distinct(), "vertices")
    kept = materialize(roots.select("graph_id", "vertex_id").distinct(), "roots")
    now = materialize(edges.where("u <> v").select("graph_id", "edge_name", "u", "v", F.col(length).alias("len"), F.array("edge_name").alias("path")), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        drawn, inside = _drawn_together(now, kept)
        drawn = materialize(drawn, "drawn")
        maps.append(inside)
        degree = degrees(drawn).join(kept.withColumn("root", F.lit(True)), ["graph_id", "vertex_id"], "left")
        tips = materialize(degree.where("degree = 1 and root is null").select("graph_id", "vertex_id"), "tips")
        if tips.isEmpty():
            break
        both = drawn
        for end in ("u", "v"):
            both = both.join(tips.select("graph_id", F.col("vertex_id").alias(end), F.lit(True).alias("tip_" + end)), ["graph_id", end], "left")
        both = materialize(both, "dead_ends")
        # of an edge with two tips the smaller end stays, as u < v
        maps.append(both.where("tip_v").select("graph_id", F.col("v").alias("vertex_id"), F.col("u").alias("owner")).unionByName(both.where("tip_u and tip_v is null").select("graph_id", F.col("u").alias("vertex_id"), F.col("v").alias("owner"))))
        now = materialize(both.where("tip_u is null and tip_v is null").select(drawn.columns), "edges")
    else:
        raise RuntimeError(f"the core was not found in {max_rounds} rounds")
    step = materialize(reduce(DataFrame.unionByName, maps), "owners")
    while True:
        onward = step.select("graph_id", F.col("vertex_id").alias("owner"), F.col("owner").alias("__owner"))
        both = materialize(step.join(onward, ["graph_id", "owner"], "left"), "owners")
        step = both.select("graph_id", "vertex_id", F.coalesce("__owner", "owner").alias("owner"))
        if both.where("__owner is not null").isEmpty():
            break
    owners = vertices.join(step, ["graph_id", "vertex_id"], "left").select("graph_id", "vertex_id", F.coalesce("owner", "vertex_id").alias("owner"))
    return Core(drawn, materialize(owners, "owners"))


def spliced(pre_merges: DataFrame, core_merges: DataFrame, owners: DataFrame) -> DataFrame:
    """A merge order of the core after the merges that led to it, as one (graph_id, step, left_id, right_id).

    ``pre_merges`` (graph_id, step, left_id, right_id) keep the owner's id for
    what they make; ``core_merges`` likewise. Steps of the core follow those
    before; a graph may lack either.
    """
    last = pre_merges.groupBy("graph_id").agg(F.max("step").alias("last"))
    known = owners.select("graph_id", F.col("owner").alias("left_id")).distinct()
    core = core_merges.join(known, ["graph_id", "left_id"], "left_semi").join(last, "graph_id", "left")
    return pre_merges.select("graph_id", "step", "left_id", "right_id").unionByName(core.select("graph_id", (F.col("step") + F.coalesce("last", F.lit(0))).alias("step"), "left_id", "right_id"))


def pre_merges(owners: DataFrame) -> DataFrame:
    """``graph_id, step, left_id, right_id``: the vertices outside the core join their owner one by one, in order of id."""
    outside = owners.where("owner <> vertex_id").select("graph_id", F.col("owner").alias("left_id"), F.col("vertex_id").alias("right_id"))
    return number_rows(outside, ["graph_id"], ["left_id", "right_id"], "step").select("graph_id", "step", "left_id", "right_id")
