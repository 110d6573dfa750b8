"""Shortest paths and the orientations that follow from them, by relaxation rounds over many graphs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.operators.graph import chains, degrees, ends
from treeweave.runtime import forget, materialize

#: Rounds whose distances stay tables of their own before they are made one.
ROUNDS_APART = 12


def _half_edges(edges: DataFrame, length: str) -> DataFrame:
    """``graph_id, e, x, y, w``: each usable edge in both directions."""
    usable = edges.where(F.col(length).isNotNull() & (F.col("u") != F.col("v"))).select("graph_id", F.col("edge_name").alias("e"), "u", "v", F.col(length).alias("w"))
    return usable.select("graph_id", "e", F.col("u").alias("x"), F.col("v").alias("y"), "w").union(usable.select("graph_id", "e", "v", "u", "w"))


def compacted_moves(edges: DataFrame, roots: DataFrame, length: str) -> DataFrame:
    """``graph_id, x, y, w, inner``: ways along whole chains, from x to the junction, leaf or root y that ends the chain.

    inner tells whether x is a vertex of degree 2 inside the chain. Ways are
    doubled round by round, so a chain of n edges takes about log n rounds; a
    ring without a root leads nowhere and has no rows. Edge names tell the edges
    of a graph apart.
    """
    half = _half_edges(edges, length)
    inner = half.groupBy("graph_id", "x").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("graph_id", "x").join(roots.select("graph_id", F.col("vertex_id").alias("x")), ["graph_id", "x"], "left_anti")
    half = materialize(half.join(inner.withColumn("inner", F.lit(True)), ["graph_id", "x"], "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "half")
    # the next edge of a way that enters an inner vertex is that vertex's other one
    onward = half.where("inner").select("graph_id", F.col("x").alias("y"), F.col("e").alias("next"))
    ways = half.join(onward, ["graph_id", "y"], "left").where("next is null or next <> e")
    ways = materialize(ways.select("graph_id", "e", "x", "inner", "y", "w", "next"), "ways")
    open_ = ways.where("next is not null").count()
    while open_:
        rest = ways.where("next is not null").select("graph_id", F.col("e").alias("next"), F.col("x").alias("y"), F.col("y").alias("__y"), F.col("w").alias("__w"), F.col("next").alias("__next"))
        going = ways.where("next is not null").join(rest.unionByName(ways.where("next is null").select("graph_id", F.col("e").alias("next"), F.col("x").alias("y"), F.col("y").alias("__y"), F.col("w").alias("__w"), F.col("next").alias("__next"))), ["graph_id", "next", "y"])
        going = going.select("graph_id", "e", "x", "inner", F.col("__y").alias("y"), (F.col("w") + F.col("__w")).alias("w"), F.col("__next").alias("next"))
        spent, ways = ways, materialize(ways.where("next is null").unionByName(going), "ways")
        forget(spent)
        left = ways.where("next is not null").count()
        if left == open_:  # only rings are left: they shrink no more
            break
        open_ = left
    forget(half)
    return ways.where("next is null").groupBy("graph_id", "x", "y", "inner").agg(F.min("w").alias("w"))


def _nearest(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("graph_id", "vertex_id").agg(F.min("dist").alias("dist"))


def shortest_paths(edges: DataFrame, roots: DataFrame, length: str = "len", max_rounds: int = 10_000) -> DataFrame:
    """``graph_id, vertex_id, dist``: the least sum of ``length`` from the graph's root.

    ``roots`` has graph_id and vertex_id. Lengths must not be negative; edges of
    null length are no way. Unreached vertices have no row. Chains of degree-2
    vertices are one way each while distances settle, and their vertices are
    filled in at the end. Each round relaxes only the ways of vertices that came
    nearer in the round before, and writes only those that come nearer now: an
    anti-join drops the rest, and what is known is neither grouped nor written
    again but every ROUNDS_APART rounds. The rounds number about the junctions on
    the longest shortest path.
    """
    ways = materialize(compacted_moves(edges, roots, length), "ways")
    moves = ways.where("not inner").select("graph_id", F.col("x").alias("vertex_id"), F.col("y").alias("other"), "w")
    zero = F.lit(0).cast(ways.schema["w"].dataType)
    fresh = materialize(roots.select("graph_id", "vertex_id", zero.alias("dist")).distinct(), "dist")
    told = [fresh]
    for _ in range(max_rounds):
        reach = fresh.join(moves, ["graph_id", "vertex_id"]).groupBy("graph_id", F.col("other").alias("vertex_id")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        known = reduce(DataFrame.unionByName, told).select(F.col("graph_id").alias("__g"), F.col("vertex_id").alias("__v"), F.col("dist").alias("__d"))
        near = (F.col("graph_id") == F.col("__g")) & (F.col("vertex_id") == F.col("__v")) & (F.col("__d") <= F.col("dist"))
        fresh = materialize(reach.join(known, near, "left_anti"), "dist")
        if fresh.isEmpty():
            break
        told.append(fresh)
        if len(told) == ROUNDS_APART:
            whole = materialize(_nearest(told), "dist")
            forget(*told[:-1])
            told = [whole, fresh]
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    settled = materialize(_nearest(told), "dist")
    forget(*told, fresh)
    ends_ = settled.select("graph_id", F.col("vertex_id").alias("y"), "dist")
    filled = ways.where("inner").join(ends_, ["graph_id", "y"]).groupBy("graph_id", F.col("x").alias("vertex_id")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
    return settled.unionByName(filled)


def hop_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, level``: hops from the root."""
    hops = edges.select("graph_id", "edge_name", "u", "v", F.lit(1).cast("long").alias("hop"))
    return shortest_paths(hops, roots, "hop").withColumnRenamed("dist", "level")


def orient(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """``graph_id, edge_name, parent, child``: each edge leads from the end with the smaller (dist, id) to the other.

    Edges with an unreached end have no direction and no row; nor have self loops.
    """
    d = dist.select("graph_id", F.col("vertex_id").alias("u"), F.col("dist").alias("du"))
    both = edges.where("u <> v").join(d, ["graph_id", "u"]).join(d.toDF("graph_id", "v", "dv"), ["graph_id", "v"])
    forth = F.struct("du", "u") < F.struct("dv", "v")
    return both.select("graph_id", "edge_name", F.when(forth, F.col("u")).otherwise(F.col("v")).alias("parent"), F.when(forth, F.col("v")).otherwise(F.col("u")).alias("child"))


def repair(directions: DataFrame, dist: DataFrame, roots: DataFrame) -> DataFrame:
    """Directions in which no vertex of degree 2 but a root has two parents.

    Such a vertex lies where two shortest paths meet inside a chain. Of its two
    half chains, each up to a junction or the root, the one whose far end has
    the greater (dist, id) turns round. Takes and returns ``graph_id, edge_name,
    parent, child``.
    """
    edges = directions.select("graph_id", "edge_name", F.col("parent").alias("u"), F.col("child").alias("v"))
    two = degrees(edges).where("degree = 2").select("graph_id", "vertex_id").join(roots.select("graph_id", "vertex_id"), ["graph_id", "vertex_id"], "left_anti")
    into = directions.groupBy("graph_id", F.col("child").alias("vertex_id")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    meets = materialize(into.join(two, ["graph_id", "vertex_id"]).select("graph_id", "vertex_id"), "meets")
    if meets.isEmpty():
        return directions
    half = materialize(chains(edges, meets.unionByName(roots.select("graph_id", "vertex_id"))), "halves")
    touching = materialize(ends(edges).join(half, ["graph_id", "edge_name"]).select("graph_id", "chain_id", "vertex_id").distinct(), "touching")
    # the far end of a half chain: its tip that isn't the meeting vertex
    inner = two.join(meets, ["graph_id", "vertex_id"], "left_anti")
    tips = touching.join(inner, ["graph_id", "vertex_id"], "left_anti").join(meets, ["graph_id", "vertex_id"], "left_anti").join(dist, ["graph_id", "vertex_id"])
    far = tips.groupBy("graph_id", "chain_id").agg(F.max(F.struct("dist", F.col("vertex_id").alias("tip"))).alias("far"))
    sides = touching.join(meets, ["graph_id", "vertex_id"]).join(far, ["graph_id", "chain_id"], "left")
    turned = sides.groupBy("graph_id", "vertex_id").agg(F.max(F.struct("far", "chain_id")).alias("m"), F.count(F.lit(1)).alias("n")).where("n = 2").select("graph_id", F.col("m.chain_id").alias("chain_id")).distinct()
    flips = half.join(turned, ["graph_id", "chain_id"]).select("graph_id", "edge_name", F.lit(True).alias("flip"))
    both = directions.join(flips, ["graph_id", "edge_name"], "left")
    turn = F.coalesce("flip", F.lit(False))
    return both.select("graph_id", "edge_name", F.when(turn, F.col("child")).otherwise(F.col("parent")).alias("parent"), F.when(turn, F.col("parent")).otherwise(F.col("child")).alias("child"))
