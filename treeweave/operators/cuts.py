"""Minimum edge cuts of many graphs at once, by a preflow that is pushed in rounds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.operators.graph import pair_multiplicity
from treeweave.runtime import forget, materialize


@dataclass(frozen=True)
class Cut:
    """value: graph_id, cut (edges cut); sides: graph_id, vertex_id, side (``source`` or ``target``)."""

    value: DataFrame
    sides: DataFrame


def drawn_together(edges: DataFrame, terminals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with each graph's source set and target set as one vertex each, named by its smallest id, and ``graph_id, s, t``.

    Edges inside a set vanish; parallel edges stay. ``terminals``: graph_id,
    vertex_id, side. Graphs that lack either side have no rows.
    """
    least = lambda side: F.min(F.when(F.col("side") == side, F.col("vertex_id")))
    ends = materialize(terminals.groupBy("graph_id").agg(least("source").alias("s"), least("target").alias("t")).where("s is not null and t is not null"), "terminals")
    named = terminals.join(ends, "graph_id").select("graph_id", "vertex_id", F.when(F.col("side") == "source", F.col("s")).otherwise(F.col("t")).alias("new"))
    out = edges.join(ends, "graph_id", "left_semi")
    for end in ("u", "v"):
        out = out.join(named.select("graph_id", F.col("vertex_id").alias(end), F.col("new").alias("__new")), ["graph_id", end], "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return out.where("u <> v").select("graph_id", "u", "v"), ends


def _distances(arcs: DataFrame, ends: DataFrame) -> DataFrame:
    """``graph_id, x, h``: arcs with room left from each vertex to its graph's target; others have no row."""
    open_ = arcs.where("room > 0").select("graph_id", "x", "y")
    found = [materialize(ends.select("graph_id", F.col("t").alias("x"), F.lit(0).alias("h")), "heights")]
    while True:
        seen = reduce(DataFrame.unionByName, found)
        front = found[-1].select("graph_id", F.col("x").alias("y"), "h")
        near = open_.join(front, ["graph_id", "y"]).groupBy("graph_id", "x").agg((F.min("h") + 1).alias("h")).join(seen, ["graph_id", "x"], "left_anti")
        near = materialize(near, "heights")
        if near.isEmpty():
            forget(near)
            out = materialize(seen, "heights")
            forget(*found)
            return out
        found.append(near)


def minimum_cut(edges: DataFrame, terminals: DataFrame, max_phases: int = 10_000) -> Cut:
    """The least number of edges that part each graph's source set from its target set, and the sides that they part.

    ``edges``: graph_id, u, v, parallel edges counting each; ``terminals``:
    graph_id, vertex_id, side (``source`` or ``target``), both sets disjoint.
    Graphs that lack either side have no rows; where nothing joins the sets, the
    cut is 0. Of several least cuts it is the one with the fewest vertices on
    the target's side.

    The source fills all its edges. Then, by phases, for all graphs at once:
    distances to the target over arcs with room left, level by level; and as
    many pushes as the greatest distance of a vertex that holds too much, each
    over arcs that lead one step nearer, shared out in order of the neighbours'
    ids. A phase brings at least one unit to the target, mostly all that its
    distances allow. What can't reach the target stays where it is: a greatest
    preflow gives the cut as a flow does, and nothing has to flow back. Graphs
    in which nothing moves any more are set aside. A vertex's excess is what
    its arcs say, so the arcs are all that a push writes.
    """
    drawn, ends = drawn_together(edges, terminals)
    pairs = materialize(pair_multiplicity(drawn).select("graph_id", "u", "v", F.col("m").cast("long").alias("m")), "pairs")
    both = pairs.select("graph_id", F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y"), "m"), F.struct(F.col("v").alias("x"), F.col("u").alias("y"), "m"))))
    told = materialize(both.join(ends, "graph_id"), "arcs")
    given = materialize(told.where("x = s").select("graph_id", F.col("y").alias("x"), F.col("m").alias("given")), "given")
    # arcs without the source's; nothing can leave it, so no way leads through it
    arcs = told.where("x <> s and y <> s").join(given, ["graph_id", "x"], "left")
    now = materialize(arcs.select("graph_id", "x", "y", F.col("m").alias("size"), F.col("m").alias("room"), "t", F.coalesce("given", F.lit(0)).alias("given")), "arcs")
    open_ends = ends
    done: list[DataFrame] = []
    reach: list[DataFrame] = []
    mine = W.partitionBy("graph_id", "x")
    for _ in range(max_phases):
        h = _distances(now, open_ends)
        excess = now.where("x <> t").groupBy("graph_id", "x").agg((F.max("given") + F.sum(F.col("room") - F.col("size"))).alias("excess")).where("excess > 0")
        active = materialize(excess.join(h, ["graph_id", "x"]).groupBy("graph_id").agg(F.max("h").alias("far")), "active")
        done.append(materialize(now.join(active, "graph_id", "left_anti"), "settled"))
        reach.append(materialize(h.join(active, "graph_id", "left_anti").select("graph_id", F.col("x").alias("vertex_id")), "reach"))
        far = active.agg(F.max("far")).first()[0]
        if far is None:
            break
        level = h.join(active, "graph_id", "left_semi")
        open_ends = materialize(open_ends.join(active, "graph_id", "left_semi"), "terminals")
        spent, now = now, now.join(active, "graph_id", "left_semi")
        now = now.join(level.withColumnRenamed("h", "hx"), ["graph_id", "x"], "left").join(level.select("graph_id", F.col("x").alias("y"), F.col("h").alias("hy")), ["graph_id", "y"], "left")
        now = materialize(now.withColumn("down", F.coalesce(F.col("hx") == F.col("hy") + 1, F.lit(False))).drop("hx", "hy"), "arcs")
        forget(spent)
        for _ in range(far):
            held = F.max("given").over(mine) + F.sum(F.col("room") - F.col("size")).over(mine)
            room = F.when(F.col("down"), F.col("room")).otherwise(F.lit(0))
            before = F.coalesce(F.sum(room).over(mine.orderBy("y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            pushed = now.withColumn("push", F.when(F.col("x") == F.col("t"), F.lit(0)).otherwise(F.greatest(F.least(room, held - before), F.lit(0))))
            pushed = materialize(pushed, "pushed")
            back = pushed.where("push > 0").select("graph_id", F.col("x").alias("y"), F.col("y").alias("x"), F.col("push").alias("back"))
            spent, now = now, materialize(pushed.join(back, ["graph_id", "x", "y"], "left").withColumn("room", F.col("room") - F.col("push") + F.coalesce("back", F.lit(0))).drop("push", "back"), "arcs")
            still = not pushed.where("push > 0").isEmpty()
            forget(spent, pushed)
            if not still:
                break
        now_, now = now, materialize(now.drop("down"), "arcs")
        forget(now_, h)
    else:
        raise RuntimeError(f"cuts did not settle in {max_phases} phases")
    settled = reduce(DataFrame.unionByName, done)
    arrived = settled.where("x = t").groupBy("graph_id").agg(F.sum(F.col("room") - F.col("size")).alias("flow"))
    direct = given.join(ends.select("graph_id", F.col("t").alias("x")), ["graph_id", "x"]).select("graph_id", F.col("given").alias("direct"))
    zero = F.lit(0).cast("long")
    value = ends.join(arrived, "graph_id", "left").join(direct, "graph_id", "left").select("graph_id", (F.coalesce("flow", zero) + F.coalesce("direct", zero)).alias("cut"))
    near = reduce(DataFrame.unionByName, reach).withColumn("near", F.lit(True))
    vertices = edges.select("graph_id", F.explode(F.array("u", "v")).alias("vertex_id")).unionByName(terminals.select("graph_id", "vertex_id")).distinct().join(ends, "graph_id", "left_semi")
    fixed = terminals.select("graph_id", "vertex_id", "side").distinct()
    sides = vertices.join(near, ["graph_id", "vertex_id"], "left").join(fixed, ["graph_id", "vertex_id"], "left")
    side = F.coalesce("side", F.when(F.col("near"), "target").otherwise("source"))
    return Cut(materialize(value, "cuts"), materialize(sides.select("graph_id", "vertex_id", side.alias("side")), "sides"))
