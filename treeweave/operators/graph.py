"""Graph operators over edge tables of many graphs at once.

An edge table has ``graph_id, edge_name, u, v`` and any attributes. Parallel
edges and self loops are rows like any other; ``edge_name`` tells edges of a
graph apart. Every operator groups by graph and vertex, so that a table of many
graphs is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeweave.functions.partitions import log_bell
from treeweave.operators.components import connected_components
from treeweave.runtime import col_of


def ends(edges: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, edge_name, other``: each edge once for each of its ends, self loops twice."""
    side = F.array(F.struct(F.col("u").alias("vertex_id"), F.col("v").alias("other")), F.struct(F.col("v").alias("vertex_id"), F.col("u").alias("other")))
    return edges.select("graph_id", "edge_name", F.explode(side).alias("s")).select("graph_id", "s.vertex_id", "edge_name", "s.other")


def degrees(edges: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, degree``; a self loop counts twice, as does each parallel edge once. Counted before the shuffle."""
    return ends(edges).groupBy("graph_id", "vertex_id").agg(F.count(F.lit(1)).alias("degree"))


def incident(edges: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, edges``: the sorted names of each vertex's edges, each once."""
    return ends(edges).groupBy("graph_id", "vertex_id").agg(F.sort_array(F.collect_set("edge_name")).alias("edges"))


def pair_multiplicity(edges: DataFrame) -> DataFrame:
    """``graph_id, u, v, m``: number of edges between each pair of vertices, u <= v."""
    pair = edges.select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pair.groupBy("graph_id", "u", "v").agg(F.count(F.lit(1)).alias("m"))


def induced_by_vertices(edges: DataFrame, vertices: DataFrame, keep: Column) -> DataFrame:
    """Edges whose two ends both pass ``keep``, a condition on the vertex table."""
    good = vertices.where(keep).select("graph_id", "vertex_id").distinct()
    for end in ("u", "v"):
        edges = edges.join(good.withColumnRenamed("vertex_id", end), ["graph_id", end], "left_semi")
    return edges


def filter_out_edges(edges: DataFrame, drop: Column, remove_vertices: bool = False) -> DataFrame:
    """Edges that don't match ``drop``.

    With ``remove_vertices``, a vertex goes unless an edge that doesn't match
    ends there, and all edges between the vertices that stay are kept.
    """
    good = edges.where(~F.coalesce(drop, F.lit(False)))
    if not remove_vertices:
        return good
    return induced_by_vertices(edges, ends(good).select("graph_id", "vertex_id"), F.lit(True))


def defects(edges: DataFrame) -> DataFrame:
    """``graph_id, kind, edge_name`` of self loops and of names that several edges of a graph bear."""
    loops = edges.where("u = v").select("graph_id", F.lit("self_loop").alias("kind"), "edge_name")
    names = edges.groupBy("graph_id", "edge_name").count().where("count > 1")
    return loops.unionByName(names.select("graph_id", F.lit("duplicate_name").alias("kind"), "edge_name"))


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move edge ends along ``mapping`` (graph_id, vertex_id, new_id); edges inside a new vertex vanish.

    Vertices without a row keep their id; names and other columns stay, so
    parallel edges can arise. ``mapping`` has one row for each vertex at most.
    """
    for end in ("u", "v"):
        m = mapping.select("graph_id", F.col("vertex_id").alias(end), F.col("new_id").alias("__new"))
        edges = edges.join(m, ["graph_id", end], "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return edges.where("u <> v")


def boundaries(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """``graph_id, cluster, outdegree``: edges that leave each cluster of ``clusters`` (graph_id, vertex_id, cluster)."""
    mine = clusters.select("graph_id", F.col("vertex_id").alias("u"), F.col("cluster").alias("cu"))
    both = edges.join(mine, ["graph_id", "u"]).join(mine.select("graph_id", F.col("u").alias("v"), F.col("cu").alias("cv")), ["graph_id", "v"])
    left = both.where("cu <> cv").select("graph_id", F.explode(F.array("cu", "cv")).alias("cluster"))
    counted = left.groupBy("graph_id", "cluster").agg(F.count(F.lit(1)).alias("outdegree"))
    named = clusters.select("graph_id", "cluster").distinct()
    return named.join(counted, ["graph_id", "cluster"], "left").select("graph_id", "cluster", F.coalesce("outdegree", F.lit(0)).cast("long").alias("outdegree"))


def merge_priorities(edges: DataFrame, counts: DataFrame | None = None, merged: DataFrame | None = None, merged_cost: int = 1) -> DataFrame:
    """``graph_id, u, v, m, outdegree, product, indegree, maxdegree, degrees, diff, diffinv, boundary`` of merging each adjacent pair.

    outdegree = d(u) + d(v) - 2m: edges of the merged vertex; product = (d(u) -
    m)(d(v) - m); indegree = m, the edges that vanish inside; maxdegree and
    degrees: the greater and the product of d(u) and d(v); diff = degrees less
    the logarithm of the number of set partitions of outdegree edges, and
    diffinv its negative; boundary = outdegree, and ``merged_cost`` more where
    both or neither of the two are in ``merged`` (graph_id, vertex_id), so that
    clusters rather take up single vertices. With ``counts`` (graph_id,
    vertex_id, n: candidates of each vertex), degrees is the product of the two
    counts and diff takes the sum of their logarithms instead. Several metrics
    order lexicographically as a struct.
    """
    d = degrees(edges)
    pairs = pair_multiplicity(edges.where("u <> v"))
    for end in ("u", "v"):
        pairs = pairs.join(d.select("graph_id", F.col("vertex_id").alias(end), F.col("degree").alias(f"d{end}")), ["graph_id", end])
        if counts is not None:
            pairs = pairs.join(counts.select("graph_id", F.col("vertex_id").alias(end), F.col("n").alias(f"n{end}")), ["graph_id", end])
        if merged is not None:
            pairs = pairs.join(merged.select("graph_id", F.col("vertex_id").alias(end), F.lit(True).alias(f"m{end}")), ["graph_id", end], "left")
    weight = F.col("du") * F.col("dv") if counts is None else F.col("nu") * F.col("nv")
    size = weight if counts is None else F.log("nu") + F.log("nv")
    alike = F.lit(True) if merged is None else F.col("mu").isNull() == F.col("mv").isNull()
    pairs = pairs.withColumn("outdegree", F.col("du") + F.col("dv") - 2 * F.col("m")).withColumn("diff", size - log_bell(F.col("outdegree")))
    return pairs.select(
        "graph_id", "u", "v", "m", "outdegree", ((F.col("du") - F.col("m")) * (F.col("dv") - F.col("m"))).alias("product"), F.col("m").alias("indegree"),
        F.greatest("du", "dv").alias("maxdegree"), weight.alias("degrees"), "diff", (-F.col("diff")).alias("diffinv"),
        (F.col("outdegree") + F.when(alike, F.lit(merged_cost)).otherwise(F.lit(0))).alias("boundary"),
    )


def chains(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """``graph_id, edge_name, chain_id``: edges linked through vertices of degree 2.

    ``stops`` (graph_id, vertex_id) names vertices that end a chain whatever
    their degree. chain_id is the smallest edge name of the chain. Links are
    made by name alone, and components settle in a logarithmic number of rounds,
    so a long chain is no long loop.
    """
    two = degrees(edges).where("degree = 2").select("graph_id", "vertex_id")
    if stops is not None:
        two = two.join(stops, ["graph_id", "vertex_id"], "left_anti")
    through = ends(edges).join(two, ["graph_id", "vertex_id"]).groupBy("graph_id", "vertex_id")
    links = through.agg(F.min("edge_name").alias("a"), F.max("edge_name").alias("b")).where("a < b")
    key = lambda c: F.struct(F.col("graph_id"), F.col(c))
    pair = links.select(key("a").cast("struct<graph_id:string,name:int>").alias("src"), key("b").cast("struct<graph_id:string,name:int>").alias("dst"))
    found = connected_components(pair).select("vertex.graph_id", F.col("vertex.name").alias("edge_name"), F.col("component.name").alias("chain_id"))
    named = edges.select("graph_id", "edge_name").distinct().join(found, ["graph_id", "edge_name"], "left")
    return named.select("graph_id", "edge_name", F.coalesce("chain_id", "edge_name").alias("chain_id"))


def compact_chains(edges: DataFrame) -> DataFrame:
    """``graph_id, chain_id, n_edges, a, b``: chains of degree-2 vertices as one edge each, a <= b their ends.

    A cycle of degree-2 vertices has no ends: a and b are null. A chain that
    returns to its junction has the junction as both ends. Where edges have
    ``len``, the chain has its sum; with ``edges`` kept in ``names`` (sorted), a
    compacted edge can be told back to what it stands for.
    """
    c = chains(edges)
    junctions = degrees(edges).where("degree <> 2").select("graph_id", "vertex_id")
    at_end = ends(edges).join(junctions, ["graph_id", "vertex_id"]).join(c, ["graph_id", "edge_name"])
    tips = at_end.groupBy("graph_id", "chain_id").agg(F.min("vertex_id").alias("a"), F.max("vertex_id").alias("b"))
    extra = []
    if "len" in edges.columns:
        c = c.join(edges.select("graph_id", "edge_name", "len"), ["graph_id", "edge_name"])
        extra = [F.sum("len").alias("len"), F.sort_array(F.collect_list("edge_name")).alias("names")]
    sizes = c.groupBy("graph_id", "chain_id").agg(F.count(F.lit(1)).alias("n_edges"), *extra)
    return sizes.join(tips, ["graph_id", "chain_id"], "left").select("graph_id", "chain_id", "n_edges", "a", "b", *(["len", "names"] if extra else []))


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge, that of the smallest name, for each pair of vertices; self loops go."""
    first = edges.where("u <> v").groupBy("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return first.agg(F.min("edge_name").alias("edge_name"))


def graph_components(edges: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, component``: the smallest vertex of each vertex's component."""
    kind = "struct<graph_id:string,v:bigint>"
    pair = [F.struct(col_of("graph_id"), col_of(c)).cast(kind).alias(n) for c, n in (("u", "src"), ("v", "dst"))]
    found = connected_components(edges.select(*pair))
    return found.select("vertex.graph_id", F.col("vertex.v").alias("vertex_id"), F.col("component.v").alias("component"))
