"""Assembly of the chosen tree, and what must hold of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.operators.components import connected_components
from treeweave.operators.graph import ends
from treeweave.runtime import col_of, materialize


def tree_vertices(choices: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, copy``: one copy of a vertex for each block of its choice, numbered from 0."""
    return choices.select("graph_id", "vertex_id", F.posexplode("blocks").alias("copy", "edges")).select("graph_id", "vertex_id", "copy")


def tree_edges(edges: DataFrame, choices: DataFrame) -> DataFrame:
    """``graph_id, edge_name, u, u_copy, v, v_copy``: each edge at the copy whose block holds it; copy 0 where none does."""
    held = choices.select("graph_id", "vertex_id", F.posexplode("blocks").alias("copy", "block"))
    held = held.select("graph_id", "vertex_id", "copy", F.explode("block").alias("edge_name"))
    for end in ("u", "v"):
        h = held.select("graph_id", F.col("vertex_id").alias(end), "edge_name", F.col("copy").alias(f"{end}_copy"))
        edges = edges.join(h, ["graph_id", "edge_name", end], "left")
    zero = F.lit(0)
    return edges.select("graph_id", "edge_name", "u", F.coalesce("u_copy", zero).alias("u_copy"), "v", F.coalesce("v_copy", zero).alias("v_copy"))


def renumbered(tree: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, copy, new_id`` with first copies keeping their id's order from 1 and further copies last; each graph is a window of its own."""
    seen = tree.select("graph_id", F.explode(F.array(F.struct(F.col("u").alias("vertex_id"), F.col("u_copy").alias("copy")), F.struct(F.col("v").alias("vertex_id"), F.col("v_copy").alias("copy")))).alias("s"))
    each = seen.select("graph_id", "s.vertex_id", "s.copy").distinct()
    order = W.partitionBy("graph_id").orderBy(F.col("copy") > 0, "vertex_id", "copy")
    return each.withColumn("new_id", F.row_number().over(order))


def split_graph(vertices: DataFrame, edges: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen tree as vertices and edges of its own, attributes and all.

    Vertices are numbered from 1 in each graph, first copies in order of their
    old ids and further copies last; ``og_vertex`` and ``copy`` tell where they
    come from, and copies bear their vertex's attributes. Edges keep their name
    and attributes and lead between copies. ``vertices`` may lack some vertices,
    whose attributes then are null; graphs without choices give no rows.
    """
    told = [c for c in edges.columns if c not in ("graph_id", "edge_name", "u", "v")]
    own = choices.select("graph_id").distinct()
    placed = tree_edges(edges.join(own, "graph_id", "left_semi"), choices)
    ids = materialize(renumbered(placed), "copies")
    out = placed
    for end in ("u", "v"):
        of = ids.select("graph_id", F.col("vertex_id").alias(end), F.col("copy").alias(f"{end}_copy"), F.col("new_id").alias(f"__{end}"))
        out = out.join(of, ["graph_id", end, f"{end}_copy"])
    out = out.select("graph_id", "edge_name", F.col("__u").cast("long").alias("u"), F.col("__v").cast("long").alias("v"))
    if told:
        out = out.join(edges.select("graph_id", "edge_name", *[col_of(c) for c in told]), ["graph_id", "edge_name"])
    attributes = [c for c in vertices.columns if c not in ("graph_id", "vertex_id", "og_vertex", "copy")]
    both = ids.join(vertices.select("graph_id", "vertex_id", *[col_of(c) for c in attributes]), ["graph_id", "vertex_id"], "left")
    named = both.select("graph_id", F.col("new_id").cast("long").alias("vertex_id"), F.col("vertex_id").alias("og_vertex"), "copy", *[col_of(c) for c in attributes])
    return named, out


def invariants(tree: DataFrame) -> DataFrame:
    """``graph_id, n_vertices, n_edges, n_components`` of a split graph; a tree has one component and one edge fewer than vertices."""
    key = lambda c: F.concat_ws("/", F.col("graph_id").cast("string"), F.col(c).cast("string"), F.col(f"{c}_copy").cast("string"))
    links = tree.select(key("u").alias("src"), key("v").alias("dst"))
    parts = connected_components(links)
    of = tree.select("graph_id", F.explode(F.array(key("u"), key("v"))).alias("vertex")).distinct()
    counted = of.join(parts, "vertex").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count_distinct("component").alias("n_components"))
    sizes = tree.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return counted.join(sizes, "graph_id").select("graph_id", "n_vertices", "n_edges", "n_components")


def direction_conflicts(choices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that don't enter exactly one of their ends: none, in a valid choice."""
    into = choices.select("graph_id", "vertex_id", F.explode("incoming").alias("edge_name"))
    seen = ends(edges).select("graph_id", "vertex_id", "edge_name").join(into.withColumn("in", F.lit(1)), ["graph_id", "vertex_id", "edge_name"], "left")
    return seen.groupBy("graph_id", "edge_name").agg(F.coalesce(F.sum("in"), F.lit(0)).alias("n")).where("n <> 1").select("graph_id", "edge_name")
