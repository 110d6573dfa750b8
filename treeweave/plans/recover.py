"""From graphs and candidates to split trees, as files or as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweave.functions.geometry import distance
from treeweave.operators.beam import Beam
from treeweave.operators.greedy import greedy
from treeweave.operators.kinds import of_members
from treeweave.operators.solve import MAX_BOUNDARY, solve
from treeweave.operators.tree import split_graph
from treeweave.runtime import col_of, materialize
from treeweave.sources import costs, ply


@dataclass(frozen=True)
class Recovered:
    """status: graph_id, status, cost; vertices and edges of the solved graphs' split trees."""

    status: DataFrame
    vertices: DataFrame
    edges: DataFrame


def with_lengths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose missing ``len`` is the distance of their ends' coordinates."""
    if "len" not in edges.columns:
        edges = edges.withColumn("len", F.lit(None).cast("double"))
    at = [F.col(c) if c in vertices.columns else F.lit(None).cast("double") for c in "xyz"]
    for end in ("u", "v"):
        place = vertices.select("graph_id", F.col("vertex_id").alias(end), F.struct(*[a.cast("double").alias(c) for a, c in zip(at, "xyz")]).alias(f"__{end}"))
        edges = edges.join(place, ["graph_id", end], "left")
    apart = distance(*[[F.col(f"__{end}.{c}") for c in "xyz"] for end in ("u", "v")])
    return edges.withColumn("len", F.coalesce("len", apart)).drop("__u", "__v")


def recover(vertices: DataFrame, edges: DataFrame, candidates: DataFrame, beam: Beam | None = None, priority: str | tuple[str, ...] = "outdegree", max_boundary: int = MAX_BOUNDARY, members: DataFrame | None = None) -> Recovered:
    """Solve the graphs, split them by their choices, and carry the attributes over.

    With a ``beam``, the greedy choice is kept in it, for which lengths that are
    missing come from the coordinates. Roots are the vertices with an
    all-outgoing candidate. With ``members`` (graph_id, kind; no beam), edges and
    candidates are those of the kinds of ``graph_kinds``: each kind is solved and
    split once, and every graph's tree bears its own vertices' attributes.
    """
    if beam and members is not None:
        raise ValueError("a beam takes lengths from each graph's own vertices")
    edges = materialize(edges, "edges")
    candidates = materialize(candidates, "candidates")
    protected = None
    if beam:
        chosen = materialize(greedy(with_lengths(vertices, edges), candidates, costs.root_of(candidates)), "greedy")
        protected = chosen.where("status = 'chosen'")
    found = solve(edges, candidates, priority, beam, protected, max_boundary)
    choices = materialize(found.choices, "choices")
    if members is None:
        return Recovered(found.status, *split_graph(vertices, edges, choices))
    bare = edges.select("graph_id", F.explode(F.array("u", "v")).alias("vertex_id")).distinct()
    kind_vertices, kind_edges = (materialize(t, "trees") for t in split_graph(bare, edges, choices))
    own = vertices.select("graph_id", F.col("vertex_id").alias("og_vertex"), *[col_of(c) for c in vertices.columns if c not in ("graph_id", "vertex_id", "og_vertex", "copy")])
    tree_vertices = of_members(kind_vertices, members).join(own, ["graph_id", "og_vertex"], "left").select(*kind_vertices.columns, *[col_of(c) for c in own.columns[2:]])
    return Recovered(of_members(found.status, members), tree_vertices, of_members(kind_edges, members))


def recover_files(spark: SparkSession, graphs: str, candidates: str, out: str, beam: Beam | None = None, max_boundary: int = MAX_BOUNDARY) -> DataFrame:
    """Read PLY graphs and candidate texts of the same names, and write each solved graph's tree as PLY under ``out``; returns the status of each graph.

    A graph's tree is the text in ``out/graph_id=<name>_tree``.
    """
    vertices, edges = ply.read_ply(spark, graphs)
    found = recover(vertices.drop("attributes"), edges.drop("attributes"), costs.parse_candidates(ply.graph_files(spark, candidates)), beam, max_boundary=max_boundary)
    called = F.concat("graph_id", F.lit("_tree")).alias("graph_id")
    rest = lambda df: [c for c in df.columns if c != "graph_id"]
    ply.write_ply(found.vertices.select(called, *rest(found.vertices)), found.edges.select(called, *rest(found.edges)), out)
    return found.status
