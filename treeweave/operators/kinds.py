"""Equal graphs told by their edges, so that what hangs on a graph's edges alone is worked out once for all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeweave.runtime import materialize


def _kind(columns: list[str]) -> Column:
    """The name of a group of rows by their contents, whatever their order: a count, two sums without carry and one with it, of hashes of the rows."""
    hashes = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    told = [F.count(F.lit(1)), *[F.bit_xor(h) for h in hashes], F.sum(F.shiftright(hashes[0], 32))]
    return F.concat_ws(".", *[F.hex(x) for x in told])


def graph_kinds(edges: DataFrame, again: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``graph_id, kind``, a row for each graph, and the edges of each kind once, with the kind as their graph_id.

    Graphs are of one kind if their edges agree in edge_name, u and v; other
    columns are left out. Nothing is collected: an edge is two hashes of 64 bits,
    which combine before the shuffle, so a graph may have any number of edges.
    Different graphs get one name with a chance of about 2^-128 a pair. Edges and
    ids have no nulls. A kind's edges are those of its graph of the smallest id;
    ``again`` gives the edges of some graphs (graph_id) where that is cheaper than
    to work out all ``edges`` once more.
    """
    named = ["edge_name", "u", "v"]
    members = materialize(edges.groupBy("graph_id").agg(_kind(named).alias("kind")), "members")
    shown = materialize(members.groupBy("kind").agg(F.min("graph_id").alias("graph_id")), "kinds")
    own = again(shown.select("graph_id")) if again else edges
    return members, materialize(own.join(shown, "graph_id").select(F.col("kind").alias("graph_id"), *named), "edges")


def of_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """Rows found for kinds, as ``graph_kinds`` names them, for each graph of the kind; columns stay as they are."""
    return members.join(found.withColumnRenamed("graph_id", "kind"), "kind").select(*found.columns)
