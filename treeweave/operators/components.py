"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.runtime import forget, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label each endpoint of ``edges`` with the smallest vertex it reaches.

    Returns ``(vertex, component)``. Alternates large-star and small-star steps,
    which settle in O(log^2 n) rounds whatever the diameter; each round is two
    key aggregations and two joins on the shrinking edge list, written to the
    shared folder so that lineage stays short. Null endpoints and self loops
    link nothing; a vertex that only has a self loop is its own component.
    Raises RuntimeError when ``max_rounds`` do not suffice (never seen: the
    bound is far above what the round count needs).
    """
    a, b = F.col(src), F.col(dst)
    named = edges.select(a.alias("u"), b.alias("v")).where("u is not null and v is not null")
    ends = named.select(F.col("u").alias("vertex")).union(named.select("v"))
    vertices = materialize(ends.distinct(), "vertices")
    links = materialize(
        named.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(max_rounds):
        spent, links = links, materialize(_small_star(_large_star(links)).distinct(), "links")
        forget(spent)
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.expr("xxhash64(v, u) % 1000003")).alias("s")
        ).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return vertices.join(roots, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of u to the smallest vertex next to u."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie u and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))
