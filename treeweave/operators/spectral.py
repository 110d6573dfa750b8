"""Fiedler vectors and spectral orders of many graphs at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.operators.graph import graph_components, pair_multiplicity
from treeweave.operators.ranking import number_rows
from treeweave.runtime import forget, materialize

#: Vectors of the subspace in which a round looks for the next vector.
BASIS = 7


def _matrix(edges: DataFrame) -> DataFrame:
    """``graph_id, x, y, w, c``: the Laplacian of each graph entry by entry, the diagonal among them, and twice its greatest degree, which bounds its eigenvalues."""
    pairs = pair_multiplicity(edges.where("u <> v"))
    arcs = pairs.select("graph_id", F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y"), "m"), F.struct(F.col("v").alias("x"), F.col("u").alias("y"), "m"))))
    arcs = materialize(arcs, "arcs")
    degree = materialize(arcs.groupBy("graph_id", "x").agg(F.sum("m").alias("d")), "degrees")
    bound = degree.groupBy("graph_id").agg((2 * F.max("d")).cast("double").alias("c"))
    entries = arcs.select("graph_id", "x", "y", (-F.col("m")).cast("double").alias("w")).unionByName(degree.select("graph_id", "x", F.col("x").alias("y"), F.col("d").cast("double").alias("w")))
    return materialize(entries.join(bound, "graph_id"), "laplacian")


def _next_vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each graph, from the products of its basis vectors: the weights of the best vector in their span, its Rayleigh quotient, residual and mean.

    With B = 2 L / c - 1 the basis is t0, t1 = B t0, t(k+1) = 2 B t(k) - t(k-1);
    so L t(k) is a sum of basis vectors too, and all that is asked follows from
    the products of all pairs. Directions too weak to tell from rounding are
    left out.
    """
    k = BASIS
    for frame in frames:
        rows = []
        for gid, products, sums, c, n in zip(frame["graph_id"], frame["products"], frame["sums"], frame["c"], frame["n"]):
            gram = np.zeros((k + 1, k + 1))
            gram[np.triu_indices(k + 1)] = products
            gram = gram + np.triu(gram, 1).T
            lap = np.zeros((k + 1, k))  # L t(j) as weights of t(0) ... t(k)
            for j in range(k):
                lap[j, j] += c / 2
                if j:
                    lap[j + 1, j] += c / 4
                    lap[j - 1, j] += c / 4
                else:
                    lap[1, 0] += c / 2
            inner = gram[:k, :k]
            size, directions = np.linalg.eigh(inner)
            strong = size > 1e-13 * max(size[-1], 1e-300)
            white = directions[:, strong] / np.sqrt(size[strong])
            acts = white.T @ (gram[:k, :] @ lap) @ white
            values, vectors = np.linalg.eigh((acts + acts.T) / 2)
            w = white @ vectors[:, 0]
            image = lap @ w
            image[:k] -= values[0] * w
            residual = float(np.sqrt(max(image @ gram @ image, 0.0)))
            rows.append((gid, w.tolist(), float(values[0]), residual, float(np.dot(w, sums[:k]) / n)))
        yield pd.DataFrame(rows, columns=["graph_id", "weights", "value", "residual", "mean"])


def fiedler_vectors(edges: DataFrame, tolerance: float = 1e-7, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """The second eigenvector of each connected graph's Laplacian: ``(graph_id, vertex_id, x)`` and ``(graph_id, value, residual, rounds)``.

    A round multiplies by the Laplacian ``BASIS`` times, each a join of its
    entries with the vectors so far and a sum by vertex, and takes the best
    vector of the subspace that they span (Rayleigh and Ritz); the products of
    the vectors, a few dozen sums for each graph, are all that meets. Constants
    are deflated: the start, a hash of the ids, and every round's result have no
    mean. Graphs of up to ``BASIS`` + 1 vertices are exact in one round; a graph
    is done when the residual, which bounds the value's error, is below
    ``tolerance`` times twice its greatest degree. Graphs that don't get there in
    ``max_rounds`` keep their best vector, with its residual to tell.

    Edges count as often as they are parallel; self loops don't. The sign is such
    that the sum of x by ids' order starts with a negative or zero entry at the
    smallest id. Where the eigenvalue is multiple, it is some vector of its
    space. Graphs of several components belong to ``spectral_order``: their value
    would be 0.
    """
    matrix = _matrix(edges)
    start = matrix.where("x = y").select("graph_id", F.col("x").alias("vertex_id"), (F.xxhash64("graph_id", "x") / F.lit(2.0**63)).alias("x"))
    mean = start.groupBy("graph_id").agg(F.avg("x").alias("mean"))
    now = materialize(start.join(mean, "graph_id").select("graph_id", "vertex_id", (F.col("x") - F.col("mean")).alias("x")), "vectors")
    pairs = [(i, j) for i in range(BASIS + 1) for j in range(i, BASIS + 1)]
    vectors, told = [], []
    for r in range(1, max_rounds + 1):
        t = now.select("graph_id", F.col("vertex_id").alias("y"), F.array("x").alias("t"))
        for k in range(BASIS):
            rows = matrix.join(t, ["graph_id", "y"]).select("graph_id", "x", "c", (F.col("w") * F.col("t")[k]).alias("p"), F.when(F.col("x") == F.col("y"), F.col("t")).alias("t"))
            summed = rows.groupBy("graph_id", F.col("x").alias("y")).agg(F.sum("p").alias("l"), F.max("t").alias("t"), F.first("c").alias("c"))
            b = 2 * F.col("l") / F.col("c") - F.col("t")[k]
            t = summed.select("graph_id", "y", "c", F.concat("t", F.array(2 * b - F.col("t")[k - 1] if k else b)).alias("t"))
            if k < BASIS - 1:
                t = t.drop("c")
        t = materialize(t, "basis")
        gathered = t.groupBy("graph_id").agg(
            F.array(*[F.sum(F.col("t")[i] * F.col("t")[j]) for i, j in pairs]).alias("products"), F.array(*[F.sum(F.col("t")[i]) for i in range(BASIS + 1)]).alias("sums"), F.first("c").alias("c"), F.count(F.lit(1)).alias("n")
        )
        found = gathered.mapInPandas(_next_vectors, "graph_id string, weights array<double>, value double, residual double, mean double")
        found = materialize(found.join(gathered.select("graph_id", "c"), "graph_id").withColumn("settled", F.col("residual") <= F.col("c") * tolerance), "found")
        mixed = F.aggregate(F.zip_with("weights", F.slice("t", 1, BASIS), lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x)
        better = materialize(t.join(found, "graph_id").select("graph_id", F.col("y").alias("vertex_id"), (mixed - F.col("mean")).alias("x"), "settled"), "vectors")
        last = F.lit(r == max_rounds)
        vectors.append(better.where(F.col("settled") | last).select("graph_id", "vertex_id", "x"))
        told.append(found.where(F.col("settled") | last).select("graph_id", "value", "residual", F.lit(r).alias("rounds")))
        spent, now = now, better.where(~F.col("settled")).select("graph_id", "vertex_id", "x")
        forget(spent, t)
        if now.isEmpty():
            break
        open_graphs = found.where(~F.col("settled")).select("graph_id")
        matrix = materialize(matrix.join(open_graphs, "graph_id", "left_semi"), "laplacian")
    whole = reduce(DataFrame.unionByName, vectors)
    first = whole.groupBy("graph_id").agg(F.min(F.struct("vertex_id", "x")).alias("first"))
    sign = F.when(F.col("first.x") > 0, -1.0).otherwise(1.0)
    return whole.join(first, "graph_id").select("graph_id", "vertex_id", (F.col("x") * sign).alias("x")), reduce(DataFrame.unionByName, told)


def spectral_order(edges: DataFrame, vertices: DataFrame, tolerance: float = 1e-7, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """``graph_id, vertex_id, component, x, place``: each graph's vertices by their Fiedler values, from 1; and ``graph_id, component, value, residual, rounds``.

    Values are of each component for itself: components follow each other by
    their smallest vertex, and within one vertices go by value, ties by id. A
    vertex without an edge is a component of value 0. ``vertices`` (graph_id,
    vertex_id) are all vertices.
    """
    parts = graph_components(edges)
    alone = vertices.join(parts, ["graph_id", "vertex_id"], "left_anti").select("graph_id", "vertex_id", F.col("vertex_id").alias("component"))
    parts = materialize(parts.unionByName(alone.distinct()), "components")
    key = F.to_json(F.struct(F.col("graph_id").alias("g"), F.col("component").alias("c")))
    mine = parts.select("graph_id", F.col("vertex_id").alias("u"), "component")
    own = edges.where("u <> v").join(mine, ["graph_id", "u"]).select(key.alias("graph_id"), "u", "v")
    found, told = fiedler_vectors(own, tolerance, max_rounds)
    values = parts.withColumn("key", key).join(found.select(F.col("graph_id").alias("key"), "vertex_id", "x"), ["key", "vertex_id"], "left")
    values = values.select("graph_id", "vertex_id", "component", F.coalesce("x", F.lit(0.0)).alias("x"))
    placed = number_rows(values, ["graph_id"], ["component", "x", "vertex_id"], "place")
    back = F.from_json("graph_id", "g string, c long")
    return placed, told.select(back["g"].alias("graph_id"), back["c"].alias("component"), "value", "residual", "rounds")
