"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.runtime import col_of, materialize, shuffle_partitions

#: Bound of the sample that centroids and codebooks are fitted on; every vector is indexed.
SAMPLE = 32_768
#: Bytes of the sample, which the driver holds.
SAMPLE_BYTES = 128 << 20
#: Coarse cells: about the square root of the number of vectors, as far as the sample has this many vectors for each.
VECTORS_A_CELL = 4
#: Bytes of a code, and values of each.
SUBSPACES, CODES = 16, 256
#: Cells are probed up to the share at which this recall is reached within the sample.
SAMPLE_RECALL, SAMPLE_QUERIES = 0.97, 256
#: Candidates of a query that are measured first in each task; their exact distances bound which of the others must be measured too.
RERANKED = 160
#: Vectors of a bin, fewer where bins would not fill the tasks, and queries that meet a bin at once.
SHARD, LEAST_SHARD, QUERIES_AT_ONCE = 8192, 256, 4096


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers**2).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (half - x[lo : lo + 4096] @ centers.T).argmin(axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from random distinct points; an empty cluster restarts at a random point."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = max(1, min(k, len(x)))
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        order = np.argsort(own, kind="stable")
        n = np.bincount(own, minlength=k)
        sums = np.add.reduceat(np.concatenate([x[order], np.zeros_like(x[:1])]), np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centers


@dataclass(frozen=True)
class Index:
    """Coarse centroids, codebooks of residuals (subspace, code, component) and the share of cells to probe."""

    centroids: np.ndarray
    codebooks: np.ndarray
    share: float

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int = 11) -> Index:
        centroids = k_means(sample, cells, 10, seed)
        own = _nearest(sample, centroids)
        parts = _subspaces(sample - centroids[own])
        books = np.zeros((parts.shape[1], CODES, parts.shape[2]))
        for i in range(parts.shape[1]):
            found = k_means(np.ascontiguousarray(parts[:, i]), CODES, 6, seed + i)
            books[i, : len(found)] = found
            books[i, len(found) :] = found[0]
        return cls(centroids, books, _share(sample, own, centroids))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and quantisation error (distance of a vector to what its codes stand for)."""
        cell = _nearest(x, self.centroids)
        parts = _subspaces(x - self.centroids[cell])
        codes = np.stack([_nearest(np.ascontiguousarray(parts[:, i]), book) for i, book in enumerate(self.codebooks)], axis=1)
        meant = self.codebooks[np.arange(codes.shape[1]), codes]
        return cell, codes.astype(np.uint8), np.sqrt(((parts - meant) ** 2).sum(axis=(1, 2)))

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of the query's residual to each code of each subspace, in a row."""
        r = _subspaces((q - self.centroids[cell])[None])[0]
        return ((r[:, None, :] - self.codebooks) ** 2).sum(axis=2).ravel()


def _subspaces(x: np.ndarray) -> np.ndarray:
    """Rows cut into SUBSPACES parts of equal width; the last is filled with zeros."""
    m = min(SUBSPACES, x.shape[1])
    width = -(-x.shape[1] // m)
    return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)


def _share(sample: np.ndarray, own: np.ndarray, centroids: np.ndarray, k: int = 10) -> float:
    """The least share of cells, nearest first, that hold SAMPLE_RECALL of the true neighbours of some sample vectors."""
    q = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    half = (sample**2).sum(axis=1) / 2
    near = np.argsort(half - q @ sample.T, axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort((centroids**2).sum(axis=1) / 2 - q @ centroids.T, axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return float((needed[int(SAMPLE_RECALL * (len(needed) - 1))] + 1) / len(centroids)) if len(needed) else 1.0


def _best(q: np.ndarray, x: np.ndarray, reps: np.ndarray, far: np.ndarray, err: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the ``most`` vectors nearest to q, ties to the smaller id.

    far: asymmetric distances, squared; err: quantisation errors. A vector lies
    no nearer than its asymmetric distance less its error, so all that can beat
    the ``most``-th best of the first RERANKED are measured, however many.
    """
    d = np.full(len(reps), np.inf)

    def measure(at: np.ndarray) -> None:
        d[at] = np.sqrt(((x[at] - q) ** 2).sum(axis=1))

    if len(reps) <= RERANKED:
        measure(np.arange(len(reps)))
    else:
        first = np.argpartition(far, RERANKED - 1)[:RERANKED]
        measure(first)
        if most <= RERANKED:
            limit, near = np.partition(d[first], most - 1)[most - 1], np.sqrt(far)
            able = near - err <= limit + 1e-9 * (near + err + limit)  # room for rounding
        else:
            able = np.ones(len(reps), bool)
        able[first] = False
        measure(np.flatnonzero(able))
    at = np.flatnonzero(d < np.inf)
    at = at[np.lexsort((reps[at], d[at]))[:most]]
    return at, d[at]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part: an id, and a vector without null, NaN or infinite components that isn't all zero."""
    v = F.transform(col_of(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(col_of(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def _sample(classes: DataFrame, n: int, dim: int) -> DataFrame:
    """The vectors of the smallest hashes, SAMPLE and SAMPLE_BYTES at most. A bound on the hash, a fifth above what is needed, thins the rows first, so that what meets in one task doesn't grow with n."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    h = F.xxhash64("v")
    rows = classes.select("v")
    if (share := (1.2 * most + 100) / n) < 1:
        rows = rows.where(h < F.lit(int((share - 0.5) * 2**64)))
    return rows.orderBy(h, "v").limit(most)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row the k nearest others found, by Euclidean distance, ties to the smaller id.

    is_query: a condition on ``vec_id``. Equal vectors are one entry of the
    index with their first k + 1 ids, so copies are neither compared nor lost.
    Centroids and codebooks are fitted on a sample of at most SAMPLE vectors and
    SAMPLE_BYTES; all vectors are indexed. A query looks into the nearest cells, as many as
    the sample shows to be needed and more where they hold few vectors;
    asymmetric distance tables rank the cells' codes, and all that can be among
    the best by their quantisation errors are ranked again by exact
    double-precision distances, so within the cells no neighbour is lost.

    Bins of the index hold a bounded number of vectors and meet a bounded number
    of queries at once. Null, zero and non-finite vectors, rows without an id and vectors of another
    length than most take no part; equal rows count once. Ids are
    taken to be of one vector; where one has several, the least is its query, and
    each other of them among a query's k + 1 nearest entries leaves it one short.
    Where fewer than k others
    exist, all are returned. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    first = rows.withColumn("r", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = materialize(first.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"), "classes")
    n = classes.count()
    sample = np.stack(_sample(classes, n, dim).toPandas()["v"].to_list()).astype(np.float64)
    index = Index.fit(sample, max(1, min(round(math.sqrt(n)), len(sample) // VECTORS_A_CELL)))
    tasks = shuffle_partitions(spark)
    shard = min(SHARD, max(LEAST_SHARD, n // (4 * tasks)))
    sent = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, codes, err = sent.value.encode(_matrix(b.column("v"), dim))
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err, pa.float64()), b.column("v")], ["rep", "cell", "code", "err", "v"])

    coded = materialize(classes.select("rep", "v").mapInArrow(encode, "rep long, cell int, code binary, err double, v array<double>"), "codes")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("cell").count().collect():  # a row for each cell, a quarter of SAMPLE at most
        sizes[r["cell"]] = r["count"]
    # Cells lie in a row, one after another, and a bin is ``shard`` places of the row: small cells share a bin, and a
    # large cell is spread over many by a hash of its entries.
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    places = spark.createDataFrame([(i, int(a), int(x)) for i, (a, x) in enumerate(zip(starts, sizes)) if x], "cell int, start long, size long")
    probes, enough = max(1, math.ceil(index.share * len(sizes))), 4 * RERANKED

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        half = (ix.centroids**2).sum(axis=1) / 2
        for b in batches:
            ids, bins, cells = [], [], []
            for i, q in zip(b.column("query_id").to_pylist(), _matrix(b.column("v"), dim) if b.num_rows else ()):
                order = np.argsort(half - ix.centroids @ q, kind="stable")
                upto = max(probes, int(np.searchsorted(np.cumsum(sizes[order]), enough)) + 1)
                asked: dict[int, list[int]] = {}
                for c in order[:upto].tolist():
                    for x in range(int(starts[c]) // shard, int(starts[c] + sizes[c] - 1) // shard + 1) if sizes[c] else ():
                        asked.setdefault(x, []).append(c)
                ids += [i] * len(asked)
                bins += asked.keys()
                cells += asked.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bins, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "bin", "cells"])

    queries = rows.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = materialize(queries, "queries")
    asked = materialize(queries.mapInArrow(probe, "query_id long, bin long, cells array<int>"), "asked")
    # A bin's entries are sent once for each block of the queries that ask it, which number by the asks of that bin; a row for each bin.
    blocks = F.broadcast(asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("blocks")))
    draw = F.pmod(F.xxhash64("rep"), F.col("size"))
    placed = coded.join(F.broadcast(places), "cell").withColumn("bin", F.floor((F.col("start") + draw) / shard)).join(blocks, "bin")
    left = placed.select("rep", "cell", "code", "err", "v", "bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = asked.join(blocks, "bin").join(queries, "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))

    def scan(entries: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        ix = sent.value
        ids, found, scores = [], [], []
        if len(entries) and len(asks):
            entries = entries.sort_values(["cell", "rep"])
            reps, cell, err = entries["rep"].to_numpy(), entries["cell"].to_numpy(), entries["err"].to_numpy()
            x = np.stack(entries["v"].to_list()).astype(np.float64)
            codes = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(len(reps), -1).astype(np.int64)
            codes += np.arange(codes.shape[1]) * CODES
            which, lo = np.unique(cell, return_index=True)
            span = {int(c): (int(a), int(b)) for c, a, b in zip(which, lo, [*lo[1:], len(cell)])}
            for q, v, cells in zip(asks["query_id"], asks["v"], asks["cells"]):
                v, parts = np.asarray(v, np.float64), [(c, *span[c]) for c in cells if c in span]
                if parts:
                    far = np.concatenate([ix.tables(v, c)[codes[a:b]].sum(axis=1) for c, a, b in parts])
                    at = np.concatenate([np.arange(a, b) for _, a, b in parts])
                    best, d = _best(v, x[at], reps[at], far, err[at], k + 1)  # the query itself may be one
                    ids.append(np.full(len(best), q, np.int64))
                    found.append(reps[at[best]])
                    scores.append(d)
        if not ids:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "score": np.empty(0)})
        return pd.DataFrame({"query_id": np.concatenate(ids), "rep": np.concatenate(found), "score": np.concatenate(scores)})

    # dealt by number, so that adaptive execution does not put few and small partitions, which take long, into one
    left, right = left.repartition(tasks, "bin", "block"), right.repartition(tasks, "bin", "block")
    near = left.groupBy("bin", "block").cogroup(right.groupBy("bin", "block")).applyInPandas(scan, "query_id long, rep long, score double")
    # Each entry holds an id at least, so the k + 1 best entries hold the k best ids besides the query's own.
    best = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("score", "rep"))).where(F.col("r") <= k + 1)
    measured = best.join(classes.select("rep", "ids"), "rep")
    each = measured.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
