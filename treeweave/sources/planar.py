"""Planar graphs from points: Delaunay triangles of many graphs at once, and their duals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeweave.operators.ranking import number_rows
from treeweave.runtime import forget, materialize

KEY = ["graph_id", "level", "i", "j"]
#: A set of up to so many points is one row and is triangulated in one task; greater ones by waves over all tasks.
WHOLE = 64
#: Comparisons closer than this share of their terms are made again in whole fractions.
CLOSE = 1e-11


def _usable(points: DataFrame) -> DataFrame:
    """Points of known places."""
    real = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    given = points.select("graph_id", F.col("point_id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return given.where(F.col("graph_id").isNotNull() & F.col("id").isNotNull() & real[0] & real[1])


def _by_size(points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Sets of up to ``WHOLE`` points as rows ``graph_id, ids, xs, ys``, and the points of the greater ones, if there are any."""
    given = _usable(points)
    great = materialize(given.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("graph_id"), "great")
    rest = None if great.isEmpty() else points.join(great, "graph_id", "left_semi")
    few = given if rest is None else given.join(great, "graph_id", "left_anti")
    sets = few.repartition("graph_id").groupBy("graph_id", "x", "y").agg(F.min("id").alias("id")).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("p"))
    return sets.where(F.size("p") > 2).select("graph_id", F.col("p.id").alias("ids"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys")), rest


def _exact(x: list[float], y: list[float]) -> list[tuple[int, int, int]]:
    """``_empty_circles`` of one set in whole fractions."""
    xs, ys = ([int(v) if v == int(v) else Fraction(v) for v in c] for c in (x, y))
    found = []
    for a in range(len(xs)):
        for b in range(a + 1, len(xs)):
            cots, between = {}, False
            for p in range(len(xs)):
                if p not in (a, b):
                    ax, ay, bx, by = xs[a] - xs[p], ys[a] - ys[p], xs[b] - xs[p], ys[b] - ys[p]
                    cross, dot = ax * by - ay * bx, ax * bx + ay * by
                    if cross:
                        cots[p] = cross > 0, Fraction(dot) / Fraction(cross)
                    between |= not cross and dot < 0
            near = [f((c for left, c in cots.values() if left == side), default=None) for side, f in ((True, min), (False, max))]
            if not between and (None in near or near[0] >= near[1]):
                found += [(a, b, p) for p, (left, c) in cots.items() if p > b and c == near[0 if left else 1]]
    return found


def _empty_circles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sets of n points each (rows of x and y): set and places a < b < p of every three points with no point inside their circle.

    The cotangent at which a point sees a pair tells where the middle of their
    circle lies: the circle is empty if the cotangent is the least on the point's side
    and not below the greatest on the other, and no point lies between the two.
    Sets in which three points are nearly on a line, or four on a circle, are
    done again exactly.
    """
    n = x.shape[1]
    dx, dy = (c[:, :, None] - c[:, None, :] for c in (x, y))
    first, second = np.triu_indices(n, 1)
    ax, ay, bx, by = dx[:, first], dy[:, first], dx[:, second], dy[:, second]  # from each point to the pair's ends
    terms = ax * by, ay * bx, ax * bx, ay * by
    cross, dot = terms[0] - terms[1], terms[2] + terms[3]
    flat, long = np.abs(terms[0]) + np.abs(terms[1]), np.abs(terms[2]) + np.abs(terms[3])
    other = np.ones((len(first), n), bool)
    other[np.arange(len(first)), first] = other[np.arange(len(first)), second] = False
    left, right = (cross > 0) & other, (cross < 0) & other
    with np.errstate(divide="ignore", invalid="ignore"):
        cot = dot / cross
        slack = CLOSE * (long + np.abs(cot) * flat) / np.abs(cross)
    unsure = ((np.abs(cross) <= CLOSE * flat) & other).any((1, 2))
    low, high = np.where(left, cot, np.inf), np.where(right, cot, -np.inf)
    lo, hi = low.min(2), high.max(2)
    slack = np.where(left | right, slack, 0.0)
    at_lo, at_hi = low <= (lo[:, :, None] + slack), high >= (hi[:, :, None] - slack)
    reach = np.maximum(np.where(at_lo & left, slack, 0.0).max(2), np.where(at_hi & right, slack, 0.0).max(2))
    maybe = lo + reach >= hi - reach
    ties = ((at_lo & left).sum(2) > 1) | ((at_hi & right).sum(2) > 1) | (np.isfinite(lo) & np.isfinite(hi) & (np.abs(lo - hi) <= 2 * reach))
    unsure |= (maybe & ties).any(1)
    apex = ((left & (low == lo[:, :, None])) | (right & (high == hi[:, :, None]))) & (lo >= hi)[:, :, None] & (np.arange(n) > second[:, None]) & ~unsure[:, None, None]
    g, pair, p = np.nonzero(apex)
    again = [(k, *t) for k in np.flatnonzero(unsure) for t in _exact(x[k].tolist(), y[k].tolist())]
    more = np.array(again, int).reshape(-1, 4).T
    return tuple(np.concatenate(c) for c in zip((g, first[pair], second[pair], p), more))


def _whole_sets(make: Callable[..., dict[str, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sets to the rows that ``make`` gives for their triangles: sets of one size go together, a few megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("ids").offsets.to_numpy()
            ids, xs, ys = (batch.column(c).values.to_numpy() for c in ("ids", "xs", "ys"))
            sizes = np.diff(starts)
            for n in np.unique(sizes):
                mine = np.flatnonzero(sizes == n)
                for some in np.array_split(mine, max(1, len(mine) * int(n) ** 3 // 500_000)):
                    if len(some):
                        at = starts[some][:, None] + np.arange(n)
                        g, a, b, p = _empty_circles(xs[at], ys[at])
                        rows = make(g, *(ids[at[g, k]] for k in (a, b, p)))
                        owner = batch.column("graph_id").take(pa.array(some[rows.pop("set")]))
                        yield pa.RecordBatch.from_arrays([owner, *map(pa.array, rows.values())], ["graph_id", *rows])

    return run


def _corners(g: np.ndarray, p: np.ndarray, q: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    return {"set": g, "p": p, "q": q, "r": r}


def _places(g: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal ``g``, from 1."""
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    return np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) + 1


def _dual_edges(g: np.ndarray, p: np.ndarray, q: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """``dual``'s edges of whole sets."""
    order = np.lexsort((r, q, p, g))
    g, p, q, r = g[order], p[order], q[order], r[order]
    k = _places(g)
    sides = np.concatenate([np.stack([g, s, t, k]) for s, t in ((p, q), (p, r), (q, r))], 1)
    sides = sides[:, np.lexsort(sides[::-1])]
    new = np.flatnonzero(np.r_[True, (sides[:3, 1:] != sides[:3, :-1]).any(0)]) if sides.shape[1] else np.zeros(0, int)
    two = new[np.diff(np.r_[new, sides.shape[1]]) == 2]
    rows = np.stack([sides[0, two], sides[3, two], sides[3, two + 1]])
    g, u, v = rows[:, np.lexsort(rows[::-1])]
    return {"set": g, "edge_name": _places(g).astype("int32"), "u": u, "v": v}


def _located(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each graph's frame, and its points in the cells of each level: cells hold about one point at level 0, are twice as wide at the next, and one covers the frame at level ``top``."""
    given = materialize(_usable(points).groupBy("graph_id", "x", "y").agg(F.min("id").alias("id")), "points")
    side = F.ceil(F.sqrt(F.count(F.lit(1))))
    width = lambda c: F.when(F.max(c) > F.min(c), (F.max(c) - F.min(c)) / side).otherwise(1.0)
    frames = given.groupBy("graph_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), width("x").alias("w"), width("y").alias("h"), F.ceil(F.log2(side + 1)).cast("int").alias("top"))
    frames = materialize(frames, "frames")
    placed = given.join(frames, "graph_id").select("*", F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    return frames, materialize(placed.select("graph_id", "level", _cell("x", "x0", "w").alias("i"), _cell("y", "y0", "h").alias("j"), "id", "x", "y"), "cells")


def _cell(at: str, start: str, width: str) -> Column:
    return F.floor((F.col(at) - F.col(start)) / (F.col(width) * F.pow(F.lit(2.0), "level")))


def _near(asks: DataFrame, cells: DataFrame) -> DataFrame:
    """Each question (``mx, my``, its frame and level) with the points of the nine cells around it; ``out`` holds the edges of that block."""
    centre = asks.withColumn("ci", _cell("mx", "x0", "w")).withColumn("cj", _cell("my", "y0", "h"))
    wide, high = F.col("w") * F.pow(F.lit(2.0), "level"), F.col("h") * F.pow(F.lit(2.0), "level")
    block = F.struct(
        (F.col("x0") + wide * (F.col("ci") - 1)).alias("left"), (F.col("x0") + wide * (F.col("ci") + 2)).alias("right"),
        (F.col("y0") + high * (F.col("cj") - 1)).alias("low"), (F.col("y0") + high * (F.col("cj") + 2)).alias("high"),
    )
    around = centre.withColumn("block", block)
    for c, cell in (("i", "ci"), ("j", "cj")):
        around = around.withColumn(c, F.explode(F.array(*[F.col(cell) + d for d in (-1, 0, 1)])))
    return around.drop("ci", "cj").join(cells.select(*KEY, F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py")), KEY, "left").drop("i", "j")


def _inside(x: Column, y: Column, r: Column) -> Column:
    """Whether a circle lies in the block that was searched."""
    return (x - r >= F.col("block.left")) & (x + r <= F.col("block.right")) & (y - r >= F.col("block.low")) & (y + r <= F.col("block.high"))


def _first_edges(frames: DataFrame, cells: DataFrame) -> DataFrame:
    """Directed edges between each point and its nearest: a nearest neighbour shares an empty circle."""
    asks = cells.where("level = 0").join(frames, "graph_id").select("graph_id", "id", "x", "y", "x0", "y0", "w", "h", "top", "level", F.col("x").alias("mx"), F.col("y").alias("my"))
    found = []
    while True:
        far = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
        best = F.min(F.when(F.col("pid") != F.col("id"), F.struct(far.alias("r"), F.col("pid").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"))))
        judged = _near(asks, cells).groupBy(*asks.columns, "block").agg(best.alias("best"))
        settled = F.coalesce((F.col("level") == F.col("top")) | _inside(F.col("x"), F.col("y"), F.col("best.r")), F.lit(False))
        judged = materialize(judged.withColumn("settled", settled), "nearest")
        found.append(judged.where("settled and best is not null"))
        if judged.where("not settled").isEmpty():
            break
        asks = _wider(judged, asks.columns)
    every = reduce(DataFrame.unionByName, found)
    ends = [F.struct(F.col(a + "id").alias("id"), F.col(a + "x").alias("x"), F.col(a + "y").alias("y")) for a in ("", "best.")]
    return every.select("graph_id", F.explode(F.array(F.struct(ends[0].alias("a"), ends[1].alias("b")), F.struct(ends[1].alias("a"), ends[0].alias("b")))).alias("e")).select("graph_id", "e.a", "e.b").distinct()


def triangulate(points: DataFrame) -> DataFrame:
    """The Delaunay triangles ``graph_id, p, q, r`` (point ids, p < q < r) of ``graph_id, point_id, x, y``.

    Sets of up to ``WHOLE`` points are told by definition, one shuffle for all of
    them: every three points with none inside their circle, exactly, so of points on one
    empty circle every three. Greater sets go by ``waves``.

    Points at one place are one point, of the smallest id; rows with a null or
    non-finite value take no part. Points on one line, and fewer than three, give
    no triangles.
    """
    sets, great = _by_size(points)
    found = sets.mapInArrow(_whole_sets(_corners), f"graph_id {sets.schema['graph_id'].dataType.simpleString()}, p long, q long, r long")
    return found if great is None else found.unionByName(waves(great))


def waves(points: DataFrame) -> DataFrame:
    """``triangulate`` for sets of any size.

    A wave from each point's nearest neighbour: each round asks, for all directed
    edges of all graphs that are new, for the point on their left that sees them
    under the widest angle. The question goes to the points of the nine grid cells around the
    edge; an answer whose circle leaves them asks again in cells twice as
    wide, and one cell covers the frame at last, so edges of the hull end. All points
    start at once: rounds number about the greatest degree plus the levels.
    The least angle combines before the shuffle; only edges of the hull and
    of very long triangles meet many points.

    Of points on one empty circle the smaller id wins for each edge,
    which may tear the triangles there: points in general position are asked for.
    """
    frames, cells = _located(points)
    new, waiting, rounds = materialize(_first_edges(frames, cells), "edges"), None, []
    ax, ay, bx, by, px, py = (F.col(c) for c in ("a.x", "a.y", "b.x", "b.y", "px", "py"))
    while True:
        asks = new.join(frames, "graph_id").select("*", F.lit(0).alias("level"), ((ax + bx) / 2).alias("mx"), ((ay + by) / 2).alias("my"))
        asks = asks if waiting is None else asks.unionByName(waiting)
        cross = (ax - px) * (by - py) - (ay - py) * (bx - px)
        cot = ((ax - px) * (bx - px) + (ay - py) * (by - py)) / cross
        best = F.min(F.when(cross > 0, F.struct(cot.alias("cot"), F.col("pid").alias("id"), px.alias("x"), py.alias("y"))))
        judged = _near(asks, cells).groupBy(*asks.columns, "block").agg(best.alias("p"))
        turn, radius = F.col("p.cot") / 2, F.hypot(bx - ax, by - ay) / 2 * F.sqrt(1 + F.pow("p.cot", 2))
        fits = _inside(F.col("mx") - turn * (by - ay), F.col("my") + turn * (bx - ax), radius)
        judged = judged.withColumn("settled", F.coalesce((F.col("level") == F.col("top")) | fits, F.lit(False)))
        judged = materialize(judged.withColumn("p", F.when(F.col("settled") & F.col("p").isNotNull(), F.struct("p.id", "p.x", "p.y"))), "apexes")
        forget(new)
        rounds.append(judged)
        if judged.isEmpty():
            break
        waiting = _wider(judged, asks.columns)
        known = reduce(DataFrame.unionByName, [_sides(r, ("a", "b"), ("b", "p"), ("p", "a")) for r in rounds])
        known = known.where("b is not null and a is not null").select(F.col("graph_id").alias("g"), F.col("a.id").alias("ka"), F.col("b.id").alias("kb"))
        reached = _sides(judged.where("p is not null"), ("p", "b"), ("a", "p")).distinct()
        new = materialize(reached.join(known, (F.col("graph_id") == F.col("g")) & (F.col("a.id") == F.col("ka")) & (F.col("b.id") == F.col("kb")), "left_anti"), "edges")
    every = reduce(DataFrame.unionByName, rounds).where("p is not null").select("graph_id", F.array_sort(F.array("a.id", "b.id", "p.id")).alias("t"))
    return every.distinct().select("graph_id", *[F.col("t")[k].alias(c) for k, c in enumerate("pqr")])


def _sides(judged: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Directed edges of answered questions; a question without a settled answer has its own side alone whole, the others lack an end."""
    return judged.select("graph_id", F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])).alias("e")).select("graph_id", "e.a", "e.b")


def _wider(judged: DataFrame, columns: list[str]) -> DataFrame:
    """The questions that the searched block left open, one level up."""
    return judged.where("not settled").select(*[(F.col(c) + 1).cast("int").alias(c) if c == "level" else c for c in columns])


def dual(points: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)``: a vertex for each triangle at its centroid, numbered from 1 by its points, and an edge for each side that two triangles share, named from 1 by its ends.

    Degrees are at most three, so every vertex has few candidates. A side of more
    than two triangles, as points on one circle make them, is no edge.
    """
    numbered = materialize(number_rows(triangles, ["graph_id"], ["p", "q", "r"], "vertex_id"), "triangles")
    corners = numbered.select("graph_id", "vertex_id", F.explode(F.array("p", "q", "r")).alias("point_id"))
    where = points.groupBy("graph_id", "point_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    vertices = corners.join(where, ["graph_id", "point_id"]).groupBy("graph_id", "vertex_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("s"), F.col(b).alias("t")) for a, b in ("pq", "pr", "qr")])).alias("side")
    shared = numbered.select("graph_id", "vertex_id", sides).groupBy("graph_id", "side").agg(F.min("vertex_id").alias("u"), F.max("vertex_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n = 2")
    edges = number_rows(shared.select("graph_id", "u", "v"), ["graph_id"], ["u", "v"], "edge_name")
    return vertices, edges.select("graph_id", F.col("edge_name").cast("int").alias("edge_name"), "u", "v")


def dual_edges(points: DataFrame) -> DataFrame:
    """The edges of ``dual`` for the triangles of ``points``: small sets without another shuffle."""
    sets, great = _by_size(points)
    found = sets.mapInArrow(_whole_sets(_dual_edges), f"graph_id {sets.schema['graph_id'].dataType.simpleString()}, edge_name int, u long, v long")
    return found if great is None else found.unionByName(dual(great, waves(great))[1])
