"""Triangles of points against their definition: Euler's count, empty circles, whole hulls."""

import collections
import itertools
import math
import random

import numpy as np

from treeweave.operators.candidates import all_candidates
from treeweave.plans import catalogue
from treeweave.sources import planar

SCHEMA = "graph_id string, point_id long, x double, y double"


def hull(points):
    """Andrew's chain: the corners of the convex hull."""
    points = sorted(points)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out = []
    for side in (points, points[::-1]):
        part = []
        for p in side:
            while len(part) > 1 and turn(part[-2], part[-1], p) <= 0:
                part.pop()
            part.append(p)
        out += part[:-1]
    return out


def holds(points, triangles):
    xy = np.array(list(points.values()))
    assert len(triangles) == 2 * len(points) - 2 - len(hull(list(points.values())))  # Euler's formula for triangles that fill the hull
    for t in triangles:
        (ax, ay), (bx, by), (cx, cy) = (points[i] for i in t)
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        assert (np.hypot(xy[:, 0] - ux, xy[:, 1] - uy) >= math.hypot(ax - ux, ay - uy) * (1 - 1e-9)).all()


def test_triangles_and_duals(spark):
    """One wide graph, one clustered, small and degenerate ones, at once; the duals are solved."""
    rng = random.Random(3)
    sets = {
        "wide": {i: (rng.gauss(3, 2.5), 4 * rng.gauss(3, 2.5)) for i in range(200)},
        "clustered": {i: (rng.random() * 10 ** rng.choice((0, 0, 3)), rng.random()) for i in range(60)},
        "four": {1: (0.0, 0.0), 2: (4.0, 0.0), 3: (0.0, 4.1), 4: (1.0, 1.0)},
        "three": {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (0.0, 1.0)},
        "line": {i: (float(i), 2.0 * i) for i in range(5)},
        "two": {1: (0.0, 0.0), 2: (1.0, 1.0)},
        "one": {1: (0.0, 0.0)},
    }
    rows = [(g, i, *p) for g, points in sets.items() for i, p in points.items()]
    rows += [("four", 9, 1.0, 1.0), ("four", 10, None, 1.0), ("four", 11, float("nan"), 1.0), ("four", 12, float("inf"), 1.0), (None, 1, 0.0, 0.0), ("four", None, 2.0, 2.0)]
    given = spark.createDataFrame(rows, SCHEMA)
    found = planar.triangulate(given).collect()
    by = {g: [(r["p"], r["q"], r["r"]) for r in found if r["graph_id"] == g] for g in sets}
    for g in ("wide", "clustered", "four", "three"):
        holds(sets[g], by[g])
    assert not by["line"] and not by["two"] and not by["one"]
    assert sum(map(len, by.values())) == len(found)

    small = [r for r in found if r["graph_id"] in ("four", "three")]
    vertices, edges = planar.dual(given, spark.createDataFrame(small))
    assert sorted((r["graph_id"], r["vertex_id"]) for r in vertices.collect()) == [("four", 1), ("four", 2), ("four", 3), ("three", 1)]
    assert sorted((r["graph_id"], r["edge_name"], r["u"], r["v"]) for r in edges.collect()) == [("four", 1, 1, 2), ("four", 2, 1, 3), ("four", 3, 2, 3)]
    roots = edges.groupBy("graph_id").agg({"u": "min"}).toDF("graph_id", "vertex_id")
    assert all_candidates(edges, roots).count() > 0


def test_no_points(spark):
    empty = spark.createDataFrame([], SCHEMA)
    triangles = planar.triangulate(empty)
    assert triangles.collect() == [] and triangles.columns == ["graph_id", "p", "q", "r"]
    assert planar.dual(empty, triangles)[1].collect() == []


def test_small_sets_are_told_by_definition(spark):
    """Sets with many points on one line and on one circle, in whole numbers: every three points with none inside their circle, in one task and without a written step a round."""
    rng = random.Random(5)
    sets = {f"s{k}": list(dict.fromkeys((rng.randrange(5), rng.randrange(5)) for _ in range(9))) for k in range(30)}
    rows = [(g, i, float(x), float(y)) for g, points in sets.items() for i, (x, y) in enumerate(points)]
    given = spark.createDataFrame(rows, SCHEMA)
    want, edges = set(), set()
    for g, points in sets.items():
        own = []
        for t in itertools.combinations(range(len(points)), 3):
            (ax, ay), (bx, by), (cx, cy) = (points[i] for i in t)
            area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
            inside = 0
            for x, y in points:
                a, b, c = ((px - x, py - y) for px, py in ((ax, ay), (bx, by), (cx, cy)))
                size = lambda v: v[0] ** 2 + v[1] ** 2
                turn = lambda v, w: v[0] * w[1] - w[0] * v[1]
                inside += area * (size(a) * turn(b, c) - size(b) * turn(a, c) + size(c) * turn(a, b)) > 0
            if area and not inside:
                own.append(t)
        want |= {(g, *t) for t in own}
        sides = collections.defaultdict(list)
        for k, t in enumerate(sorted(own), 1):
            for side in itertools.combinations(t, 2):
                sides[side].append(k)
        edges |= {(g, i, *uv) for i, uv in enumerate(sorted(tuple(s) for s in sides.values() if len(s) == 2), 1)}
    found = planar.triangulate(given)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert {tuple(r) for r in planar.dual_edges(given).collect()} == edges
    assert {tuple(r) for r in planar.dual(given, found)[1].collect()} == edges


def test_greater_sets_go_by_waves(spark, monkeypatch):
    """Points in general position: either way gives the same triangles and duals."""
    rng = random.Random(8)
    rows = [(g, i, rng.random(), rng.random()) for g, n in (("few", 20), ("many", planar.WHOLE + 2)) for i in range(n)]
    given = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, planar.triangulate(given).collect()))
    dual = planar.dual(given, spark.createDataFrame(found, "graph_id string, p long, q long, r long"))[1].collect()
    monkeypatch.setattr(planar, "WHOLE", 100)
    assert found == sorted(map(tuple, planar.triangulate(given).collect())) and {g for g, *_ in found} == {"few", "many"}
    assert sorted(map(tuple, planar.dual_edges(given).collect())) == sorted(map(tuple, dual))


def test_duals_of_small_sets_write_no_rows_between(spark, monkeypatch):
    monkeypatch.setattr(planar, "number_rows", None)
    made = catalogue.QUERIES["planar_dual"](spark, "/root/testdata/sf0.001")
    assert made.columns == ["graph_id", "edge_name", "u", "v"] and made.count() > 1000
