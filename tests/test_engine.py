"""Paths, merge order, greedy, assembly and conversion against plain Python on made graphs."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from treeweave.functions.geometry import distance
from treeweave.operators import candidates as C
from treeweave.operators import paths, solve, tree
from treeweave.operators.beam import histogram
from treeweave.operators.greedy import greedy
from treeweave.operators.voxels import voxelise
from treeweave.plans.merge_order import merge_rounds, merge_sequence
from treeweave.plans.recover import recover_files, with_lengths
from treeweave.runtime import forget, materialize
from treeweave.sources import costs, ply, tables, testgraphs

EDGE = "graph_id string, edge_name int, u long, v long, len long"


def made_graph(rng, n, extra, chain):
    """A random tree of n vertices with extra edges, each edge cut into up to ``chain`` pieces."""
    pairs = [(i, rng.randrange(1, i)) for i in range(2, n + 1)] + [tuple(rng.sample(range(1, n + 1), 2)) for _ in range(extra)]
    out, top = [], n
    for u, v in pairs:
        for _ in range(rng.randrange(chain)):
            top += 1
            out.append((u, top))
            u = top
        out.append((u, v))
    return [(i + 1, u, v, rng.randrange(1, 9)) for i, (u, v) in enumerate(out)]


def dijkstra(edges, root):
    near = {}
    for _, u, v, w in edges:
        if w is not None:
            near.setdefault(u, []).append((v, w))
            near.setdefault(v, []).append((u, w))
    dist, heap = {}, [(0, root)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in dist:
            dist[x] = d
            for y, w in near.get(x, ()):
                heapq.heappush(heap, (d + w, y))
    return dist


def test_paths_with_chains(spark):
    rng = random.Random(11)
    graphs = {f"r{i}": made_graph(rng, rng.randrange(2, 12), rng.randrange(5), 6) for i in range(12)}
    graphs["long"] = made_graph(rng, 25, 12, 20)
    graphs["ring"] = [(i, i, i % 9 + 1, 1) for i in range(1, 10)]
    graphs["lost ring"] = [(1, 1, 2, 3), (2, 3, 4, 1), (3, 4, 5, 1), (4, 5, 3, 1)]
    graphs["parallel"] = [(1, 1, 2, 4), (2, 1, 2, 3), (3, 2, 2, 1), (4, 2, 3, None), (5, 2, 3, 0)]
    roots = {g: 1 if g != "r3" else max(x for _, *uv, _ in es for x in uv) for g, es in graphs.items()}
    edges = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], EDGE)
    got = {}
    for r in paths.shortest_paths(edges, spark.createDataFrame(list(roots.items()), "graph_id string, vertex_id long")).collect():
        assert got.setdefault(r["graph_id"], {}).setdefault(r["vertex_id"], r["dist"]) == r["dist"]
    assert got == {g: dijkstra(es, roots[g]) for g, es in graphs.items()}
    assert paths.shortest_paths(edges.where("false"), spark.createDataFrame([("x", 1)], "graph_id string, vertex_id long")).collect()[0]["dist"] == 0


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    graphs = {f"s{i}": made_graph(rng, rng.randrange(2, 6), rng.randrange(3), 2) for i in range(15)}
    edges = materialize(spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], EDGE).where("u <> v"), "edges")
    roots = spark.createDataFrame([(g, 1) for g in graphs], "graph_id string, vertex_id long")
    return edges, roots, materialize(C.all_candidates(edges, roots), "candidates")


def test_solver_against_brute_force(small):
    edges, _, cands = small
    want = {r["graph_id"]: r["best_cost"] for r in solve.brute_force(edges, cands).collect()}
    for priority in ("diff",):
        got = {r["graph_id"]: (r["status"], r["cost"]) for r in solve.solve(edges, cands, priority).status.collect()}
        assert got == {g: ("infeasible" if c is None else "solved", c) for g, c in want.items()}


def test_wide_boundaries_are_a_status(small):
    edges, _, cands = small
    wide = {r["graph_id"] for r in merge_rounds(edges)[0].sparkSession.createDataFrame([(r["graph_id"], r["boundary"]) for m in merge_rounds(edges) for r in m.collect()], "graph_id string, b long").where("b > 1").collect()}
    got = solve.solve(edges, cands, max_boundary=1)
    status = {r["graph_id"]: r["status"] for r in got.status.collect()}
    assert wide and {g for g, s in status.items() if s == "too_wide"} == wide and set(status.values()) - {"too_wide"} <= {"solved", "infeasible"}
    assert not wide & {r["graph_id"] for r in got.choices.select("graph_id").collect()}


@pytest.mark.parametrize("kind, bound", [("ladder", 4), ("tree with long chains", 4)])
def test_boundaries_of_the_merge_order(spark, kind, bound):
    """The greatest boundary stays near what the graph's shape allows; a vertex's own edges are a boundary, too."""
    rng = random.Random(1)
    if kind == "ladder":
        pairs = [(i, i + 2) for i in range(1, 13)] + [(i, i + 1) for i in range(1, 14, 2)]
    else:
        pairs = [(u, v) for _, u, v, _ in made_graph(rng, 12, 2, 6)]
    edges = spark.createDataFrame([("g", i + 1, u, v) for i, (u, v) in enumerate(pairs)], "graph_id string, edge_name int, u long, v long")
    rounds = merge_rounds(edges)
    ends = [x for p in pairs for x in p]
    assert max(r.agg(F.max("boundary")).first()[0] for r in rounds) <= max(bound, max(map(ends.count, ends)))
    assert sum(r.count() for r in rounds) == len({x for p in pairs for x in p}) - 1


def plain_ways(edges, root):
    """Parent and child of each edge (name: u, v, length), by Dijkstra and the turning of half chains, for one graph."""
    near, dist, heap = {}, {}, [(0, root)]
    for n, (u, v, w) in edges.items():
        near.setdefault(u, []).append((n, v, w))
        near.setdefault(v, []).append((n, u, w))
    while heap:
        d, x = heapq.heappop(heap)
        if x not in dist:
            dist[x] = d
            for _, y, w in near[x]:
                heapq.heappush(heap, (d + w, y))
    ways = {n: tuple(sorted((u, v), key=lambda x: (dist[x], x))) for n, (u, v, _) in edges.items() if u != v}
    inner = {x for x, es in near.items() if len(es) == 2 and x != root}
    meets = {x for x in inner if all(ways.get(n, (x, 0))[1] == x for n, *_ in near[x])}
    flips = set()
    for m in meets:
        halves = {}
        for n, y, _ in near[m]:
            chain = [n]
            while y in inner and y not in meets:
                n, y = next((k, z) for k, z, _ in near[y] if k != n)
                chain.append(n)
            halves[min(chain)] = ((dist[y], y) if y not in meets else (-1, -1), min(chain), chain)
        if len(halves) == 2:
            flips.update(max(halves.values())[2])
    return {n: (c, p) if n in flips else (p, c) for n, (p, c) in ways.items()}, near


def plain_greedy(edges, cands, root):
    ways, near = plain_ways(edges, root)
    got = {}
    for x in near:
        given = sorted(n for n, (_, c) in ways.items() if c == x)
        twins = set()
        if len(near[x]) > 2:
            for (n, a, _), (k, b, _) in itertools.combinations(near[x], 2):
                if a != b and len(near[a]) == len(near[b]) == 2 and any(y == b for _, y, _ in near[a]):
                    twins.add((n, k))
        fit = [c for v, blocks, incoming, c in cands if v == x and incoming == given and not any(n in b and k in b for n, k in twins for b in blocks)]
        got[x] = min(fit, default=None)
    return got


def test_greedy_takes_the_cheapest_fitting_candidate(spark, small):
    lines = testgraphs.order_graphs(spark, "/root/testdata/sf0.001")[0].withColumn("len", F.col("v") - F.col("u"))
    many = lines, lines.groupBy("graph_id").agg(F.min("u").alias("vertex_id"))
    for edges, roots, cands in (small, (*many, C.all_candidates(*many))):
        graphs, choices, root = {}, {}, dict(map(tuple, roots.select("graph_id", "vertex_id").collect()))
        for r in edges.collect():
            graphs.setdefault(r["graph_id"], {})[r["edge_name"]] = r["u"], r["v"], r["len"]
        for r in cands.collect():
            choices.setdefault(r["graph_id"], []).append((r["vertex_id"], r["blocks"], sorted(r["incoming"]), r["cost"]))
        want = {(g, x): c for g, es in graphs.items() for x, c in plain_greedy(es, choices[g], root[g]).items() if x != root[g]}
        got = {(r["graph_id"], r["vertex_id"]): r for r in greedy(edges, cands, roots).collect()}
        assert {k: (r["cost"] if r["status"] == "chosen" else None) for k, r in got.items() if k[1] != root[k[0]]} == want
        assert all(r["status"] == "chosen" for k, r in got.items() if k[1] == root[k[0]])  # a chain from the root to the root may turn one end inward


def test_total_cost_counts_branches_only_by_default(small):
    edges, _, cands = small
    chosen = solve.solve(edges, cands).choices.collect()
    degree = {}
    for r in edges.collect():
        for x in (r["u"], r["v"]):
            degree[r["graph_id"], x] = degree.get((r["graph_id"], x), 0) + 1
    want = {}
    for r in chosen:
        if degree[r["graph_id"], r["vertex_id"]] > 2 and r["incoming"]:
            want[r["graph_id"]] = want.get(r["graph_id"], 0) + r["cost"]
    df = edges.sparkSession.createDataFrame(chosen)
    assert dict(map(tuple, solve.total_cost(df, edges).collect())) == want


def test_recover_files(spark, tmp_path):
    """A square with a tail, as files: the tree is written as PLY with its vertices' and edges' attributes. The beam is wide enough to be exact."""
    edges = [(1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 0), (5, 2, 4)]
    head = "ply\nformat ascii 1.0\nelement vertex 5\nproperty double x\nproperty double y\nproperty double z\nproperty int root\nelement edge 5\nproperty int vertex1\nproperty int vertex2\nproperty int name\nend_header\n"
    text = head + "".join(f"{x} {y} 0 {int(i == 0)}\n" for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0), (2, 2)])) + "".join(f"{u} {v} {n}\n" for n, u, v in edges)
    (tmp_path / "graphs").mkdir()
    (tmp_path / "graphs/sq.ply").write_text(text)
    (tmp_path / "costs").mkdir()
    frame = spark.createDataFrame([("sq", n, u + 1, v + 1) for n, u, v in edges], "graph_id string, edge_name int, u long, v long")
    cands = C.all_candidates(frame, spark.createDataFrame([("sq", 1)], "graph_id string, vertex_id long"))
    (tmp_path / "costs/sq.txt").write_text(costs.to_text(cands).first()["text"])
    best = solve.brute_force(frame, cands).first()["best_cost"]
    from treeweave.operators.beam import Beam

    for name, beam in (("beam", Beam("fixed", 50)),):
        status = recover_files(spark, str(tmp_path / "graphs"), str(tmp_path / "costs"), str(tmp_path / name), beam).collect()
        assert [(r["graph_id"], r["status"], r["cost"]) for r in status] == [("sq", "solved", best)]
        got = spark.read.text(str(tmp_path / name), wholetext=True).select("graph_id", F.col("value").alias("text"))
        v, e = ply.parse(got)
        vs, es = v.collect(), e.collect()
        assert {r["graph_id"] for r in vs} == {"sq_tree"} and len(vs) == 6 and len(es) == 5
        assert sorted(int(r["attributes"]["og_vertex"]) for r in vs if int(r["attributes"]["copy"]) > 0) == [int(r["attributes"]["og_vertex"]) for r in vs[5:]]
        place = {int(r["attributes"]["og_vertex"]): (r["x"], r["y"]) for r in vs}
        assert place == {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (2, 2)}
        ends = {r["edge_name"]: {int(vs[r[x] - 1]["attributes"]["og_vertex"]) for x in "uv"} for r in es}
        assert ends == {n: {u + 1, v + 1} for n, u, v in edges}


def test_split_graph_of_graphs_without_choices(small):
    edges, _, cands = small
    vertices = edges.select("graph_id", F.col("u").alias("vertex_id")).distinct().limit(0)
    v, e = tree.split_graph(vertices, edges, solve.solve(edges, cands).choices.where("false"))
    assert v.count() == 0 and e.count() == 0


def test_lengths_from_coordinates(spark):
    v = spark.createDataFrame([("g", 1, 0.0, 0.0, 0.0), ("g", 2, 3.0, 4.0, None)], "graph_id string, vertex_id long, x double, y double, z double")
    e = spark.createDataFrame([("g", 1, 1, 2, None), ("g", 2, 1, 2, 7.0)], "graph_id string, edge_name int, u long, v long, len double")
    assert {r["edge_name"]: r["len"] for r in with_lengths(v, e).collect()} == {1: 5.0, 2: 7.0}
    assert {r["len"] for r in with_lengths(v, e.drop("len")).collect()} == {5.0}
    assert v.select(distance([F.col("x")], [F.lit(2.0)]).alias("d")).collect()[1]["d"] == 1.0


def test_full_candidates(spark):
    edges = spark.createDataFrame([("g", 1, 5, 6), ("g", 2, 6, 7), ("g", 3, 6, 8), ("g", 4, 8, 9)], "graph_id string, edge_name int, u long, v long")
    roots = spark.createDataFrame([("g", 5)], "graph_id string, vertex_id long")
    small = spark.createDataFrame([("g", 1, [[1]], [], 0.5), ("g", 2, [[1, 2, 3]], [1], 0.7), ("g", 3, [[2]], [2], 9.0)], "graph_id string, vertex_id long, blocks array<array<int>>, incoming array<int>, cost double")
    ids = spark.createDataFrame([("g", 1, 4), ("g", 2, 5), ("g", 3, 6)], "graph_id string, vertex_id long, original_id long")
    got = sorted((r["vertex_id"], r["blocks"], r["incoming"], r["cost"]) for r in tables.full_candidates(small, ids, edges, roots).collect())
    assert got == [(5, [[1]], [], 0.5), (6, [[1, 2, 3]], [1], 0.7), (7, [[2]], [2], 0.0), (8, [[3, 4]], [3], 0.0), (8, [[3, 4]], [4], 0.0), (9, [[4]], [4], 0.0)]


def test_plot_rows_and_histogram(spark, small):
    steps = merge_sequence(small[0])
    rows = tables.plot_rows(steps).collect()
    assert len(rows) == steps.count() and all(r["children"] == sorted(r["children"]) and max(r["children"]) < r["parent"] for r in rows)
    df = spark.createDataFrame([("a", "k", 2.0), ("a", "k", 1.0), ("a", "l", 3.0), ("b", "k", 5.0)], "g string, key string, cost double")
    assert {r["g"]: r["costs"] for r in histogram(df, ["g"]).collect()} == {"a": {"k": 1.0, "l": 3.0}, "b": {"k": 5.0}}


def test_voxels_leave_no_holes(spark):
    seg = spark.createDataFrame([("g", 1, 0.0, 0.0, 0.0, 40.0, 0.0, 0.0, 1.0), ("g", 2, 5.0, 5.0, None, 6.0, 6.0, 6.0, 0.5), ("g", 3, 7.0, 7.0, 7.0, 7.0, 7.0, 7.0, 0.5)], "graph_id string, segment_id int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, value double")
    got = {(r["x"], r["y"], r["z"]): r["value"] for r in voxelise(seg).collect()}
    assert got == {**{(x, 0, 0): 255 for x in range(41)}, (7, 7, 7): 127}
    assert len(voxelise(seg.where("segment_id = 1"), steps=5).collect()) == 6


def test_merge_metrics(spark):
    from treeweave.operators.graph import merge_priorities

    edges = spark.createDataFrame([("g", 1, 1, 2), ("g", 2, 1, 2), ("g", 3, 2, 3), ("g", 4, 1, 4)], "graph_id string, edge_name int, u long, v long")
    got = {(r["u"], r["v"]): r.asDict() for r in merge_priorities(edges).collect()}
    assert {k: got[1, 2][k] for k in ("m", "outdegree", "product", "indegree", "maxdegree", "degrees")} == {"m": 2, "outdegree": 2, "product": 1, "indegree": 2, "maxdegree": 3, "degrees": 9}
    assert got[1, 2]["diff"] == pytest.approx(9 - math.log(2)) and got[2, 3]["diffinv"] == pytest.approx(math.log(2) - 3)


def test_written_tables_can_be_dropped(spark):
    df = materialize(spark.range(3), "gone")
    path = df.inputFiles()[0].rpartition("/")[0]
    forget(df, None, spark.range(2))
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
