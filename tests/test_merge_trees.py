"""Merge trees, minimum cuts, spectral orders and split trees of several graphs at once, against plain Python and numpy."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweave.functions import partitions as P
from treeweave.operators import candidates as C
from treeweave.operators import core, cuts, merge_tree, solve, spectral
from treeweave.operators import graph as G
from treeweave.plans import catalogue, split_tree
from treeweave.plans.merge_order import merge_rounds
from treeweave.sources import testgraphs

SF = "/root/testdata/sf0.001"


def made(seed, sizes):
    """Graphs g0, g1 ... with parallel edges and loops, the last of two components, and a merge tree of each: vertices and clusters drawn at random, or all in a chain."""
    r = random.Random(seed)
    graphs, merges = {}, {}
    for g, n in enumerate(sizes):
        parts = [range(1, n + 1)] if g < len(sizes) - 1 else [range(1, n // 2 + 1), range(n // 2 + 1, n + 1)]
        edges, own, top = [], [], n
        for part in parts:
            edges += [(r.randint(max(part[0], i - 3), i - 1), i) for i in part[1:]] + [(r.choice(part), r.choice(part)) for _ in range(r.randint(0, n))]
            left = list(part)
            while len(left) > 1:
                if g % 2:
                    r.shuffle(left)
                a, b = left.pop(), left.pop()
                top += 1
                own.append((min(a, b), max(a, b), top))
                left.append(top)
        graphs[f"g{g}"] = [(i, u, v) for i, (u, v) in enumerate(edges)]
        merges[f"g{g}"] = own
    return graphs, merges


GRAPHS, MERGES = made(3, [2, 3, 4, 7, 9, 20, 12, 11])
VERTICES = {g: sorted({x for e in es for x in e[1:]}) for g, es in GRAPHS.items()}


def leaves(merges, x):
    kids = {n: (a, b) for a, b, n in merges}
    return leaves(merges, kids[x][0]) | leaves(merges, kids[x][1]) if x in kids else {x}


def out(g, inside):
    return sum((u in inside) != (v in inside) for _, u, v in GRAPHS[g])


def price(g, merges):
    total = 0
    for a, b, _ in merges:
        x, y = out(g, leaves(merges, a)), out(g, leaves(merges, b))
        total += x * y * (x + y)
    return total


def clusters(merges):
    return sorted(sorted(leaves(merges, n)) for *_, n in merges)


def by_graph(df):
    found = collections.defaultdict(list)
    for r in df.collect():
        found[r["graph_id"]].append((r["left_id"], r["right_id"], r["new_id"]))
    return found


@pytest.fixture(scope="module")
def tables(spark):
    edges = spark.createDataFrame([(g, *e) for g, es in GRAPHS.items() for e in es], "graph_id string, edge_name int, u long, v long")
    return edges, spark.createDataFrame([(g, *m) for g, ms in MERGES.items() for m in ms], merge_tree.MERGE)


@pytest.fixture(scope="module")
def tree(tables):
    return merge_tree.merge_tree(*tables)


def roots_of(merges):
    kids = {c for a, b, _ in merges for c in (a, b)}
    return sorted(n for *_, n in merges if n not in kids)


def test_region_costs(tables, tree):
    want = {}
    for g, ms in MERGES.items():
        want |= {(g, v): (out(g, {v}),) * 2 for v in VERTICES[g]}
        want |= {(g, n): (out(g, leaves(ms, n)), out(g, leaves(ms, a)) * out(g, leaves(ms, b))) for a, b, n in ms}
    costs = merge_tree.region_costs(tables[0], tree)
    assert {(r["graph_id"], r["node"]): (r["outdegree"], r["cost"]) for r in costs.collect()} == want
    totals = {r["graph_id"]: (r["cost"], r["widest"]) for r in merge_tree.sequence_costs(costs).collect()}
    assert totals == {g: (sum(c for (h, _), (_, c) in want.items() if h == g), max(o for (h, _), (o, _) in want.items() if h == g)) for g in GRAPHS}


def test_tree_order(tree):
    rows = merge_tree.tree_order(tree).collect()
    for g, ms in MERGES.items():
        kids = {n: (a, b) for a, b, n in ms}
        level, preorder, breadth, queue = dict.fromkeys(roots_of(ms), 0), {}, [], roots_of(ms)
        while queue:
            x = queue.pop(0)
            breadth.append(x)
            queue += kids.get(x, ())
            level |= {k: level[x] + 1 for k in kids.get(x, ())}

        def walk(x, k):
            preorder[x] = k
            k += 1
            for y in kids.get(x, ()):  # noqa: B023
                k = walk(y, k)
            return k

        for x in roots_of(ms):
            walk(x, 1)
        own = sorted((r for r in rows if r["graph_id"] == g), key=lambda r: r["place"])
        assert [r["node"] for r in own] == breadth[::-1] and [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert all((r["level"], r["preorder"]) == (level[r["node"]], preorder[r["node"]]) for r in own)
        assert {r["node"]: r["parent"] for r in own if r["parent"]} == {c: n for a, b, n in ms for c in (a, b)}


def test_sequence_and_trigraph(tables, tree):
    for g, s in by_graph(merge_tree.sequence_of(tree).orderBy("step")).items():
        assert clusters(s) == clusters(MERGES[g])
        assert sorted(n for *_, n in s) == [max(VERTICES[g]) + k for k in range(1, len(s) + 1)] and all(a < n and b < n for a, b, n in s)
    links, held = merge_tree.trigraph(tables[1])
    top = tables[1].groupBy("graph_id").agg(F.max("new_id").alias("top"))
    assert {g: clusters(s) for g, s in by_graph(merge_tree.merges_of(links, held, top)).items()} == {g: clusters(m) for g, m in MERGES.items()}


def test_a_deep_tree_is_directed(spark):
    n = 400
    links = spark.createDataFrame([("g", i, i + 1) for i in range(n)] + [("g", i, 1000 + i) for i in range(0, n, 7)] + [("lost", 1, 2)], "graph_id string, a long, b long")
    up = merge_tree.rooted(links, spark.createDataFrame([("g", 200)], "graph_id string, node long")).collect()
    assert {r["node"]: r["parent"] for r in up} == {i: i + 1 for i in range(200)} | {i: i - 1 for i in range(201, n + 1)} | {1000 + i: i for i in range(0, n, 7)}


def with_root_on(merges, root, link):
    """The tree of ``root`` without it, directed again from a link."""
    kids = {n: (a, b) for a, b, n in merges}
    own, todo, links = [], [root], [frozenset(kids[root])]
    while todo:
        x = todo.pop()
        for k in kids.get(x, ()):
            todo.append(k)
            if x != root:
                links.append(frozenset((x, k)))
    if link is None:
        return links
    near = collections.defaultdict(set)
    for a, b in (tuple(x) for x in links if x != link):
        near[a].add(b)
        near[b].add(a)
    own, todo, seen = [(*link, root)], list(link), set(link)
    while todo:
        x = todo.pop()
        new = sorted(near[x] - seen)
        seen |= set(new)
        todo += new
        if new:
            own.append((*new, x))
    return own


def test_best_roots(tables, tree):
    got = by_graph(merge_tree.rerooted(tables[0], tree))
    gains = collections.defaultdict(dict)
    for r in merge_tree.root_gains(tables[0], tree).collect():
        gains[r["graph_id"]][r["node"]] = r["gain"]
    better = 0
    for g, ms in MERGES.items():
        best = 0
        parent = {c: n for a, b, n in ms for c in (a, b)}
        for root in roots_of(ms):
            own = [m for m in ms if leaves(ms, m[2]) <= leaves(ms, root)]
            costs = {link: price(g, with_root_on(own, root, link)) for link in with_root_on(own, root, None)}
            best += min(costs.values())
            for x in {c for a, b, _ in own for c in (a, b)}:
                link = frozenset((x, parent[x])) if parent[x] != root else frozenset(next((a, b) for a, b, n in own if n == root))
                assert gains[g][x] == costs[link] - price(g, own)
        assert price(g, got[g]) == best and len(got[g]) == len(ms)
        better += best < price(g, ms)
    assert better >= 3


def rotated_plainly(g, merges):
    cost = lambda x, y: x * y * (x + y)
    while True:
        kids = {n: (a, b) for a, b, n in merges}
        size = {x: out(g, leaves(merges, x)) for m in merges for x in m}
        moves = []
        for u, pair in kids.items():
            for v, a in (pair, pair[::-1]):
                for b, c in (kids[v], kids[v][::-1]) if v in kids else ():
                    ab = out(g, leaves(merges, a) | leaves(merges, b))
                    moves.append((cost(ab, size[c]) + cost(size[a], size[b]) - cost(size[a], size[v]) - cost(size[b], size[c]), u, v, b, a, c))
        moves = [m for m in moves if m[0] < 0]
        best = {}
        for m in moves:
            for x in m[1:3]:
                best[x] = min(best.get(x, m), m)
        taken = [m for m in moves if best[m[1]] == best[m[2]] == m]
        if not taken:
            return sorted(merges)
        before = price(g, merges)
        for _, u, v, b, a, c in taken:
            merges = [m for m in merges if m[2] not in (u, v)] + [(*sorted((v, c)), u), (*sorted((a, b)), v)]
        assert price(g, merges) == before + sum(m[0] for m in taken)


def test_rotations(tables):
    some = ("g3", "g4", "g7")
    edges, merges = (t.where(F.col("graph_id").isin(*some)) for t in tables)
    got = by_graph(merge_tree.rotated(edges, merges))
    assert {g: sorted(got[g]) for g in some} == {g: rotated_plainly(g, MERGES[g]) for g in some}
    assert any(price(g, got[g]) < price(g, MERGES[g]) for g in some)


def test_chains_of_orders_rotate_to_a_local_optimum(spark):
    edges = testgraphs.order_graphs(spark, SF)[0]
    chains = {r["graph_id"]: r["price"] for r in merge_tree.tree_prices(edges, merge_tree.merge_tree(edges, testgraphs.chain_merges(edges))).collect()}
    got = {r["graph_id"]: r["price"] for r in catalogue.QUERIES["rotated_trees"](spark, SF).collect()}
    assert got.keys() == chains.keys() and all(got[g] <= chains[g] for g in chains) and sum(got[g] < chains[g] for g in chains) > 10


def greatest_flow(g, sources, targets):
    room = collections.Counter()
    name = lambda x: "s" if x in sources else "t" if x in targets else x
    for _, u, v in GRAPHS[g]:
        room[name(u), name(v)] += 1
        room[name(v), name(u)] += 1
    flow = 0
    while True:
        came, queue = {"s": None}, ["s"]
        for x in queue:
            for (a, b), r in room.items():
                if a == x and r > 0 and b not in came:
                    came[b] = x
                    queue.append(b)
        if "t" not in came:
            return flow
        x = "t"
        while came[x] is not None:
            room[came[x], x] -= 1
            room[x, came[x]] += 1
            x = came[x]
        flow += 1


@pytest.mark.parametrize("seed", [1])
def test_minimum_cuts(spark, tables, seed):
    r = random.Random(seed)
    ends = {}
    for g, vs in VERTICES.items():
        mixed = r.sample(vs, len(vs))
        k = r.randint(1, max(1, len(vs) // 3))
        ends[g] = mixed[:k], mixed[k : 2 * k]
    rows = [(g, x, side) for g, pair in ends.items() for side, xs in zip(("source", "target"), pair) for x in xs] + [("none", 1, "source")]
    cut = cuts.minimum_cut(tables[0], spark.createDataFrame(rows, "graph_id string, vertex_id long, side string"))
    value = {x["graph_id"]: x["cut"] for x in cut.value.collect()}
    side = collections.defaultdict(dict)
    for x in cut.sides.collect():
        side[x["graph_id"]][x["vertex_id"]] = x["side"]
    assert value == {g: greatest_flow(g, *map(set, pair)) for g, pair in ends.items()}
    for g, pair in ends.items():
        assert sum(side[g][u] != side[g][v] for _, u, v in GRAPHS[g]) == value[g] and sorted(side[g]) == VERTICES[g]
        assert all(side[g][x] == s for s, xs in zip(("source", "target"), pair) for x in xs)


def components_of(g):
    near = {v: {v} for v in VERTICES[g]}
    for _, u, v in GRAPHS[g]:
        whole = near[u] | near[v]
        near |= dict.fromkeys(whole, whole)
    return sorted({tuple(sorted(s)) for s in near.values()})


def test_spectral_order(spark, tables):
    more = spark.createDataFrame([("g0", 77)], "graph_id string, vertex_id long")  # a vertex without an edge
    vertices = tables[0].select("graph_id", F.explode(F.array("u", "v")).alias("vertex_id")).distinct().unionByName(more)
    order, told = spectral.spectral_order(tables[0], vertices)
    rows = collections.defaultdict(list)
    for r in order.orderBy("place").collect():
        rows[r["graph_id"]].append(r)
    value = {(r["graph_id"], r["component"]): r["value"] for r in told.collect()}
    for g in GRAPHS:
        parts = components_of(g) + [(77,)] * (g == "g0")
        assert [r["place"] for r in rows[g]] == list(range(1, len(rows[g]) + 1))
        assert [r["component"] for r in rows[g]] == [p[0] for p in parts for _ in p]
        for part in parts:
            own = [r for r in rows[g] if r["component"] == part[0]]
            assert [r["x"] for r in own] == sorted(r["x"] for r in own) and tuple(sorted(r["vertex_id"] for r in own)) == part
            if len(part) > 1:
                lap = np.zeros((len(part),) * 2)
                for _, u, v in GRAPHS[g]:
                    if u in part and u != v:
                        i, j = part.index(u), part.index(v)
                        lap += np.outer(e := np.eye(len(part))[i] - np.eye(len(part))[j], e)
                x = np.array([next(r["x"] for r in own if r["vertex_id"] == v) for v in part])
                second = np.linalg.eigvalsh(lap)[1]
                assert abs(x @ lap @ x / (x @ x) - second) < 1e-6 and abs(value[g, part[0]] - second) < 1e-6 and abs(x.sum()) < 1e-6


def test_spectral_values_of_orders(spark):
    edges = collections.defaultdict(list)
    for r in testgraphs.order_graphs(spark, SF)[0].collect():
        edges[r["graph_id"]].append((r["u"], r["v"]))
    got = {r["graph_id"]: r["value"] for r in catalogue.QUERIES["spectral_values"](spark, SF).collect()}
    assert got.keys() == edges.keys()
    for g, es in edges.items():
        names = sorted({x for e in es for x in e})
        lap = np.zeros((len(names),) * 2)
        for u, v in es:
            d = np.array([(n == u) - (n == v) for n in names], float)
            lap += np.outer(d, d)
        assert got[g] == pytest.approx(np.linalg.eigvalsh(lap)[1], abs=2e-6)


def test_split_trees_and_their_rounds(spark, tables):
    some = tables[0].where(F.col("graph_id").isin("g1", "g7"))
    merges = split_tree.split_merges(some)
    got = by_graph(merges)
    for g in ("g1", "g7"):
        assert len(got[g]) == len(VERTICES[g]) - len(components_of(g)) and sorted(map(tuple, (sorted(leaves(got[g], n)) for n in roots_of(got[g])))) == components_of(g)
    rounds = split_tree.rounds_of(some, merges)
    assert len(rounds) < 10
    now = {(g, v): {v} for g in got for v in VERTICES[g]}
    for i, r in enumerate(rounds):
        rows = r.collect()
        assert len({x for p in rows for x in ((p["graph_id"], p["left_id"]), (p["graph_id"], p["right_id"]))}) == 2 * len(rows)
        for p in rows:
            g = p["graph_id"]
            a, b = now.pop((g, p["left_id"])), now.pop((g, p["right_id"]))
            assert p["left_id"] == min(a | b) and p["left_id"] < p["right_id"] and p["boundary"] == out(g, a | b)
            assert p["shared"] == sorted(n for n, u, v in GRAPHS[g] if (u in a and v in b) or (u in b and v in a))
            now[g, p["left_id"]] = a | b


def test_solved_by_several_priorities(spark):
    edges = spark.createDataFrame([("k4", i, u, v) for i, (u, v) in enumerate([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (3, 5), (4, 5)])] + [("two", 1, 1, 2), ("two", 2, 3, 4)], "graph_id string, edge_name int, u long, v long")
    roots = spark.createDataFrame([("k4", 1), ("two", 1)], "graph_id string, vertex_id long")
    cands = C.all_candidates(edges, roots)
    best = {r["graph_id"]: r["best_cost"] for r in solve.brute_force(edges.where("graph_id = 'k4'"), cands.where("graph_id = 'k4'")).collect()}["k4"]
    assert sorted(map(tuple, solve.solve(edges, cands, ("boundary", "diff", "random")).status.collect())) == [("k4", "solved", best), ("two", "disconnected", None)]
    with pytest.raises(ValueError):
        merge_rounds(edges, ("boundary", "sideways"))


def plain_core(edges, root):
    """The vertices that stay, and the edges that lie in the core: leaves go until none is left, then vertices of degree 2."""
    left = {n: (u, v) for n, u, v in edges if u != v}
    vertices = {x for _, u, v in edges for x in (u, v)}
    while True:
        degree = collections.Counter(x for e in left.values() for x in e)
        tips = {x for x, d in degree.items() if d == 1 and x != root}
        if not tips:
            break
        gone = {n for n, (u, v) in left.items() if u in tips or v in tips}
        left = {n: e for n, e in left.items() if n not in gone}
    return vertices, left, {x for x, d in collections.Counter(x for e in left.values() for x in e).items() if d != 2 or x == root}


def test_core_graphs(spark, tables):
    lengths = {(g, n): (7 * n + len(g)) % 11 + 1 for g, es in GRAPHS.items() for n, *_ in es}
    ring = [("ring", i, i, i % 6 + 1) for i in range(1, 7)]
    rows = [(g, *e) for g, es in GRAPHS.items() for e in es] + ring
    lengths |= {("ring", i): i for i in range(1, 7)}
    edges = spark.createDataFrame([(g, n, u, v, lengths[g, n]) for g, n, u, v in rows], "graph_id string, edge_name int, u long, v long, len long")
    rooted = {"g2": 4, "g5": 1, "g6": 12}
    core_ = core.core_graph(edges, spark.createDataFrame(list(rooted.items()), "graph_id string, vertex_id long"))
    found, owners = collections.defaultdict(list), collections.defaultdict(dict)
    for r in core_.edges.collect():
        found[r["graph_id"]].append(r)
    for r in core_.owners.collect():
        owners[r["graph_id"]][r["vertex_id"]] = r["owner"]
    for g in [*GRAPHS, "ring"]:
        own = [(n, u, v) for h, n, u, v in rows if h == g]
        vertices, left, junctions = plain_core(own, rooted.get(g))
        ends = {n: (u, v) for n, u, v in own}
        assert sorted(n for r in found[g] for n in r["path"]) == sorted(left)
        for r in found[g]:
            at = r["u"]
            for n in r["path"]:
                at = sum(ends[n]) - at
            assert at == r["v"] and r["len"] == sum(lengths[g, n] for n in r["path"]) and r["edge_name"] == min(r["path"])
        stay = {x for r in found[g] for x in (r["u"], r["v"])}
        assert junctions <= stay and all(x in junctions or all(y == x for y in (r["u"], r["v"])) for x in stay for r in found[g] if x in (r["u"], r["v"]))
        assert owners[g].keys() == vertices and all(owners[g][o] == o for o in owners[g].values()) and (stay <= set(owners[g].values()))
        assert rooted.get(g, None) is None or owners[g][rooted[g]] == rooted[g]
    before = core.pre_merges(core_.owners)
    for g in found:
        assert len({o for o in owners[g].values()}) + before.where(F.col("graph_id") == g).count() == len(owners[g])
    after = spark.createDataFrame([("ring", 1, 1, 99), ("g5", 1, 1, 2), ("nowhere", 1, 5, 6)], "graph_id string, step long, left_id long, right_id long")
    whole = collections.defaultdict(list)
    for r in core.spliced(before, after, core_.owners).orderBy("step").collect():
        whole[r["graph_id"]].append((r["step"], r["left_id"]))
    assert [x for x, _ in whole["ring"]] == [1, 2, 3, 4, 5, 6] and whole["ring"][-1] == (6, 1) and "nowhere" not in whole


def test_counts_of_any_degree(spark):
    rows = spark.range(-1, 38).select("id", P.directed_partition_count(F.col("id")).alias("n"), P.merge_cost(F.col("id"), F.lit(3)).alias("cost"), P.region_size(F.col("id"), "bell").alias("bell")).collect()
    three = sum(math.comb(3, k) * k ** (3 - k) for k in range(1, 4))
    for r in rows:
        n = max(r["id"], 0)
        want = sum(math.comb(n, k) * k ** (n - k) for k in range(n + 1))
        assert int(r["n"]) == want and r["cost"] == pytest.approx(want * three * (r["id"] + 3), rel=1e-14) and r["bell"] == float(P.bell_number(n))
    assert spark.sql("select cast(null as int) as n").select(P.directed_partition_count(F.col("n"))).first()[0] is None
    with pytest.raises(Exception, match="too great"):
        spark.range(38, 39).select(P.directed_partition_count(F.col("id"))).collect()
    logs = spark.createDataFrame([(n,) for n in (0, 1, 2, 9, 10, 40, 200, 201, 600)], "n long").select("n", P.log_bell(F.col("n")).alias("l")).collect()
    assert all(r["l"] == pytest.approx(math.log(P.bell_number(r["n"])), rel=1e-11, abs=1e-11) for r in logs)


def test_queue_metrics(spark):
    edges = spark.createDataFrame([("g", i, u, v) for i, (u, v) in enumerate([(1, 2), (1, 2), (2, 3), (3, 4), (4, 1)] + [(5, x) for x in range(10, 310)] + [(5, 6)])], "graph_id string, edge_name int, u long, v long")
    counts = spark.createDataFrame([("g", v, 3 * v) for v in [*range(1, 7), *range(10, 310)]], "graph_id string, vertex_id long, n long")
    merged = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "graph_id string, vertex_id long")
    got = {(r["u"], r["v"]): r for r in G.merge_priorities(edges, counts, merged, 1000).collect()}
    assert {k: got[k]["boundary"] for k in ((1, 2), (2, 3), (3, 4), (5, 6))} == {(1, 2): 1002, (2, 3): 1003, (3, 4): 2, (5, 6): 1300}
    assert got[5, 6]["degrees"] == 15 * 18 and got[5, 6]["diff"] == pytest.approx(math.log(15) + math.log(18) - math.log(P.bell_number(300)), rel=1e-12)
    assert all(r["diffinv"] == -r["diff"] for r in got.values())
