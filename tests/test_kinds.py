"""What hangs on a graph's edges alone is found once for all equal graphs."""

import collections

import pytest
from pyspark.sql import functions as F

from treeweave.operators import core, kinds, merge_tree, solve, spectral
from treeweave.plans import catalogue
from treeweave.sources import testgraphs

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.fixture(scope="module")
def order_edges(spark):
    found = collections.defaultdict(set)
    for r in testgraphs.order_graphs(spark, SF)[0].collect():
        found[r["graph_id"]].add((r["edge_name"], r["u"], r["v"]))
    return found


#: Each query, and the operator that is to meet every kind of graph once, with the place of its edges.
ONCE = [
    ("best_roots", merge_tree, "rerooted", 0),
    ("spectral_values", spectral, "spectral_order", 0),
    ("greedy_many", catalogue, "greedy", 0),
    ("region_costs", merge_tree, "merge_tree", 0),
    ("tree_invariants", solve, "solve", 0),
    ("merge_tree_order", merge_tree, "merge_tree", 0),
    ("solve_many_beam", solve, "solve", 0),
    ("brute_force_min", solve, "brute_force", 0),
    ("core_graphs", core, "core_graph", 0),
    ("sequence_costs", merge_tree, "merge_tree", 0),
    ("recover_trees", catalogue, "recover", 1),
    ("split_order_min_cost", solve, "solve", 0),
    ("solve_many", solve, "solve", 0),
    ("rotated_trees", merge_tree, "rotated", 0),
    ("backtrack_total_cost", solve, "solve", 0),
    ("dp_min_cost", solve, "solve", 0),
]


@pytest.mark.parametrize("name, home, operator, place", ONCE)
def test_equal_graphs_are_worked_out_once(spark, order_edges, monkeypatch, name, home, operator, place):
    def see(*args, **_):
        raise Seen(args[place].select("graph_id").distinct().count())

    monkeypatch.setattr(home, operator, see)
    with pytest.raises(Seen) as seen:
        catalogue.QUERIES[name](spark, SF)
    assert seen.value.args[0] == len(set(map(frozenset, order_edges.values()))) < len(order_edges)


def test_kinds(spark, order_edges):
    """Graphs are of one kind if they agree in all edges, whatever their order; rows that are there twice count twice."""
    made = {"a": [(1, 1, 2), (2, 2, 3)], "b": [(2, 2, 3), (1, 1, 2)], "c": [(1, 1, 2), (2, 3, 2)], "d": [(1, 1, 2)], "e": [(2, 2, 3)], "f": [(1, 1, 2)] * 2, "g": [(1, 1, 2)] * 3, "h": [(1, 1, 2), (2, 2, 3), (3, 3, 4), (3, 3, 4)]}
    edges = spark.createDataFrame([(g, *e) for g, es in made.items() for e in es], "graph_id string, edge_name int, u long, v long").repartition(3)
    members, of = kinds.graph_kinds(edges)
    kind = {r["graph_id"]: r["kind"] for r in members.collect()}
    assert kind.keys() == made.keys() and kind["a"] == kind["b"] and len(set(kind.values())) == len(made) - 1
    back = collections.defaultdict(list)
    for r in kinds.of_members(of, members).collect():
        back[r["graph_id"]].append((r["edge_name"], r["u"], r["v"]))
    assert {g: sorted(es) for g, es in back.items()} == {g: sorted(es) for g, es in made.items()}
    members, of = kinds.graph_kinds(testgraphs.order_graphs(spark, SF)[0])
    assert of.select("graph_id").distinct().count() == len(set(map(frozenset, order_edges.values()))) and members.count() == len(order_edges)
    assert kinds.graph_kinds(edges.where("false"))[1].count() == 0
