"""The algebra of partitions and directions against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from treeweave.functions import partitions as P


def set_partitions(xs):
    if not xs:
        yield []
        return
    first, *rest = xs
    for p in set_partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], sorted([first, *p[i]]), *p[i + 1 :]]


def joined(p1, p2, shared, closed):
    """By union-find over blocks: a forest, and no component without an edge that stays."""
    nodes = [("a", i) for i in range(len(p1))] + [("b", i) for i in range(len(p2))]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in shared:
        a = find(("a", next(i for i, b in enumerate(p1) if e in b)))
        b = find(("b", next(i for i, b in enumerate(p2) if e in b)))
        if a == b:
            return None
        parent[a] = b
    groups = {}
    for kind, p in (("a", p1), ("b", p2)):
        for i, b in enumerate(p):
            groups.setdefault(find((kind, i)), set()).update(set(b) - set(shared))
    blocks = sorted(sorted(g) for g in groups.values())
    if closed:
        return blocks if len(blocks) == 1 else None
    return blocks if all(blocks) else None


def test_block_join(spark):
    rng, rows = random.Random(2), []
    for _ in range(1500):
        n_shared, n1, n2 = rng.randrange(0, 4), rng.randrange(0, 3), rng.randrange(0, 3)
        shared = list(range(1, n_shared + 1))
        e1, e2 = shared + list(range(10, 10 + n1)), shared + list(range(20, 20 + n2))
        if not e1 or not e2:
            continue
        p1, p2 = (sorted(rng.choice(list(set_partitions(e)))) for e in (e1, e2))
        rows.append((p1, p2, shared, n1 + n2 == 0))
    df = spark.createDataFrame(rows, "a array<array<int>>, b array<array<int>>, s array<int>, closed boolean")
    for r in df.select("*", P.joined_blocks(F.col("a"), F.col("b"), F.col("s"), F.col("closed")).alias("j")).collect():
        assert r["j"] == joined(r["a"], r["b"], r["s"], r["closed"]), r


@pytest.mark.parametrize("n", range(0, 7))
def test_enumeration(spark, n):
    edges = spark.createDataFrame([(list(range(n, 0, -1)),)], "e array<int>")
    got = edges.select(P.partitions_of(F.col("e")).alias("p")).first()["p"]
    want = {tuple(sorted(map(tuple, p))) for p in set_partitions(list(range(1, n + 1)))}
    assert len(got) == P.bell_number(n) == len(want)
    assert {tuple(map(tuple, p)) for p in got} == want


def test_directions_and_counts(spark):
    row = spark.createDataFrame([([[1, 3], [2]],)], "b array<array<int>>").select(P.incoming_choices(F.col("b")).alias("i"), P.outgoing(F.col("b"), F.array(F.lit(3))).alias("o")).first()
    assert sorted(row["i"]) == [[1, 2], [2, 3]] and row["o"] == [1, 2]
    counts = spark.range(0, 10).select("id", P.directed_partition_count(F.col("id").cast("int")).alias("c")).collect()
    for r in counts:
        xs = list(range(r["id"]))
        if r["id"] <= 6:
            brute = sum(len(list(itertools.product(*p))) for p in set_partitions(xs))
            assert r["c"] == brute
    assert [r["c"] for r in counts][1:] == [1, 3, 10, 41, 196, 1057, 6322, 41393, 293608]


def test_codes(spark):
    df = spark.createDataFrame([([[4, 2], [1]], [2, 1])], "b array<array<int>>, i array<int>")
    assert df.select(P.code(P.canonical(F.col("b")), F.col("i"))).first()[0] == "1|2,4:1,2"
