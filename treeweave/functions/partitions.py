"""Set partitions and edge directions as native column expressions.

A partition is ``blocks array<array<int>>`` of edge names, sorted inside and
out; directions are ``incoming array<int>``, the sorted names of the edges that
point to the vertex. All other edges of the partition point away.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(blocks: Column) -> Column:
    """Blocks in their one sorted form; null stays null."""
    return F.sort_array(F.transform(blocks, lambda b: F.sort_array(b)))


def code(blocks: Column, incoming: Column) -> Column:
    """A directed partition as text, such as ``1,3|2:2``: blocks, then incoming edges."""
    text = F.array_join(F.transform(blocks, lambda b: F.array_join(b.cast("array<string>"), ",")), "|")
    return F.concat(text, F.lit(":"), F.array_join(F.sort_array(incoming).cast("array<string>"), ","))


def cost_milli(blocks: Column, incoming: Column, vertex: Column) -> Column:
    """The deterministic test cost of a canonical directed partition, a long from 0 to 999.

    (31 * sum(block index * edge name) + 17 * sum(incoming) + 7 * vertex) modulo 1000.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    weighted = F.aggregate(
        F.transform(blocks, lambda b, i: i.cast("long") * total(b)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return (F.lit(31) * weighted + F.lit(17) * total(incoming) + F.lit(7) * vertex.cast("long")) % F.lit(1000)


def partitions_of(edges: Column) -> Column:
    """All set partitions of an array of edges, as ``array<array<array<int>>>`` in canonical form.

    Elements enter one by one; each joins one of the blocks so far or opens its
    own. The result has Bell(n) entries, so n is a vertex degree, never a table's
    size. No edges give one partition without blocks.
    """
    one = F.array().cast("array<array<int>>")
    start = F.array(one)

    def add(sofar: Column, e: Column) -> Column:
        def grow(p: Column) -> Column:
            joined = F.transform(F.sequence(F.lit(1), F.size(p) + 1), lambda i: F.transform(
                F.concat(p, F.array(F.array().cast("array<int>"))), lambda b, j: F.when(j + 1 == i, F.concat(b, F.array(e))).otherwise(b)))
            return F.transform(joined, lambda q: F.filter(q, lambda b: F.size(b) > 0))

        return F.flatten(F.transform(sofar, grow))

    return F.transform(F.aggregate(F.sort_array(edges), start, add), canonical)


def incoming_choices(blocks: Column) -> Column:
    """All ways to choose one incoming edge in each block, each sorted: ``array<array<int>>``."""
    start = F.array(F.array().cast("array<int>"))
    grow = lambda sofar, b: F.flatten(F.transform(sofar, lambda a: F.transform(b, lambda e: F.concat(a, F.array(e)))))
    return F.transform(F.aggregate(blocks, start, grow), lambda c: F.sort_array(c))


def joined_blocks(left: Column, right: Column, shared: Column, closed: Column) -> Column:
    """Blocks of two clusters merged along their shared edges, or null where they don't fit.

    Each block of ``right`` is folded into the blocks so far: it takes up those
    it shares an edge with. Two shared edges to one block would close a cycle:
    null. Shared edges are dropped; a block that loses all its edges is a
    component without a way out: null, unless ``closed`` says that no edge is
    left at all, when exactly one such component must remain.
    """
    empty = F.array().cast("array<int>")
    start = F.struct(left.alias("bl"), F.lit(True).alias("ok"))

    def fold(acc: Column, b: Column) -> Column:
        s = F.array_intersect(b, shared)
        touched = F.filter(acc["bl"], lambda x: F.arrays_overlap(x, s))
        apart = F.filter(acc["bl"], lambda x: ~F.arrays_overlap(x, s))
        merged = F.array_except(F.array_union(F.flatten(touched), b), s)
        return F.struct(
            F.concat(apart, F.array(F.coalesce(merged, empty))).alias("bl"), (acc["ok"] & (F.size(touched) == F.size(s))).alias("ok")
        )

    def finish(acc: Column) -> Column:
        fits = F.when(closed, F.size(acc["bl"]) == 1).otherwise(F.forall(acc["bl"], lambda b: F.size(b) > 0))
        return F.when(acc["ok"] & fits, canonical(acc["bl"]))

    return F.aggregate(right, start, fold, finish)


def outgoing(blocks: Column, incoming: Column) -> Column:
    """Sorted edges of the blocks that point away."""
    return F.sort_array(F.array_except(F.flatten(blocks), incoming))


#: Counts up to here have 38 digits at most, as Spark's decimals do.
_MOST_DIGITS = 10**38


def directed_partitions(n: int) -> int:
    """Number of directed partitions of n edges: sum over k of C(n, k) * k^(n - k); one for no edges."""
    return sum(math.comb(n, k) * k ** (n - k) for k in range(1, n + 1)) if n > 0 else 1


def _up_to(count: Callable[[int], int], bound: float) -> list[int]:
    found: list[int] = []
    while (x := count(len(found))) < bound:
        found.append(x)
    return found


def _looked_up(n: Column, values: list, kind: str, what: str) -> Column:
    """The n-th of ``values``, the first for negative n, null for null; an error beyond the last."""
    beyond = F.raise_error(F.concat(F.lit(f"{what} is too great for {kind} at "), n.cast("string"))).cast(kind)
    table = F.array(*[F.lit(x).cast(kind) for x in values])
    return F.when(n.isNull(), F.lit(None).cast(kind)).when(n < len(values), F.element_at(table, (F.greatest(n, F.lit(0)) + 1).cast("int"))).otherwise(beyond)


def directed_partition_count(n: Column) -> Column:
    """Number of directed partitions of n edges, exact, as decimal(38, 0); an error where it has more digits."""
    return _looked_up(n, [Decimal(x) for x in _up_to(directed_partitions, _MOST_DIGITS)], "decimal(38,0)", "the number of directed partitions")


def bell_number(n: int) -> int:
    """Number of set partitions of n elements, by the Bell triangle."""
    row = [1]
    for _ in range(n):
        nxt = [row[-1]]
        for x in row:
            nxt.append(nxt[-1] + x)
        row = nxt
    return row[0]


def log_bell(n: Column) -> Column:
    """Natural logarithm of the number of set partitions of n elements, for any n.

    By Dobinski's formula the number is the sum over k of k^n / k!, divided by e.
    Terms are added relative to the greatest, and beyond k = 2 n they are too
    small to tell; the logarithms of k! are Stirling's series from 10 on.
    """
    n = F.greatest(n.cast("long"), F.lit(0))
    low = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(1, 10)])

    def term(k: Column) -> Column:
        x = k.cast("double")
        stirling = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
        return n * F.log(x) - F.when(k < 10, F.element_at(low, F.least(k, F.lit(9)).cast("int"))).otherwise(stirling)

    terms = F.transform(F.sequence(F.lit(1).cast("long"), 2 * n + 20), term)
    total = lambda t: F.aggregate(t, F.struct(F.array_max(t).alias("m"), F.lit(0.0).alias("s")), lambda a, x: F.struct(a["m"].alias("m"), (a["s"] + F.exp(x - a["m"])).alias("s")), lambda a: a["m"] + F.log(a["s"]) - 1)
    return F.when(n == 0, F.lit(0.0)).otherwise(total(terms))  # only for none does k = 0 count


def region_size(n: Column, measure: str = "outdegree") -> Column:
    """How much a region with n outgoing edges weighs in costs: n itself, or the number of its set or directed partitions as a double (an error beyond doubles)."""
    if measure == "outdegree":
        return n
    if measure not in ("bell", "directed"):
        raise ValueError(f"unknown measure {measure}")
    count = bell_number if measure == "bell" else directed_partitions
    return _looked_up(n, [float(x) for x in _up_to(count, 1e300)], "double", f"the number of partitions ({measure})")


def merge_price(left_out: Column, right_out: Column, measure: str = "outdegree") -> Column:
    """Cost estimate of merging clusters with so many outgoing edges: f(u) f(w) (u + w)."""
    return region_size(left_out, measure) * region_size(right_out, measure) * (left_out + right_out)


def merge_cost(left_out: Column, right_out: Column) -> Column:
    """``merge_price`` by directed partitions, a double: exact below 2^53."""
    return merge_price(left_out, right_out, "directed")
