"""Pruning of ranked rows within groups: the beam of a search.

All modes are window functions over the group, ordered by cost and then by a
tie-break, so results are the same on every run. A key marked as protected
stays in the beam: it takes the last place if it would be cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.runtime import col_of

MODES = ("fixed", "percent", "probability", "delta")
_EPSILON = 1e-5


@dataclass(frozen=True)
class Beam:
    """How a group is cut.

    fixed: the ``limit`` cheapest rows. percent: the share ``limit``, and
    ``min_width`` rows at least. probability: up to the row at which 1 - 1 / (1
    + running cost) passes ``limit``, and ``min_width`` rows at least. delta:
    rows whose scaled cost lies within ``limit`` of the best; ``norm`` is none,
    division (by the greatest) or minmax.
    """

    mode: str = "fixed"
    limit: float = float("inf")
    min_width: int = 1
    norm: str = "none"

    def __post_init__(self):
        if self.mode not in MODES or self.norm not in ("none", "division", "minmax"):
            raise ValueError(f"unknown beam: {self.mode}, {self.norm}")


def prune(df: DataFrame, beam: Beam, by: list[str], cost: str = "cost", ties: list[str] | None = None, protected: Column | None = None) -> DataFrame:
    """The rows of ``df`` that the beam keeps within each group of ``by``.

    Null costs sort last. ``ties`` should tell the rows of a group apart. All
    columns stay. ``protected`` marks rows that must stay; with several in a
    group only the cheapest is sure of its place.
    """
    c = col_of(cost)
    order = [c.asc_nulls_last(), *[col_of(t) for t in ties or []]]
    group = W.partitionBy(*[col_of(b) for b in by])
    ranked = group.orderBy(*order)
    if beam.mode == "fixed" and beam.limit == float("inf"):
        return df
    if beam.mode == "delta":
        lo, hi = F.min(c).over(group), F.max(c).over(group)
        if beam.norm == "division":
            gap = (c - lo) / (hi + F.lit(_EPSILON))
        elif beam.norm == "minmax":
            gap = (c - lo) / (hi - lo + F.lit(_EPSILON))
        else:
            gap = c - lo
        keep = gap <= F.lit(beam.limit)
        if protected is not None:
            keep = keep | F.coalesce(protected, F.lit(False))
        kept = df.withColumn("__keep", keep)
        return kept.where("__keep").drop("__keep")
    if beam.mode == "fixed" and protected is None:
        # a plain rank filter: Spark cuts each partition before the shuffle
        kept = df.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= int(beam.limit))
        return kept.drop("__rank")
    placed = df.withColumn("__rank", F.row_number().over(ranked)).withColumn("__n", F.count(F.lit(1)).over(group))
    if beam.mode == "fixed":
        width = F.lit(int(beam.limit))
    elif beam.mode == "percent":
        width = F.greatest(F.lit(beam.min_width), F.floor(F.lit(beam.limit) * F.col("__n")))
    else:
        upto = F.lit(1.0) + F.sum(c).over(ranked.rowsBetween(W.unboundedPreceding, 0))
        placed = placed.withColumn("__over", F.when(F.lit(1.0) - F.lit(1.0) / upto > F.lit(beam.limit), F.col("__rank") - 1))
        placed = placed.withColumn("__cut", F.min("__over").over(group))
        width = F.when(F.col("__cut").isNull(), F.col("__n")).otherwise(F.greatest(F.lit(beam.min_width), F.col("__cut")))
    placed = placed.withColumn("__width", width)
    if protected is None:
        keep = F.col("__rank") <= F.col("__width")
    else:
        placed = placed.withColumn("__own", F.coalesce(protected, F.lit(False)))
        placed = placed.withColumn("__best", F.min(F.when(F.col("__own"), F.col("__rank"))).over(group))
        outside = F.coalesce(F.col("__best") > F.col("__width"), F.lit(False))
        keep = (F.col("__rank") <= F.col("__width") - outside.cast("int")) | (outside & (F.col("__rank") == F.col("__best")))
    return placed.where(keep).select(*[col_of(x) for x in df.columns])


def histogram(df: DataFrame, by: list[str], key: str = "key", cost: str = "cost") -> DataFrame:
    """``by..., costs``: the kept rows' costs by key, a map for each group; of rows that share a key the cheapest counts. Groups are beams, so of bounded width."""
    least = df.groupBy(*[col_of(b) for b in by], col_of(key).alias("__key")).agg(F.min(col_of(cost)).alias("__cost"))
    return least.groupBy(*[col_of(b) for b in by]).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__key", "__cost")))).alias("costs"))
