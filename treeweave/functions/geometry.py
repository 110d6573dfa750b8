"""Lengths and scales as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeweave.runtime import col_of


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance; a missing coordinate counts as 0."""
    zero = F.lit(0.0)
    parts = [F.pow(F.coalesce(x, zero) - F.coalesce(y, zero), F.lit(2)) for x, y in zip(a, b)]
    return F.sqrt(reduce(lambda x, y: x + y, parts))


def joint_min_max(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``columns`` scaled by their joint least and greatest value (within ``by``, if given) to 0..1.

    One aggregate, a row for each group, joined back. Nulls stay null; where
    all values are equal the scaled value is 0.
    """
    lo = reduce(F.least, [F.min(col_of(c)) for c in columns]) if len(columns) > 1 else F.min(col_of(columns[0]))
    hi = reduce(F.greatest, [F.max(col_of(c)) for c in columns]) if len(columns) > 1 else F.max(col_of(columns[0]))
    keys = by or []
    ends = df.groupBy(*keys).agg(lo.alias("__lo"), hi.alias("__hi"))
    # without keys the aggregate is one row, so the broadcast is of fixed size
    joined = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))
    width = F.col("__hi") - F.col("__lo")
    scale = lambda c: F.when(width > 0, (col_of(c) - F.col("__lo")) / width).otherwise(F.when(col_of(c).isNotNull(), F.lit(0.0))).alias(c)
    return joined.select(*[scale(c) if c in columns else col_of(c) for c in df.columns])
