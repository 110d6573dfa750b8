"""Rasterised skeletons: occupied grid cells as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.functions.geometry import distance

SCALE = 255


def voxelise(segments: DataFrame, steps: int | None = None, value: str = "value", step_length: float = 1.0) -> DataFrame:
    """``graph_id, x, y, z, value``: the cells that line segments pass, sampled at both ends and every ``step_length`` between.

    With ``steps``, at so many places a segment instead, whatever its length.

    ``segments``: graph_id, segment_id, x1 y1 z1 x2 y2 z2 and an attribute,
    stored as whole number of ``SCALE`` parts. Where several segments meet in a
    cell, the one with the greatest (id, value) wins. Coordinates are cut to whole
    numbers towards zero; segments with a missing coordinate give no cells.
    """
    length = distance([F.col(f"{c}1") for c in "xyz"], [F.col(f"{c}2") for c in "xyz"])
    n = F.lit(steps) if steps else F.greatest(F.ceil(length / F.lit(float(step_length))).cast("int"), F.lit(1))
    segments = segments.dropna(subset=[f"{c}{i}" for c in "xyz" for i in "12"]).withColumn("__n", n)
    at = F.explode(F.sequence(F.lit(0), F.col("__n"))).alias("i")
    share = F.col("i") / F.col("__n").cast("double")
    along = [(F.col(f"{c}1") + share * (F.col(f"{c}2") - F.col(f"{c}1"))).cast("long").alias(c) for c in "xyz"]
    cells = segments.select("*", at).select("graph_id", "segment_id", *along, (F.col(value) * SCALE).cast("int").alias("value"))
    return cells.dropna(subset=["x", "y", "z"]).groupBy("graph_id", "x", "y", "z").agg(F.max(F.struct("segment_id", "value"))["value"].alias("value"))
