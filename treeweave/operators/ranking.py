"""Dense numbers for rows of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.runtime import col_of, materialize, shuffle_partitions


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str = "number") -> DataFrame:
    """Add ``out``: 1, 2, 3 ... within the groups of ``by`` in ``order``.

    Rows are range-partitioned by group and order, so one large group is spread
    over many tasks; the counts of whole ranges, a row for each range and group,
    carry over to later ranges. ``order`` must tell the rows of a group apart for
    numbers that are the same on every run. Nulls sort first.
    """
    cols = [col_of(c) for c in (*by, *order)]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *cols).withColumn("__range", F.spark_partition_id())
    own = W.partitionBy("__range", *[col_of(c) for c in by]).orderBy(*[col_of(c) for c in order])
    placed = materialize(ranged.withColumn("__own", F.row_number().over(own)), "ranges")
    counts = placed.groupBy("__range", *[col_of(c) for c in by]).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*[col_of(c) for c in by]).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("__range").alias("__r"), *[col_of(c).alias(f"__b{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    on = placed["__range"] == starts["__r"]
    for i, c in enumerate(by):
        on = on & col_of(c).eqNullSafe(F.col(f"__b{i}"))
    return placed.join(starts, on).select(*[col_of(c) for c in df.columns], (F.col("__own") + F.col("__start")).alias(out))


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with vertices renumbered from 1 in id order within each graph, and the map ``graph_id, vertex_id, new_id``."""
    seen = edges.select("graph_id", F.explode(F.array("u", "v")).alias("vertex_id")).distinct()
    ids = materialize(number_rows(seen, ["graph_id"], ["vertex_id"], "new_id"), "ids")
    for end in ("u", "v"):
        edges = edges.join(ids.select("graph_id", F.col("vertex_id").alias(end), F.col("new_id").alias("__new")), ["graph_id", end]).withColumn(end, F.col("__new")).drop("__new")
    return edges, ids
