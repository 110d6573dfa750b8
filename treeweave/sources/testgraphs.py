"""Graphs made from the driver's tables, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.runtime import table

def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u, v, w``: nations u < v, and the order lines in which a customer of one buys from a supplier of the other."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    pair = both.where("c_nationkey <> s_nationkey").select(F.least("c_nationkey", "s_nationkey").cast("long").alias("u"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("v"))
    return pair.groupBy("u", "v").agg(F.count(F.lit(1)).alias("w"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trade`` as an edge table: edge_name = 100 u + v, nations being fewer than 100."""
    return trade(spark, sf_dir).select(F.lit("trade").alias("graph_id"), (F.col("u") * 100 + F.col("v")).cast("int").alias("edge_name"), "u", "v", "w")


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge table of distinct (part, supplier) pairs; suppliers are negative vertices, and names hash the pair."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), (-F.col("l_suppkey") - 1).alias("v")).distinct()
    return pairs.select(F.lit("part_supp").alias("graph_id"), F.hash("u", "v").alias("edge_name"), "u", "v")


def order_graphs(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One small graph for each order of at least two line numbers: ``(edges, roots)``.

    Vertices are the order's line numbers. Each is tied to the next, and to the
    next but one where both bear the same first return flag and status; edges
    are named 10 u + v, and the smallest number is the root. So degrees stay at
    four or less without any line being left out, and graphs have cycles.
    ``among`` (graph_id) names the graphs that are asked for, if not all.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("graph_id"), F.col("l_linenumber").cast("long").alias("u"), F.concat("l_returnflag", "l_linestatus").alias("f"))
    lines = lines if among is None else lines.join(among, "graph_id", "left_semi")
    lines = lines.repartition("graph_id").groupBy("graph_id", "u").agg(F.min("f").alias("f"))  # one shuffle serves the groups and what follows by graph
    along = W.partitionBy("graph_id").orderBy("u")
    near = lines.select("graph_id", "u", F.array(F.lead("u", 1).over(along), F.when(F.lead("f", 2).over(along) == F.col("f"), F.lead("u", 2).over(along))).alias("vs"))
    pairs = near.select("graph_id", "u", F.explode("vs").alias("v")).where("v is not null")
    edges = pairs.select("graph_id", (F.col("u") * 10 + F.col("v")).cast("int").alias("edge_name"), "u", "v")
    return edges, edges.groupBy("graph_id").agg(F.min("u").alias("vertex_id"))


def chain_merges(edges: DataFrame) -> DataFrame:
    """A merge tree (graph_id, left_id, right_id, new_id) for each orders' graph: lines join one by one in order of number, and the k-th makes cluster 10 + k."""
    lines = edges.select("graph_id", F.explode(F.array("u", "v")).alias("n")).distinct()
    along = W.partitionBy("graph_id").orderBy("n")
    ranked = lines.select("graph_id", F.col("n").alias("right_id"), F.row_number().over(along).cast("long").alias("k"), F.lag("n").over(along).alias("before")).where("k > 1")
    return ranked.select("graph_id", F.when(F.col("k") == 2, F.col("before")).otherwise(F.col("k") + 9).alias("left_id"), "right_id", (F.col("k") + 10).alias("new_id"))


def customer_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Many small graphs, one a customer: ``(edges, roots)``.

    Vertex 0 is the customer, 1 to 5 the order priorities, 6 to 10 the regions
    of the suppliers; a priority hangs on the customer if an order has it, and a
    region on a priority if a line of such an order comes from it. Graphs have
    many cycles; their number follows the data.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("p"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    seen = both.select(F.col("o_custkey").cast("string").alias("graph_id"), "p", F.col("n_regionkey").cast("long").alias("r")).distinct()
    spokes = seen.select("graph_id", F.col("p").cast("int").alias("edge_name"), F.lit(0).cast("long").alias("u"), F.col("p").alias("v")).distinct()
    rims = seen.select("graph_id", (F.col("p") * 10 + F.col("r")).cast("int").alias("edge_name"), F.col("p").alias("u"), (F.col("r") + 6).alias("v"))
    edges = spokes.unionByName(rims)
    return edges, edges.select("graph_id", F.lit(0).cast("long").alias("vertex_id")).distinct()


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of points for each customer, one an order: days since 1992 times 10,000, and cents; whole numbers, so that sides of lines are told exactly."""
    orders = table(spark, sf_dir, "orders")
    x = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 10000.0
    return orders.select(F.col("o_custkey").cast("string").alias("graph_id"), F.col("o_orderkey").cast("long").alias("point_id"), x.alias("x"), F.round(F.col("o_totalprice") * 100).cast("double").alias("y"))
