"""Other sources and sinks of graphs: CSV, JSON, Parquet, id maps, voxels, nested rows for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweave.operators.candidates import default_candidates

VERTEX_SCHEMA = "graph_id string, vertex_id long, x double, y double, z double, og_index int, root int"
EDGE_SCHEMA = "graph_id string, edge_name int, u long, v long, len double, weight smallint"


def write_csv(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """``path/vertices`` and ``path/edges`` with header lines; nested columns are left out."""
    for df, name in ((vertices, "vertices"), (edges, "edges")):
        flat = [f.name for f in df.schema if f.dataType.simpleString().split("<")[0] not in ("array", "map", "struct")]
        df.select(*flat).write.csv(f"{path}/{name}", header=True)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of ``write_csv`` by the fixed schemas, matched by name; columns that are missing are null."""

    def load(name: str, schema: str) -> DataFrame:
        raw = spark.read.csv(f"{path}/{name}", header=True)
        kinds = [x.strip().split(" ") for x in schema.split(",")]
        return raw.select(*[(F.col(c).try_cast(k) if c in raw.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds])

    return load("vertices", VERTEX_SCHEMA), load("edges", EDGE_SCHEMA)


def nested(vertices: DataFrame, edges: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``graph_id, nodes, edges``: a row for each graph with its vertices, their candidates and its edges in arrays, in order."""
    nodes = vertices
    if candidates is not None:
        own = candidates.groupBy("graph_id", "vertex_id").agg(F.sort_array(F.collect_list(F.struct("blocks", "incoming", "cost"))).alias("candidates"))
        nodes = vertices.join(own, ["graph_id", "vertex_id"], "left")
    row = lambda df, key: F.sort_array(F.collect_list(F.struct(key, *[c for c in df.columns if c not in ("graph_id", key) and not df.schema[c].dataType.simpleString().startswith("map")])))
    n = nodes.groupBy("graph_id").agg(row(nodes, "vertex_id").alias("nodes"))
    e = edges.groupBy("graph_id").agg(row(edges, "edge_name").alias("edges"))
    return n.join(e, "graph_id", "full")


def write_json(vertices: DataFrame, edges: DataFrame, path: str, candidates: DataFrame | None = None) -> None:
    """One JSON object a line for each graph."""
    nested(vertices, edges, candidates).write.json(path)


def read_json(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of ``write_json``'s files; ``schema`` is that of ``nested`` and saves a pass for inference."""
    graphs = spark.read.schema(schema).json(path)
    return (graphs.select("graph_id", F.inline("nodes")), graphs.select("graph_id", F.inline("edges")))


def save_graphs(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables, the engine's own store."""
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def load_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def read_id_maps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``graph_id, vertex_id, original_id``: line i of a file is the original 0-based id of vertex i; blank lines at the end don't count."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("graph_id"), F.split(F.rtrim("value"), r"\r?\n").alias("lines"))
    each = files.select("graph_id", F.posexplode("lines").alias("at", "line"))
    return each.select("graph_id", (F.col("at") + 1).cast("long").alias("vertex_id"), F.btrim("line").try_cast("long").alias("original_id")).where("original_id is not null")


def to_original_ids(candidates: DataFrame, id_map: DataFrame) -> DataFrame:
    """Candidates of truncated graphs under the vertex ids of the full ones (0-based original ids become ids from 1)."""
    both = candidates.join(id_map, ["graph_id", "vertex_id"])
    return both.withColumn("vertex_id", F.col("original_id") + 1).drop("original_id")


def full_candidates(candidates: DataFrame, id_map: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates of whole graphs from those of their truncated forms.

    ``candidates`` go under their original ids; vertices of ``edges`` (the whole
    graphs) of degree 2 or less get the free default candidates instead of any
    of their own. Roots of such a degree keep their own.
    """
    default = default_candidates(edges, roots)
    moved = to_original_ids(candidates, id_map)
    kept = moved.join(default.select("graph_id", "vertex_id").distinct(), ["graph_id", "vertex_id"], "left_anti")
    columns = ["graph_id", "vertex_id", "blocks", "incoming", "cost"]
    kind = candidates.schema["cost"].dataType
    return kept.select(columns).unionByName(default.withColumn("cost", F.col("cost").cast(kind)).select(columns))


def plot_rows(merge_tree: DataFrame) -> DataFrame:
    """``graph_id, parent, children, outdegree``: a merge sequence (graph_id, left_id, right_id, new_id) as nested rows, one for each merge."""
    return merge_tree.select("graph_id", F.col("new_id").alias("parent"), F.sort_array(F.array("left_id", "right_id")).alias("children"), F.lit(2).alias("outdegree"))
