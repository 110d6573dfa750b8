"""ASCII PLY graph files, read and written by Spark; each file is one graph.

A file is one row of text, cut by native functions: its header names the
properties, whose order differs between files, so values are found by name. A
graph must fit in a row; a table of many files is spread by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that are typed; all properties stay in ``attributes`` too.
VERTEX_COLUMNS = {"x": "double", "y": "double", "z": "double", "og_index": "int", "root": "int"}
EDGE_COLUMNS = {"name": "int", "len": "double", "weight": "smallint"}


def graph_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``graph_id, text``: the files under ``path``; graph_id is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name")
    return files.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("graph_id"), F.col("value").alias("text"))


def _names(section: Column) -> Column:
    return F.regexp_extract_all(section, F.lit(r"property\s+(?:list\s+\w+\s+)?\w+\s+(\w+)"), F.lit(1))


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)`` of rows of ``graph_id, text``.

    vertices: graph_id, vertex_id (place in the file from 1), x, y, z, og_index,
    root, attributes. edges: graph_id, edge_name, u, v, len, weight, attributes.
    A property that a file doesn't have is null. Texts without a PLY header give
    no rows. Lines may end in \\r\\n.
    """
    head = F.substring_index("text", "end_header", 1)
    body = F.split(F.btrim(F.regexp_replace(F.expr("substring(text, length(substring_index(text, 'end_header', 1)) + 11)"), "\r", ""), F.lit("\n ")), "\n")
    count = lambda what: F.regexp_extract(head, rf"element\s+{what}\s+(\d+)", 1).try_cast("int")
    cut = files.where(F.col("text").startswith("ply")).select(
        "graph_id", body.alias("lines"), count("vertex").alias("nv"), F.coalesce(count("edge"), F.lit(0)).alias("ne"),
        _names(F.substring_index(F.substring_index(head, "element vertex", -1), "element edge", 1)).alias("vertex_names"),
        _names(F.substring_index(head, "element edge", -1)).alias("edge_names"),
    )
    lines = cut.select("*", F.posexplode("lines").alias("at", "line")).withColumn("values", F.split(F.btrim("line"), r"\s+"))

    def table(names: str, rows: Column) -> DataFrame:
        pairs = F.map_from_entries(F.slice(F.arrays_zip(F.col(names).alias("k"), F.col("values").alias("v")), 1, F.size(names)))
        return lines.where(rows).select("graph_id", "at", pairs.alias("attributes"))

    get = lambda name, kind: F.try_element_at("attributes", F.lit(name)).try_cast(kind)
    vertices = table("vertex_names", F.col("at") < F.col("nv"))
    edges = table("edge_names", (F.col("at") >= F.col("nv")) & (F.col("at") < F.col("nv") + F.col("ne")))
    return (
        vertices.select("graph_id", (F.col("at") + 1).cast("long").alias("vertex_id"), *[get(c, k).alias(c) for c, k in VERTEX_COLUMNS.items()], "attributes"),
        edges.select("graph_id", get("name", "int").alias("edge_name"), (get("vertex1", "long") + 1).alias("u"), (get("vertex2", "long") + 1).alias("v"),
                     *[get(c, k).alias(c) for c, k in EDGE_COLUMNS.items() if c != "name"], "attributes"),
    )


def read_ply(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return parse(graph_files(spark, path))


def roots_of(vertices: DataFrame) -> DataFrame:
    return vertices.where("root = 1").select("graph_id", "vertex_id")


_PLY_TYPE = {"int": "int", "bigint": "int", "smallint": "int", "double": "double", "float": "double"}


def to_ply(vertices: DataFrame, edges: DataFrame, dense: bool = False) -> DataFrame:
    """``graph_id, text``: each graph as a PLY text.

    Vertices go in order of vertex_id and are renumbered from 0, edges in order
    of edge_name (``vertex1``, ``vertex2``, ``name`` first). All other columns of
    whole-number or double type are properties; nulls are written as 0. ``dense``
    says that each graph's ids are 1, 2, 3 and so on, as ``split_graph`` gives
    them: then places need no join.
    """
    kinds = {f.name: _PLY_TYPE.get(f.dataType.simpleString()) for f in [*vertices.schema, *edges.schema]}
    vcols = [c for c in vertices.columns if c not in ("graph_id", "vertex_id") and kinds[c]]
    ecols = [c for c in edges.columns if c not in ("graph_id", "edge_name", "u", "v") and kinds[c]]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    ids = vertices.groupBy("graph_id").agg(F.sort_array(F.collect_list("vertex_id")).alias("ids"), F.sort_array(F.collect_list(F.struct("vertex_id", F.array_join(F.array(*map(text, vcols)), " ").alias("line")))).alias("vl"))
    if dense:
        edges = edges.withColumns({"__u": F.col("u") - 1, "__v": F.col("v") - 1})
    place = ids.select("graph_id", F.posexplode("ids").alias("place", "vertex_id"))
    for end in () if dense else ("u", "v"):
        edges = edges.join(place.select("graph_id", F.col("vertex_id").alias(end), F.col("place").alias(f"__{end}")), ["graph_id", end])
    line = F.array_join(F.array(F.col("__u").cast("string"), F.col("__v").cast("string"), text("edge_name"), *map(text, ecols)), " ")
    el = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("edge_name", line.alias("line")))).alias("el"))
    both = ids.join(el, "graph_id", "left")
    el_ = F.coalesce("el", F.array().cast(el.schema["el"].dataType))
    prop = lambda c, name=None: f"property {kinds[c]} {name or c}\n"
    head = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("vl").cast("string"), F.lit("\n" + "".join(map(prop, vcols)) + "element edge "), F.size(el_).cast("string"),
        F.lit("\nproperty int vertex1\nproperty int vertex2\nproperty int name\n" + "".join(map(prop, ecols)) + "end_header\n"),
    )
    return both.select("graph_id", F.concat(head, F.array_join(F.concat(F.col("vl.line"), el_["line"]), "\n"), F.lit("\n")).alias("text"))


def write_ply(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder ``graph_id=...`` for each graph, with its PLY text in it."""
    to_ply(vertices, edges).select("graph_id", F.regexp_replace("text", r"\n\z", "").alias("text")).write.partitionBy("graph_id").text(path)
