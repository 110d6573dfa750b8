"""Candidate texts: line i holds the candidates of vertex i, each as ``edges,labels,directions,cost;``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweave.functions.partitions import canonical


def parse_candidates(files: DataFrame) -> DataFrame:
    """``graph_id, vertex_id, blocks, incoming, cost`` of rows of ``graph_id, text``.

    Edges with equal labels form a block; direction 1 is incoming, 0 outgoing.
    White space around fields, blank lines between candidates' marks, and a last
    line without a line end are fine. Blank lines count as vertices without
    candidates. A candidate whose fields can't be read or differ in length gives
    a row with null blocks, for ``malformed`` to find.
    """
    lines = files.select("graph_id", F.posexplode(F.split(F.regexp_replace("text", r"\r", ""), "\n")).alias("at", "line"))
    each = lines.select("graph_id", (F.col("at") + 1).cast("long").alias("vertex_id"), F.explode(F.filter(F.transform(F.split("line", ";"), lambda c: F.btrim(c)), lambda c: c != "")).alias("c"))
    parts = F.transform(F.split("c", ","), lambda p: F.split(F.btrim(p), r"\s+"))
    ints = lambda i: F.transform(F.try_element_at(parts, F.lit(i)), lambda x: x.try_cast("int"))
    read = each.select("graph_id", "vertex_id", ints(1).alias("e"), ints(2).alias("l"), ints(3).alias("d"), F.try_element_at(F.try_element_at(parts, F.lit(4)), F.lit(1)).try_cast("double").alias("cost"))
    whole = (F.size("e") == F.size("l")) & (F.size("e") == F.size("d")) & F.col("cost").isNotNull()
    for c in "eld":
        whole = whole & ~F.exists(c, lambda x: x.isNull())
    zipped = F.arrays_zip("e", "l", "d")
    blocks = F.transform(F.array_distinct("l"), lambda l: F.transform(F.filter(zipped, lambda z: z["l"] == l), lambda z: z["e"]))
    incoming = F.transform(F.filter(zipped, lambda z: z["d"] == 1), lambda z: z["e"])
    ok = F.coalesce(whole, F.lit(False))
    return read.select("graph_id", "vertex_id", F.when(ok, canonical(blocks)).alias("blocks"), F.when(ok, F.sort_array(incoming)).alias("incoming"), F.when(ok, F.col("cost")).alias("cost"))


def malformed(candidates: DataFrame) -> DataFrame:
    return candidates.where("blocks is null").select("graph_id", "vertex_id")


def root_of(candidates: DataFrame) -> DataFrame:
    """``graph_id, vertex_id``: the last vertex of a graph that has an all-outgoing candidate."""
    return candidates.where("size(incoming) = 0 and blocks is not null").groupBy("graph_id").agg(F.max("vertex_id").alias("vertex_id"))


def to_text(candidates: DataFrame) -> DataFrame:
    """``graph_id, text``: candidates in the same form, vertices 1 to the greatest in order; a graph is one text."""
    flat = F.flatten("blocks")
    labels = F.flatten(F.transform("blocks", lambda b, i: F.transform(b, lambda _: i)))
    join = lambda xs: F.array_join(xs.cast("array<string>"), " ")
    ways = F.transform(flat, lambda e: F.array_contains("incoming", e).cast("int"))
    piece = F.concat_ws(",", join(flat), join(labels), join(ways), F.col("cost").cast("string"))
    per = candidates.groupBy("graph_id", "vertex_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(piece, F.lit(";")))), "").alias("line"))
    maps = per.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("vertex_id", "line"))).alias("m"), F.max("vertex_id").alias("n"))
    lines = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return maps.select("graph_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
