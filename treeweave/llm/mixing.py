"""Mixing sources to target weights by range sort and distributed prefix sums (operator 4).

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeweave.runtime import col_of, materialize, shuffle_partitions

#: Weights of the sources, in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: A document is taken this many times at most.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before, within ``groups`` in ``order``.

    The rows are range-partitioned by group and order, so a large group is
    spread over many ranges. Each range sums on its own, and the sums of whole
    ranges, a row for each range and group, carry over to the later ranges.
    The columns must be the same on a rerun; rows that tie in ``order`` should
    be equal. ``df`` should be cheap to read twice: Spark samples it for the ranges.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *groups, *order).withColumn("__range", F.spark_partition_id())
    before = W.partitionBy("__range", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = materialize(ranged.withColumn("__own", F.coalesce(F.sum(value).over(before), F.lit(0))), "ranges")
    ranges = summed.groupBy("__range", *groups).agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("__range", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start")) if groups else ranges.select(
        "__range", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start")
    )
    on = summed["__range"] == starts["__range"]
    for i, g in enumerate(groups):
        on &= summed[g].eqNullSafe(starts[f"__g{i}"])
    # a row for each range and group: bounded by the ranges plus the groups, so Spark picks the join by its size
    return summed.join(starts, on).select(*[summed[c] for c in df.columns], (F.col("__own") + F.col("__start")).alias(out))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, weight, target)`` from rows of ``(source, size)``.

    Sources sorted by code point, null last, take the weights in turn and share
    the sum of all sizes. A target stops at ``most`` times its source's size;
    the excess is shared again by weight until none is above: one pass of prefix
    sums over the sources in the order in which they fill up.
    """
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = materialize(by.select("source", F.col("source").isNull().alias("last"), "source_size", F.lit(1).cast("long").alias("one")), "sources")
    ranked = prefix_sums(by, [], ["last", "source"], "one", "rank")
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    # Sources in the order in which rising shares fill them up. Once the caps before a source are full, the rest is shared
    # by the weights from it on; the first source whose part is then no more than its cap is the first that isn't full.
    order = [(F.col("cap").cast("double") / F.col("weight")).alias("fills"), *ranked.columns, F.col("source").isNull().alias("last")]
    by_fill = ["fills", "last", "source"]
    filled = prefix_sums(ranked.select(*order), [], by_fill, "cap", "full_before")
    filled = prefix_sums(filled, [], by_fill, "weight", "weight_before")
    sums = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total, weights_ = sums["total"] or 0, sums["weights"] or 0
    whole = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")
    fits = whole(F.col("weight")) * (whole(total) - whole(F.col("full_before"))) <= whole(F.col("cap")) * (whole(weights_) - whole(F.col("weight_before")))
    cut = filled.where(fits).agg(F.min(F.struct(*by_fill, "full_before", "weight_before")).alias("c")).first()["c"]
    if cut is None:
        target = F.col("cap").cast("double")
    else:
        before = F.struct("fills", "last", "source") < F.struct(F.lit(cut["fills"]).alias("fills"), F.lit(cut["last"]).alias("last"), F.lit(cut["source"]).cast("string").alias("source"))
        share = F.col("weight").cast("double") * F.lit(float(total - cut["full_before"])) / F.lit(float(weights_ - cut["weight_before"]))
        target = F.when(before, F.col("cap").cast("double")).otherwise(share)
    return materialize(filled.select("source", "source_size", "weight", target.alias("target")), "targets")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How many words of each document a mix of the sources by weight takes.

    Returns a row for each row of ``docs``: ``doc_id``, ``source``, ``size``
    (words), ``source_size``, ``target`` (of its source) and ``taken``. Within
    a source, documents lie in the order of a hash of their id; the source's
    budget, its target rounded to a whole number, takes whole epochs and then
    the documents from the front, the last of them in part. So the words taken
    from a source are its budget exactly, no document gives more than
    ``max_epochs`` times its size, and reruns agree.

    Null and empty texts have size 0 and give nothing. Null sources are one
    source, the last. Rows with null ids hash alike and sort by size; rows that
    repeat an id are rows of their own, and equal rows are interchangeable. An
    empty table gives an empty result. A long text is counted whole. Other columns are ignored.
    """
    key = F.md5(F.coalesce(col_of(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(col_of(id_col).cast("long").alias("doc_id"), col_of(source_col).cast("string").alias("source"), word_count(col_of(text_col).cast("string")).alias("size"), key.alias("key"))
    rows = materialize(rows, "sizes")
    targets = source_targets(rows.select("source", "size"), weights, max_epochs)
    placed = prefix_sums(rows, ["source"], ["key", "doc_id", "size"], "size", "before")
    goals = targets.select(F.col("source").alias("of"), "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("of")))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.col("budget") % F.col("source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(rest - F.col("before"), F.col("size")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS r,
         sum(source_size) OVER () AS total FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER p, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS free_now
  FROM o WINDOW p AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT min(r) AS r FROM c WHERE CAST(w AS HUGEINT) * CAST(total - full_before AS HUGEINT) <= CAST(cap AS HUGEINT) * CAST(free_now AS HUGEINT)),
t AS (
  SELECT c.source, c.source_size,
         CASE WHEN x.r IS NULL OR c.r < x.r THEN CAST(c.cap AS DOUBLE)
              ELSE CAST(c.w AS DOUBLE) * CAST(x.total - x.full_before AS DOUBLE) / CAST(x.free_now AS DOUBLE) END AS target
  FROM c LEFT JOIN (SELECT c.* FROM c JOIN cut ON c.r = cut.r) x ON true),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (budget // source_size) * size + greatest(0, least(budget % source_size - before, size)) END AS BIGINT) AS taken
FROM b
"""
