"""From raw documents to a weighted training mix, one operator a stage.

Every stage takes the rows that the stage before kept and, but for the last,
returns the columns of its input, whatever they are called: an operator appends
its own columns, under names that don't clash, and stages find them by place.

What holds for all stages: null and empty texts are rows like any other, unless
a stage says what becomes of them; long texts are read whole; extra columns
stay; empty tables give empty tables; ties fall by id or hash, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweave.llm import decontaminate, langid, mixing, simhash, substring
from treeweave.runtime import col_of, materialize, table


def _own(docs: DataFrame) -> list:
    return [col_of(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from a bounded sample of the labelled rows; drop texts that the classifier rejects.

    Null and empty texts and texts without letters are rejected. Rows that repeat
    a document are judged alike. Without labelled rows nothing can be told from
    noise: every text is rejected.
    """
    model = langid.train(langid.labelled_sample(docs, "doc_id", "text", "lang"))
    found = langid.identify_languages(docs, model)
    accepted = found.columns[len(docs.columns) + 2]
    return found.where(col_of(accepted)).select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group, that of the smallest id.

    Texts without words are one group. Of rows that repeat the kept id one stays;
    a group without ids keeps one row.
    """
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out windows of 50 words that a document with a smaller id holds; n_chars, where there is one, follows the text.

    Null texts stay null and rows without an id lose nothing; a document may be
    left with an empty text and stays. Rows that repeat an id don't cut each other.
    """
    cut = substring.substring_dedup(docs).select(*_own(docs))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a test item. Null and empty texts hold none and stay; repeated rows are judged alike."""
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    contaminated = marked.columns[len(docs.columns) + 4]
    return marked.where(~col_of(contaminated)).select(*_own(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each remaining document gives to the mix: a row for each row, of doc_id, source, sizes, target and words taken.

    Texts without words give nothing; null sources are one source.
    """
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_overlap", benchmark_overlap),
    ("source_mix", source_mix),
]

#: SQL can't express a trained classifier; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
