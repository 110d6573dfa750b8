"""Benchmark decontamination by Wu-Manber search over words (operator 2)."""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweave.runtime import col_of, free_name, fresh_name, materialize

WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 3
#: Test words in one search table; a larger test set is searched table by table, each over all documents.
WORDS_AT_ONCE = 500_000
#: The search tables that this Python worker used last, so that its next task finds them.
_compiled: dict[str, list] = {}

#: Bytes 0-9, a-z and those of non-ASCII characters stay, A-Z become a-z, the rest part words.
_KEEP = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return (text or b"").translate(_KEEP).split()


class WuManber:
    """Search tables for many word sequences of one length.

    shift: for a block of words, how far the search may advance when the block
    ends at the current word; buckets: for a block that ends a sequence, its
    sequences by their first block. Both need whole blocks, so ``length`` may
    cut the block short.
    """

    def __init__(self, length: int, sequences: dict[tuple[bytes, ...], set[str | None]]):
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for seq, items in sequences.items():
            for end in range(self.block, length + 1):
                block = seq[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.most), length - end)
            by_head = self.buckets.setdefault(seq[-self.block :], {})
            by_head.setdefault(seq[: self.block], []).append((seq, frozenset(items)))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, frozenset[str | None]]]:
        """First word and items of each occurrence, from left to right."""
        shift, buckets, most, block, length = self.shift.get, self.buckets, self.most, self.block, self.length
        at, n = length, len(words)  # ``at`` is one past the window's last word
        while at <= n:
            tail = tuple(words[at - block : at])
            step = shift(tail, most)
            if step:
                at += step
                continue
            lo = at - length
            for seq, items in buckets[tail].get(tuple(words[lo : lo + block]), ()):
                if tuple(words[lo:at]) == seq:
                    yield lo, items
            at += 1


def compile_tables(items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    """One search table for each window length among the items: ``window``, and those of shorter items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
    for item, words in items:
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length[n][tuple(words[i : i + n])].add(item)
    return [WuManber(n, found) for n, found in sorted(by_length.items())]


def search(tables: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Disjoint hit spans of a text's words, in order, and the items that occur in it."""
    spans, items = [], set()
    for t in tables:
        for lo, found in t.occurrences(words):
            spans.append((lo, lo + t.length))
            items |= found
    return _union(spans), items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, words_at_once: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The test set in blocks of bounded size, one block in the driver at a time."""
    block: list[tuple[str | None, bytes]] = []
    size = 0
    rows = benchmark.select(col_of(item_col).cast("string").alias("item"), F.encode(col_of(text_col).cast("string"), "UTF-8").alias("text")).where("text is not null")
    for item, text in rows.toLocalIterator(prefetchPartitions=False):
        block.append((item, bytes(text)))
        size += len(words_of(bytes(text)))
        if size >= words_at_once:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searcher(sent: Broadcast | None, window: int):
    """A function that searches a text's words with one block's tables; a Python worker compiles a block once and keeps the last."""
    call = uuid.uuid4().hex

    def run(words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        if call not in _compiled:
            _compiled.clear()
            _compiled[call] = compile_tables(((i, words_of(t)) for i, t in sent.value), window) if sent else []
        return search(_compiled[call], words)

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _spans(some: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"lo": lo, "hi": hi} for lo, hi in s] for s in some], _ARROW_SPANS)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    words_at_once: int = WORDS_AT_ONCE,
) -> DataFrame:
    """Mark documents that hold ``window`` consecutive words of a test item.

    An item of fewer words, but not none, is one window. Returns all columns of
    ``docs`` and: ``n_words``, ``n_hit`` (words inside any occurrence),
    ``n_items``, ``items_sha256`` (of the item ids, sorted as strings and joined
    by commas), ``contaminated`` and ``hit_spans`` (word spans, in order); names
    that clash get trailing underscores. Item ids of any type are read as strings. Null and empty texts have no words; a
    text is searched whole, however long. Rows that repeat an item id count as
    one item; items without an id count for hits, but not among the items;
    items without a text take no part. Without items, nothing is hit. Repeated
    documents each have a row; an empty document table gives none.

    The test set is read in blocks of ``words_at_once`` words, one at a time in
    the driver and in each executor. A single block is searched in place: no
    document is shuffled. A larger test set takes a pass over the documents for
    each block; the hits are written down by a digest of the text and then meet
    the documents.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text_col, words_at_once)
    block, more = next(blocks, None), next(blocks, None)
    if more is None:
        return _marked(docs, text_col, _searcher(spark.sparkContext.broadcast(block) if block else None, window))
    text = col_of(text_col).cast("string")
    texts = docs.select(F.md5(text.cast("binary")).alias("key"), text.alias("t")).where("t is not null")
    hits = []
    while block:
        sent = spark.sparkContext.broadcast(block)
        hits.append(materialize(texts.mapInArrow(_hits(_searcher(sent, window)), T.StructType([T.StructField("key", T.StringType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])), "hits"))
        sent.destroy()
        block, more = more, next(blocks, None)
    found = reduce(DataFrame.unionByName, [h.dropDuplicates(["key"]) for h in hits])
    key, spans, items = [fresh_name(docs, x) for x in ("text_key", "text_spans", "text_items")]
    found = found.groupBy(F.col("key").alias(key)).agg(F.flatten(F.collect_list("spans")).alias(spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items))
    keyed = docs.withColumn(key, F.md5(text.cast("binary"))).join(materialize(found, "found"), key, "left")
    return _marked(keyed.select(*[col_of(c) for c in docs.columns], spans, items), text_col, None)


def _hits(find):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *find(words_of(t))) for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())]
            rows = [r for r in rows if r[1]]
            items = pa.array([sorted(x for x in r[2] if x is not None) for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), _spans([r[1] for r in rows]), items], ["key", "spans", "items"])

    return run


def _marked(docs: DataFrame, text_col: str, find) -> DataFrame:
    """The new columns from ``find``, or without it from the spans and items in the last two columns of ``docs``."""
    given_columns = docs.columns if find else docs.columns[:-2]
    inner, names = _names(given_columns)
    n_columns = len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(n_columns).cast(pa.binary()).to_pylist()]
            if find:
                hits = [find(w) for w in words]
            else:
                known = zip(b.column(n_columns + 1).to_pylist(), b.column(n_columns + 2).to_pylist())
                hits = [([(x["lo"], x["hi"]) for x in s or ()], set(i or ())) for s, i in known]
            spans = [_union(s) for s, _ in hits]
            items = [sorted(x for x in i if x is not None) for _, i in hits]
            n_hit = [sum(hi - lo for lo, hi in s) for s in spans]
            new = [
                pa.array([len(w) for w in words], pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([n > 0 for n in n_hit], pa.bool_()),
                _spans(spans),
            ]
            kept = [b.column(i) for i in range(n_columns)]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*inner, *(f"n{i}" for i in range(len(new)))])

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), _SPANS)
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, docs.schema)] + [T.StructField(f"n{i}", k) for i, k in enumerate(kinds)])
    extra = [] if find else [col_of(docs.columns[-2]).alias("s"), col_of(docs.columns[-1]).alias("i")]
    given = docs.select(*[col_of(c).alias(n) for c, n in zip(given_columns, inner)], col_of(text_col).cast("string").alias("t"), *extra)
    out = given.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(given_columns, inner)], *[F.col(f"n{i}").alias(n) for i, n in enumerate(names)])


def _names(columns: list[str]) -> tuple[list[str], list[str]]:
    """Safe inner names for the columns of the documents, and free names for the new ones."""
    wishes = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
    return [f"c{i}" for i in range(len(columns))], [free_name(columns, w) for w in wishes]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out
