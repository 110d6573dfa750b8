"""Removal of word windows that an earlier document holds, by difference-cover anchors (operator 5)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweave.llm.wordhash import Words, in_parts, mix
from treeweave.runtime import col_of, fresh_name, materialize, shuffle_partitions

WINDOW = 50
#: Bytes of text whose words are hashed at once.
_PART = 4 << 20


@functools.lru_cache(maxsize=16)
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences give every residue modulo ``period``.

    A depth-first search for each size in turn; periods are at most 31 here.
    """

    def grow(cover: tuple[int, ...], diffs: frozenset[int], left: int) -> tuple[int, ...] | None:
        if len(diffs) == period:
            return cover
        if not left or len(diffs) + sum(2 * (len(cover) + i) for i in range(left)) < period:
            return None
        for x in range(cover[-1] + 1, period):
            more = diffs | {(x - c) % period for c in cover} | {(c - x) % period for c in cover}
            if found := grow((*cover, x), frozenset(more), left - 1):
                return found
        return None

    size = 1
    while not (found := grow((0,), frozenset({0}), size - 1)):
        size += 1
    return found


def period_of(window: int) -> int:
    """The anchors' period: up to 31, and less than two thirds of the window so that anchors stay long."""
    return max(1, min(31, int(window * 0.62)))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the half-open ranges, in a row."""
    n = np.maximum(hi - lo, 0)
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _parts(b: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    column = b.column(text)
    sizes = [x or 0 for x in pa.compute.binary_length(column).to_pylist()]
    for lo, hi in in_parts(sizes, _PART):
        part = b.slice(lo, hi - lo)
        yield part, part.column(text).cast(pa.binary()).to_pylist()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of each text's word sequence."""
    for b in batches:
        one, two = [], []
        for t in b.column("__text").cast(pa.binary()).to_pylist():
            d = hashlib.blake2b(b" ".join((t or b"").split()), digest_size=16).digest()
            one.append(int.from_bytes(d[:8], "little", signed=True))
            two.append(int.from_bytes(d[8:], "little", signed=True))
        columns = [b.column("__id"), b.column("__print"), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["__id", "__print", "d1", "d2"])


def _settle(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of one part: whether its id is the smallest of its group here, whether its group has two ids here, and an order by group and id."""
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(g)]]))
    least, twice = np.empty(len(g), bool), np.empty(len(g), bool)
    least[order] = i == np.repeat(i[starts], counts)
    twice[order] = np.repeat(i[starts] != i[starts + counts - 1], counts)
    return least, twice, order


def _fold(keys: tuple[np.ndarray, ...], places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """One row for each distinct key: its index, and a list of its further places (null if none). A text that repeats itself then sends one row, not one for each repeat."""
    order = np.lexsort((places, *keys))
    change = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        change |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(np.concatenate([[True], change])) if len(order) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(order)]]))
    further = np.ones(len(order), bool)
    further[starts] = False
    offsets = np.concatenate([[0], np.cumsum(counts - 1)]).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[order][further].astype(np.int32)), mask=pa.array(counts == 1))
    return order[starts], more


def _anchors(window: int):
    """Anchor rows of each text.

    Of equal anchors in one part, only those of the smallest id go under the
    anchor's hash, to meet the other parts'; the rest are known to have a
    partner and go under keys of their own. So a hot anchor costs a row or so
    for each part of some thousand texts, not one for each text.
    """
    period = period_of(window)
    length, cover = window - period + 1, np.zeros(period, bool)
    cover[list(difference_cover(period))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.and_(pa.compute.invert(b.column("__none")), pa.compute.is_null(b.column("__first"))))
            for part, texts in _parts(b, "__text"):
                w = Words(texts)
                at, h = w.windows(w.hashes(1), length, 1)
                place = at - w.first[w.doc[at]]
                own = cover[place % period] & (np.diff(w.first) >= window)[w.doc[at]]
                at, h, place = at[own], h[own], place[own]
                if not len(at):
                    continue
                ids = part.column("__id").to_numpy(zero_copy_only=False)[w.doc[at]]
                prints = part.column("__print").to_numpy(zero_copy_only=False)[w.doc[at]]
                least, twice, _ = _settle(h, ids)
                key = np.where(least, h, mix(prints.view(np.uint64)))
                head, more = _fold((key, prints), place)
                cols = (key[head].view(np.int64), ids[head], prints[head], place[head].astype(np.int32), twice[head])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), more], ["key", "id", "print", "place", "known", "more"])

    return run


def _windows(window: int):
    """Windows around the candidate anchors of each text.

    A window known here to start in a smaller document comes out as a removed
    span; else it goes out under its 128-bit hash to meet the other parts'.
    """
    reach = period_of(window) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _parts(b, "__text"):
                w = Words(texts)
                anchors = part.column("__places")
                n_anchors = np.array([len(x or ()) for x in anchors.to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(texts)), n_anchors)
                place = anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + w.first[doc]
                last = w.first[doc + 1] - window
                at = np.unique(_ranges(np.maximum(place - reach, w.first[doc]), np.minimum(place, last) + 1))
                if not len(at):
                    continue
                h1, h2 = w.hashes(1), w.hashes(2)
                starts, k1 = w.windows(h1, window, 3)
                _, k2 = w.windows(h2, window, 4)
                sel = np.searchsorted(starts, at)
                k1, k2, doc = k1[sel], k2[sel], w.doc[at]
                ids = part.column("__id").to_numpy(zero_copy_only=False)[doc]
                prints = part.column("__print").to_numpy(zero_copy_only=False)[doc]
                least, _, _ = _settle(k1 ^ mix(k2), ids)
                place = (at - w.first[doc]).astype(np.int32)
                # runs of windows that are known to repeat, and the windows that ask elsewhere
                known = np.flatnonzero(~least)
                follows = (at[known][1:] == at[known][:-1] + 1) & (doc[known][1:] == doc[known][:-1])
                head = known[np.concatenate([[True], ~follows])] if len(known) else known
                tail = known[np.concatenate([~follows, [True]])] if len(known) else known
                mine = mix(prints[head].view(np.uint64) ^ mix(place[head].astype(np.uint64)))
                asks = np.flatnonzero(least)
                first, more = _fold((k1[asks], k2[asks], prints[asks]), place[asks])
                asks = asks[first]
                rows = np.concatenate([asks, head])
                cols = (
                    np.concatenate([k1[asks], mine]).view(np.int64), np.concatenate([k2[asks], ~mine]).view(np.int64), ids[rows], prints[rows], place[rows],
                    np.concatenate([place[asks], place[tail]]) + np.int32(window), np.arange(len(rows)) >= len(asks),
                )
                more = pa.concat_arrays([more, pa.nulls(len(head), more.type)])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), more], ["k1", "k2", "id", "print", "lo", "hi", "known", "more"])

    return run


def _kept(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = [i for i, n in enumerate(b.schema.names) if n.startswith("c")]
            n_words, n_removed, sha, kept_text = [], [], [], []
            columns = (b.column(n) for n in ("__text", "__spans", "__first", "__id"))
            texts, spans, first, ids = (c.cast(pa.binary()).to_pylist() if c.type == pa.string() else c.to_pylist() for c in columns)
            for t, s, f, i in zip(texts, spans, first, ids):
                words = (t or b"").split()
                kept = words
                if f is not None and f < i and len(words) >= window:
                    kept = []
                elif s:
                    drop = np.zeros(len(words), bool)
                    for x in s:
                        drop[x["lo"] : x["hi"]] = True
                    kept = [words[k] for k in np.flatnonzero(~drop)]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept_text.append(t.decode() if t is not None and len(kept) == len(words) else joined.decode() if t is not None else None)
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            new += [pa.array(kept_text, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *new], [*(b.schema.names[i] for i in rest), *["__n", "__r", "__sha", "__kept"][: 3 + keep_text]])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Remove the words of windows that also start in a document with a smaller id.

    A window is ``window`` consecutive words of one text; words are runs of
    characters other than the six ASCII white spaces. Windows are judged on the
    input. The method: (a) of texts with equal word sequences only the first
    takes part further; (b) each text gives hashes of shorter windows at the
    places of a difference cover, modulo a period; equal windows of two texts
    share an aligned anchor, so only windows around anchors of two documents are
    looked at; (c) so each match is extended from its anchor, window by window,
    and those windows meet by a 128-bit hash of their words, and the smallest id
    stays. Words and windows are hashed by scrambles that depend on every byte
    and its place, not by polynomials, so texts made of few letters don't collide.

    Returns every column of ``docs`` with the text replaced by the kept words
    (a text that loses nothing is unchanged; null stays null), and ``n_words``,
    ``n_removed`` and ``kept_sha256``; names that clash get trailing
    underscores. keep_text=False leaves the text column out. A row with a null
    id loses nothing and removes nothing. Rows that repeat an id don't remove
    each other's words. Null and empty texts, and texts under ``window`` words,
    are kept whole; an empty table gives no rows. A text is read whole in one
    task, in parts of some megabytes with the texts beside it; a longer text is
    a part of its own.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    names = {x: fresh_name(docs, x) for x in ("n_words", "n_removed", "kept_sha256")}
    rest = [c for c in docs.columns if c != text_col]
    text = col_of(text_col).cast("string")
    id_ = col_of(id_col).cast("long")
    # Every later step reads the texts dealt by id. Its key columns are never null, each reader takes all its columns,
    # and copies are told apart after a left join: so no filter, pruning or anti join slips below the exchange, the
    # readers' plans are equal there, and Spark runs it once.
    keys = [F.coalesce(id_, F.lit(0)).alias("__id"), F.xxhash64(text, id_.isNull()).alias("__print"), id_.isNull().alias("__none"), text.alias("__text")]
    dealt = docs.select(*[col_of(c).alias(f"c{i}") for i, c in enumerate(rest)], *keys).repartition(n, "__id", "__print")
    prints = docs.select(*keys).where(~F.col("__none")).mapInArrow(_digests, "__id long, __print long, d1 long, d2 long")
    prints = materialize(prints, "prints")
    firsts = prints.groupBy("d1", "d2").agg(F.min("__id").alias("__first"), F.max("__id").alias("last")).where("__first < last").select("d1", "d2", "__first")
    firsts = materialize(firsts, "firsts")  # a table of its own: the join below then splits a hot group of copies
    copies = prints.join(firsts, ["d1", "d2"]).where("__id > __first").groupBy("__id", "__print").agg(F.min("__first").alias("__first"))
    copies = materialize(copies, "copies")

    anchors = dealt.join(copies, ["__id", "__print"], "left").mapInArrow(_anchors(window), "key long, id long, print long, place int, known boolean, more array<int>")
    same = W.partitionBy("key")
    shared = anchors.select("*", F.min("id").over(same).alias("least"), F.max("id").over(same).alias("most")).where("known or least < most")
    shared = shared.select("id", "print", F.explode(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<int>")))).alias("place"))
    places = shared.groupBy(F.col("id").alias("__id"), F.col("print").alias("__print")).agg(F.collect_list("place").alias("__places"))
    around = dealt.join(places, ["__id", "__print"]).mapInArrow(_windows(window), "k1 long, k2 long, id long, print long, lo int, hi int, known boolean, more array<int>")
    found = around.select("*", F.min("id").over(W.partitionBy("k1", "k2")).alias("least")).where("known or least < id")
    found = found.select("id", "print", F.col("hi") - F.col("lo"), F.explode(F.concat(F.array("lo"), F.coalesce("more", F.array().cast("array<int>")))).alias("lo")).toDF("id", "print", "n", "lo")
    found = found.select("id", "print", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    spans = found.groupBy(F.col("id").alias("__id"), F.col("print").alias("__print")).agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))

    full = dealt.join(spans, ["__id", "__print"], "left").join(copies, ["__id", "__print"], "left")
    kinds = {f.name: f.dataType for f in full.schema}
    fields = [T.StructField(c, kinds[c]) for c in full.columns if c.startswith("c")]
    fields += [T.StructField("__n", T.LongType()), T.StructField("__r", T.LongType()), T.StructField("__sha", T.StringType())]
    if keep_text:
        fields.append(T.StructField("__kept", T.StringType()))
    out = full.mapInArrow(_kept(window, keep_text), T.StructType(fields))
    back = [F.col("__kept").alias(c) if c == text_col else F.col(f"c{rest.index(c)}").alias(c) for c in docs.columns if keep_text or c != text_col]
    return out.select(*back, F.col("__n").alias(names["n_words"]), F.col("__r").alias(names["n_removed"]), F.col("__sha").alias(names["kept_sha256"]))
