"""Tokens of two vocabularies aligned on the bytes they stand for, and how often their ids meet (operator 12)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweave.llm.slices import Ids, Remembered, byte_slices, flat_ids, regathered
from treeweave.runtime import col_of, fresh_name, materialize

#: Texts of so many bytes together are aligned at once and share a dictionary of links; a longer text is alone.
CHUNK = 2 << 20
#: Segments that are given to a library as one text.
_TOGETHER = 256

# All that a vocabulary may take for white space, and the mark that B uses for it.
_WHITE = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2060\\u2581\\u3000\\ufeff"
_ODD = re.compile(f"^[{_WHITE}]| [{_WHITE}]|[{_WHITE}] |[{_WHITE}]$")
_EDGES = frozenset(chr(k) for k in range(0x10000) if re.match(f"[{_WHITE}]", chr(k)))
_PLAIN_SPACE = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")


def segments_of(text: str) -> list[str]:
    """Parts of a text between single spaces that stand between characters other than white space.

    There both vocabularies begin a token with the space, whatever is around:
    parts can be encoded apart, each with a space before it.
    """
    return _PLAIN_SPACE.split(text) if _ODD.search(text) else text.split(" ")


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _encoded(parts: list[str], encode: Callable[[list[str]], list[list[int]]], size: np.ndarray) -> Ids:
    """Each segment's ids, many segments to a text: a segment's tokens end with the byte where it ends.

    Segments with white space at an end, or the mark that stands for a space,
    are encoded alone, and so are those of a text whose tokens end elsewhere.
    """
    alone = np.array([not p or p[0] in _EDGES or p[-1] in _EDGES or "▁" in p for p in parts])
    plain = np.flatnonzero(~alone)
    groups = [plain[lo : lo + _TOGETHER] for lo in range(0, len(plain), _TOGETHER)]
    flat, counts, order = [], [], []
    for group, ids in zip(groups, encode([" ".join([parts[k] for k in g]) for g in groups])):
        ids = np.array(ids, np.int32)
        ends = np.cumsum([1 + len(parts[k].encode()) for k in group])
        token_ends = np.cumsum(size[ids])
        upto = np.searchsorted(token_ends, ends, "right")
        if len(ids) and (token_ends[upto - 1] == ends).all() and upto[-1] == len(ids):
            flat.append(ids)
            counts.append(np.diff(upto, prepend=0))
            order.append(group)
        else:
            alone[group] = True
    rest = np.flatnonzero(alone)
    ids, count = flat_ids(encode([parts[k] for k in rest]))
    place = np.argsort(np.concatenate([*order, rest]))
    ids, count = np.concatenate([*flat, ids]), np.concatenate([*counts, count])
    return regathered(ids, count, place)


class Pair:
    """Both vocabularies of a worker: ids of segments, and the bytes of each id's token."""

    def __init__(self, a_model: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_model.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        special = {t["id"] for t in json.loads(a_model)["added_tokens"]}
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            a_bytes[k] = token.encode() if k in special else bytes(letters[c] for c in token)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (a_bytes, b_bytes))
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        a_encode = lambda texts: [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b_encode = lambda texts: self.b.encode(texts, num_threads=1)
        self.memory = Remembered(lambda parts: _encoded(parts, a_encode, self.a_size), lambda parts: _encoded(parts, b_encode, self.b_size))

    @cached_property
    def names(self) -> pa.Array:
        """Ids as text with what follows them: A within a group and at its end, then B within a group and at its end."""
        one, two = (np.arange(len(x)).astype(str).tolist() for x in (self.a_size, self.b_size))
        return pa.array([x + end for ids, ends in ((one, ",|"), (two, ",;")) for end in ends for x in ids])


_loaded: dict[tuple[int, int], Pair] = {}


def _joined(table: pa.Array, ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    """The tokens' bytes or texts of each document as one."""
    return pa.compute.binary_join(pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), table.take(pa.array(ids))), pa.scalar("" if table.type == pa.string() else b"", table.type))


def _kept(keep: np.ndarray, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the kept documents only, and where each document's tokens now end."""
    count = np.diff(upto)
    return ids[np.repeat(keep, count)], np.concatenate([[0], np.cumsum(np.where(keep, count, 0))])


def align_batch(pair: Pair, texts: list[str | None]) -> dict[str, np.ndarray | pa.Array]:
    """Tokens, groups and links of some texts, all at once.

    The tokens of all texts lie one after another, at byte offsets. Both
    vocabularies' token ends are counted by byte once; a group ends where two
    meet, a link where there is one, and what lies before a byte comes from
    running sums, of which each document takes its part. ``links`` are the
    ids of A times 2^32 plus those of B, in order; ``link_upto`` tells where each
    document's end.
    """
    parts = [segments_of(t) if t else [] for t in texts]
    upto = np.cumsum([0, *map(len, parts)])
    codes = pair.memory.codes([s for p in parts for s in p])
    tokens = []
    for table in (0, 1):
        ids, count = pair.memory.gather(codes, table)
        tokens.append((ids, np.concatenate([[0], np.cumsum(count)])[upto]))
    del parts, codes
    whole = pa.array([b" " + t.encode() if t else b"" for t in texts], pa.binary())
    keep = np.ones(len(texts), bool)
    for table, (ids, ends) in zip((pair.a_bytes, pair.b_bytes), tokens):
        keep &= pa.compute.equal(_joined(table, ids, ends), whole).to_numpy(zero_copy_only=False)
    (a, a_upto), (b, b_upto) = (_kept(keep, *t) for t in tokens)
    byte_upto = np.concatenate([[0], np.cumsum(np.where(keep, pa.compute.binary_length(whole).to_numpy(zero_copy_only=False), 0))])
    total = int(byte_upto[-1])
    a_ends, b_ends = (np.cumsum(lengths[ids]) - 1 for lengths, ids in ((pair.a_size, a), (pair.b_size, b)))
    # tokens of either vocabulary that end with each byte: one of each at most, as no token is empty
    ending = np.bincount(np.concatenate([a_ends, b_ends]), minlength=total).astype(np.int8)
    before = lambda at, places: (np.cumsum(at, dtype=np.int32) - at)[places]
    sums = lambda at: np.concatenate([[0], np.cumsum(at, dtype=np.int32)])[byte_upto]
    a_at = np.zeros(total, bool)
    a_at[a_ends] = True
    either, both = np.flatnonzero(ending), ending == 2
    b_at = (ending > 0) & (~a_at | both)
    links = a[before(a_at, either)].astype(np.int64) << 32 | b[before(b_at, either)]
    groups, link_upto = sums(both), sums(ending > 0)
    # the text of a group is its A ids, then its B ids: a token's place follows from the tokens of the other vocabulary in groups before
    ends = np.flatnonzero(both)
    a_last, b_last = (np.searchsorted(x, ends, "right") for x in (a_ends, b_ends))  # tokens up to each group's end
    a_in, b_in = np.diff(a_last, prepend=0), np.diff(b_last, prepend=0)
    names = np.empty(len(a) + len(b), np.int32)
    names[np.arange(len(a)) + np.repeat(b_last - b_in, a_in)] = a
    names[np.arange(len(b)) + np.repeat(a_last, b_in)] = b + 2 * len(pair.a_size)
    names[a_last + b_last - b_in - 1] += len(pair.a_size)
    names[a_last + b_last - 1] += len(pair.b_size)
    told = _joined(pair.names, names, a_upto + b_upto)
    return {
        "n_a": np.diff(a_upto), "n_b": np.diff(b_upto), "n_groups": np.diff(groups), "n_links": np.diff(link_upto),
        "groups": pa.compute.utf8_rtrim(told, ";"), "links": links, "link_upto": link_upto,
    }


def align_tokens(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and how two vocabularies cut each text.

    A, a byte-level vocabulary, encodes a space and the text; B, a piece model,
    the text, to which it adds the space itself; neither knows special tokens.
    New columns: ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` and
    ``groups`` (``a1,a2|b1;a3|b2,b3``: the ids of A and of B between two
    neighbouring bytes where tokens of both end). A link is a token of A and one
    of B that have a byte in common; ``link_scores`` counts them corpus-wide by
    the further columns ``chunk``, ``links`` (numbers of the document's distinct
    links in its chunk's dictionary), ``times`` (how often it has each), ``pairs`` and ``holders`` (the dictionary: id pairs,
    A times 2^32 plus B, and in how many documents of the chunk each is linked),
    which stand in one row of each chunk, the first.

    Null and empty texts, and those whose tokens of A or B don't add up to the
    space and the text, byte for byte, have no tokens: zeros and an empty
    ``groups``. Repeated rows are documents of their own; an empty table gives
    an empty one. Whole texts of any length are read; nothing is shuffled, and
    what a task holds at once is bounded by ``CHUNK`` or its longest text. Both
    paths are the driver's; executors get the files' bytes, some four megabytes.
    New names that clash with a column of ``docs`` get trailing underscores, but
    ``link_scores`` takes a table in which none did.
    """
    models = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            models.append(f.read())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(models))
    rest = [c for c in docs.columns if c != text_col]
    n = len(rest)
    new = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups", T.StringType()), ("chunk", T.LongType()), ("links", T.ArrayType(T.IntegerType())), ("times", T.ArrayType(T.IntegerType())), ("pairs", T.ArrayType(T.LongType())), ("holders", T.ArrayType(T.LongType()))]
    names = [fresh_name(docs, x) for x, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(sent.value[0]), hash(sent.value[1]))
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Pair(*sent.value)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in byte_slices(batch, n, CHUNK):
                got = align_batch(_loaded[key], b.column(n).to_pylist())
                pairs, link = np.unique(got["links"], return_inverse=True)
                doc = np.repeat(np.arange(b.num_rows), got["n_links"])
                own, times = np.unique(doc * max(1, len(pairs)) + link, return_counts=True)
                held_by, held = np.divmod(own, max(1, len(pairs)))
                held_upto = pa.array(np.searchsorted(held_by, np.arange(b.num_rows + 1)).astype(np.int32))
                holders = np.bincount(held, minlength=len(pairs))
                first = np.concatenate([[0], np.full(b.num_rows, len(pairs))]).astype(np.int32)
                columns = [pa.array(got[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")]
                columns += [got["groups"].cast(pa.string()), pa.array(np.full(b.num_rows, chunk)), *(pa.ListArray.from_arrays(held_upto, pa.array(x.astype(np.int32))) for x in (held, times))]
                columns += [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int64))) for x in (pairs, holders)]
                chunk += 1
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), *columns], [*(f"c{k}" for k in range(n)), *(c for c, _ in new)])

    given = docs.select(*[col_of(c).alias(f"c{i}") for i, c in enumerate(rest)], col_of(text_col).cast("string").alias("t"))
    fields = [T.StructField(f"c{i}", given.schema[i].dataType) for i in range(n)]
    return given.mapInArrow(run, T.StructType([*fields, *(T.StructField(c, k) for c, k in new)])).toDF(*rest, *names)


def link_scores(aligned: DataFrame) -> DataFrame:
    """The rows of ``align_tokens`` with ``n_best`` and ``count_sum`` in place of its chunk columns; other columns may have been added or dropped.

    The count of an id pair is the number of documents in which it is linked.
    ``count_sum`` adds the counts of a document's links, each as often as it
    occurs; ``n_best`` counts the links whose count is the greatest that any pair
    with the same id of A has.

    The table is written once. Pairs are counted from the chunks' dictionaries,
    which hold each pair once for some megabytes of text, so a pair that most
    documents hold is no hot key; the counts go back to the dictionaries by an
    equi-join, and each chunk meets its own: a chunk's rows and its dictionary,
    both bounded by the text of a chunk, are one group.
    """
    rest = [c for c in aligned.columns if c not in ("chunk", "links", "times", "pairs", "holders")]
    n = len(rest)
    written = materialize(aligned, "links")
    entries = written.select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "e")).select("chunk", "at", "e.pairs", "e.holders")
    counts = materialize(entries.groupBy("pairs").agg(F.sum("holders").alias("n")), "pairs")
    a = F.shiftright("pairs", 32)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.withColumn("a", a).join(best, "a").select("pairs", "n", (F.col("n") == F.col("most")).alias("best"))
    dictionary = entries.join(ranked, "pairs").select(F.col("chunk").alias("part"), "at", "n", "best")
    docs = written.where(F.size("links") > 0).select("chunk", "links", "times", *[col_of(c).alias(f"c{i}") for i, c in enumerate(rest)])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        count, is_best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at] = right.column("n").to_numpy()
        is_best[at] = right.column("best").to_numpy(zero_copy_only=False)
        links, times = left.column("links"), pa.compute.list_flatten(left.column("times")).to_numpy()
        flat = pa.compute.list_flatten(links).to_numpy()
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(links).to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[flat] * times)])[ends]) for x in (is_best, count)]
        return pa.table([*(left.column(f"c{i}") for i in range(n)), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())], names=[*(f"c{i}" for i in range(n)), "b", "s"])

    fields = [T.StructField(f"c{i}", written.schema[c].dataType) for i, c in enumerate(rest)]
    schema = T.StructType([*fields, T.StructField("b", T.LongType()), T.StructField("s", T.LongType())])
    scored = docs.groupBy("chunk").cogroup(dictionary.groupBy("part")).applyInArrow(score, schema).toDF(*rest, "n_best", "count_sum")
    none = written.where(F.size("links") == 0).select(*[col_of(c) for c in rest], F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return scored.unionByName(none)
