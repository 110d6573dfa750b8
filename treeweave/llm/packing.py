"""Sequences of near-equal length by Karmarkar-Karp multiway differencing (operator 11)."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweave.llm.slices import Ids, Remembered, byte_slices, flat_ids, regathered
from treeweave.runtime import col_of, fresh_name

CAPACITY = 2048
#: What is left of a document after its full sequences is cut into pieces of so many tokens.
PIECE = 512
#: Pieces that are packed together.
BIN = 2048
#: The id that ends every document.
END = 1
_SLICE = 2 << 20
#: Words whose ids a Python worker remembers; beyond, it starts anew.
REMEMBERED = 800_000


def karmarkar_karp(sizes: list[int], ways: int) -> tuple[np.ndarray, np.ndarray]:
    """``ways`` windows of near-equal sums: each size's window, and the windows' sums.

    Every size starts as a partial partition that holds it alone. The two with
    the largest differences between their windows merge, the fullest windows of
    one with the emptiest of the other, until one partition is left. Ties fall
    to the earlier partition. A window is known by one of its sizes while sizes
    merge. Partitions hold their windows in use only, as negative sums from the
    fullest on and names, so that a merge takes a few operations on short arrays.
    """
    into = np.arange(len(sizes))
    least, alone = -np.asarray(sizes, np.int64), np.arange(len(sizes))
    heap: list = [(k, i, least[i : i + 1], alone[i : i + 1]) for i, k in enumerate(least.tolist())]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums, names = heapq.heappop(heap)
        _, _, others, other_names = heapq.heappop(heap)
        others, other_names = others[::-1], other_names[::-1]
        if (meet := len(sums) + len(others) - ways) > 0:
            own, met = len(sums), other_names[:meet]
            into[met] = names[own - meet :]
            sums, names = np.concatenate((sums, others[meet:])), np.concatenate((names, other_names[meet:]))
            sums[own - meet : own] += others[:meet]
        else:
            sums, names = np.concatenate((sums, others)), np.concatenate((names, other_names))
        order = sums.argsort(kind="stable")
        sums, names = sums[order], names[order]
        heapq.heappush(heap, (int(sums[0] - (sums[-1] if len(sums) == ways else 0)), made, sums, names))
        made += 1
    while (into[into] != into).any():
        into = into[into]
    place, full = np.full(len(sizes), -1), np.zeros(ways, np.int64)
    for _, _, sums, names in heap:
        place[names] = np.arange(len(names))
        full[: len(sums)] = -sums
    return place[into], full


def near_equal_windows(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Each size's window and the number of windows, none above ``capacity``.

    The number starts at what the total needs and rises whenever the capacity is
    exceeded: by one, or by one for each 512 windows. No size may exceed it.
    """
    ways = -(-int(sum(sizes)) // capacity)
    while True:
        window, sums = karmarkar_karp(sizes, ways)
        if not len(sums) or sums.max() <= capacity:
            return window, ways
        ways += max(1, ways // 512)


def _powers(n: int, capacity: int) -> list[int]:
    """Full sequences, then falling powers of two, that hold n tokens without padding."""
    return [capacity] * (n // capacity) + [1 << k for k in reversed(range(capacity.bit_length())) if (n % capacity) >> k & 1]


class _Packer:
    """Pieces of one task that wait for their sequences.

    A piece is (batch, row, start, ids); sequences are numbered from ``first`` on.
    """

    def __init__(self, first: int, capacity: int, bin_pieces: int):
        self.next, self.capacity, self.bin_pieces = first, capacity, bin_pieces
        self.waiting: list[tuple[int, int, int, np.ndarray]] = []

    def full(self) -> bool:
        return len(self.waiting) >= self.bin_pieces

    def laid(self, sequences: list[list]) -> Iterator[tuple]:
        """(batch, row, start, ids, sequence, offset); pieces of a document that meet again become one."""
        for pieces in sequences:
            at = 0
            pieces.sort(key=lambda p: p[:3])
            k = 0
            while k < len(pieces):
                b, r, start, ids = pieces[k]
                k += 1
                while k < len(pieces) and pieces[k][:3] == (b, r, start + len(ids)):
                    ids = np.concatenate([ids, pieces[k][3]])
                    k += 1
                yield b, r, start, ids, self.next, at
                at += len(ids)
            self.next += 1

    def windows(self, pieces: list) -> list[list]:
        window, ways = near_equal_windows([len(p[3]) for p in pieces], self.capacity)
        out: list[list] = [[] for _ in range(ways)]
        for w, p in zip(window.tolist(), pieces):
            out[w].append(p)
        return [x for x in out if x]

    def flush(self) -> Iterator[tuple]:
        pieces, self.waiting = self.waiting, []
        yield from self.laid(self.windows(pieces))

    def flush_last(self) -> Iterator[tuple]:
        """The last pieces of a task: what would fill a window in part only goes, cut, to sequences of powers of two, which need no padding."""
        pieces, self.waiting = self.waiting, []
        total = sum(len(p[3]) for p in pieces)
        ways = total // self.capacity
        over = total - ways * self.capacity
        while True:
            # so many tokens from the last pieces go, the rest must fit the windows
            rest, short, left = list(pieces), [], over
            while left:
                b, r, start, ids = rest.pop()
                cut = max(0, len(ids) - left)
                if cut:
                    rest.append((b, r, start, ids[:cut]))
                short.append((b, r, start + cut, ids[cut:]))
                left -= len(ids) - cut
            if not rest:
                break
            window, sums = karmarkar_karp([len(p[3]) for p in rest], ways)
            if sums.max() <= self.capacity:
                break
            over = min(total, over + ways * max(1, int(sums.max()) - self.capacity))
        sequences: list[list] = [[] for _ in range(ways)]
        if rest:
            for w, p in zip(window.tolist(), rest):
                sequences[w].append(p)
        short.reverse()
        for size in _powers(sum(len(p[3]) for p in short), self.capacity):
            own: list = []
            while size:
                b, r, start, ids = short.pop(0)
                if len(ids) > size:
                    short.insert(0, (b, r, start + size, ids[size:]))
                    ids = ids[:size]
                own.append((b, r, start, ids))
                size -= len(ids)
            sequences.append(own)
        yield from self.laid([x for x in sequences if x])


#: Letters without marks and without odd lower case, and punctuation: the vocabulary splits a segment of the one and then the other between the two, and nowhere else.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Words that are given to the library as one text.
_TOGETHER = 256


class _Words:
    """Ids of segments as the public library gives them, with each word, whatever its case and the marks after it, encoded once."""

    def __init__(self, tokenizer, most: int = REMEMBERED):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts = Remembered(self.learn, most=most)

    def alone(self, parts: list[str]) -> Ids:
        return flat_ids([e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])

    def learn(self, parts: list[str]) -> Ids:
        """Words of letters go to the library many at a time, told apart by the ids that end a word; where these are more or fewer than the words, one by one."""
        letters = np.array([p.isalpha() for p in parts])
        plain = np.flatnonzero(letters)
        groups = [plain[lo : lo + _TOGETHER] for lo in range(0, len(plain), _TOGETHER)]
        flat, counts, order = [], [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([parts[k] for k in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                flat.append(ids)
                counts.append(np.diff(ends, prepend=0))
                order.append(group)
            else:
                letters[group] = False
        rest = np.flatnonzero(~letters)
        ids, count = self.alone([parts[k] for k in rest])
        return regathered(np.concatenate([*flat, ids]), np.concatenate([*counts, count]), np.argsort(np.concatenate([*order, rest])))

    def encode(self, segments: list[str] | pa.Array) -> Ids:
        """Words of letters are told from the marks behind them, and lower-cased as the vocabulary does, for all segments at once."""
        given = (segments if isinstance(segments, pa.Array) else pa.array(segments, pa.string())).cast(pa.large_string())
        marks = pa.compute.utf8_ltrim(given, characters=_LETTERS)
        plain = pa.compute.equal(pa.compute.utf8_rtrim(marks, characters=_MARKS), "")
        words = pa.compute.if_else(plain, pa.compute.utf8_lower(pa.compute.utf8_rtrim(given, characters=_MARKS)), given)
        found = [x.dictionary_encode() for x in (words, pa.compute.if_else(plain, marks, ""))]
        codes = self.parts.codes([p for x in found for p in x.dictionary.to_numpy(zero_copy_only=False).tolist()])
        own, behind = (x.indices.to_numpy() for x in found)
        ids, count = self.parts.gather(np.stack([codes[own], codes[behind + len(found[0].dictionary)]], axis=1).ravel())
        return ids, count.reshape(-1, 2).sum(axis=1)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, each with the end id behind it, and each text's number of ids; texts are cut at white space, and each segment among them is looked up once."""
        cut = pa.compute.split_pattern(pa.compute.replace_substring(pa.compute.fill_null(texts, ""), "\n", " "), " ")
        found = cut.flatten().dictionary_encode()
        ids, count = self.encode(found.dictionary)
        ids, count = np.append(ids, np.int32(END)), np.append(count, 1)
        upto = np.cumsum(pa.compute.list_value_length(cut).to_numpy())
        ids, count = regathered(ids, count, np.insert(found.indices.to_numpy(), upto, len(count) - 1))
        return ids, np.diff(np.cumsum(count)[upto + np.arange(len(upto))], prepend=0)


_memory: dict[int, _Words] = {}


def _words(model: bytes) -> _Words:
    if hash(model) not in _memory:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(model.decode())
        if "Lowercase" not in str(tokenizer.normalizer) or "behavior=Removed" not in str(tokenizer.pre_tokenizer):
            raise ValueError("a vocabulary whose words depend on the white space between them")
        _memory.clear()
        _memory[hash(model)] = _Words(tokenizer)
    return _memory[hash(model)]


def pack_sequences(docs: DataFrame, model_path: str, text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, bin_pieces: int = BIN) -> DataFrame:
    """Pieces of all documents in training sequences of at most ``capacity`` tokens.

    The columns of ``docs`` but its text, and ``start`` (tokens of the document
    before the piece), ``length``, ``ids`` (the piece, little-endian unsigned
    32-bit, as a training file holds it), ``doc_tokens``, ``sequence_id`` and
    ``offset`` (tokens of the sequence before the piece). A document is the ids
    of its text by the vocabulary at ``model_path`` (a path on the driver; its
    bytes, some two megabytes, go to the executors) and the id 1. Each id lies
    in one piece; the pieces of a sequence follow each other without a gap.

    A document's full sequences are cut off first. What is left is cut into
    pieces of ``piece`` tokens, of which ``bin_pieces`` at a time are dealt to
    near-equal windows by Karmarkar-Karp differencing; the number of windows
    rises whenever one exceeds the capacity. Pieces of one document that meet
    in a window become one again. The last tokens of a task that fill no window
    go to sequences of powers of two. Each task packs the documents it reads:
    nothing is shuffled, and sequence ids carry the task's number.

    Null and empty texts are the end id alone. Repeated rows and ids, null ids
    among them, are documents of their own; an empty table gives an empty one.
    Whole texts of any length are read. Clashing new names get underscores.
    """
    if not 0 < piece <= capacity or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two, and piece at most capacity")
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c != text_col]
    n = len(rest)
    names = [fresh_name(docs, x) for x in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(sent.value)
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, bin_pieces)
        held: dict[int, tuple[pa.RecordBatch, np.ndarray]] = {}
        number = -1

        def rows(laid: list[tuple]) -> pa.RecordBatch:
            which = sorted({p[0] for p in laid})
            table = pa.Table.from_batches([held[b][0] for b in which]).combine_chunks()
            base = dict(zip(which, np.cumsum([0, *(held[b][0].num_rows for b in which)]).tolist()))
            own = table.take(pa.array([base[p[0]] + p[1] for p in laid], pa.int64()))
            columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in own.columns]
            new = [
                pa.array([p[2] for p in laid], pa.int64()), pa.array([len(p[3]) for p in laid], pa.int64()), pa.array([p[3].astype("<u4").tobytes() for p in laid], pa.binary()),
                pa.array([int(held[p[0]][1][p[1]]) for p in laid], pa.int64()), pa.array([p[4] for p in laid], pa.int64()), pa.array([p[5] for p in laid], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays([*columns, *new], [*(f"c{k}" for k in range(n + 1)), "s", "l", "i", "d", "q", "o"])

        for batch in batches:
            for b in byte_slices(batch, n, _SLICE):
                ids, sizes = words.encode_texts(b.column(n))
                upto = np.cumsum(sizes)
                number += 1
                # the text is done with; a column that numbers rows keeps tables of no other column in shape
                held[number] = (pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), pa.array(np.arange(b.num_rows))], [*(f"c{k}" for k in range(n)), "row"]), sizes)
                whole = []
                for r, (end, size) in enumerate(zip(upto.tolist(), sizes.tolist())):
                    own, full = ids[end - size : end], size - size % capacity
                    for start in range(0, full, capacity):
                        whole.append([(number, r, start, own[start : start + capacity])])
                    packer.waiting += [(number, r, start, own[start : min(size, start + piece)].copy()) for start in range(full, size, piece)]
                if laid := list(packer.laid(whole)):
                    yield rows(laid)
                if packer.full():
                    yield rows(list(packer.flush()))
                    held.clear()
        if packer.waiting:
            yield rows(list(packer.flush_last()))

    given = docs.select(*[col_of(c).alias(f"c{i}") for i, c in enumerate(rest)], col_of(text_col).cast("string").alias("t"))
    kinds = [("s", T.LongType()), ("l", T.LongType()), ("i", T.BinaryType()), ("d", T.LongType()), ("q", T.LongType()), ("o", T.LongType())]
    fields = [T.StructField(f"c{i}", given.schema[i].dataType) for i in range(n)] + [T.StructField(f"c{n}", T.LongType())]
    out = given.mapInArrow(run, T.StructType([*fields, *(T.StructField(c, k) for c, k in kinds)]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *[F.col(c).alias(name) for (c, _), name in zip(kinds, names)])
