"""Token counts by heap-and-linked-list byte-pair merging (operator 10)."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweave.runtime import col_of, fresh_name

SPACE = "▁"
LIMIT = 4096
#: Distinct segments whose counts a Python worker remembers; on overflow it starts anew.
REMEMBERED = 1_000_000
#: Longer segments are counted each time and not remembered.
_LONG = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one serialised protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    """Merge ranks of a piece model: a pair may merge if the joined piece is in ``scores``."""

    scores: dict[str, float]
    characters: set[str]
    memory: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, data: bytes) -> PieceModel:
        """From the bytes of a .model file. Fixed field numbers of its public format: 1 pieces (1 text, 2 score, 3 kind: 1 normal, 4 user-defined, 6 byte), 2 trainer (3 type: 2 byte pairs), 3 normaliser (1 name, 3 dummy prefix, 4 extra white space)."""
        scores, kinds, normal = {}, set(), {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                kinds.add(kind)
                if kind == 1:
                    scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a byte-pair model")
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(1) != b"identity" or normal.get(3, 1) != 1 or normal.get(4, 1) != 0 or 6 not in kinds or kinds & {4, 5}:
            raise ValueError("a model with another normaliser, without byte pieces or with user-defined pieces")
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece joins two words")
        return cls(scores, {p for p in scores if len(p) == 1})

    def count(self, text: str | None) -> int:
        """Number of tokens of a whole text, without begin and end tokens."""
        if not text:
            return 0
        # no piece has a space mark after another character, so a merge never crosses from a word into the next mark
        total, memory, seen = 0, self.memory, self.memory.get
        plain = "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " "
        for word in text.split(" ") if plain else _segments(SPACE + text.replace(" ", SPACE)):
            n = seen(word)
            if n is None:
                n = self.merge(word if word[:1] == SPACE else SPACE + word)
                if len(word) <= _LONG:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[word] = n
            total += n
        return total

    def merge(self, segment: str) -> int:
        """Tokens of a segment: initial symbols minus merges.

        Symbols form a linked list, candidate pairs a heap by rank and then
        place. The best pair merges, its neighbours make new candidates, and
        stale candidates are dropped when popped. A character that is no piece
        ends up as its UTF-8 bytes.
        """
        scores = self.scores
        symbols = list(segment)
        last = len(symbols) - 1
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        heap: list[tuple[float, int, int, str]] = []
        for i in range(last):
            pair = symbols[i] + symbols[i + 1]
            if (s := scores.get(pair)) is not None:
                heap.append((-s, i, i + 1, pair))
        heapq.heapify(heap)
        count = sum(1 if c in self.characters else len(c.encode("utf-8", "surrogatepass")) for c in symbols)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            after[j] = -1
            count -= 1
            if k <= last:
                before[k] = i
                joined = pair + symbols[k]
                if (s := scores.get(joined)) is not None:
                    heapq.heappush(heap, (-s, i, k, joined))
            if (h := before[i]) >= 0:
                joined = symbols[h] + pair
                if (s := scores.get(joined)) is not None:
                    heapq.heappush(heap, (-s, h, i, joined))
        return count


def _segments(marked: str) -> Iterator[str]:
    """Cut before each run of space marks that follows another character."""
    lo, n = 0, len(marked)
    while lo < n:
        hi = lo
        while hi < n and marked[hi] == SPACE:
            hi += 1
        hi = marked.find(SPACE, hi)
        hi = n if hi < 0 else hi
        yield marked[lo:hi]
        lo = hi


_loaded: dict[bytes, PieceModel] = {}


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The columns of ``docs`` but its text, and ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model_path`` names a piece model on the driver; its bytes, half a megabyte
    or so, go to the executors. Counts equal the public library's for whole
    texts. Null counts as empty: no bytes, no tokens. A very long text is counted
    whole in one task; repeated rows are counted each and alike; an empty table
    gives no rows. Names that clash with a column of ``docs`` get trailing
    underscores. Nothing is shuffled.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c != text_col]
    n = len(rest)
    names = [fresh_name(docs, x) for x in ("n_bytes", "n_tokens", "over_limit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value not in _loaded:
            _loaded.clear()
            _loaded[sent.value] = PieceModel.load(sent.value)
        count = _loaded[sent.value].count
        for b in batches:
            tokens = pa.array([count(t) for t in b.column(n).to_pylist()], pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(n)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), size, tokens], [*(f"c{i}" for i in range(n)), "s", "k"])

    given = docs.select(*[col_of(c).alias(f"c{i}") for i, c in enumerate(rest)], col_of(text_col).cast("string").alias("t"))
    fields = [T.StructField(f"c{i}", given.schema[i].dataType) for i in range(n)]
    out = given.mapInArrow(run, T.StructType([*fields, T.StructField("s", T.LongType()), T.StructField("k", T.LongType())]))
    new = (F.col("s"), F.col("k"), F.col("k") > limit)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *[x.alias(y) for x, y in zip(new, names)])
