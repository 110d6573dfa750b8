"""Periodic runs of words by harmonic grid probing, and texts collapsed to one period of each run (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from treeweave.llm.slices import byte_slices
from treeweave.runtime import col_of, fresh_name

#: Shortest run, in words; a run also holds two periods at least.
MIN_LENGTH = 12
#: Texts of so many bytes together are probed at once; a longer text is alone.
_SLICE = 4 << 20
#: Grid points, and words of a comparison, that are held at once.
_BLOCK = 1 << 21

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _matched(words: np.ndarray, at: np.ndarray, shift: np.ndarray, cap: np.ndarray, step: int) -> np.ndarray:
    """How many places from ``at`` on in direction ``step``, ``cap`` at most, hold the word that lies ``shift`` further on.

    Chunks of doubling width are compared for all places at once; those that
    meet a difference are done. The first and the last word of ``words`` occur
    once, so a place beyond either counts as a difference.
    """
    out = np.zeros(len(at), np.int64)
    left = np.flatnonzero(cap > 0)
    width = 8
    while len(left):
        still = []
        rows = max(1, _BLOCK // width)
        for lo in range(0, len(left), rows):
            k = left[lo : lo + rows]
            x = at[k, None] + step * (out[k, None] + np.arange(width))
            p = shift[k, None]
            x = np.clip(x, 0, len(words) - 1 - p)
            same = words[x] == words[x + p]
            whole = same.all(axis=1)
            out[k] = np.minimum(out[k] + np.where(whole, width, same.argmin(axis=1)), cap[k])
            still.append(k[whole & (out[k] < cap[k])])
        left = np.concatenate(still)
        width = min(2 * width, 4096)
    return out


def find_runs(ids: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """All runs of some texts as rows of text, start, length and period, sorted by text, start and period.

    ``ids``: the texts' words as numbers from 0 on, one text after another;
    ``sizes``: words of each text. For each period p the words at jp and
    (j+1)p are compared for all j: a run of two periods holds such a pair. What
    matches is extended both ways, up to the next grid point, and neighbours
    that meet are joined. Periods go by octaves [a, 2a), in which none is a
    multiple of another; grid points whose pair lies in a found run of a period
    that divides p are left out, as such a run has no p for its smallest period.
    So the probes of n words number about n log n, whatever the text says.
    """
    found = np.zeros((0, 4), np.int64)
    most = int(sizes.max(initial=0)) // 2
    first = np.cumsum(sizes) - sizes
    low = 1
    while low <= most:
        high = min(2 * low, most + 1)
        part = np.flatnonzero(sizes >= max(2 * low, min_length))
        if len(part):
            # the texts that are long enough, with a word that occurs once before each and after the last
            n = sizes[part]
            base = np.cumsum(n + 1) - n
            doc = np.repeat(np.arange(len(part)), n)
            words = np.empty(int(n.sum()) + len(part) + 1, np.int64)
            owner = np.full(len(words), -1, np.int64)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            words[np.concatenate([base - 1, [len(words) - 1]])] = -1 - np.arange(len(part) + 1)
            words[base[doc] + place] = ids[first[part][doc] + place]
            owner[base[doc] + place] = doc
            lo = low
            while lo < high:  # so many periods that their grid points fit a block
                hi = lo + 1
                points = (len(words) - 1) // lo
                while hi < high and points + (len(words) - 1) // hi <= _BLOCK:
                    points += (len(words) - 1) // hi
                    hi += 1
                found = np.concatenate([found, _probe(words, owner, base, part, lo, hi, found, min_length)])
                lo = hi
        low = high
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _probe(words, owner, base, part, lo: int, hi: int, found: np.ndarray, min_length: int) -> np.ndarray:
    """The runs of periods lo to hi - 1."""
    periods = np.arange(lo, hi)
    counts = (len(words) - 1) // periods
    offset = np.cumsum(counts) - counts
    total = int(counts.sum())
    # grid points inside found runs of a period that divides theirs
    skip = np.zeros(total + 1, np.int32)
    spot = np.full(int(part[-1]) + 1, -1, np.int64)
    spot[part] = base
    known = found[(found[:, 0] <= part[-1])]
    known = known[(spot[known[:, 0]] >= 0) & (known[:, 2] > lo)]
    if len(known):
        s = spot[known[:, 0]] + known[:, 1]
        e, q = s + known[:, 2], known[:, 3]
        least = -(-lo // q)
        many = np.maximum(np.minimum(hi - 1, known[:, 2] - 1) // q - least + 1, 0)
        r = np.repeat(np.arange(len(known)), many)
        p = (least[r] + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)) * q[r]
        a, b = -(-s[r] // p), (e[r] - 1 - p) // p
        ok = b >= a
        np.add.at(skip, offset[p[ok] - lo] + a[ok], 1)
        np.add.at(skip, offset[p[ok] - lo] + b[ok] + 1, -1)
    p = np.repeat(periods, counts)
    i = (np.arange(total) - np.repeat(offset, counts)) * p
    hit = np.flatnonzero((words[i] == words[i + p]) & (owner[i] == owner[i + p]) & (np.cumsum(skip[:-1]) == 0))
    p, i = p[hit], i[hit]
    right = _matched(words, i, p, p, 1)
    joined = np.zeros(len(hit) + 1, bool)  # whether a match goes on from the one before
    joined[1:-1] = (right[:-1] == p[:-1]) & (p[1:] == p[:-1]) & (i[1:] == i[:-1] + p[:-1])
    head, tail = np.flatnonzero(~joined[:-1]), np.flatnonzero(~joined[1:])
    p = p[head]
    start = i[head] - _matched(words, i[head] - 1, p, p - 1, -1)
    length = i[tail] + right[tail] - start + p
    good = np.flatnonzero(length >= np.maximum(min_length, 2 * p))
    d = owner[start[good]]
    return np.stack([part[d], start[good] - base[d], length[good], p[good]], axis=1)


def collapse_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """The columns of ``docs`` but its text, and ``n_words``, ``runs`` and ``collapsed``.

    Words are runs of characters other than the six ASCII white spaces. A run is
    a stretch of words with smallest period q (words q apart are the same), of
    ``min_length`` words and of 2 q at least, that no neighbouring word extends.
    ``runs`` lists start, length and period of each, by start, then period; runs
    may overlap. ``collapsed`` is the text of the words that no run holds beyond
    its first q, joined by one space: a repeated list, line or loop stays once.

    Null texts have no words, no runs and a null ``collapsed``; empty and blank
    ones an empty ``collapsed``. Repeated rows are rows of their own; an empty
    table gives an empty one. New names that clash with a column of ``docs`` get
    trailing underscores. Whole texts of any length are read; nothing is
    shuffled.
    """
    rest = [c for c in docs.columns if c != text_col]
    n = len(rest)
    names = [fresh_name(docs, x) for x in ("n_words", "runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, n, _SLICE):
                texts = b.column(n).cast(pa.binary()).to_pylist()
                split = [t.split() if t else [] for t in texts]
                sizes = np.array([len(w) for w in split], np.int64)
                number = {w: k for k, w in enumerate(set().union(*split))}
                ids = np.fromiter((k for w in split for k in map(number.__getitem__, w)), np.int64, int(sizes.sum()))
                found = find_runs(ids, sizes, min_length)
                upto = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                kept: list[bytes | None] = []
                for d, (t, w) in enumerate(zip(texts, split)):
                    own = found[upto[d] : upto[d + 1]]
                    if len(own):
                        gone = np.zeros(len(w) + 1, np.int64)
                        np.add.at(gone, own[:, 1] + own[:, 3], 1)
                        np.add.at(gone, own[:, 1] + own[:, 2], -1)
                        w = [w[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    kept.append(None if t is None else b" ".join(w))
                runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                new = [pa.array(sizes), pa.ListArray.from_arrays(pa.array(upto), runs), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), *new], [*(f"c{k}" for k in range(n)), "n", "r", "k"])

    given = docs.select(*[col_of(c).alias(f"c{i}") for i, c in enumerate(rest)], col_of(text_col).cast("string").alias("t"))
    fields = [T.StructField(f"c{i}", given.schema[i].dataType) for i in range(n)]
    out = given.mapInArrow(run, T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("r", T.ArrayType(RUN)), T.StructField("k", T.StringType())]))
    return out.toDF(*rest, *names)
