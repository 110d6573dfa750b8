"""Arrow batches in parts of bounded size, and ids of text segments that a worker remembers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of consecutive rows whose texts hold ``most`` bytes together, or a single row of more."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size.astype(np.int64))
    lo = 0
    while lo < len(upto):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


#: Ids of some segments one after another, and the number of each one's ids.
Ids = tuple[np.ndarray, np.ndarray]


def flat_ids(lists: list[list[int]]) -> Ids:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum())), count


def regathered(ids: np.ndarray, count: np.ndarray, places: np.ndarray) -> Ids:
    """The ids of the segments at ``places``, in that order."""
    taken = count[places]
    at = np.repeat((np.cumsum(count) - count)[places] - (np.cumsum(taken) - taken), taken)
    at += np.arange(len(at))
    return ids[at], taken


class Remembered:
    """Ids of text segments by one vocabulary or more, each segment encoded once: all ids of a vocabulary lie in one array.

    ``encoders`` take a list of segments each. ``fixed`` are ids of further
    segments, the same by every vocabulary, that have the codes 0, 1 ... for
    good. A memory that has grown beyond ``most`` segments or ``most_bytes``
    characters starts anew with the next call, so it is bounded whatever the
    texts hold.
    """

    def __init__(self, *encoders: Callable[[list[str]], Ids], fixed: tuple[tuple[int, ...], ...] = (), most: int = 400_000, most_bytes: int = 32 << 20):
        self.encoders, self.fixed, self.most, self.most_bytes = encoders, fixed, most, most_bytes
        self._start_anew()

    def _start_anew(self) -> None:
        self.code: dict[str, int] = {}
        self.held = 0
        self.tables = [flat_ids([list(f) for f in self.fixed]) for _ in self.encoders]
        self._find_places()

    def _find_places(self) -> None:
        self.first = [np.cumsum(count) - count for _, count in self.tables]

    def codes(self, segments: list[str]) -> np.ndarray:
        """A code for each segment, good until the next call."""
        if len(self.code) > self.most or self.held > self.most_bytes:
            self._start_anew()
        new = list(set(segments).difference(self.code))
        if new:
            start = len(self.fixed) + len(self.code)
            self.code.update(zip(new, range(start, start + len(new))))
            self.held += sum(map(len, new))
            self.tables = [tuple(map(np.concatenate, zip(old, encode(new)))) for old, encode in zip(self.tables, self.encoders)]
            self._find_places()
        return np.fromiter(map(self.code.__getitem__, segments), np.int64, len(segments))

    def gather(self, codes: np.ndarray, table: int = 0) -> Ids:
        """The segments' ids by one of the vocabularies, and the number of each one's ids."""
        ids, counts = self.tables[table]
        count = counts[codes]
        at = np.repeat(self.first[table][codes] - (np.cumsum(count) - count), count)
        at += np.arange(len(at))
        return ids[at], count
