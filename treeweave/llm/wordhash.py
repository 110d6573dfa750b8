"""Vectorised hashes of words and word windows over many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words of more bytes are digested one by one.
_LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts, with their place and their hashes.

    lo, hi: byte spans in ``data``; doc: each word's text; first: each text's
    first word (one entry more than texts). Words are runs of bytes other than
    the six ASCII white spaces.
    """

    def __init__(self, texts: list[bytes | None]):
        self.data = b"\n".join(t or b"" for t in texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        gap = _SPACE[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.lo, self.hi = edge[0::2], edge[1::2]
        ends = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64))
        self.first = np.concatenate([[0], np.searchsorted(self.lo, ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.raw = raw

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes after eight are scrambled in, the length last, so no sum of letters can cancel out."""
        n = self.hi - self.lo
        out = np.full(len(n), mix(np.array([seed], np.uint64) + _ODD)[0], np.uint64)
        # every eight bytes that start in the data, as a number
        view = np.lib.stride_tricks.as_strided(np.frombuffer(self.data + b"\0" * 8, np.uint8), (len(self.data), 8), (1, 1))
        at = np.flatnonzero(n <= _LONG)
        for lo in range(0, _LONG, 8):
            at = at[n[at] > lo]
            if not len(at):
                break
            eight = np.ascontiguousarray(view[self.lo[at] + lo]).view("<u8")[:, 0]
            over = np.uint64(8) * np.maximum(8 - (n[at] - lo), 0).astype(np.uint64)  # bits beyond the word's end
            out[at] = mix((out[at] ^ ((eight << over) >> over)) * _ODD + np.uint64(seed))
        for i in np.flatnonzero(n > _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.lo[i] : self.hi[i]], digest_size=8, key=b"%d" % seed).digest(), "little")
        return mix(out ^ n.astype(np.uint64))

    def windows(self, hashes: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``width`` words that lies in one text.

        Hashes of 1, 2, 4 ... words are paired up by a scramble that heeds their
        order; a window is paired from those that its width is the sum of.
        """
        n = len(hashes) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        start = np.uint64(2 * seed + 1)
        part, size, done, out = hashes, 1, 0, np.full(n, mix(np.array([start]))[0], np.uint64)
        while True:
            if width & size:
                out = mix(out * _ODD + part[done : done + n])
                done += size
            if done == width:
                break
            part = mix(part[:-size] * _ODD + (part[size:] ^ start))
            size *= 2
        at = np.arange(n)
        own = self.doc[at] == self.doc[at + width - 1]
        return at[own], out[own]


def in_parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list into consecutive parts whose sizes add up to ``most`` or so."""
    lo = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)
