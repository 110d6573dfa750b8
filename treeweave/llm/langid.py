"""Language identification by averaged hashed subword embeddings (operator 1)."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweave.runtime import col_of, fresh_name, materialize

UNDETERMINED = "und"
#: Rows in the embedding table; subwords are hashed onto them.
BUCKETS = 1 << 18
DIM = 16
#: Lengths of the character subwords; a word's ends count as a character.
NGRAMS = (1, 2, 3, 4)
#: Bits of the table of subwords seen in training, and the lengths of subwords that count as evidence.
KNOWN_BITS, EVIDENCE = 22, (3, 4)
#: Held-back texts that are all alike set no closer bounds than these.
LEAST_SPREAD, LEAST_REACH = 0.01, 3.0
#: Bound of the labelled sample the classifier is fitted on: texts of a language, texts in all, bytes in all, and bytes of a text (longer ones aren't learned from).
TEXTS_PER_LANGUAGE, TEXTS_IN_ALL, BYTES_IN_ALL, BYTES_OF_A_TEXT = 500, 20_000, 64 << 20, 1 << 20
#: Characters of text hashed at once.
_PART = 1 << 20


@functools.cache
def _letter_classes() -> np.ndarray:
    """For each code point, itself in lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def subwords(text: str) -> tuple[np.ndarray, bool, np.ndarray]:
    """Bucket of each subword of a text, repeats included, whether it has a letter, and the evidence places of its longer subwords.

    Runs of letters are words; every other character parts them. Subwords run
    over a word and one mark on either end, never over two words.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letter_classes()[np.minimum(codes, 0x10FFFF)]
    keep = (low > 0) | np.concatenate([[True], low[:-1] > 0])  # one mark for a run of other characters
    low = np.concatenate([[0], low[keep], [0]]).astype(np.uint64)
    gap = low == 0
    found, places, h = [], [np.empty(0, np.int64)], np.zeros(len(low), np.uint64)
    inside = np.zeros(len(low), bool)
    for n in range(1, max(NGRAMS) + 1):
        if n > len(low):
            break
        h = h[: len(low) - n + 1] * np.uint64(0x100000001B3) + low[n - 1 :] + np.uint64(1)
        # a gap may stand first or last only
        inside = (inside[: len(h)] | gap[n - 2 : n - 2 + len(h)]) if n > 2 else np.zeros(len(h), bool)
        if n in NGRAMS:
            ok = ~inside if n > 1 else ~gap
            if n == 2:
                ok &= ~(gap[:-1] & gap[1:])
            x = h[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            found.append((x >> np.uint64(40)) % np.uint64(BUCKETS))
            if n in EVIDENCE:
                places.append((x & np.uint64((1 << KNOWN_BITS) - 1)).astype(np.int64))
    return np.concatenate(found).astype(np.int64), bool((~gap).any()), np.concatenate(places)


def _pieces(text: str) -> Iterator[str]:
    """A very long text in pieces, cut where a word ends if it can be."""
    at = 0
    while len(text) - at > _PART:
        to = at + _PART
        cut = text.rfind(" ", at, to) + 1
        cut = cut if cut > at else to
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@dataclass(frozen=True)
class Evidence:
    """Which subwords training saw, and how large a share of them a text of the learned languages has.

    bits: a packed table of the subwords seen; mean and spread: mean and
    standard deviation of the share over held-back texts; reach: how many
    deviations below the mean a text may lie, of which short texts have larger ones.
    """

    bits: np.ndarray
    mean: float = 1.0
    spread: float = 0.0
    reach: float = 0.0

    def seen(self, places: np.ndarray) -> int:
        return int(((self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).sum())

    def deviations(self, share: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = min(self.mean, 1 - 1e-3)
        return (m - share) / np.sqrt(self.spread**2 + m * (1 - m) / np.maximum(n, 1))

    def enough(self, seen: int, n: int, text: str) -> bool:
        """Whether the share seen/n is within reach; repeats of a subword count as one draw, which is looked at only where it can matter."""
        share = np.array([seen / max(n, 1)])
        if not n or self.deviations(share, np.array([n]))[0] <= self.reach:
            return True
        distinct = np.unique(np.concatenate([np.unique(subwords(p)[2]) for p in _pieces(text)]))
        return bool(self.deviations(share, np.array([len(distinct)]))[0] <= self.reach)


@dataclass(frozen=True)
class LanguageModel:
    """table: each bucket's embedding times the linear layer, one column a language (the mean of products is the product of the mean); threshold: scores below it are rejected, as are texts without enough evidence.

    Where languages outnumber DIM, ``layer`` is the linear layer and ``table`` the embeddings alone, so the table never grows with them.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    temperature: float
    threshold: float
    layer: np.ndarray | None = None
    evidence: Evidence | None = None

    def _sums(self, text: str | None) -> tuple[np.ndarray | None, int, int]:
        """Calibrated probabilities of the whole text, or None if it has no letter; its evidence subwords, seen and all."""
        if not text or not self.languages:
            return None, 0, 0
        total, n, any_letter, seen, shown = np.zeros(self.table.shape[1]), 0, False, 0, 0
        for piece in _pieces(text):
            ids, letters, places = subwords(piece)
            any_letter |= letters
            if len(ids):
                total += np.bincount(ids, minlength=BUCKETS) @ self.table if len(ids) > 20_000 else self.table[ids].sum(axis=0)
                n += len(ids)
            if self.evidence:
                seen, shown = seen + self.evidence.seen(places), shown + len(places)
        if not any_letter or not n:
            return None, 0, 0
        z = (total if self.layer is None else total @ self.layer) / n / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum(), seen, shown

    def probabilities(self, text: str | None) -> np.ndarray | None:
        return self._sums(text)[0]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is accepted as one of the learned languages."""
        p, seen, shown = self._sums(text)
        if p is None:
            return UNDETERMINED, 0.0, False
        best = int(p.argmax())
        fine = p[best] >= self.threshold and (self.evidence is None or self.evidence.enough(seen, shown, text))
        return self.languages[best], float(p[best]), bool(fine)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Distinct buckets of a text, their shares, and its evidence places."""
    ids = [subwords(p) for p in _pieces(text)]
    if not any(letters for _, letters, _ in ids):
        return None
    which, n = np.unique(np.concatenate([x for x, _, _ in ids]), return_counts=True)
    return which, (n / n.sum()).astype(np.float32), np.concatenate([p for _, _, p in ids])


def _views(text: str, key: int) -> list[str]:
    """A training text whole, and two short cuts of it, so that short texts are learned too."""
    words = text.split()
    cuts = []
    for i, n in enumerate((3, 12)):
        if len(words) > 2 * n:
            at = (key * (i + 3) * 2654435761) % (len(words) - n)
            cuts.append(" ".join(words[at : at + n]))
    return [text, *cuts]


def train(texts: list[tuple[int, str, str]], epochs: int = 4, rate: float = 0.5, kept: float = 0.999) -> LanguageModel:
    """Fit embeddings and a linear softmax by stochastic gradient descent.

    texts: (key, language, text). Texts whose key hashes to 0 modulo 5 are held
    back: on them the temperature (least log loss) is set, and both bounds of
    the rejection, so that at least the share ``kept`` of the rightly predicted
    texts pass each: the score's threshold, and how small a share of its longer
    subwords training may have seen. The second finds texts of languages that
    were not learned, noise and code, on which a softmax may be sure of itself.
    There is no bias, and subwords never seen weigh nothing. Without held-back
    texts the threshold lies half way from blind chance to certainty and half of
    the subwords must be known. No labelled text gives a model that predicts nothing.
    """
    languages = tuple(sorted({lang for _, lang, _ in texts}))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), 1.0, 1.0)
    code = {lang: i for i, lang in enumerate(languages)}
    fit, held = [], []
    for key, lang, text in sorted(texts):
        aside = zlib.crc32(b"held %d" % key) % 5 == 0
        for view in _views(text, key):
            if bag := _bag(view):
                (held if aside else fit).append((code[lang], *bag))
    known = np.zeros(1 << KNOWN_BITS, bool)
    for *_, places in fit:
        known[places] = True
    rng = np.random.Generator(np.random.PCG64(17))
    k = len(languages)
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    out, seen = np.zeros((DIM, k), np.float32), np.zeros(BUCKETS, bool)
    steps, done = epochs * max(1, len(fit)), 0
    for _ in range(epochs):
        for j in rng.permutation(len(fit)).tolist():
            y, ids, share, _ = fit[j]
            lr = np.float32(rate * (1 - done / steps) + 1e-4)
            done += 1
            rows = emb[ids]
            mean = share @ rows
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = out @ p
            out -= lr * np.outer(mean, p)
            seen[ids] = True
            # each subword is stepped as if it stood alone among sqrt(n): else long texts hardly move their rows
            emb[ids] = rows - (lr * np.sqrt(len(ids), dtype=np.float32)) * np.outer(share, grad)
    layer = out if k > DIM else None
    table = np.where(seen[:, None], emb if k > DIM else emb @ out, 0)
    logits = np.array([share @ table[ids] if layer is None else share @ table[ids] @ layer for _, ids, share, _ in held]) if held else np.zeros((0, k))
    labels = np.array([y for y, *_ in held], np.int64)
    temperature = _temperature(logits, labels)
    threshold = _threshold(logits / temperature, labels, kept)
    right = logits.argmax(axis=1) == labels if len(labels) else np.zeros(0, bool)
    evidence = _evidence(np.packbits(known, bitorder="little"), [p for (*_, p), ok in zip(held, right) if ok], kept)
    return LanguageModel(languages, table.astype(np.float32), temperature, threshold, layer, evidence)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.25, 8.0, 41)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _threshold(logits: np.ndarray, labels: np.ndarray, kept: float) -> float:
    """Half way, in log odds, from blind chance to the score that the share ``kept`` of right predictions reach; without any, half way from chance to certainty."""
    chance = 1 / max(1, logits.shape[1])
    if len(labels) and chance < 1:
        p = _softmax(logits)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == labels])
        if len(right):
            odds = [math.log(x / (1 - x)) for x in (chance, min(float(right[int(len(right) * (1 - kept))]), 1 - 1e-9))]
            return 1 / (1 + math.exp(-sum(odds) / 2))
    return (1 + chance) / 2


def _evidence(bits: np.ndarray, held: list[np.ndarray], kept: float) -> Evidence:
    """Bounds of the evidence from the places of held-back texts; the reach is doubled, since few texts are held back."""
    held = [p for p in held if len(p)]
    if not held:
        return Evidence(bits, 0.5, 0.0, 0.0)
    n = np.array([len(np.unique(p)) for p in held])
    share = np.array([Evidence(bits).seen(p) / len(p) for p in held])
    # the spread between texts shows in the longer ones; in short ones the draw of their subwords hides it
    long = n >= np.median(n)
    rough = Evidence(bits, float(share.mean()), max(LEAST_SPREAD, float(share[long].std())))
    far = np.sort(rough.deviations(share, n))
    return Evidence(bits, rough.mean, rough.spread, max(LEAST_REACH, 2 * float(far[min(len(far) - 1, math.ceil(kept * len(far)) - 1)])))


def labelled_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TEXTS_PER_LANGUAGE, in_all: int = TEXTS_IN_ALL, most_bytes: int = BYTES_IN_ALL
) -> list[tuple[int, str, str]]:
    """A bounded sample of the labelled rows, drawn by a hash of the id.

    Each language gives about ``per_language`` texts: the share of its rows is
    set from the counts of all rows, and lowered for all languages alike where
    the sample would hold more than half of ``most_bytes``. ``in_all`` and
    ``most_bytes`` bound the whole sample. Texts of more than BYTES_OF_A_TEXT,
    and rows without an id, language or text, aren't learned from.
    """
    text = col_of(text_col).cast("string")
    rows = docs.select(col_of(id_col).cast("long").alias("key"), col_of(lang_col).cast("string").alias("lang"), text.alias("text"), F.octet_length(text).alias("bytes"))
    rows = rows.where(f"key is not null and lang is not null and text is not null and bytes <= {BYTES_OF_A_TEXT}")
    n = F.count(F.lit(1))
    rate = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / n).alias("rate"), F.sum("bytes").alias("bytes"))
    # All languages, written down: Spark broadcasts them if they are few, and joins them otherwise.
    rate = materialize(rate, "rates")
    expected = rate.agg(F.sum(F.col("rate") * F.col("bytes"))).first()[0] or 0.0
    lower = min(1.0, 0.5 * most_bytes / expected) if expected else 1.0
    draw = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = rows.join(rate.select("lang", "rate"), "lang").where(draw < F.col("rate") * lower)
    got, size = [], 0
    for r in picked.select("key", "lang", "text", "bytes").orderBy(F.xxhash64("key"), "key", "lang", F.xxhash64("text")).limit(in_all).toLocalIterator():
        size += r["bytes"]
        if size > most_bytes:
            break
        got.append((r["key"], r["lang"], r["text"]))
    return got


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``accepted`` to the rows of ``docs``.

    The whole text counts, a very long one piece by piece. Null and empty texts
    and texts without letters are ``und`` with score 0 and not accepted; equal
    texts have equal results, and languages that tie go to the first by name.
    Repeated rows stay, an empty table gives no rows. Only the text is looked at;
    all other columns stay, and names that clash get trailing underscores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)
    names = [fresh_name(docs, x) for x in ("lang_pred", "score", "accepted")]
    own = [i for i, f in enumerate(docs.schema) if f.name == text_col and f.dataType == T.StringType()]
    at = own[0] if own else n  # a text that is a string already isn't sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = sent.value.predict
        for b in batches:
            found = [predict(t) for t in b.column(at).to_pylist()]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *new], [*(f"c{i}" for i in range(n)), "p", "s", "a"])

    given = docs.select(*[col_of(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], *([] if own else [col_of(text_col).cast("string").alias("t")]))
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    fields += [T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("a", T.BooleanType())]
    out = given.mapInArrow(run, T.StructType(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *[F.col(x).alias(y) for x, y in zip("psa", names)])


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out of training: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(col_of(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
