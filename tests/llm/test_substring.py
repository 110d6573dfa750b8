"""Substring removal where hashes could fail: long words of few letters, long windows of two words."""

import hashlib
import random

import pytest
from test_documents import brute_substring

from treeweave.llm import substring
from treeweave.llm.wordhash import Words


def thue_morse(n, a, b):
    return [b if i.bit_count() & 1 else a for i in range(n)]


@pytest.mark.parametrize("letters", [16, 64, 128, 512, 4096])
def test_words_of_two_letters_differ(spark, letters):
    one, two = "".join(thue_morse(letters, "a", "b")), "".join(thue_morse(letters, "b", "a"))
    rest = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join([*rest[:30], one, *rest[30:]])), (2, " ".join([*rest[:30], two, *rest[30:]]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_windows_of_two_words_differ(spark):
    docs = [(1, " ".join(thue_morse(2048, "a", "b"))), (2, " ".join(thue_morse(2048, "b", "a")))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(df, window=1500).collect()}
    assert got == {i: n for i, _, n in brute_substring(docs, 1500)}


def test_brute_force_with_long_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("ab", k=n)) for n in (1, 7, 8, 9, 63, 64, 65, 512, 512, 512)]
    base = [" ".join(rng.choices(words, k=70)) for _ in range(4)]
    docs = [(i, " ".join((a := rng.choice(base).split())[: rng.randrange(70)] + rng.choices(words, k=3) + rng.choice(base).split()[rng.randrange(40) :] + a[:5])) for i in range(50)]
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), window=12).collect()}
    assert got == {i: (n, hashlib.sha256(b" ".join(kept)).hexdigest()) for i, kept, n in brute_substring(docs, 12)}


@pytest.mark.parametrize("width", [1, 2, 3, 20, 50, 64])
def test_window_hashes_tell_windows_apart(width):
    rng = random.Random(width)
    texts = [" ".join(rng.choices(["a", "b", "ab"], k=rng.randrange(200))).encode() for _ in range(30)] + [None, b"", b" \t"]
    w = Words(texts)
    words = [w.data[a:b] for a, b in zip(w.lo, w.hi)]
    at, h = w.windows(w.hashes(1), width, 3)
    want = [i for i in range(len(words) - width + 1) if w.doc[i] == w.doc[i + width - 1]]
    assert at.tolist() == want
    known = {}
    for i, x in zip(at.tolist(), h.tolist()):
        assert known.setdefault(x, words[i : i + width]) == words[i : i + width]
    assert len(known) == len({tuple(words[i : i + width]) for i in want})
