"""Packed sequences, aligned vocabularies and periodic runs against brute force and the public libraries."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from cases import LONG, ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeweave.llm import alignment, packing, queries, runs
from treeweave.llm.slices import Remembered, flat_ids
from treeweave.runtime import table

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
STRANGE = [
    "<|startoftext|> a<|endoftext|>b </s> <s>", "  two  spaces ", "tab\tand\r\nline\n\n ends ", "no break  wide　", "a mark ▁ of space", "İstanbul ǅ ΣΑΣ ﬁ", "é é ́x", "\x00\x1c \x1d", "👩‍👩‍👧 字符 한국",
    "it's we'll 'S don't", "x" * 3000, "12 345\n678", "\n", " a", "a ", "'s 's", " line \u0085 next", "",
]


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 11: packing


def differenced(sizes, ways):
    """Multiway differencing with lists, as the method is told."""
    parts = [(0, i, sorted([[s, [i]]] + [[0, []] for _ in range(ways - 1)], key=lambda w: -w[0])) for i, s in enumerate(sizes)]
    made = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[2][0][0] - p[2][-1][0]), p[1]))
        (_, _, x), (_, _, y) = parts[:2]
        both = [[a[0] + b[0], a[1] + b[1]] for a, b in zip(x, y[::-1])]
        parts = [*parts[2:], (0, made, sorted(both, key=lambda w: -w[0]))]
        made += 1
    return sorted((s, sorted(m)) for s, m in parts[0][2])


@pytest.mark.parametrize("seed", range(20))
def test_differencing(seed):
    r = random.Random(seed)
    sizes, ways = [r.randint(1, 60) for _ in range(r.randint(1, 40))], r.randint(1, 9)
    window, sums = packing.karmarkar_karp(sizes, ways)
    assert sorted((int(s), [i for i, x in enumerate(window) if x == w]) for w, s in enumerate(sums)) == differenced(sizes, ways)


def test_windows_rise_until_none_is_too_full():
    assert packing.near_equal_windows([])[1] == 0
    window, ways = packing.near_equal_windows([6, 6, 6, 6, 6], 10)  # the total asks for three
    assert ways == 5 and sorted(window) == [0, 1, 2, 3, 4]
    sizes = np.random.default_rng(1).integers(1, 512, 3000).tolist()
    window, ways = packing.near_equal_windows(sizes)
    assert np.bincount(window, sizes).max() <= 2048 and ways * 2048 <= 1.01 * sum(sizes)


def held(pieces, docs, capacity=2048):
    """What must hold of packed pieces (rows with doc_id, start, length, ids, doc_tokens, sequence_id, offset); gives the share of padding."""
    library = Tokenizer.from_file(WORD)
    want = collections.Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in docs)
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    sequences = collections.defaultdict(list)
    for p in pieces:
        ids = struct.unpack(f"<{p['length']}I", p["ids"])
        by[p["doc_id"], p["doc_tokens"]][p["start"]].append(ids)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    need = collections.Counter()
    for (d, ids), n in want.items():
        need[d, len(ids)] += n
    for (d, size), n in need.items():
        # copies with one id are cut alike or not; each place is covered once for each
        covered = np.zeros(size, int)
        for start, cuts in by[d, size].items():
            for ids in cuts:
                covered[start : start + len(ids)] += 1
                assert any(x[start : start + len(ids)] == ids for y, x in want if y == d)
        assert (covered == n).all()
    assert by.keys() == need.keys()
    padded = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padded += capacity - at if at & (at - 1) else 0
    return padded / total if total else 0


def test_packed_tables(spark, sf, odd):
    for docs, most in ((table(spark, sf, "documents").select("doc_id", "text"), 0.01), (odd, 0.01)):
        pieces = packing.pack_sequences(docs, WORD)
        assert held(pieces.collect(), texts(docs)) <= most


def test_packing_of_odd_texts_and_small_bins(spark):
    rows = [(i, t) for i, t in enumerate(STRANGE)] + [(None, None), (3, "twice"), (3, "twice"), (99, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for capacity, piece, bin_pieces in ((2048, 512, 2048), (64, 16, 8), (8, 8, 1), (1, 1, 5)):
        pieces = packing.pack_sequences(docs.where("doc_id <> 99 or doc_id is null") if capacity < 64 else docs, WORD, capacity=capacity, piece=piece, bin_pieces=bin_pieces).collect()
        held(pieces, [r for r in rows if r[0] != 99 or capacity >= 64], capacity)
    with pytest.raises(ValueError):
        packing.pack_sequences(docs, WORD, capacity=100)


def test_packing_keeps_columns(spark, clashing):
    out = packing.pack_sequences(clashing.withColumn("start", F.lit(1)).withColumn("ids", F.lit("x")), WORD)
    assert out.columns == [c for c in clashing.columns if c != "text"] + ["start", "ids", "start_", "length", "ids_", "doc_tokens", "sequence_id", "offset"]
    assert out.where("n_words = 'kept' and `a.b` = 'kept'").count() == out.count() > 0
    assert packing.pack_sequences(clashing.limit(0), WORD).count() == 0


def test_packing_query(spark, sf):
    got = queries.op11_packing(spark, sf).toPandas()
    library = Tokenizer.from_file(WORD)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts(table(spark, sf, "documents"))}
    assert got.groupby("doc_id")["length"].sum().to_dict() == {d: len(x) for d, x in ids.items()}
    for p in got.itertuples():
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.doc_id][p.start : p.start + p.length]))


def test_memory_starts_anew():
    made = []
    memory = Remembered(lambda s: made.append(len(s)) or flat_ids([[len(x)] * len(x) for x in s]), fixed=((7, 8),), most=2)
    for words in (["a", "bb", "a"], ["ccc", ""], ["a", "dd"]):
        codes = memory.codes(words)
        codes = np.concatenate([codes, [0]])
        ids, count = memory.gather(codes)
        assert ids.tolist() == [len(w) for w in words for _ in w] + [7, 8] and count.tolist() == [*map(len, words), 2]
    assert made == [2, 2, 2]


def test_words_start_anew(libraries):
    words = packing._Words(libraries[2], most=3)
    for segments in (["Some", "words,", "and"], ["and", "Some...", "it's", "new"], ["Some", "words", "", "x1", "..."]) * 2:
        ids, count = words.encode(segments)
        assert np.split(ids, np.cumsum(count)[:-1])[0].tolist() == libraries[2].encode(segments[0], add_special_tokens=False).ids
        assert ids.tolist() == libraries[2].encode(" ".join(segments), add_special_tokens=False).ids


class Counting:
    """A library that counts the words that it is given."""

    def __init__(self, library):
        self.library, self.given = library, []

    def get_vocab(self):
        return self.library.get_vocab()

    def encode_batch_fast(self, texts, **options):
        self.given += [w for t in texts for w in t.split()]
        return self.library.encode_batch_fast(texts, **options)


def test_words_of_any_case_are_encoded_once(libraries):
    words = packing._Words(counting := Counting(libraries[2]))
    segments = ["Été,", "été", "ÉTÉ...", "Straße", "STRAßE", "words", "Words;", "WORDS", "it's", "IT'S", "ª", "μ"]
    for _ in range(2):
        assert words.encode(segments)[0].tolist() == libraries[2].encode(" ".join(segments), add_special_tokens=False).ids
    assert sorted(counting.given) == sorted(["été", "straße", "words", ",", "...", ";", "it's", "IT'S", "ª", "μ"])


def test_texts_look_segments_up_once(libraries, monkeypatch):
    words, asked = packing._Words(libraries[2]), []
    monkeypatch.setattr(words.parts, "codes", lambda parts, f=words.parts.codes: asked.append(len(parts)) or f(parts))
    rows = [*(r[1] for r in ODD), *STRANGE, None, "", " ", "so \n so", "and so, and so, " * 500, "<|endoftext|> it's\u2003THE end\t\r"]
    ids, count = words.encode_texts(pa.array(["left out", *rows])[1:])
    parts = np.split(ids, np.cumsum(count)[:-1])
    assert [p.tolist() for p in parts] == [[*libraries[2].encode(t or "", add_special_tokens=False).ids, packing.END] for t in rows]
    assert words.encode_texts(pa.array([], pa.string()))[1].tolist() == []
    words.encode_texts(pa.array(["and so, and so, " * 500]))
    assert asked[-1] == 5  # and, so and nothing; the comma and nothing


def test_differencing_of_many_equal_sizes():
    sizes = [512] * 90 + [random.Random(1).randint(1, 512) for _ in range(60)]
    window, sums = packing.karmarkar_karp(sizes, 33)
    assert sorted((int(s), [i for i, x in enumerate(window) if x == w]) for w, s in enumerate(sums)) == differenced(sizes, 33)


# 12: alignment


def alignment_of(rows):
    """The contract's columns for each row of (id, text), token by token."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters = {c: k for k, c in enumerate([chr(x) if x in {*range(33, 127), *range(161, 173), *range(174, 256)} else None for x in range(256)]) if c}
    for k in [x for x in range(256) if x not in letters.values()]:
        letters[chr(256 + len(letters) - 188)] = k
    a_bytes = lambda k: bytes(letters[c] for c in a.id_to_token(k))
    b_bytes = lambda k: bytes([int(t[3:5], 16)]) if re.fullmatch("<0x..>", t := b.id_to_piece(k)) else t.replace("▁", " ").encode()
    found = []
    for _, t in rows:
        groups, links = [], []
        one, two = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        spans = []
        for ids, told in ((one, a_bytes), (two, b_bytes)):
            at, own = 0, []
            for k in ids:
                own.append((at, at := at + len(told(k)), k))
            spans.append(own)
        if not t or any(b"".join(told(k) for k in ids) != (" " + t).encode() for ids, told in ((one, a_bytes), (two, b_bytes))):
            found.append((0, 0, [], []))
            continue
        near = 0
        for s, e, k in spans[0]:
            while spans[1][near][1] <= s:
                near += 1
            links += [(k, m) for lo, hi, m in spans[1][near : near + 200] if lo < e and hi > s]
        before = 0
        for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            groups.append("|".join(",".join(str(k) for s, e, k in own if before <= s and e <= cut) for own in spans))
            before = cut
        found.append((len(one), len(two), groups, links))
    count = collections.Counter(x for *_, links in found for x in set(links))
    top = collections.Counter()
    for (k, _), n in count.items():
        top[k] = max(top[k], n)
    return sorted(
        (-1 if d is None else d, x, y, len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), ";".join(g)) for (d, _), (x, y, g, links) in zip(rows, found)
    )


def aligned(df):
    out = alignment.link_scores(alignment.align_tokens(df, BYTE, PIECE))
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in out.collect())


def test_alignment_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(STRANGE)] + [(d, t) for d, t, *_ in ODD if t != LONG] + [(50, LONG[:4000])]
    assert aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == alignment_of(rows)


def test_alignment_query_and_small_chunks(spark, sf, monkeypatch):
    rows = [(d, t and t[:3000]) for d, t in texts(table(spark, sf, "documents"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = alignment_of(rows)
    assert aligned(docs) == want
    docs.write.mode("overwrite").parquet(f"{(d := __import__('tempfile').mkdtemp())}/documents.parquet")
    got = queries.op12_alignment(spark, d).toPandas().sort_values("doc_id")
    digest = [hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "" for r in want]
    assert [(*r[:7], h) for r, h in zip(want, digest)] == [tuple(r) for r in got.itertuples(index=False)]


WHITE = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0    　​﻿▁"


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(WHITE), st.sampled_from("ab'sé1.,字́\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_segments_are_encoded_as_the_whole_text(libraries, text):
    a, b, word = libraries
    parts = alignment.segments_of(text) if text else []
    assert " ".join(parts) == text
    assert [k for p in parts for k in a.encode(" " + p, add_special_tokens=False).ids] == (a.encode(" " + text, add_special_tokens=False).ids if text else [])
    assert [k for p in parts for k in b.encode(p)] == b.encode(text)
    assert [k for p in text.replace("\n", " ").split(" ") for k in word.encode(p, add_special_tokens=False).ids] == word.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD)


def test_alignment_keeps_columns(spark, clashing):
    out = alignment.link_scores(alignment.align_tokens(clashing, BYTE, PIECE))
    assert out.columns == [c for c in clashing.columns if c != "text"] + ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert out.where("n_words = 'kept' and `a.b` = 'kept'").count() == len(ODD)
    assert alignment.link_scores(alignment.align_tokens(clashing.limit(0), BYTE, PIECE)).count() == 0
    assert alignment.align_tokens(clashing.withColumn("N_A", F.lit(1)), BYTE, PIECE).columns[-10:-8] == ["n_a_", "n_b"]


# 13: periodic runs


def runs_of(words, least=12):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, 2 * q) and not any(all(words[x] == words[x + r] for x in range(s, s + length - r)) for r in range(1, q)):
                found.append((s, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    docs = []
    for _ in range(40):
        n, k = r.randint(0, 90), r.choice([1, 2, 3, 9])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n else 0):
            a, p = r.randrange(n), r.randint(1, max(1, n // 3))
            for i in range(a, r.randint(a, n)):
                w[i] = w[a + (i - a) % p]
        docs.append(w)
    least = r.choice([2, 4, 12])
    got = runs.find_runs(np.array([x for w in docs for x in w], np.int64), np.array([len(w) for w in docs], np.int64), least)
    assert [tuple(x) for x in got.tolist()] == [(d, *x) for d, w in enumerate(docs) for x in runs_of(w, least)]


def test_blocks_change_nothing(monkeypatch):
    r = np.random.default_rng(3)
    w = np.concatenate([np.tile(r.integers(0, 4, 37), 9), r.integers(0, 2, 800), np.tile(np.arange(300), 3)])
    whole = runs.find_runs(w, np.array([len(w)]))
    monkeypatch.setattr(runs, "_BLOCK", 50)
    assert (runs.find_runs(w, np.array([len(w)])) == whole).all() and [tuple(x[1:]) for x in whole] == runs_of(w.tolist())


def test_long_texts_take_no_quadratic_time():
    for w in (np.zeros(1_000_000, np.int64), np.arange(1_000_000) % 1000):
        assert find_first(w) == (0, 1_000_000, 1 + int(w[-1]))


def find_first(w):
    (found,) = runs.find_runs(w, np.array([len(w)]))
    return tuple(found[1:].tolist())


def test_collapsed_odd_texts(spark):
    loop = "say it again " * 20
    rows = [(d, t) for d, t, *_ in ODD] + [(20, loop), (21, "so " + loop + "\n end"), (22, "a " * 11), (23, "a " * 12), (24, "   x x \x1c \x1c")] + [(25, loop)] * 2
    got = runs.collapse_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    want = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = runs_of(words) if t != LONG else [(0, 60_000, 977 * 31)] if 60_000 >= 2 * 977 * 31 else []
        want.append((d, len(words), found, None if t is None else collapsed(words, found)))
    key = lambda r: str(r)
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=key) == sorted(want, key=key)


def test_runs_keep_columns(spark, clashing):
    out = runs.collapse_runs(clashing.withColumn("RUNS", F.lit(1)))
    assert out.columns == [c for c in clashing.columns if c != "text"] + ["RUNS", "n_words_", "runs_", "collapsed"]
    assert out.where("n_words = 'kept' and `a.b` = 'kept'").count() == len(ODD)
    assert runs.collapse_runs(clashing.limit(0)).count() == 0


def test_runs_query(spark, sf):
    got = queries.op13_periodic_runs(spark, sf).toPandas().set_index("doc_id")
    seen = 0
    for d, t in texts(table(spark, sf, "documents")):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            continue
        found, row = runs_of(words), got.loc[d]
        seen += len(found)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        assert (row["n_runs"], row["runs_sha256"]) == (len(found), hashlib.sha256(lines.encode()).hexdigest())
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        if found:
            s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
            assert tuple(row[["start", "length", "period", "exponent_milli"]]) == (s, length, q, 1000 * length // q)
        else:
            assert pd.isna(row[["start", "length", "period", "exponent_milli"]]).all()
    assert seen > 10


def test_planting_query_takes_nulls_and_blanks(spark):
    rows = [(i, t) for i in range(40) for t in (None, "", " \n", "one", "a b c d e f g h i j k l m n o p")] + [(None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert queries._with_planted_runs(docs).count() == len(rows)
    assert queries._with_planted_runs(docs).where("text is null").count() == 40
