"""Document operators against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from cases import LONG, ODD, rows
from pyspark.sql import functions as F

from treeweave.llm import decontaminate, langid, licenses, mixing, queries, simhash, substring, tokens
from treeweave.runtime import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def empty_of(df):
    return df.where("false")


# 1: language ID


def test_languages_held_out(spark, sf):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    truth = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text").where("lang is not null and text is not null")
    both = got.join(truth, "doc_id").where("held_out").collect()
    assert len(both) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in both) / len(both) > 0.95
    assert all(0 <= r["score"] <= 1 for r in both)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in both)


def test_languages_of_odd_rows(clashing):
    model = langid.train([(i, lang, t) for i in range(40) for lang, t in (("en", f"the house of the people and {i}"), ("de", f"das Haus der Leute und {i}"))])
    got = langid.identify_languages(clashing, model).select("doc_id", "text", "lang_pred", "lang_pred_", "score_", "accepted").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["lang_pred"] == "kept"
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred_"], r["score_"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred_"] in ("en", "de") and 0 < r["score_"] <= 1
    assert langid.identify_languages(empty_of(clashing), model).count() == 0


def test_frequent_languages_stay_among_many_labels(spark):
    docs = spark.range(2400).selectExpr("id as doc_id", "if(id < 1200, concat('en-', id), if(id % 2 = 0, 'en', 'de')) as lang", "'some text' as text")
    got = langid.labelled_sample(docs, "doc_id", "text", "lang")
    assert len({lang for _, lang, _ in got}) == 1202
    assert all(400 < sum(x == lang for _, x, _ in got) < 600 for lang in ("en", "de"))


def test_more_languages_than_dimensions():
    texts = [(i, f"l{k:02}", " ".join(f"{chr(97 + k)}{chr(97 + (k * j + i) % 20)}" for j in range(1, 12))) for i in range(30) for k in range(20)]
    model = langid.train(texts)
    assert model.table.shape == (langid.BUCKETS, langid.DIM) and len(model.languages) == 20
    assert sum(model.predict(t)[0] == lang for _, lang, t in texts) / len(texts) > 0.9


def test_no_labels_predict_nothing(odd):
    model = langid.train(langid.labelled_sample(odd.where("lang = 'none'"), "doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.identify_languages(odd, model).collect()} == {"und"}


def test_rejection_follows_the_threshold():
    texts = [(i, lang, t) for i in range(60) for lang, t in (("en", f"the house of the people and the river {i}"), ("fr", f"la maison des gens et la rivière {i}"))]
    model = langid.train(texts)
    p, score, ok = model.predict("the house and the river")
    assert p == "en" and ok and score >= model.threshold
    assert not langid.LanguageModel(model.languages, model.table, model.temperature, 1.1).predict("the house")[2]


def test_unknown_scripts_are_rejected(spark, sf):
    model = langid.train(langid.labelled_sample(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id", "text", "lang"))
    for text in ("Привет, как дела? Сегодня хорошая погода, и мы идём гулять", "今天天气很好我们去公园散步", "Καλημέρα σας πώς είστε σήμερα", "こんにちは世界"):
        assert not model.predict(text)[2], text


# 2: decontamination


def brute_hits(words, items, window=10):
    hit, found = set(), set()
    for item, w in items:
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit |= set(range(k, k + n))
                    found.add(item)
    return hit, found


def test_decontamination_brute_force(spark):
    import random

    rng = random.Random(3)
    vocabulary = ["a", "b", "cc", "Dd", "é"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary[:3], k=rng.randrange(0, 9)))) for i in range(12)] + [(50, docs[3][1]), (50, docs[4][1]), (51, None), (None, "a b"), (52, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (10, 500_000):
        for r in decontaminate.decontaminate(d, b, words_at_once=at_once).collect():
            words = decontaminate.words_of(r["text"].encode())
            hit, found = brute_hits(words, [(i, decontaminate.words_of(t.encode())) for i, t in items if t is not None])
            found -= {None}  # an item without an id makes hits, but is no item to name
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(found), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_of_many_blocks_and_batches(spark):
    """Several blocks over several Arrow batches: the same rows as in one block, and a block is compiled once a task."""
    docs = spark.range(0, 3000, 1, 2).selectExpr("id as doc_id", "if(id % 50 = 7, null, concat_ws(' ', transform(sequence(0, 40), i -> concat('w', (id * 7 + i) % 97)))) as text")
    items = spark.range(40).selectExpr("if(id % 9 = 4, null, id) as item_id", "concat_ws(' ', transform(sequence(0, 14), i -> concat('w', (id * 2 + i) % 97))) as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        one, many = (sorted(map(str, decontaminate.decontaminate(docs, items, words_at_once=n).collect())) for n in (500_000, 100))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many and len(one) == 3000


def test_decontamination_odd_rows(clashing, spark):
    items = spark.createDataFrame([(1, "word5 and5"), (2, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(clashing, items).collect()}
    assert got[6]["n_hit_"] > 0 and got[6]["N_HIT"] == "kept" and got[1]["n_words_"] == 0
    pieces = decontaminate.decontaminate(clashing, items, words_at_once=1)
    assert sorted(map(str, pieces.collect())) == sorted(map(str, decontaminate.decontaminate(clashing, items).collect()))
    named = decontaminate.decontaminate(clashing, items.selectExpr("concat('mmlu-é/', item_id) as item_id", "text")).where("doc_id = 6").first()
    assert (named["n_items"], named["items_sha256"]) == (1, hashlib.sha256("mmlu-é/1".encode()).hexdigest())
    none = decontaminate.decontaminate(clashing, items.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == len(ODD)
    assert decontaminate.decontaminate(empty_of(clashing), items).count() == 0


# 4: mixing


def test_mix_reaches_budgets(spark):
    docs = [(i, "w " * (i % 13), None if i % 11 == 0 else f"s{i % 4}") for i in range(400)] + [(1, "w w", "s1"), (None, "w", "s2"), (7, None, "tiny"), (8, "w", "tiny2")]
    got = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).toPandas()
    assert len(got) == len(docs)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    by = got.groupby("source", dropna=False)
    for _, g in by:
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5001
        assert g["size"].sum() == g["source_size"].iloc[0]
    again = mixing.mix_sources(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string")).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_targets_by_plain_rounds(spark):
    """Targets against capping round after round, for many source sizes."""
    import random

    rng = random.Random(2)
    for sizes in ([rng.choice((0, 1, 5, 50, 1000, 100_000)) for _ in range(n)] for n in (1, 2, 3, 7, 40)):
        rows = [(None if i == 2 else f"s{i:02}", n) for i, n in enumerate(sizes)]
        names = sorted((s for s, _ in rows), key=lambda s: (s is None, s or ""))
        weight, cap = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3 * n for s, n in rows}
        full: set = set()
        while True:
            left, free = sum(sizes) - sum(cap[s] for s in full), [s for s in names if s not in full]
            share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
            if not (more := {s for s in free if share[s] > cap[s]}):
                break
            full |= more
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert got == pytest.approx({s: cap[s] if s in full else share[s] for s in names})


def test_mix_odd_rows(clashing):
    got = mixing.mix_sources(clashing)
    assert got.count() == len(ODD) and got.where("size = 0 and taken > 0").count() == 0
    assert mixing.mix_sources(empty_of(clashing)).count() == 0


# 5: substring dedup


def brute_substring(docs, window):
    first = {}
    seqs = [(i, WORD.findall((t or "").encode())) for i, t in docs]
    for i, w in seqs:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            if i is not None:
                first[s] = min(first.get(s, i), i)
    for i, w in seqs:
        drop = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                drop |= set(range(k, k + window))
        yield i, [x for k, x in enumerate(w) if k not in drop], len(drop)


@pytest.mark.parametrize("window", [1, 2, 5, 12])
def test_substring_brute_force(spark, window):
    import random

    rng = random.Random(window)
    base = [" ".join(rng.choices("abcde", k=40)) for _ in range(6)]
    docs = []
    for i in range(60):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randrange(0, 40)
        docs.append((i // 2 if i % 7 == 0 else i, rng.choice([a, a[:cut] + " zz " + b[cut:], " ".join(rng.choices("vwxyz", k=rng.randrange(0, 30))), None, "a a a a a a a a a a a a a a a a"])))
    docs.append((None, base[0]))
    got = substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), window=window).collect()
    want = sorted((str(i), n, hashlib.sha256(b" ".join(kept)).hexdigest()) for i, kept, n in brute_substring(docs, window))
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept_sha256"]) for r in got) == want
    for r in got:
        if r["text"] is not None and r["n_removed"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_substring_odd_rows(clashing):
    got = substring.substring_dedup(clashing.union(clashing.withColumn("doc_id", F.col("doc_id") + 100)))
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert by[6][0]["text"] == LONG and by[106][0]["text"] == "" and by[1][0]["text"] is None and by[6][0]["n_removed"] == "kept"
    assert by[106][0]["n_removed_"] == by[106][0]["n_words_"]
    assert substring.substring_dedup(empty_of(clashing)).count() == 0


@pytest.mark.parametrize("period", range(1, 32))
def test_difference_cover(period):
    cover = substring.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# 7: SimHash


def brute_print(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_brute_force(spark, sf):
    got = queries.op7_simhash_groups(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    roots = brute_groups(prints)
    least = {}
    for i, r in zip(ids, roots):
        least.setdefault(r, i)
    want = {i: (f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_large_buckets_keep_all_links(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centre = 0x0123456789ABCDEF
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.close_links(spark.createDataFrame(signed, "fp long"), tile=16)
    pairs = [(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    at = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))
    for a, b in pairs:
        x, y = at[a], at[b]
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        parent[x] = y
    roots = {i for i in range(len(fps)) if parent[i] == i}
    assert len(roots) == len(set(brute_groups(fps)))


def test_simhash_odd_rows(clashing):
    got = simhash.simhash_groups(clashing).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8]
    # rows that repeat the kept id or text, and groups without ids: one row of each group stays
    text = "a row without any id at all"
    rows = [(None, text, "x"), (None, text, "y"), (4, "some other words that are here", "x"), (4, "some other words that are here", "y"), (4, "quite another text under the same id", "z"), (9, "some other words that are here", "x")]
    got = simhash.drop_near_duplicates(clashing.sparkSession.createDataFrame(rows, "doc_id long, text string, own string").withColumn("KEPT_ID", F.create_map(F.lit("a"), F.lit(1))))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, text), (4, "quite another text under the same id"), (4, "some other words that are here")]
    assert simhash.simhash_groups(empty_of(clashing)).count() == 0


# 8: licenses


def test_license_rules(spark):
    mit = ". ".join(licenses.SENTENCES[k] for k in ("grant_mit", "notice_mit", "as_is_mit")) + "."
    wrapped = mit.replace(", ", ",\n   ")
    texts = [(1, mit), (2, wrapped.upper()), (3, "Released under the Apache License, Version 2.0."), (4, "nothing here"), (5, None), (6, ""), (7, mit + "\n\n" + "Some words. " + licenses.SENTENCES["grant_isc"] + "."), (8, "the permission. " + licenses.SENTENCES["notice_mit"])]
    got = dict(rows(licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "licenses"))
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "ISC,MIT", 8: ""}


def test_license_versions(spark):
    grant = "Frob is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    fsf, later = " as published by the Free Software Foundation", "of the License, or (at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, "
    only2, later3 = f"{grant}{fsf}; version 2 of the License.", f"{grant}{fsf}, either version 3 {later}"
    texts = {
        only2: "GPL-2.0-only", later3: "GPL-3.0-or-later", grant + fsf + ".": "GPL", grant + " version 2" + fsf + ".": "GPL-2.0-only",
        **{f"{grant}{fsf}{m} either version {v} {later}": f"GPL-{v}.0-or-later" for m in ";," for v in (1, 2, 3)},
        **{f"{grant}{fsf}{m} version {v} of the License.": f"GPL-{v}.0-only" for m in ";," for v in (1, 2, 3)},
        f"{only2} {licenses.SENTENCES['hope_gpl']}.\n\nNext. {later3}": "GPL-2.0-only,GPL-3.0-or-later",
        mpl + "v. 2.0.": "MPL-2.0", mpl + "v. 1.1.": "", mpl + "version 2.0.": "MPL-2.0", "2.0": "",
    }
    got = dict(rows(licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")), "text", "licenses"))
    assert got == texts


def test_license_odd_rows(clashing):
    got = licenses.scan_licenses(clashing)
    assert got.count() == len(ODD) and {r["licenses"] for r in got.collect()} == {"kept"} and "licenses_" in got.columns
    assert licenses.scan_licenses(empty_of(clashing)).count() == 0


# 10: tokens


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_tokens_equal_the_library(spark, sf, library, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    hard = ["<s> </s> <unk>", "▁▁a ▁b", "  two  spaces   ", "\n\ttab\n", "a\u0000b", "ａｂｃ ﬁ ①", "🙂🙂🙂", "x" * 3000, " 　 é", "<0x41>", "a" * 7 + " " * 9]
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string"))
    for r in tokens.count_tokens(docs.withColumn("t", F.col("text")), path).collect():
        want = len(library.encode(r["t"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len((r["t"] or "").encode()), want > 4096), r["t"][:50]


def test_token_odd_rows(clashing):
    got = tokens.count_tokens(clashing, public_tokenizers.path("piece_bpe_32k.model"))
    assert got.count() == len(ODD) and {r["n_tokens"] for r in got.collect()} == {"kept"} and "n_tokens_" in got.columns
    assert tokens.count_tokens(empty_of(clashing), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
