"""Main text, nearest neighbours, chats and the pipeline against brute force and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from cases import ODD
from pyspark.sql import functions as F

import corpus_pipeline
from treeweave.llm import ann, chat, decontaminate, html_text, mixing, substring
from treeweave.runtime import table

# 3: main text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; more</title><style>p{color:red}</style><script>var x = "<p>no</p>";</script></head>
<body class="home"><!-- a comment <p>hidden</p> --><header class="site-header"><a href="/">Home</a> <a href="/b">Blog</a></header>
<nav><ul><li><a href="#">One</a></li><li><a href="#">Two</a></li></ul></nav><div class="cookie-banner">We use cookies, as all do.</div>
<main><article><h1>A long   journey</h1><p>First paragraph, with <b>bold</b> words &amp; signs; it goes on, and on, for a while.</p>
<div class="advert">Buy now, pay later, it is cheap!</div>
<p>Second paragraph:<br>it has caf&eacute; and &#8212; dashes, plus a <a href="x">link</a> in it, and a few more words.</p><p>Third, and last, paragraph of the text, which ends here.</p>
<form><input name=q><label>Search here</label></form></article>
<section id="comments"><h2>Comments</h2><p>A reader says: this is great, I like it, very much, thanks a lot, really.</p></section></main>
<aside class="sidebar"><p>Related: read this, and this, and that one, too.</p></aside><footer><p>Copyright 2020, all rights reserved, by us.</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "\n\n".join([
        "A long journey", "First paragraph, with bold words & signs; it goes on, and on, for a while.",
        "Second paragraph: it has café and — dashes, plus a link in it, and a few more words.", "Third, and last, paragraph of the text, which ends here.",
    ])


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p>", "</p></div>", "<!--", "<script>", "<script>x", "<p class='", "&", "&#xFFFFFFFF;", "<a<b<c>", "]]>", "<![CDATA[", "<table><tr><td>", "<nav>only a menu</nav>", "\x00<p>\x00"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_plain_text_stays():
    assert html_text.main_text("just a text, without tags.") == "just a text, without tags."
    assert html_text.main_text("<p>one, two, three.<p>four, five, six.") == "one, two, three.\n\nfour, five, six."


LINES = ["One long line of the text, with words, and marks; it goes on and on, for a while.", "Another line of it, which says more, and more, and yet more, of the same.", "The third line, last of them, ends what was said before, in so many words."] * 3
HEAD, LEAD = "A short title", "A lead, of a few words."
BODY = "".join(f"<p>{x}</p>" for x in LINES)


@pytest.mark.parametrize("page, want", [
    (f"<article><h1>{HEAD}</h1><p class=lead>{LEAD}</p><div class=body>{BODY}</div></article>", [HEAD, LEAD, *LINES]),
    (f"<div id=page><h1>{HEAD}</h1><div class=body>{BODY}</div></div>", [HEAD, *LINES]),
    (f"<main><h1>{HEAD}</h1><p>{LEAD}</p><blockquote>{BODY}</blockquote></main>", [HEAD, LEAD, *LINES]),
    (f"<article><h1>{HEAD}</h1>{BODY}<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul></article>", [HEAD, *LINES, "Source one", "Source two"]),
    (f"<div>{BODY}<p><a href=a>A linked paragraph, as long as others are.</a></p></div>", [*LINES, "A linked paragraph, as long as others are."]),
    (f"<body class='has-sidebar'><nav>menu</nav><h1>{HEAD}</h1>{BODY}<div class=sidebar><p>Read this, and that.</p></div></body>", [HEAD, *LINES]),
    (f"<h1>{HEAD}</h1><div class='post share-open'>{BODY}</div>", [HEAD, *LINES]),
    (f"<main><article class='post'><h1>{HEAD}</h1>{BODY}</article><section class=comments>{BODY * 4}</section></main>", [HEAD, *LINES]),
])
def test_no_part_of_an_article_is_dropped(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "k"), (2, None, None, "k"), (None, "u", "", "k"), (3, "u", "<p>" + "long text, and more. " * 50_000 + "</p>", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert got[2]["text_"] == "" and got[3]["n_chars"] == len("long text, and more. " * 50_000) - 1 and got[1]["TEXT"] == "k"
    assert html_text.extract_text(pages.where("false")).count() == 0


# 6: nearest neighbours


def brute_neighbours(ids, x, queries, k=10):
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_sample_is_thinned_before_it_meets(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 300)
    classes = spark.range(20_000).select(F.array(F.col("id").cast("double"), F.rand(1)).alias("v"))
    taken = ann._sample(classes, 20_000, 2)
    want = sorted(((r["h"], r["v"]) for r in classes.select(F.xxhash64("v").alias("h"), "v").collect()))[:300]
    assert sorted(r["v"] for r in taken.collect()) == sorted(v for _, v in want)
    assert 300 <= classes.where(F.xxhash64("v") < int(((1.2 * 300 + 100) / 20_000 - 0.5) * 2**64)).count() < 700
    assert "xxhash64" in taken._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 16 * 50)
    assert ann._sample(classes, 20_000, 2).count() == 50 and ann._sample(classes.limit(7), 7, 2).count() == 7


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [5.0, 5.0]), (1, [1.0, 1.0]), (2, [5.0, 6.0]), (2, [5.0, 6.0]), (3, [9.0, 9.0])]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v == 0, k=2).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1.0)]  # its other vector takes a place


def test_recall_and_distances(spark):
    sf = "/root/testdata/sf0.1"
    e = table(spark, sf, "embeddings")
    got = ann.nearest_neighbours(e, lambda v: v % 100 == 0).collect()
    data = e.select("vec_id", "embedding").toPandas()
    ids, x = data["vec_id"].to_numpy(), np.stack(data["embedding"].to_list()).astype(np.float64)
    at = {int(i): n for n, i in enumerate(ids)}
    want = brute_neighbours(ids, x, [(int(i), x[at[int(i)]]) for i in ids if i % 100 == 0])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    hits = 0
    for q, rs in found.items():
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, len(want[q]) + 1))
        assert [(s, v) for _, v, s in rs] == sorted((s, v) for _, v, s in rs)
        for _, v, s in rs:
            assert s == pytest.approx(np.sqrt(((x[at[v]] - x[at[q]]) ** 2).sum()), rel=1e-12)
        hits += len({v for _, v, _ in rs} & {v for v, _ in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = lambda: [float(a) for a in rng.normal(size=5)]
    same = v()
    rows = [(i, same) for i in range(0, 40)] + [(i, v()) for i in range(40, 70)] + [(100, same), (200, v()), (300, None), (400, [0.0] * 5), (500, [1.0, None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 5), (700, [1.0]), (None, v()), (40, v())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("v", F.lit(1))
    got = ann.nearest_neighbours(vectors, lambda x: x % 100 == 0).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == {0, 100, 200}
    assert by[100] == [(i, 0.0) for i in range(10)] and by[0] == [(i, 0.0) for i in range(1, 11)] and len(by[200]) == 10
    assert ann.nearest_neighbours(vectors.where("false"), lambda x: x % 100 == 0).count() == 0
    assert ann.nearest_neighbours(vectors.where("vec_id in (100, 5)"), lambda x: x % 100 == 0).count() == 1


def test_near_equal_vectors_of_a_large_table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100_000, 32))
    x[::50] = rng.normal(size=32) + rng.normal(size=(2000, 32)) * 1e-5  # nearly equal, none of them equal
    where = set(range(0, 100_000, 2500))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(vectors, lambda v: v.isin(*where)).collect()
    want = brute_neighbours(np.arange(len(x)), x, [(i, x[i]) for i in sorted(where)])
    hits = {i: 0 for i in where}
    for r in got:
        hits[r["query_id"]] += r["vec_id"] in {v for v, _ in want[r["query_id"]]}
    assert sum(hits.values()) / (10 * len(where)) >= 0.9


@pytest.mark.parametrize("kind", ["gaussian", "groups"])
def test_recall_beyond_the_sample(spark, kind):
    """More vectors than the index is fitted on, without and with structure; recall and exact distances."""
    rng = np.random.default_rng(9)
    n, dim = ann.SAMPLE + 12_000, 16
    x = rng.normal(size=(n, dim)) + (4 * rng.normal(size=(50, dim))[rng.integers(0, 50, n)] if kind == "groups" else 0)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(vectors, lambda v: v % 1000 == 0).collect()
    want = brute_neighbours(np.arange(n), x, [(i, x[i]) for i in range(0, n, 1000)])
    hits = sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in got)
    assert len(got) == 10 * len(want) and hits >= 0.9 * len(got)
    assert all(r["score"] == pytest.approx(np.sqrt(((x[r["vec_id"]] - x[r["query_id"]]) ** 2).sum()), rel=1e-12) for r in got)


# 9: chats

HARD = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_end|>", "\\", "a\\n", "[INST", "<<SYS>> b <</SYS>>", "<<|im_end|>|im_end|>", "", "\n\n", "é🙂", "[\\/INST]"]


def test_chats_round_trip(spark):
    rows = []
    for c in range(6):
        for t, text in enumerate(HARD):
            rows.append((c, t, ["user", "assistant", "system\n<|im_end|>"][(t + c) % 3], text))
    rows += [(10, None, "assistant", "null turn"), (10, 1, None, None), (11, 1, "user", "tie"), (11, 1, "assistant", "tie"), (11, 1, "user", "tie"), (None, 0, "assistant", "no id"), (12, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("last", F.lit(1)).withColumn("turns", F.lit(2))
    examples = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():
        inner = re.sub(r"<\|im_start\|>|<\|im_end\|>\n", "", r["formatted"])
        assert not re.search(r"<\|im_(start|end)\||</?s>|\[/?INST\]|<</?SYS>>", inner.replace("<|im_start|>", ""))
        if r["loss_start"] is not None:
            assert r["formatted"][r["loss_start"] + r["loss_length"] :] == "<|im_end|>\n"
    n_targets = sum(r[2] == "assistant" for r in rows)
    assert examples.where("loss_start is not null").count() == n_targets
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


def test_long_conversations(spark):
    """1,500 turns: each example holds its prefix; no row carries more than the conversation."""
    turns = spark.range(1500).selectExpr("id % 2 as conv_id", "id as turn", "if(id % 4 < 2, 'user', 'assistant') as role", "concat('text <|im_end|> ', repeat(cast(id as string), 20)) as text")
    examples = chat.format_chats(turns)
    assert examples.count() == 750
    for r in chat.read_back(examples).collect():
        mine = [(("user", "assistant")[i % 4 >= 2], f"text <|im_end|> {str(i) * 20}") for i in range(r["conv_id"], 1500, 2)]
        assert r["n_turns"] == 750 and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(b for a, b in mine if a == "assistant").encode()).hexdigest()


# the pipeline


def test_stages_have_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_pipeline_stages_by_brute_force(spark, sf):
    from test_documents import brute_groups, brute_print, brute_substring

    docs = table(spark, sf, "documents")
    have = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    clean = {i for i, r in have.items() if r["lang"] is not None and r["text"] and len(r["text"].split()) > 20}
    assert len(clean & after) >= 0.99 * len(clean)
    ids = sorted(have)
    roots = brute_groups([brute_print(have[i]["text"]) for i in ids])
    first = {}
    for i, r in zip(ids, roots):
        first.setdefault(r, i)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == set(first.values())
    cut = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    for i, kept, n in brute_substring([(i, have[i]["text"]) for i in ids], substring.WINDOW):
        assert cut[i]["text"] == (b" ".join(kept).decode() if n else have[i]["text"])
        assert cut[i]["n_chars"] == (len(cut[i]["text"]) if cut[i]["text"] is not None else None)
    items = [(r["item_id"], decontaminate.words_of(r["text"].encode())) for r in table(spark, sf, "benchmark").collect()]
    grams = {tuple(w[k : k + min(10, len(w))]) for _, w in items for k in range(max(1, len(w) - 9)) if w}
    hit = {i for i, r in have.items() for w in [decontaminate.words_of((r["text"] or "").encode())] for n in {len(g) for g in grams} if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in corpus_pipeline.benchmark_overlap(spark, docs, sf).collect()} == set(have) - hit
    mixed = corpus_pipeline.source_mix(spark, docs, sf).toPandas()
    for _, g in mixed.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5001


def test_pipeline_on_odd_rows(spark, sf):
    docs = spark.createDataFrame([(*r[:2], r[2], r[3], len(r[1] or "")) for r in ODD], table(spark, sf, "documents").schema)
    for rows in (docs, docs.where("false")):
        out = rows
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
        assert set(mixing.mix_sources(rows).columns) == set(out.columns)
        out.collect()


def test_pipeline_with_clashing_and_extra_columns(spark, sf):
    """Columns that bear the names of what operators add change nothing, and all columns come through."""
    docs = table(spark, sf, "documents")
    extra = docs
    for name, value in (("accepted", F.lit(False)), ("contaminated", F.lit(False)), ("score", F.lit("x")), ("N_WORDS", F.lit(1)), ("n_removed", F.lit(2)), ("size", F.lit("y")), ("kept_id", F.lit(3)), ("extra", F.array(F.lit(1))), ("a.b c", F.create_map(F.lit("k"), F.lit(1)))):
        extra = extra.withColumn(name, value)
    extra = extra.repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, sf), stage(spark, extra, sf)
        assert got.columns == extra.columns, name
        assert sorted(map(tuple, got.select(*docs.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str), name
        assert {(r["accepted"], r["contaminated"], r["N_WORDS"], r["a.b c"]["k"]) for r in got.collect()} == {(False, False, 1, 1)}
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(str, last(spark, extra, sf).collect())) == sorted(map(str, last(spark, docs, sf).collect()))
