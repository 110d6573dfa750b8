"""Main text: pages without telling names, and the path ratios against a plain recount."""

import math
import re
import time

import numpy as np
import pytest

from treeweave.llm import html_text as H
from treeweave.runtime import table

LINES = [f"Paragraph {i} of the text, which goes on for quite a while, and says this; then that, and more of it." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
ARTICLE = f"<article><h1>Head</h1>{BODY}</article>"
NAV, FOOT = "<nav><a href=x>menu</a></nav>", "<footer>c</footer>"
HALF = len(BODY) // 2
OPAQUE = (
    "<body><div class=q1><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul></div>"
    f"<div class=q2><h1>Head</h1>{BODY[:HALF]}<div class=q5>Buy now, pay later, it is cheap!</div>{BODY[HALF:]}</div>"
    "<div class=q7><div class=q8><p>A reader says: this is great, I like it.</p></div><div class=q8><p>Another one says, well, not so great, is it now?</p></div></div>"
    "<div class=q9>Copyright 2020, all rights reserved, by us.</div></body>"
)


@pytest.mark.parametrize("page, want", [
    (f'<body class="single has-sidebar">{NAV}{ARTICLE}{FOOT}</body>', ["Head", *LINES]),
    (f'<body><div class="content with-sidebar"><h1>Head</h1>{BODY}</div><div class="sidebar">read more of it, and this</div></body>', ["Head", *LINES]),
    (f'<body><form id="aspnetForm"><div class=x><h1>Head</h1>{BODY}</div><div class="menu"><a>one</a></div></form></body>', ["Head", *LINES]),
    (OPAQUE, ["Head", *LINES]),
    (f'<article><h1>Head</h1>{BODY}<p><a href=1>A paragraph that is a link, all of it</a></p><ul><li><a href=1>Ref one</a></li></ul><p class="notice-of-death">She died in May.</p></article>',
     ["Head", *LINES, "A paragraph that is a link, all of it", "Ref one", "She died in May."]),
    (f"<table><tr><td><ul><li><a href=1>Home</a></li></ul></td><td><h1>Head</h1>{BODY}</td></tr><tr><td>Copyright, us</td></tr></table>", ["Head", *LINES]),
    (f'<main><article><h1>Head</h1><p>Short text, of one.</p></article><section class="comments">{BODY * 3}</section></main>', ["Head", "Short text, of one."]),
    (f"<article><h1>Head</h1><table><tr><td>a</td><td>b</td></tr></table><section><h2>Part</h2>{BODY}</section><div class=q3><p>A boxed note.</p></div></article>", ["Head", "a", "b", "Part", *LINES, "A boxed note."]),
    ('<div class="ad">buy this, now</div><article></article>', []),
    (NAV, []),
])
def test_pages(page, want):
    assert H.main_text(page) == "\n\n".join(want)


def test_ratios_decide(monkeypatch):
    right = H.main_text(OPAQUE)
    monkeypatch.setattr(H, "path_scores", lambda group, *rest: np.ones(len(group)))
    assert H.main_text(OPAQUE) != right and "Copyright" in H.main_text(OPAQUE)


def plain_scores(blocks):
    """blocks: (path, element, parent, characters, marks) in page order, counted with loops."""
    ratio, mark = {}, {}
    for path in {b[0] for b in blocks}:
        mine = [b for b in blocks if b[0] == path]
        elements, parents = len({b[1] for b in mine}), len({b[2] for b in mine})
        ratio[path] = math.sqrt(sum(b[3] for b in mine) / elements * sum(b[3] for b in mine) / parents)
        mark[path] = sum(b[4] for b in mine) / elements

    def smooth(values, i):
        near = [(math.exp(-0.5 * (j - i) ** 2), values[j]) for j in range(len(values)) if abs(j - i) <= 2]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    rs, ms = [ratio[b[0]] for b in blocks], [mark[b[0]] for b in blocks]
    each = [math.sqrt(rs[i] * smooth(rs, i)) * (1 + smooth(ms, i)) for i in range(len(blocks))]
    mean = {p: sum(s for s, b in zip(each, blocks) if b[0] == p) / sum(b[0] == p for b in blocks) for p in ratio}
    return [mean[b[0]] for b in blocks]


def test_ratios_by_plain_count(spark, sf):
    """Every page of the table, and the page above: scores, choice and text."""
    pages = [r["html"] for r in table(spark, sf, "pages").select("html").collect()]
    for page in [*pages, OPAQUE]:
        p = H.read_page(page or "")
        if not p.blocks:
            continue
        rows = [(p.path[b.node], b.node, p.parent[b.node], float(len(b.text) - b.linked), float(len(H._PUNCTUATION.findall(b.text)))) for b in p.blocks]
        cols = [np.array(c) for c in zip(*rows)]
        group = np.unique(cols[0], return_inverse=True)[1]
        got = H.path_scores(group, *cols[1:])
        assert got == pytest.approx(plain_scores(rows))


def plain_text(page):
    """The whole selection, block by block with loops, from the blocks and marks of ``read_page``."""
    p = H.read_page(page or "")
    up = lambda i: [] if i < 0 else [i, *up(p.parent[i])]
    own, length = [b.node for b in p.blocks], [len(b.text) for b in p.blocks]
    size = [float(len(b.text) - b.linked) for b in p.blocks]
    if not own:
        return ""
    marked = H._marked(p, np.array(own), np.array(length, float), np.array(size))
    free = [j for j, i in enumerate(own) if not marked[i]]
    if not free and not {"article", "main"} & set(p.tag):
        free = [j for j, i in enumerate(own) if p.mark[i] != H.FIXED]
    if not free:
        return ""
    box = {i: next((k for k in up(i) if p.layout[k]), 0) for i in own}
    article = {i: next((k for k in up(i) if p.tag[k] == "article"), 0) for i in own}
    if not any(size[j] for j in free):
        size = [length[j] if article[own[j]] else 0.0 for j in range(len(own))]
    score = plain_scores([(p.path[own[j]], own[j], p.parent[own[j]], size[j], len(H._PUNCTUATION.findall(p.blocks[j].text)) * (1 - p.blocks[j].linked / length[j])) for j in free])
    titled = {box[own[j]] for j in free if p.tag[own[j]] == "h1"}
    value = {j: s * (8 if article[own[j]] or box[own[j]] in titled or any(p.tag[k] == "main" for k in up(own[j])) else 1) for j, s in zip(free, score)}
    chosen = [j for j in free if value[j] > 0 and value[j] >= 0.35 * max(value.values()) * (1 - 1e-12)]
    if not chosen:
        return ""

    def linked(j):
        def outer(i):
            inner = [k for k in up(i) if k != 0]
            return next((k for k in inner if p.layout[k] or p.parent[k] == 0 or p.layout[p.parent[k]]), 0)

        same = [k for k in free if outer(own[k]) == outer(own[j])]
        return sum(p.blocks[k].linked for k in same) >= 0.5 * sum(length[k] for k in same)

    in_articles = sum(size[j] for j in chosen if article[own[j]])
    within = in_articles > 0 and in_articles >= 0.5 * sum(size[j] for j in chosen)
    if within:
        chosen = [j for j in chosen if article[own[j]]]
    heads = [j for j in free if j <= chosen[0] and p.tag[own[j]] == "h1" and not linked(j)]
    head, keep = heads[-1] if heads else chosen[0], []
    for j in free:
        i = own[j]
        if within:
            framed = article[i] in {article[own[k]] for k in chosen} or j == head
        else:
            framed = box[i] in {box[own[k]] for k in chosen} and (j > chosen[0] or not linked(j))
            framed |= head <= j <= chosen[-1] and not linked(j) and (j < chosen[0] or p.tag[i] in H.TEXTUAL)
        if j in chosen or (framed and length[j] <= sum(length[k] for k in chosen)):
            keep.append(p.blocks[j].text)
    return "\n\n".join(keep)


def bare(page):
    """The page without the tags and names that tell its parts."""
    page = re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|section)\b[^>]*>", r"<\1div>", page or "")
    return re.sub(r"\s(?:class|id)=(?:\"[^\"]*\"|[^\s>]+)", "", page)


def test_selection_by_plain_loops(spark, sf):
    pages = [r["html"] for r in table(spark, sf, "pages").select("html").collect()]
    for page in [*pages, *map(bare, pages), OPAQUE]:
        assert H.main_text(page) == plain_text(page)


def test_scores_choose_on_the_table(spark, sf, monkeypatch):
    """Bare pages give the texts of the pages as they are; turned scores give other texts on most pages, random ones on most bare pages."""
    pages = [r["html"] for r in table(spark, sf, "pages").select("html").collect()]
    right, stripped = [H.main_text(x) for x in pages], [H.main_text(bare(x)) for x in pages]
    assert sum(a == b for a, b in zip(right, stripped)) >= 0.98 * len(pages)
    true, rng = H.path_scores, np.random.default_rng(5)
    monkeypatch.setattr(H, "path_scores", lambda *a: (lambda s: s.max() + s.min() - s)(true(*a)))
    assert sum(H.main_text(x) != y for x, y in zip(pages, right)) > 0.5 * len(pages)
    monkeypatch.setattr(H, "path_scores", lambda group, *a: rng.random(int(group.max()) + 1)[group])
    assert sum(H.main_text(bare(x)) != y for x, y in zip(pages, right)) > 0.5 * len(pages)


def test_articles_of_the_table_stay_whole(spark, sf):
    """The tables' pages hold one article each, its blocks parted by p and h1: all of it stays, and nothing else."""
    import html as _html

    for r in table(spark, sf, "pages").select("html").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)
        if inner:
            parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner[1]).replace("<br>", " "))
            want = [" ".join(_html.unescape(x).split()) for x in parts]
            if not re.search(r"<(?!/?(?:p|h1|b|br)>)[a-z!/]", inner[1]):
                assert H.main_text(r["html"]) == "\n\n".join(x for x in want if x)


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>One text, deep down.</p>"
    assert H.main_text(deep) == "One text, deep down."
    assert len(H.main_text("<article>" + "<p>word, and more.</p>" * 20_000 + "</article>").split("\n\n")) == 20_000


@pytest.mark.parametrize("page", [
    "<div>" * 50_000 + f"<article>{BODY}</article>",
    "<div class=sidebar>" * 50_000 + BODY,
    "<ul><li>" * 50_000 + f"</ul><article>{BODY}</article>",
    "<div>" * 20_000 + "</td></li>" * 20_000 + BODY,
    f"<article>{BODY}</article>" + "<b x " * 50_000 + '"',
])
def test_deep_and_broken_pages_take_linear_time(page):
    start = time.process_time()
    assert H.main_text(page) == "\n\n".join(LINES)
    assert time.process_time() - start < 20


def test_a_quotation_mark_without_its_pair():
    assert H.main_text(f'<article><p>He is 6" tall, they say.</p>{BODY}<p class="x>One.</p></article>') == "\n\n".join(['He is 6" tall, they say.', *LINES, "One."])


LONG_TEXT = "A paragraph of the article, with words, and marks; it goes on and on, for a good while, as others do."


@pytest.mark.parametrize("inside, want", [
    ('<h2 id="comments">Comments on the report</h2>', ["Comments on the report"]),
    ('<h2 id="related">Related work</h2>', ["Related work"]),
    ('<h3 class="share">On sharing</h3>', ["On sharing"]),
    ('<section id="sharing"><h2>Sharing memory</h2><p>Two tasks can share it, too, as shown below.</p></section>', ["Sharing memory", "Two tasks can share it, too, as shown below."]),
    ("<p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be one, as before, in what follows.</p>", ["Let x be one, as before, in what follows."]),
    ('<section id="comments"><h2>3 replies</h2><p>Great, I like it, thanks a lot, really.</p></section>', None),
    ('<div class="advert"><h2>Buy now</h2><p>Cheap, and good, and yours.</p></div>', []),
    ('<p class="reply">He said no, and left.</p>', ["He said no, and left."]),
    ('<div class="alert">Mind the gap, please.</div>', ["Mind the gap, please."]),
    ("<p>Seen <span hidden>not <span>so</span> this</span>text, and more.</p>", ["Seen text, and more."]),
    ("<div><label>Your name</label><input name=n></div>", []),
])
def test_headings_and_sections_of_an_article_stay(inside, want):
    page = f"<body><article><h1>Title of it</h1><p>{LONG_TEXT}</p>{inside}<p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></article></body>"
    got = H.main_text(page).split("\n\n")
    if want is None:  # the comments go; their heading goes with them
        want = []
    assert got == ["Title of it", LONG_TEXT, *want, LONG_TEXT, LONG_TEXT]


@pytest.mark.parametrize("page, want", [
    (f"<div class=page><h1>Head</h1><div class=top>The lead, in one line, in its own box.</div><div class=body>{BODY}</div></div>", ["Head", "The lead, in one line, in its own box.", *LINES]),
    (f"<div class=page><h1>Head</h1><p class=lead>The lead, in one line.</p><div class=body>{BODY}</div></div>", ["Head", "The lead, in one line.", *LINES]),
    (f"<div class=body><h1>Head</h1>{BODY}<h2>Short</h2><div class=x><p>Only one.</p></div><h2>More</h2>{BODY}</div>", ["Head", *LINES, "Short", "Only one.", "More", *LINES]),
    (f"<div class=nav><a href=1>Home</a></div><div class=body><h1>Head</h1>{BODY}<h2>Sources</h2><ul><li><a href=1>A book</a></li><li><a href=2>Another</a></li></ul></div>", ["Head", *LINES, "Sources", "A book", "Another"]),
    (f"<body><article><p><a href=1>All of it a link</a></p></article></body>", ["All of it a link"]),
])
def test_pages_without_articles(page, want):
    assert H.main_text(page) == "\n\n".join(want)
