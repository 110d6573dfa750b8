"""Main text of web pages by tag-path ratios (operator 3)."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweave.runtime import col_of, fresh_name

# Elements of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg annotation annotation-xml object canvas select title xmp noembed noframes".split())
BLOCK = frozenset(
    "html body article aside header footer nav main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset legend address details summary hgroup center dialog menu head button".split()
)
#: Elements that are furniture by the standard; ``header`` is too, outside an article.
FURNITURE = frozenset("nav footer aside form head menu dialog button fieldset".split())
#: Inline elements of forms, whose text is no part of an article.
UNSHOWN = frozenset(("label", "option", "output"))
# Words that name page furniture in class and id attributes, and words that may stand beside them.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended recommendations comment comments disqus reply replies respond pagination pager toolbar copyright legal widget skip hidden".split()
)
BESIDE = frozenset(
    "site page main top bottom left right inner outer box block wrapper wrap container area section list item items bar unit slot text body title header "
    "link links button buttons icon icons post posts article articles user reader form group row col primary secondary global the".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: The words that tell furniture from a part of the text within an article, on elements other than running text.
STRONG = COMMENTS | ADVERTS | frozenset("newsletter subscribe share sharing social related recommended recommendations nav navbar breadcrumb breadcrumbs sidebar cookie cookies consent".split())
#: Elements that belong to running text: they stand in a box, and are none themselves.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption hgroup details summary center header address".split())
#: Start tags that end an open element of the same kind.
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[,.;:!?…、。，！？；،؛؟।]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HEADING = re.compile("h[1-6]")
#: Elements that no open sibling is sought beyond.
ENCLOSING = ("ul", "ol", "dl", "table", "body", "article")
_ENDS: dict[str, re.Pattern[str]] = {}
#: Width of the Gaussian that smooths path ratios along the page.
SIGMA = 1.0
#: Share of the page's greatest score that a content block's reaches.
THRESHOLD = 0.35
#: What an article, a main part or a box with a heading of first rank multiplies a score by.
RAISED = 8.0


@dataclass
class Block:
    """One run of text between block boundaries: its element, its text and how much of it lies in links."""

    node: int
    text: str
    linked: int


@dataclass
class Page:
    """Text blocks in page order, and the block elements: parent, tag, tag path, mark and whether it holds block elements. Element 0 is the page."""

    blocks: list[Block]
    parent: list[int]
    tag: list[str]
    path: list[int]
    mark: list[int]
    layout: list[bool]


#: Marks of an element: none, a class or id that names furniture, furniture by the standard.
PLAIN, CUED, FIXED = 0, 1, 2


def _is_cue(token: str) -> bool:
    """Whether a class or id names furniture: one of its words does, and no word says anything else."""
    words = [w.lower() for w in _WORD.findall(token)]
    return any(w in CUES for w in words) and all(w in CUES or w in BESIDE for w in words)


def _names_furniture(tag: str, name: str, value: str, within: bool) -> bool:
    """Whether a class or id marks an element.

    Heading generators make ids of any words: no heading is marked. Within an
    article fewer words count: for a section's id those of reader comments, for
    running text those of adverts, else STRONG.
    """
    if tag in ("html", "body", "article", "main") or _HEADING.fullmatch(tag):
        return False
    cues = [t for t in value.split() if _is_cue(t)]
    if not within:
        return bool(cues)
    telling = COMMENTS if name == "id" and tag == "section" else ADVERTS if tag in TEXTUAL else STRONG
    return any(w.lower() in telling for t in cues for w in _WORD.findall(t))


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)]


def _hides(attributes: list[tuple[str, str]]) -> bool:
    return any(k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and _HIDDEN.search(v.lower())) for k, v in attributes)


def _mark(tag: str, attributes: list[tuple[str, str]], in_article: bool, within: bool) -> int:
    """``in_article``: an article or main part has begun; ``within``: an article is open."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return FIXED
    if _hides(attributes):
        return FIXED
    mark = PLAIN
    for name, value in attributes:
        if name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
            return FIXED
        if name in ("class", "id") and _names_furniture(tag, name, value, within):
            mark = CUED
    return mark


def read_page(page: str) -> Page:
    """The page's text blocks and elements. A tag path tells elements by tag and first two classes, from the root down."""
    out = Page([], [-1], [""], [0], [PLAIN], [False])
    known: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = [("", 0)]
    places: dict[str, list[int]] = {}  # where the open elements of each tag lie in the stack, so that deep pages aren't searched level by level
    parts: list[str] = []
    linked, links, articles = 0, 0, 0
    mute, muted = "", 0  # the inline element whose text isn't shown, and how many of its kind are open since

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.blocks.append(Block(stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal articles
        flush()
        for tag, _ in stack[at:]:
            places[tag].pop()
            articles -= tag in ("article", "main")
        del stack[at:]

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def say(text: str) -> None:
        nonlocal linked
        if text and not muted:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag not in BLOCK:
            if muted:
                muted += (-1 if closing else 1) if tag == mute else 0
            elif not closing and tag not in VOID and not m[3].endswith("/") and (tag in UNSHOWN or (m[3] and _hides(_attributes(m[3])))):
                mute, muted = tag, 1
            continue
        muted = 0
        if closing:
            if opened := last((tag,)):
                close(opened)
            else:
                flush()
            links = 0 if tag in ("li", "p", "nav", "div", "ul", "article", "td") else links
            continue
        flush()
        if stack[-1][0] == "p" or _HEADING.fullmatch(stack[-1][0]) and _HEADING.fullmatch(tag):
            close(len(stack) - 1)
        if ends := SIBLING.get(tag):
            opened = last(ends)
            if opened > last(ENCLOSING):
                close(opened)
        above = stack[-1][1]
        attributes = _attributes(m[3]) if m[3] else []
        called = tag + "".join("." + w for k, v in attributes if k == "class" for w in v.split()[:2])
        path = known.setdefault((out.path[above], called), len(known) + 1)
        if tag not in ("table", "tr") and (cell := last(("td", "th"))) > last(("table",)):
            out.layout[stack[cell][1]] = True
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(out.tag)))
        out.parent.append(above)
        out.tag.append(tag)
        out.path.append(path)
        out.mark.append(_mark(tag, attributes, articles > 0, last(("article",)) > 0))
        # an unnamed section is part of the text around it; a table cell with block elements in it lays out the page
        out.layout.append(tag not in TEXTUAL and (tag != "section" or bool(attributes)))
        articles += tag in ("article", "main")
    flush()
    return out


def path_scores(group: np.ndarray, node: np.ndarray, parent: np.ndarray, size: np.ndarray, marks: np.ndarray, raised: np.ndarray | None = None) -> np.ndarray:
    """The score of each block: its tag path's, times RAISED where ``raised`` says so.

    group: each block's path; node and parent: its element and that element's
    parent; size and marks: its characters and punctuation outside links, in
    page order. A path's text ratio is the geometric mean of its text for each
    of its elements and for each of their parents, so that paragraphs which
    share a parent outweigh as many that have one each; its punctuation ratio
    is its marks for each element. Both are smoothed along the page, and the text
    ratio is fused with its smoothed form and multiplied by the punctuation's.
    The mean over a path's blocks is its score.
    """
    n = int(group.max()) + 1 if len(group) else 0
    elements = np.bincount(np.unique(np.stack([group, node]), axis=1)[0], minlength=n)
    parents = np.bincount(np.unique(np.stack([group, parent]), axis=1)[0], minlength=n)
    text = np.bincount(group, size, n)
    ratio = text / np.sqrt(np.maximum(elements * parents, 1))
    mark_ratio = np.bincount(group, marks, n) / np.maximum(elements, 1)
    own = ratio[group]
    fused = np.sqrt(own * _smooth(own)) * (1.0 + _smooth(mark_ratio[group]))
    score = (np.bincount(group, fused, n) / np.maximum(np.bincount(group, minlength=n), 1))[group]
    return score if raised is None else np.where(raised, RAISED, 1.0) * score


def chosen_blocks(score: np.ndarray) -> np.ndarray:
    """Blocks whose score reaches THRESHOLD of the page's greatest."""
    return (score >= THRESHOLD * score.max(initial=0.0)) & (score > 0)


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by blank lines.

    Blocks in furniture take no part: elements that are furniture by the
    standard, and those whose class or id names it. A mark counts for nothing on
    an element that holds most of the page's text, unless there is an article
    outside it. Of the other blocks, the tag paths whose scores reach the
    threshold are content; an article, a main part and a box with a heading of first rank around a
    block raise its score (RAISED), and choose nothing themselves. What the
    chosen blocks frame comes with them (``_with_context``), but no block longer
    than all chosen text: a wrong choice does not pull in the article around it.
    """
    if not page:
        return ""
    p = read_page(page)
    if not p.blocks:
        return ""
    own = np.array([b.node for b in p.blocks])
    length = np.array([len(b.text) for b in p.blocks], float)
    link = np.array([b.linked for b in p.blocks], float) / length
    size = length * (1 - link)
    inside = _marked(p, own, length, size)
    free = ~inside[own]
    if not free.any():
        if "article" in p.tag or "main" in p.tag:
            return ""
        free = np.array([p.mark[n] != FIXED for n in own])
        if not free.any():
            return ""
    at = np.flatnonzero(free)
    own, length, link, size = own[at], length[at], link[at], size[at]
    box, article, main = _places(p)
    if not size.any():  # an article of nothing but links is an article
        size = np.where(article[own] > 0, length, 0)
    path, parent = np.array(p.path)[own], np.array(p.parent)[own]
    _, group = np.unique(path, return_inverse=True)
    marks = np.array([len(_PUNCTUATION.findall(p.blocks[i].text)) for i in at.tolist()], float) * (1 - link)
    titled = {int(box[i]) for i in own.tolist() if p.tag[i] == "h1"}
    raised = (article[own] > 0) | main[own] | np.array([b in titled for b in box[own].tolist()])
    chosen = chosen_blocks(path_scores(group, own, parent, size, marks, raised))
    keep = _with_context([p.tag[i] for i in own], box[own], article[own], _link_lists(p, own, length, link), length, size, chosen)
    return "\n\n".join(p.blocks[i].text for i, k in zip(at.tolist(), keep) if k)


def _places(p: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each element: its box (itself or the nearest element around it that isn't running text), its article (0: none), and whether it lies in a main part."""
    n = len(p.tag)
    box, article, main = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(1, n):
        q = p.parent[i]
        box[i] = i if p.layout[i] else box[q]
        article[i] = i if p.tag[i] == "article" else article[q]
        main[i] = main[q] or p.tag[i] == "main"
    return box, article, main


def _link_lists(p: Page, own: np.ndarray, length: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Whether each block's outermost element of running text, within its box, is at least half links."""
    n = len(p.tag)
    outermost = np.zeros(n, np.int64)
    for i in range(1, n):
        q = p.parent[i]
        outermost[i] = i if p.layout[i] or q == 0 or p.layout[q] else outermost[q]
    outer = outermost[own]
    return (np.bincount(outer, length * link, n) >= 0.5 * np.bincount(outer, length, n))[outer]


def _with_context(tags: list[str], box: np.ndarray, article: np.ndarray, links: np.ndarray, length: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen blocks, and those that they frame and that are no longer than all chosen text.

    Where articles hold at least half of the chosen text, content lies in them:
    the rest of these articles is framed, and the last heading of first rank
    before the first chosen block. Elsewhere the boxes of chosen blocks are framed
    (lists of links only behind the first chosen block), and so is what lies from that heading to
    the first chosen block and, in elements of running text, on to the last,
    but for lists of links.
    """
    if not chosen.any():
        return chosen
    held = np.bincount(article, size * chosen)
    within = held[1:].sum() >= 0.5 * held.sum() and held[1:].any()
    if within:
        chosen = chosen & (held[article] > 0) & (article > 0)
    place = np.arange(len(tags))
    first, last = np.flatnonzero(chosen)[[0, -1]]
    heads = [j for j in range(first + 1) if tags[j] == "h1" and not links[j]]
    head = heads[-1] if heads else first
    if within:
        framed = ((article > 0) & (held[article] > 0)) | (place == head)
    else:
        textual = np.array([t in TEXTUAL for t in tags])
        framed = np.isin(box, box[chosen]) & (~links | (place > first))
        framed |= (place >= head) & (place <= last) & ~links & (textual | (place < first))
    return chosen | (framed & (length <= (length * chosen).sum()))


def _marked(p: Page, own: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each element lies in furniture, marks of wrappers set aside.

    Marked elements that hold most of the text lie in one another. From the
    outermost on, a mark is set aside while the unmarked text outside is little
    and no article's.
    """
    n = len(p.tag)
    under = np.bincount(own, size, n)
    for i in range(n - 1, 0, -1):
        under[p.parent[i]] += under[i]
    wrappers = [i for i in range(1, n) if p.mark[i] != PLAIN and under[i] > 0.5 * under[0]]
    within, article, marked = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)  # wrappers around, in an article, in another mark
    wraps = set(wrappers)
    for i in range(1, n):
        q = p.parent[i]
        within[i] = within[q] + (i in wraps)
        article[i] = article[q] or p.tag[i] in ("article", "h1")
        marked[i] = marked[q] or (p.mark[i] != PLAIN and i not in wraps)
    free = ~marked[own]
    outside = np.cumsum(np.bincount(within[own], size * free, len(wrappers) + 1))
    telling = np.array([not m and t == "article" for m, t in zip(marked.tolist(), p.tag)])
    telling[own] |= free & article[own]
    first = within[telling].min() if telling.any() else len(wrappers)
    aside = 0
    while aside < min(first, len(wrappers)) and outside[aside] < 0.1 * under[wrappers[aside]]:
        aside += 1
    return marked | (within > aside)


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the page."""
    r = max(1, math.ceil(2 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / SIGMA) ** 2)
    total = np.convolve(values, kernel, "full")[r : r + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel, "full")[r : r + len(values)]


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` but its markup, and ``text`` and ``n_chars`` (code points).

    The whole markup is read, however long and deeply nested; the work grows with its length.
    Null and empty pages, and pages without content, give an empty text; an
    empty table gives no rows. Each row is read by itself: equal rows give equal
    results. Broken markup is read as browsers do where it matters: paragraphs
    end at the next block, raw elements at their end tag or the end, and a
    quotation mark without its pair is a character like others. Names that
    clash get trailing underscores. Nothing is shuffled, so no host or template
    is a hot group.
    """
    rest = [c for c in pages.columns if c != html_col]
    n = len(rest)
    names = [fresh_name(pages.drop(html_col), x) for x in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(t) for t in b.column(n).to_pylist()]
            new = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *new], [*(f"c{i}" for i in range(n)), "t", "k"])

    given = pages.select(*[col_of(c).alias(f"c{i}") for i, c in enumerate(rest)], col_of(html_col).cast("string").alias("h"))
    fields = [T.StructField(f"c{i}", given.schema[i].dataType) for i in range(n)]
    out = given.mapInArrow(run, T.StructType([*fields, T.StructField("t", T.StringType()), T.StructField("k", T.LongType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("t").alias(names[0]), F.col("k").alias(names[1]))
