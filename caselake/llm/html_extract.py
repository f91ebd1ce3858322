"""Main text of web pages as the maximum-scoring contiguous run of a page's tokens.

A page is a sequence of tags and words. A word's weight is that of its place (the innermost element that holds text, or
a link) plus the lowest of what its elements are called: region tags (nav, footer, ...) and the words of their class,
id and role; a tag's weight is that of its name. Weights are log-odds of lying in the article, learned from pages that
mark it (`<article>`), over defaults for what those pages don't have; names only lower a score, they decide nothing by
themselves. One linear scan finds the run of the highest sum, and what lies outside it goes.

An element with a name that lowers its words, whose words have a sum below 0, is an insertion: a menu, form, advert or comment
in the middle. In a run its text is left out. Elements that pages use for their article (article, main, an article's
body by class, id or itemprop) with a sum above 0 besides insertions are held together: their tags and insertions weigh nothing, so that no
list, table or advert inside parts the run.

Blocks are what block-level tags separate; character references are decoded, white space in a block becomes one
space, `<br>` and cells are white space, empty blocks are dropped, blocks are joined by \\n.

Defined cases: null or empty html, or a page without a positive run, gives the empty string. Scripts, styles and
comments have no words. A tag or comment that the page ends in is dropped. An element left open ends where an element
around it does, or where `<main>`, `<article>` or `<body>` opens, if it is a region. Without a marked page the weights
are the defaults. Rows that repeat an id are extracted alike. A page is handled whole, whatever its length. Other
columns of the input are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

TRAIN_PAGES, SEEN = 2000, 20
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>\"']+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
_SPACE = frozenset("br td th img input".split())
_REGION = frozenset("nav header footer aside form menu dialog button select option label fieldset head title".split())
_RESET = ("article", "main", "body")
_CONTENT = frozenset("main articlebody article-body article-content article-text post-body post-content post-text entry-content entry-body story-body story-text".split())
#: What words of a place, a region or a name weigh where no page has taught it.
DEFAULT = {"w:p": 1.0, "w:h": 1.0, "w:blockquote": 1.0, "w:pre": 1.0, "w:li": 0.4, "w:td": 0.4, "w:div": 0.5, "w:a": -0.6} | {f"e:{t}": -4.0 for t in _REGION}
DEFAULT |= {f"n:{n}": -4.0 for n in (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent sidebar comment comments replies disqus newsletter subscribe "
    "popup modal overlay breadcrumb breadcrumbs pagination pager share sharing social related recommended nav navbar navigation menu footer masthead toolbar widget widgets login "
    "signup skip complementary contentinfo").split()}  # fmt: skip
DEFAULT |= {f"n:{n}": -1.5 for n in "header search form notice alert aside reply respond".split()}
_ROWS = frozenset(f"t:{c}{n}" for n in "ul ol li dl dt dd table thead tbody tfoot tr td th caption".split() for c in ("", "/"))


@dataclass
class Element:
    tag: str
    parent: int
    kinds: list[tuple[str, float]]  # its region and names, and the part of their weight that counts
    content: bool
    first: int  # its tokens
    last: int = -1
    depth: int = 0
    low: float = 0.0  # the lowest of its own kinds
    region: float = 0.0  # and of those around it
    total: float = 0.0
    net: float = 0.0  # total without insertions


@dataclass
class Page:
    """kind, text, element and whether it parts blocks, of each token; elements, the first being the page itself."""

    tokens: list[tuple[str, str, int, bool]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def name_kinds(attributes: str) -> list[tuple[str, float]]:
    """Each word of class, id and role, whole; or in parts, each for its share."""
    out = []
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [p for p in re.split(r"[-_]+", name) if p]
            whole = "".join(parts)
            out.append(("n:" + whole, 1.0))
            if len(parts) > 1:
                out += [("n:" + p, 1 / len(parts)) for p in parts]
    return out


def parse(text: str) -> Page:
    page = Page()
    tokens, elements = page.tokens, page.elements
    elements.append(Element("", -1, [], False, 0))
    stack, places, links, at = [0], [], 0, 0

    def words(piece: str) -> None:
        place = "a" if links else places[-1] if places else "body"
        tokens.append(("w:" + place, piece, stack[-1], False))

    def pop(keep: int) -> None:
        while len(stack) > keep:
            elements[stack.pop()].last = len(tokens)

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            words(text[at : m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            tokens.append(("t:raw", "", stack[-1], False))
            continue
        if m.group(2):
            if name == "a":
                links = 0
            tokens.append((f"t:/{name}", "", stack[-1], name in _BLOCK))
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].tag == name:
                    pop(k)
                    break
            if name in places or re.fullmatch("h[1-6]", name) and "h" in places:
                name = name if name in places else "h"
                while places.pop() != name:
                    pass
            continue
        if name in _RESET:
            links = 0
            for k in range(1, len(stack)):  # a region left open ends here
                if elements[stack[k]].tag in _REGION:
                    pop(k)
                    break
        closed = name in _VOID or m.group(4).rstrip().endswith("/")
        if not closed:
            if name == "a":
                links = 1
            if name == "p" and elements[stack[-1]].tag == "p":
                pop(len(stack) - 1)
                if places and places[-1] == "p":
                    places.pop()
            kinds = name_kinds(m.group(4)) if m.group(4) else []
            content = name in ("article", "main") or any(k[2:] in _WHOLE_CONTENT for k, share in kinds if share == 1)
            if name in _REGION:
                kinds.append(("e:" + name, 1.0))
            elements.append(Element(name, stack[-1], kinds, content, len(tokens)))
            stack.append(len(elements) - 1)
            if name in _BLOCK or name in _SPACE:
                places.append("h" if re.fullmatch("h[1-6]", name) else name)
        tokens.append(("t:" + name, " " if name in _SPACE else "", stack[-1], name in _BLOCK))
    if at < len(text):
        words(text[at:])
    pop(0)
    return page


_WHOLE_CONTENT = frozenset(n.replace("-", "") for n in _CONTENT)


def weight(weights: dict[str, float], kind: str) -> float:
    if kind in weights:
        return weights[kind]
    if kind[0] == "t":
        return -0.1 if kind in _ROWS else -0.5
    return DEFAULT.get(kind, 0.5 if kind[0] == "w" else 0.0)


def scores(page: Page, weights: dict[str, float]) -> list[float]:
    """The weight of each token (a text's is that of all its words); fills in the elements' sums of their words."""
    for e in page.elements:
        e.low = min((share * weight(weights, k) for k, share in e.kinds), default=0.0)
        e.region = min(e.low, page.elements[e.parent].region if e.parent >= 0 else 0.0, 0.0)
    out = []
    for kind, text, own, _ in page.tokens:
        w = weight(weights, kind)
        if kind[0] == "w":
            w = (w + page.elements[own].region) * len(text.split())
            page.elements[own].total += w
            page.elements[own].net += w
        out.append(w)
    for e in reversed(page.elements):
        if e.parent >= 0:
            page.elements[e.parent].total += e.total
    return out


def insertions(page: Page) -> list[bool]:
    """Of each element, whether it is one that its name and its sum tell apart, or lies in one; fills in what the others
    hold without these."""
    out = []
    for e in page.elements:
        out.append(e.parent >= 0 and out[e.parent] or e.low < 0 and e.total < 0)
    for e, left_out in zip(reversed(page.elements), reversed(out), strict=True):
        if e.parent >= 0 and not left_out:
            page.elements[e.parent].net += e.net
    return out


def held_together(page: Page, found: list[float], left_out: list[bool]) -> list[float]:
    """The weights as the scan sees them: what an article's own element holds can't be parted."""
    inside, out = [], list(found)
    for k, e in enumerate(page.elements):
        inside.append(e.parent >= 0 and inside[e.parent] or e.content and e.region >= 0 and e.net > 0)
    spans = [(e.first, e.last) for k, e in enumerate(page.elements) if inside[k]]
    if not spans:
        return out
    first, last = min(a for a, _ in spans), max(b for _, b in spans)
    for i in range(first, last):
        kind, text, own, _ = page.tokens[i]
        if left_out[own]:
            out[i] = 0.0
        elif inside[own]:
            out[i] = max(out[i], 0.1 * len(text.split())) if kind[0] == "w" else 0.0
    return out


def best_run(found: list[float]) -> tuple[int, int]:
    """The contiguous run of the highest sum, the first one and as short as can be; empty if no sum is above 0."""
    best = total = 0.0
    start, span = 0, (0, 0)
    for k, w in enumerate(found):
        total += w
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, span = total, (start, k + 1)
    return span


def extract(text: str | None, weights: dict[str, float]) -> str:
    page = parse(text or "")
    found = scores(page, weights)
    left_out = insertions(page)
    first, last = best_run(held_together(page, found, left_out))
    out, now = [], []
    for kind, piece, own, edge in page.tokens[first:last]:
        if edge:
            out.append("".join(now))
            now = []
        if not left_out[own]:
            now.append(html.unescape(piece) if kind[0] == "w" else piece)
    out.append("".join(now))
    return "\n".join(x for x in (" ".join(b.split()) for b in out) if x)


def counts(text: str) -> Counter:
    """(kind, in the article) -> words or tags, of a page that marks one article; else nothing."""
    page = parse(text)
    articles = [k for k, e in enumerate(page.elements) if e.tag == "article"]
    if len(articles) != 1:
        return Counter()
    seen, inside, kinds = Counter(), [], []
    for k, e in enumerate(page.elements):
        inside.append(k == articles[0] or e.parent >= 0 and inside[e.parent])
        kinds.append((kinds[e.parent] if e.parent >= 0 else set()) | {k for k, share in e.kinds if share == 1})
    for kind, piece, own, _ in page.tokens:
        if kind in ("t:article", "t:/article"):
            continue
        region = any(page.elements[x].tag in _REGION for x in chain(page, own)) if kind[0] == "t" else False
        n = len(piece.split()) if kind[0] == "w" else 1
        if not region:  # tags of menus say nothing about the same tags elsewhere
            seen[kind, inside[own]] += n
        if kind[0] == "w":
            for k in kinds[own]:
                seen[k, inside[own]] += n
    return seen


def chain(page: Page, own: int) -> Iterator[int]:
    while own >= 0:
        yield own
        own = page.elements[own].parent


def learn(pages: DataFrame, bound: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from at most `bound` pages, the first by hash of their url and id; kinds of fewer than SEEN words keep
    their defaults, so what comes back is bounded by the words of the sample."""
    keyed = pages.select("html", F.xxhash64("url", "page_id").alias("k")).where("html is not null")
    picked = keyed.select("k").orderBy("k").limit(bound).distinct()  # at most `bound` numbers
    chosen = keyed.join(F.broadcast(picked), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter()
            for t in b.column(0).to_pylist():
                seen.update(counts(t))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["kind", "inside", "n"])

    sums = map_arrow(chosen.select("html"), run, "kind string, inside boolean, n long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    out = {}
    for r in sums.where(F.col("a") + F.col("b") >= SEEN).collect():
        odds = math.log((r.a + 1) / (r.b + 1))
        low, high = (-4.0, 0.0) if r.kind[0] in "en" else (-1.0, -0.1) if r.kind[0] == "t" or r.kind == "w:a" else (0.2, 2.0)
        out[r.kind] = max(low, min(high, odds))
    return out


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(t, weights) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.selectExpr("cast(page_id as long) page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, learn(pages))
