"""Main text of web pages by minimum cut.

A page is a row of text blocks.  Each has two costs, of being called content and of being
called boilerplate, from a linear classifier on its tags, class names, links and words; they
are the capacities to the two terminals.  Blocks that follow each other, or hang on one parent,
are joined by edges that cost something if their labels differ.  The minimum cut, by maximum
flow, is the labelling of least total cost.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary
    table tbody td tfoot th thead tr ul""".split()
)
SILENT = frozenset("script style noscript template head title svg annotation annotation-xml iframe object canvas audio video textarea select datalist".split())
#: Any other tag, or text, ends an open head.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: A start tag of the first kind ends an open element of the second kinds, but not beyond the third.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("ul ol dl table menu body div article section".split())
OUTER = frozenset("nav footer aside form menu button dialog search header".split())
INNER = frozenset(("article", "main"))
BAD = frozenset(
    """ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert
    popup modal overlay sidebar aside widget menu navbar nav navigation breadcrumb breadcrumbs footer header masthead toolbar
    share sharing social comment comments disqus reply replies related recommended recommendations teaser newsletter subscribe
    subscription signup login search pagination pager tags taglist legal copyright disclaimer skip""".split()
)
GOOD = frozenset("article content entry post story main body text prose".split())
#: A class like `has-sidebar` tells about the page, not about the block.
ABOUT = frozenset("has with without no layout page wrapper container grid site app".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
PHRASES = re.compile(
    r"©|\(c\) \d{4}|all rights reserved|cookie|subscribe|newsletter|advertis|sign (?:up|in)|log ?in|privacy policy|terms of|share (?:this|on)|read more",
    re.I,
)
NEXT, SAME_PARENT = 0.6, 0.9  # costs of different labels


class _Open(NamedTuple):
    """An open element, and what its path from the root adds up to."""

    tag: str = ""
    score: float = 0.0  # evidence of the path
    inner: bool = False  # in an article
    block_tag: str = ""  # innermost block element
    block: int = 0  # its number
    above: int = 0  # that of the block element around it
    bad: bool = False  # in an element whose name tells of boilerplate
    outer: bool = False  # in an element that holds no articles


class _Block(NamedTuple):
    text: str
    links: int  # characters in links
    at: _Open


ROOT = _Open()


class _Page(HTMLParser):
    """Collects blocks.  What a block needs of its path is kept on the stack of open elements, so
    the time does not depend on the depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.silent = 0
        self.blocks: list[_Block] = []
        self.text: list[str] = []
        self.links, self.ids, self.has_inner = 0, 0, False

    def top(self) -> _Open:
        return self.open[-1] if self.open else ROOT

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(_Block(text, min(self.links, len(text)), self.top()))
        self.text.clear()
        self.links = 0

    def close_to(self, i: int) -> None:
        if any(e.tag in BLOCK for e in self.open[i:]):
            self.flush()
        for e in self.open[i:]:
            self.names[e.tag] -= 1
            self.silent -= e.tag in SILENT
        del self.open[i:]

    def end_head(self) -> None:
        if self.names["head"]:
            self.close_to(next(i for i, e in enumerate(self.open) if e.tag == "head"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or tag not in IN_HEAD and self.top().tag == "head":
            self.end_head()
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i].tag
                if name == "p" or name in CLOSES.get(tag, ()):
                    self.close_to(i)
                elif name in FENCE:
                    break
        if tag in VOID:
            return
        known = dict(attrs)
        words = frozenset(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{known.get('class') or ''} {known.get('id') or ''}").lower()))
        hidden = "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in (known.get("style") or "").replace(" ", "")
        around = self.top()
        if tag in INNER:  # comments may be articles too
            self.has_inner |= not words & BAD and not around.bad and not around.outer
        self.ids += 1
        score, inner = step(around.score, around.inner, tag, words, (known.get("role") or "").lower(), hidden)
        named = tag not in ("html", "body") and not words & ABOUT and bool(words & BAD)
        holder = (tag, self.ids, around.block) if tag in BLOCK else (around.block_tag, around.block, around.above)
        self.open.append(_Open(tag, score, inner, *holder, around.bad or named, around.outer or tag in OUTER))
        self.names[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.top().tag == tag and tag in SILENT:
            self.close_to(len(self.open) - 1)  # other elements stay open, as in browsers

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            i = len(self.open) - 1
            while self.open[i].tag != tag:
                i -= 1
            self.close_to(i)
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.top().tag == "head" and data.strip():
            self.end_head()
        if self.silent:
            return
        self.text.append(data)
        if self.names["a"]:
            self.links += len(data.strip())


def step(score: float, inner: bool, tag: str, words: frozenset, role: str, hidden: bool) -> tuple[float, bool]:
    """Evidence of a path, and whether it is in an article, with one more element."""
    if tag in ("html", "body"):
        return score, inner
    if tag in INNER or role in ("main", "article"):
        inner = True
        score += 4.0 if score >= 0 else 0.0
    # A header inside an article has the title of the article.
    if tag in OUTER and not (tag == "header" and inner) or role in ROLES or hidden:
        score -= 12.0
    elif words & BAD and not words & ABOUT and tag not in INNER:
        score -= 12.0
    elif words & BAD and tag in INNER and words & {"comment", "comments", "ad", "ads", "teaser", "related", "sponsored", "promo"}:
        score -= 16.0
    elif words & GOOD:
        score += 1.5
    return score, inner


def evidence(block: _Block, has_inner: bool) -> float:
    """Log odds that a block is content."""
    text, links, at = block
    score, inner = at.score, at.inner
    if has_inner and not inner:
        score -= 4.0
    n = len(text)
    score += min(2.5, max(-1.5, math.log(n / 40)))
    score -= 6.0 * max(0.0, links / n - 0.3)
    tag = at.block_tag
    score += {"p": 1.0, "li": -0.5, "td": -0.3, "th": -0.3}.get(tag, 0.5 if tag[:1] == "h" and tag[1:].isdigit() else 0.0)
    score += 0.5 * (text[-1] in ".!?…。")
    if n < 160 and not inner and PHRASES.search(text):
        score -= 3.0
    return score


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut between the source, joined to
    each node by its positive odds, and the sink, joined by the negative ones."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        join(source, i, x, 0.0) if x > 0 else join(i, sink, -x, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []  # edges from the source
        while True:
            a = to[path[-1]] if path else source
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                del path[cut:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    break
                at[a] += 1
            else:
                if not path:
                    break
                at[to[path.pop() ^ 1]] += 1


def smoothness(blocks: list[_Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between nearest blocks that hang on one parent."""
    edges = [(i, i + 1, NEXT) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if block.at.above in last:
            edges.append((last[block.at.above], i, SAME_PARENT))
        last[block.at.above] = i
    return edges


def main_text(html: str | None) -> str:
    """The blocks called content, in page order, one to a line."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    if not page.blocks:
        return ""
    odds = [evidence(b, page.has_inner) for b in page.blocks]
    keep = minimum_cut(odds, smoothness(page.blocks))
    return "\n".join(b.text for b, k in zip(page.blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages of boilerplate only, have an empty text; a null url stays
    null.  Pages of any length and depth are parsed whole, in time that grows with their
    length.  Repeated rows are all returned, extra columns
    are ignored, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
