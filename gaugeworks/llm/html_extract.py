"""Main text of a web page by minimum-cut labelling of its blocks.

A page is cut into text blocks at block-level tags. A logistic classifier gives each block
a cost for being content and one for being boilerplate, from the text itself and from what
its containers say (article, nav, footer ...; words in class and id). The costs are the
capacities to the two terminals; neighbouring blocks, and neighbours under one parent, are
joined by smoothness edges whose capacity falls with their distance in the document tree.
Maximum flow separates content from boilerplate, so a block that its own cost puts on one
side can be carried to the other by its neighbours. Only scripts, styles, forms and hidden
elements are left out beforehand.

The classifier is trained on a bounded sample of the pages themselves (TRAIN_PAGES, chosen
by a hash of the id, and TRAIN_BLOCKS blocks of each, evenly spaced) by co-training: blocks
whose containers are clear teach the weights of the text features, then blocks whose text
is clear teach those of the containers. Both start from stated weights, which count as much
as PRIOR_BLOCKS blocks.

Cutting and labelling take time in proportion to the page: distances come from the depth
of the open elements, blocks that no neighbours can carry over are settled first, and the
flow is pushed from all sources at once.

Defined results: a null or empty page, or one without content, gives an empty text;
markup may be unclosed or misnested; character references are decoded; white space
inside a block becomes one space; repeated rows give repeated results; an empty table
an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Bounds of the training sample: the expected number of pages, and blocks of each.
TRAIN_PAGES, TRAIN_BLOCKS = 2_000, 64
#: The blocks that the stated weights count for; a block is clear from this score on.
PRIOR_BLOCKS, CLEAR = 200.0, 1.0
#: Scores are cut to +-2 * MOST, so that neighbours can outweigh them; an edge between neighbours of tree distance d has SMOOTH / (1 + d).
MOST, SMOOTH = 2.0, 1.5

# HTML elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head title script style noscript template svg math object iframe canvas audio video select textarea button datalist option map".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
CONTENT = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:(?:ad|ads|adv|banner|footer|gdpr|login|menu|menubar|modal|nav|navbar|navigation|notice|notices|pager|popup|reply|replies|reaction|reactions|response|responses|share|sharing|signup|site-header|social|toolbar|topbar|tracking|widget|widgets)(?:$|[\s_-])"
    r"|(?:adbox|advert|breadcrumb|comment|consent|cookie|disclaimer|disqus|masthead|newsletter|pagination|promo|recommend|related|sidebar|sponsor|subscri))",
    re.I,
)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
GOOD_WORDS = re.compile(r"(?:^|[\s_-])(?:article|article-body|body-text|content|entry|entry-content|main|main-content|post|post-body|post-content|story|text)(?:$|[\s_-])", re.I)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())

# Words that stand in notices and page furniture.
STOCK = re.compile(r"©|\b(?:copyright|all rights reserved|cookies?|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in|advertisement|sponsored|share this|read more|related|leave a (?:comment|reply))\b", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|textarea|select|iframe|title|object|canvas|button)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^<>]*>|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
_END = re.compile(r"[.!?:;…]$")


#: What shows that a form wraps the page's text, rather than being one to fill in: an article in it, or so many paragraphs.
_ARTICLE, _PARAGRAPH, _FORM_END, PARAGRAPHS = re.compile(r"<(?:article|main)\b|\brole\s*=\s*[\"']?(?:main|article)\b", re.I), re.compile(r"<p[\s>]", re.I), re.compile(r"</form\b|\Z", re.I), 3


class _Forms:
    """Whether a form that opens at a place of the page wraps its text. Places are found once, so any number of forms takes time in proportion to the page."""

    def __init__(self, page: str) -> None:
        self.page, self.places = page, None

    def wraps(self, at: int) -> bool:
        if self.places is None:
            self.places = [[m.start() for m in p.finditer(self.page)] for p in (_ARTICLE, _PARAGRAPH, _FORM_END)]
        articles, paragraphs, ends = self.places
        end = ends[bisect_right(ends, at)] if ends[-1] > at else len(self.page)
        within = lambda found: bisect_right(found, end) - bisect_right(found, at)
        return within(articles) > 0 or within(paragraphs) >= PARAGRAPHS


class Marks(NamedTuple):
    """What the open elements say of the blocks in them, as 0 or 1."""

    good: int = 0  # article or main
    hint: int = 0  # a good word in class or id
    bad: int = 0  # nav, footer, aside, a header outside an article ...
    word: int = 0  # a bad word or role
    bad_in_good: int = 0  # the innermost of good and bad is bad
    good_in_bad: int = 0


class Block(NamedTuple):
    text: str
    element: int
    parent: int
    gap: int  # steps in the document tree from the block before
    marks: Marks
    linked: int  # characters inside links
    tag: str


class _Node(NamedTuple):
    tag: str
    block: int  # number of the nearest element that isn't inline, itself included, with its parent's, tag and depth
    parent: int
    name: str
    depth: int
    marks: Marks
    link: bool
    gone: bool


def _marked(tag: str, attrs: str, over: Marks) -> Marks | None:
    """The marks inside an element; None if nothing in it counts."""
    good, hint, bad, word = tag in CONTENT, False, tag in BOILERPLATE or tag == "header" and not over.good, False
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, a, b, c, hidden in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            value = (_HUMP.sub("-", value) if name in ("class", "id") else value).lower()
            if hidden or name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                return None
            if name == "role":
                word |= value in BAD_ROLES
                good |= value in ("main", "article")
            elif name in ("class", "id"):
                word |= bool(BAD_WORDS.search(value))
                hint |= bool(GOOD_WORDS.search(value))
    if not (good or hint or bad or word):
        return over
    worse = bad or word
    return Marks(
        int(good or over.good),
        int(hint or over.hint),
        int(bad or over.bad),
        int(word or over.word),
        int(worse and (over.good or over.hint) or over.bad_in_good and not good),
        int(good and not worse and (over.bad or over.word) or over.good_in_bad and not worse),
    )


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack = [_Node("", 0, 0, "", 0, Marks(), False, False)]
    open_: Counter = Counter()  # tags on the stack
    parts: list[str] = []
    linked, keys = 0, 0
    last, low = 0, 0  # depth of the last block, and the least since
    forms = _Forms(page)

    def close(i: int) -> None:
        nonlocal low
        for n in stack[i:]:
            open_[n.tag] -= 1
        del stack[i:]
        low = min(low, stack[-1].depth)

    def flush() -> None:
        nonlocal linked, last, low
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            n = stack[-1]
            if text and not n.gone:
                out.append(Block(text, n.block, n.parent, last + n.depth - 2 * low, n.marks, min(linked, len(text)), n.name))
                last = low = n.depth
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            whole = m[0]
            if m[1] is None and (whole[0] != "<" or whole == "<"):
                parts.append(whole)
                if stack[-1].link:
                    linked += len(whole.strip())
            continue
        tag = name.lower()
        if tag in ("html", "body"):
            continue
        if tag == "br":
            parts.append(" ")
            continue
        control = tag in ("label", "legend") and open_["form"] > 0
        inline = tag in INLINE and not control
        if not inline:
            flush()
        if m[2]:
            if open_[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                if not inline or all(n.tag in INLINE for n in stack[i:]):
                    close(i)
                else:  # a stray inline end tag doesn't close the blocks in between
                    open_[tag] -= 1
                    del stack[i]
            continue
        ends = _ENDS.get(tag, ("p",) if tag in CLOSES_P else ())
        if any(open_[e] for e in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        if tag in VOID or m[4].endswith("/") and inline:
            continue
        keys += 1
        top = stack[-1]
        # a form to fill in goes with all it holds; of one around the page's text its controls go alone
        gone = tag in NO_TEXT or tag == "form" and not forms.wraps(m.start()) or control
        marks = None if top.gone or gone else _marked(tag, m[4], top.marks)
        place = (top.block, top.parent, top.name, top.depth) if inline else (keys, top.block, tag, top.depth + 1)
        stack.append(_Node(tag, *place, marks or Marks(), tag == "a" or top.link, marks is None))
        open_[tag] += 1
    flush()
    return out


# What the start of an element ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def shallow(b: Block) -> tuple[float, ...]:
    """Text features of a block."""
    n = b.text.count(" ") + 1
    return (
        min(3.0, math.log1p(n) / 2),
        b.linked / len(b.text),
        1.0 if _END.search(b.text) else 0.0,
        min(1.0, sum(b.text.count(c) for c in ".,;:") / n),
        1.0 if b.tag in ("p", "blockquote", "pre") else 0.0,
        1.0 if b.tag in ("li", "td", "th", "dt", "dd") else 0.0,
        1.0 if b.tag[:1] == "h" and b.tag[1:].isdigit() else 0.0,
        1.0 if STOCK.search(b.text) else 0.0,
    )


class Weights(NamedTuple):
    text: tuple[float, ...]  # bias, then as in shallow()
    marks: tuple[float, ...]  # as in Marks


# The weights before any training.
UNTRAINED = Weights((-1.5, 1.5, -4.0, 1.0, 0.5, 1.0, -0.5, 1.0, -1.5), (3.0, 1.0, -3.0, -2.5, -3.0, 0.5))


def text_score(b: Block, w: Weights) -> float:
    return w.text[0] + sum(a * x for a, x in zip(w.text[1:], shallow(b), strict=True))


def mark_score(b: Block, w: Weights) -> float:
    return sum(a * x for a, x in zip(w.marks, b.marks, strict=True))


def capacities(b: Block, w: Weights) -> tuple[float, float]:
    """Costs of calling the block boilerplate and content: the capacities to the two terminals."""
    z = max(-MOST, min(MOST, (text_score(b, w) + mark_score(b, w)) / 2))
    return max(z, 0.0), max(-z, 0.0)


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with its follower, and with the next block under the same parent if that is another."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            out.append((i - 1, i, SMOOTH / (1 + b.gap)))
        j = last.get(b.parent)
        if j is not None and j < i - 1:
            out.append((j, i, SMOOTH / (1 if page[j].element == b.element else 3)))
        last[b.parent] = i
    return out


EPS = 1e-9


def settled(spare: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Nodes whose own capacity outweighs all their edges, and so on as their neighbours are settled: their side of every minimum cut.

    spare (source less sink capacity) and near are changed to what is left.
    """
    side: dict[int, bool] = {}
    total = [sum(x.values()) for x in near]
    queue = deque(range(len(spare)))
    while queue:
        u = queue.popleft()
        if u in side or abs(spare[u]) < total[u] - EPS:
            continue
        if abs(spare[u]) <= total[u] + EPS and spare[u] > 0:  # a tie may go either way
            continue
        side[u] = spare[u] > EPS
        for v, c in near[u].items():
            spare[v] += c if side[u] else -c
            total[v] -= c
            del near[v][u]
            queue.append(v)
        near[u] = {}
    return side


def min_cut(terminal: list[tuple[float, float]], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (ties go to the sink's side).

    The flow source-node-sink is pushed first. What is left goes in phases from all sources
    at once: levels by distance from any source, then a blocking flow along them.
    """
    n = len(terminal)
    spare = [s - t for s, t in terminal]
    cap: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        cap[i][j] = cap[i].get(j, 0.0) + c
        cap[j][i] = cap[j].get(i, 0.0) + c
    fixed = settled(spare, cap)
    rest = [u for u in range(n) if u not in fixed]

    def levels() -> dict[int, int]:
        level = {u: 0 for u in rest if spare[u] > EPS}
        queue = deque(level)
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > EPS and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    while True:
        level = levels()
        if not any(spare[u] < -EPS for u in level):
            break
        arcs = {u: iter(list(cap[u])) for u in level}
        for root in [u for u in level if level[u] == 0]:
            path = [root]
            while path and spare[root] > EPS:
                u = path[-1]
                if spare[u] < -EPS:
                    push = min(spare[root], -spare[u], *(cap[a][b] for a, b in zip(path, path[1:], strict=False)))
                    spare[root] -= push
                    spare[u] += push
                    for a, b in zip(path, path[1:], strict=False):
                        cap[a][b] -= push
                        cap[b][a] += push
                    # back to the first arc that is full now
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if cap[a][b] <= EPS), len(path) - 1)
                    if full < len(path) - 1:
                        del path[full + 1 :]
                    continue
                v = next((v for v in arcs[u] if cap[u][v] > EPS and level.get(v, -1) == level[u] + 1), None)
                if v is None:
                    path.pop()
                else:
                    path.append(v)
    return [fixed.get(u, u in level) for u in range(n)]


def labelled(page: list[Block], w: Weights) -> list[bool]:
    """Which blocks are content."""
    return min_cut([capacities(b, w) for b in page], edges(page))


def extract(page: str | None, w: Weights = UNTRAINED) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, labelled(found, w), strict=True) if keep)


def _taught(x: np.ndarray, y: np.ndarray, stated: tuple[float, ...]) -> tuple[float, ...]:
    """Logistic weights by Newton steps; the stated ones count for PRIOR_BLOCKS blocks, all rows together for as many."""
    w0 = np.array(stated)
    if not len(y) or y.min() == y.max():
        return stated
    w, each = w0.copy(), PRIOR_BLOCKS / len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = each * (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, each * x.T @ (y - p) - (w - w0))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(pages: DataFrame) -> Weights:
    """Classifier weights by co-training on a bounded sample of pages."""
    rows = pages.select("page_id", "html").where(F.col("html").isNotNull())
    share = min(1.0, TRAIN_PAGES / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    names = [f"x{i}" for i in range(len(UNTRAINED.text) - 1 + len(UNTRAINED.marks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "html"):
            got = []
            for page in s.column("html").to_pylist():
                found = blocks(page)
                step = max(1, -(-len(found) // TRAIN_BLOCKS))
                got += [(*shallow(b), *map(float, b.marks)) for b in found[::step]]
            cols = list(zip(*got, strict=True)) if got else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols], names=names)

    got = rows.mapInArrow(run, ", ".join(f"{n} double" for n in names)).toPandas().sort_values(names).to_numpy(np.float64)
    k = len(UNTRAINED.text) - 1
    text, marks = np.hstack([np.ones((len(got), 1)), got[:, :k]]), got[:, k:]
    said = marks @ np.array(UNTRAINED.marks)
    clear = np.abs(said) >= CLEAR
    by_text = _taught(text[clear], (said[clear] > 0).astype(np.float64), UNTRAINED.text)
    said = text @ np.array(by_text)
    clear = (np.abs(said) >= CLEAR) & marks.any(axis=1)
    return Weights(by_text, _taught(marks[clear], (said[clear] > 0).astype(np.float64), UNTRAINED.marks))


def main_text(pages: DataFrame, w: Weights) -> DataFrame:
    """page_id, url, text and its number of code points, a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "html"):
            texts = [extract(p, w) for p in s.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages))
