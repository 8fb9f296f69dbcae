"""Main text of web pages by minimum cut.

A page is parted into text blocks.  A logistic regression gives each block the
log-odds of being content; they become capacities to the two terminals, and
neighbours in the page and in the DOM are joined by smoothness edges.  The
minimum cut then labels all blocks of a page at once.  The regression is fitted
on blocks whose HTML elements say what they are (article and main against nav,
footer, aside and the like) with those elements hidden from its features; the
elements, and telling class names, enter as a prior of their own: the nearest
telling element gives it, within the range of the classifier.  A telling element
that holds most text of its page is layout and tells nothing.

Text inside scripts, styles, heads, forms' controls, comments and markup is no
block.  Character references are decoded, white space inside a block becomes
one space, blocks are joined by a newline in page order.  A head left open ends
with the first text or element that cannot be in a head.

Defined results: a null or empty page has the empty text; elements left open
end with the page or with the next block of their kind; equal pages get equal
texts; very long pages are cut like others, nothing is dropped or capped; an empty
table gives no rows and zero weights; other columns pass through, but one that has the
name of the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, table

#: Pages that the block classifier is fitted on, at most, chosen by hash.
TRAIN_PAGES = 300

# elements by what they are, as the HTML standard has them
HIDDEN = frozenset("script style noscript template textarea title head svg math iframe object select option "
                   "datalist button canvas audio video".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
                  "section summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
#: What may stand in a head; all else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Log-odds range of the classifier, prior of a telling element, and the share
#: of a page's text from which on an element is layout.
RANGE, PRIOR, LAYOUT = 4.0, {"content": 2.0, "boilerplate": -3.5, "bad": -3.5, "good": 1.0}, 0.75
#: Elements that an open one of the same kind ends.
AGAIN = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WITH = re.compile(r"(?:^|(?<=[\s_-]))(?:has|have|no|with|without)[_-][^\s]*", re.I)     # what is around, not what it is
_BAD = re.compile(r"(?:^|[\s_-])(ads?|adverts?|advertisement|banners?|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|"
                  r"notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|sidebar|side-bar|"
                  r"widget|menu|nav|navbar|navigation|breadcrumbs?|footer|header|comments?|disqus|replies|login|"
                  r"complementary|contentinfo|search)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(article|content|post|entry|story|main|body-text|post-body|entry-content)(?:$|[\s_-])", re.I)


class _Node:
    """An element that parts blocks, by its place in the tree; the root has depth 0."""
    __slots__ = ("up", "depth", "tag")

    def __init__(self, up: _Node | None, tag: str):
        self.up, self.tag = up, tag
        self.depth = up.depth + 1 if up else 0


class _Tell:
    """A telling element: what it says, and the next one around it."""
    __slots__ = ("up", "kinds", "held", "known")

    def __init__(self, up: _Tell | None, kinds: tuple):
        self.up, self.kinds, self.held, self.known = up, kinds, 0, (0.0, -1)


@dataclass
class Block:
    text: str
    node: _Node            # the innermost block element around it
    prior: float           # what elements and names say: log-odds
    linked: float          # share of the characters inside links
    weak: int              # 1 content, 0 boilerplate, -1 unknown

    @property
    def tag(self) -> str:
        return self.node.tag


@dataclass(slots=True)
class _Open:
    tag: str
    tell: _Tell | None     # the innermost telling element
    hidden: bool


class _Page:
    """Open elements, counts of them by tag, and places of those that part blocks:
    every step takes time in proportion to the elements that it opens or ends."""

    def __init__(self):
        self.open: list[_Open] = []
        self.count: dict[str, int] = {}
        self.places: list[int] = []                        # of block elements in ``open``
        self.node = _Node(None, "")
        self.blocks: list[Block] = []
        self.told: list[_Tell | None] = []                 # of each block
        self.tells: list[_Tell] = []                       # outer ones first
        self.parts: list[str] = []
        self.chars = self.linked = 0

    def cut(self, k: int) -> None:
        """Ends the open elements from number k on."""
        for o in self.open[k:]:
            self.count[o.tag] -= 1
        while self.places and self.places[-1] >= k:
            self.places.pop()
            self.node = self.node.up
        del self.open[k:]

    def text(self, s: str) -> None:
        if self.open and self.open[-1].tag == "head" and s.strip():
            self.cut(len(self.open) - 1)
        if self.open and self.open[-1].hidden:
            return
        self.parts.append(s)
        n = len(s) - s.count(" ")
        self.chars += n
        if self.count.get("a"):
            self.linked += n

    def flush(self) -> None:
        s = " ".join(html.unescape("".join(self.parts)).split())
        if s:
            self.blocks.append(Block(s, self.node, 0.0, self.linked / max(self.chars, 1), -1))
            self.told.append(self.open[-1].tell if self.open else None)
        self.parts, self.chars, self.linked = [], 0, 0

    def begin(self, tag: str, attributes: str) -> None:
        if self.open and self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.open) - 1)
        if tag in BLOCK:
            self.flush()
            if tag != "p":
                self.end_open(("p",))
            if tag in AGAIN:
                self.end_open(AGAIN[tag].split())
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or attributes.endswith("/"):
            return
        up = self.open[-1] if self.open else _Open("", None, False)
        kinds = ("content",) if tag in CONTENT else ("boilerplate",) if tag in BOILERPLATE else \
            ("header",) if tag == "header" else ()
        names = " ".join(next(filter(None, m), "") for m in _NAMES.findall(attributes)) if "=" in attributes else ""
        if names and tag not in ("html", "body"):
            if _BAD.search(names := _WITH.sub("", names)):
                kinds += ("bad",)
            elif _GOOD.search(names):
                kinds += ("good",)
        tell = up.tell
        if kinds:
            tell = _Tell(tell, kinds)
            self.tells.append(tell)
        if tag in BLOCK:
            self.places.append(len(self.open))
            self.node = _Node(self.node, tag)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append(_Open(tag, tell, up.hidden or tag in HIDDEN))

    def judge(self) -> None:
        """Sets prior and weak label of each block by the elements around it."""
        for b, t in zip(self.blocks, self.told, strict=True):
            if t:
                t.held += len(b.text)
        for t in reversed(self.tells):
            if t.up:
                t.up.held += t.held
        layout = LAYOUT * sum(len(b.text) for b in self.blocks)
        for t in self.tells:
            prior, weak = t.up.known if t.up else (0.0, -1)
            wide, own, tell = t.held >= layout, 0.0, False
            for kind in t.kinds:
                if kind == "header":
                    if weak == 1:
                        continue
                    kind = "boilerplate"
                if wide and kind in ("boilerplate", "bad"):
                    continue
                own, tell = own + PRIOR[kind], True
                if kind == "content":
                    weak = 1 if weak != 0 else 0
                elif kind == "boilerplate":
                    weak = 0
                elif kind == "bad" and weak == 1:
                    weak = -1
            if tell:
                prior = min(max(own, PRIOR["bad"]), PRIOR["content"])
            t.known = (prior, weak)
        for b, t in zip(self.blocks, self.told, strict=True):
            if t:
                b.prior, b.weak = t.known

    def end_open(self, tags) -> None:
        """Ends the innermost open block element if it is one of ``tags``."""
        if self.places and self.open[self.places[-1]].tag in tags:
            self.cut(self.places[-1])

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.count.get(tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == tag:
                    self.cut(k)
                    return


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    out, at, low = _Page(), 0, None
    page = page or ""
    while m := _TAG.search(page, at):
        if m.start() > at:
            out.text(page[at:m.start()])
        at = m.end()
        if not (tag := (m[2] or "").lower()):
            continue
        if m[1]:
            out.end(tag)
            continue
        out.begin(tag, m[3])
        if tag in RAW and not m[3].endswith("/"):
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
    out.text(page[at:])
    out.flush()
    out.judge()
    return out.blocks


FEATURES = ("bias", "words", "long", "linked", "sentence", "capital", "p", "h", "li", "td", "place")


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; none of them tells article from nav."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        out[k] = (1, np.log1p(words), words >= 15, b.linked, b.text[-1] in ".!?…。\"”", b.text[0].isupper(),
                  b.tag in ("p", "blockquote", "pre"), b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "dd", "dt"),
                  b.tag in ("td", "th"), abs(2 * (k + 0.5) / n - 1))
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient steps; both classes weigh the same."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (each * (p - y)) + l2 * w)
    return w


def min_cut(unary: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True where a node stays with the content terminal.  Capacities: from the
    content terminal max(u, 0), to the other max(-u, 0), both ways along edges.
    Dinic's algorithm: breadth-first levels, then blocking flows."""
    n = len(unary)
    if (unary >= 0).all() or (unary < 0).all():
        return unary >= 0
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for k, u in enumerate(unary.tolist()):
        add(*((s, k) if u >= 0 else (k, t)), abs(u), 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for v in queue:
            for e in out[v]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([x >= 0 for x in level[:n]])
        turn = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if cap[e] > 1e-12 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            else:
                if v == s:
                    break
                e = path.pop()
                v = to[e ^ 1]
                turn[v] += 1
                continue
            path.append(e)
            v = to[e]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, stronger the more of their path
    they share, and between neighbours under one parent.  Looking for what two
    neighbours share passes the elements that end or begin between them only."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        depth = b.node.depth
        if k:
            x, y, deepest = blocks[k - 1].node, b.node, max(blocks[k - 1].node.depth, depth)
            most = min(x.depth, y.depth) - 1               # the blocks' own elements do not count
            while x is not y:
                if x.depth >= y.depth:
                    x, y = x.up, y if x.depth > y.depth else y.up
                else:
                    y = y.up
            out.append((k - 1, k, 0.2 + 0.8 * max(0, min(x.depth, most)) / max(deepest, 1)))
        parent = b.node.up if depth > 1 else None
        if last.get(parent, k - 1) != k - 1:
            out.append((last[parent], k, 0.5))
        last[parent] = k
    return out


def content(page: str | None, w: np.ndarray) -> str:
    """The main text of a page."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    unary = np.clip(features(blocks) @ w, -RANGE, RANGE) + np.array([b.prior for b in blocks])
    keep = min_cut(unary, smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep.tolist(), strict=True) if k)


def train(pages: DataFrame, limit: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the block classifier from at most ``limit`` pages, chosen by
    hash; the executors send numbers only."""
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            rows = []
            for page in b["html"]:
                blocks = blocks_of(page)
                rows += [(k.weak, list(x)) for k, x in zip(blocks, features(blocks), strict=True) if k.weak >= 0]
            yield pd.DataFrame(rows, columns=["y", "x"])

    chosen = first_by_hash(pages.select("page_id"), ["page_id"], limit)
    sample = pages.select("page_id", "html").join(F.broadcast(chosen.select("page_id").distinct()), "page_id", "left_semi")
    got = sample.select("html").mapInPandas(run, schema).toPandas()
    if got.empty:
        return np.zeros(len(FEATURES))
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def extract(pages: DataFrame, weights: np.ndarray, out: str = "text") -> DataFrame:
    """``pages`` with the main text of their html."""
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([content(p, weights) for p in b], dtype=object)

    return pages.withColumn(out, run("html"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
