"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks of text by its block-level tags. A linear classifier
looks at a block's own words, links and tag; its log odds for content become
the capacity of the block's edge to the source or to the sink. Its weights are
fitted to the blocks inside and outside `article` and `main` of a bounded sample
of pages, around prior weights, which alone hold where no page has these tags.

Smoothness edges join neighbouring blocks, stronger the nearer they stand in the
tree, blocks with the same parent, and each block with the nearest element
around it that says what it holds: such elements are nodes as well, seeds of the
one or the other side by their tag, class, id or role. The minimum cut, found by
a maximum flow, separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, column, pieces, with_columns

STEP = 4 << 20

# Quotes matter only after "=". A page is read up to its last ">", so that no tag is looked for in vain to the page's end.
TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*)>|[^>]*>)|[!?/][^>]*>)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNFINISHED = re.compile(r"<(?:[a-zA-Z/?]|!(?!--))[^<>]*\Z")

# Tags that part blocks, tags whose contents aren't text, and void tags.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea svg object iframe noframes title".split())
VOID = frozenset("hr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"p", "button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary", "figcaption"}
PARAGRAPHS = frozenset("p blockquote pre dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li td th dt option".split())

# Marks of boilerplate and of content in tags, and in classes, ids and roles. Weak words name sections of articles as well.
OFF_TAGS = frozenset("nav footer aside form menu dialog head button select fieldset".split())
ON_TAGS = frozenset("article main".split())
OFF_WORDS = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adv|adverts?|advertis\w+|ad(?:box|sense|banner|slot|unit|wrap|wrapper|container)s?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|notifications?|banner|"
    r"sidebar|sidenav|aside|widgets?|complementary|menus?|menubar|\w*nav|navbar|navigation|breadcrumbs?|footer|contentinfo|masthead|topbar|"
    r"\w*comments?|commentlist|repl(?:y|ies)|respond|disqus|share|sharing|popup|modal|overlay|dialog|header|"
    r"newsletter|subscribe|subscription|signup|signin|login|register|search|pager|pagination|toolbar|copyright|disclaimer|skip)(?=$|[\s_\-]|\d)",
    re.IGNORECASE,
)
WEAK_WORDS = re.compile(r"(?:^|[\s_\-])(?:privacy|side|foot|head|discussion|feedback|social|related|recommend\w*|form|legal|tags|meta)(?=$|[\s_\-]|\d)", re.IGNORECASE)
ON_WORDS = re.compile(r"(?:^|[\s_\-])(?:articles?|articlebody|post|entry|story|content|main|maintext)(?=$|[\s_\-]|\d)", re.IGNORECASE)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
LEGAL = re.compile(r"\xa9|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)
COMMENTS = re.compile(r"(?:\d+\s+|leave\s+a\s+|post\s+a\s+)?(?:reader\s+)?(?:comments?|repl(?:y|ies)|responses|kommentare?|commentaires?|comentarios?)(?:\s*\(\d+\))?\W*", re.IGNORECASE)

# The classifier's features, and prior weights in log odds.
PRIOR = {
    "any": -0.3,
    "under 4 words": -1.2, "4 to 9 words": -0.3, "10 to 24 words": 0.6, "25 words or more": 1.5,
    "ends a sentence": 0.8, "paragraph": 0.7, "heading": 0.5, "listed": -0.7, "bare": -0.2,
    "half linked": -2.5, "partly linked": -0.6, "legal line": -2.5,
}
BIT = {name: 1 << i for i, name in enumerate(PRIOR)}
SAMPLE = 2000  # pages that the classifier is fitted to
EFFECT = 100.0  # blocks that the sample counts as, at most, against the prior
VARIANCE = 0.25  # of the prior

# Capacities, in log odds.
SCALE = 32  # capacities are whole numbers of 1 / SCALE
SEED = 1 << 40
NEXT, SIBLING = 1.5, 0.5
IN_CONTENT, IN_BOILERPLATE, IN_WEAK, OUTSIDE, WEAK, HOLDS = 3.5, 7.0, 2.0, 4.0, -1.5, 6.0


def attributes(attrs: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes."""
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}


def mark(name: str, attrs: str) -> tuple[int, bool]:
    """1 if the element says that it holds content, -1 if boilerplate, 0 if it says nothing; and whether it says so weakly."""
    weak = False
    if len(attrs) > 3:
        own = attributes(attrs)
        if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or HIDING.search(own.get("style", "")):
            return -1, False
        if name not in ("html", "body"):
            keys = ("class", "role") if name in PARAGRAPHS or name in HEADINGS else ("class", "id", "role", "aria-label")  # a paragraph's id is an anchor
            for word in " ".join(own.get(k, "") for k in keys).split():  # "content with-sidebar" is content
                if OFF_WORDS.search(word):
                    return -1, False
                if ON_WORDS.search(word):
                    return 1, False
                weak = weak or bool(WEAK_WORDS.search(word))
    if name in OFF_TAGS or name in ON_TAGS:
        return (-1 if name in OFF_TAGS else 1), False
    return (-1 if weak else 0), weak


class Blocks:
    """The text blocks of a page, their features, and the graph of blocks and marked elements."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.features: list[int] = []
        self.inside: list[int] = []  # 1 within article or main, 0 outside, -1 in boilerplate within
        self.edges: list[tuple[int, int, float]] = []  # blocks by number, elements by -1 - number
        self.elements: list[float] = [0.0]  # evidence of marked elements; the first is the page
        self.kinds: list[str] = ["page"]
        self._last: dict[int, int] = {}
        self._depth = self._low = 0
        end = page.rfind(">") + 1
        self._parse(page[:end], UNFINISHED.sub("", page[end:]))
        if 1 in [round(e / SEED) for e in self.elements]:
            self.elements[0] = -SEED

    def _element(self, kind: str, evidence: float, within: int) -> int:
        self.elements.append(evidence)
        self.kinds.append(kind)
        if kind == "weak":
            self.edges.append((-1 - within, -len(self.elements), HOLDS))
        return len(self.elements) - 1

    def _parse(self, page: str, rest: str) -> None:
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, marked element around, number, within article or main
        numbers, parts, linked, in_link = 1, [], 0, 0
        at, skip_to, text_len = 0, 0, 0
        open_: dict[str, int] = {}

        def flush() -> None:
            nonlocal parts, linked, text_len
            if text_len:
                self._add("".join(parts), linked, stack)
            parts, linked, text_len = [], 0, 0

        def close(n: int) -> None:
            for tag, *_ in stack[n:]:
                open_[tag] -= 1
            del stack[n:]
            self._low = min(self._low, n)

        def text(raw: str) -> None:
            nonlocal text_len, linked
            parts.append(raw)
            if not raw.isspace():
                text_len += len(raw)
                linked += len(raw) if in_link else 0

        for m in TAG.finditer(page):
            start = m.start()
            if start < skip_to:
                continue
            if start > at:
                text(page[at:start])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                if name == "a":
                    in_link = 0
                elif name in BLOCK:
                    flush()
                    if open_.get(name):
                        close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
                continue
            if name in RAW:
                if name in BLOCK:
                    flush()
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = skip_to = shut.end() if shut else len(page)
                if not shut:
                    rest = ""
            elif name in BLOCK:
                flush()
                if name in VOID:
                    continue
                ends = SELF_CLOSING.get(name)
                if ends and stack[-1][0] in ends or name in ENDS_P and stack[-1][0] == "p":
                    close(len(stack) - 1)
                _, around, _, inside = stack[-1]
                own, weak = mark(name, m["attrs"])
                if name == "header" and not own and self.elements[around] <= 0:
                    own = -1  # outside content; within, it holds the title
                inside = 1 if name in ON_TAGS else -1 if own < 0 and not weak and inside else inside
                if own > 0:
                    around = self._element("on", SEED, around)
                elif own < 0:
                    around = self._element("weak", WEAK, around) if weak else self._element("off", -SEED, around)
                stack.append((name, around, numbers, inside))
                open_[name] = open_.get(name, 0) + 1
                numbers += 1
            elif name == "a":
                in_link = 1
            elif name == "br":
                parts.append(" ")
        if at < len(page) or rest:
            text(page[at:] + rest)
        flush()

    def _add(self, raw: str, linked: int, stack: list[tuple[str, int, int, int]]) -> None:
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if not text:
            return
        tag, around, number, inside = stack[-1]
        if tag in HEADINGS and COMMENTS.fullmatch(text):  # what follows under the same parent are comments
            around = self._element("off", -SEED, around)
            if len(stack) > 2:
                stack[-2] = (stack[-2][0], around, stack[-2][2], -1 if inside else 0)
            inside = -1 if inside else 0
        words = text.count(" ") + 1
        share = min(linked, len(raw)) / max(1, len(raw))
        bits = BIT["any"] | BIT["under 4 words" if words < 4 else "4 to 9 words" if words < 10 else "10 to 24 words" if words < 25 else "25 words or more"]
        bits |= BIT["paragraph" if tag in PARAGRAPHS else "heading" if tag in HEADINGS else "listed" if tag in LISTED else "bare"]
        if words >= 4 and text[-1] in ".!?:;\"'\u00bb\u201d)\u2026":
            bits |= BIT["ends a sentence"]
        if share >= 0.1:
            bits |= BIT["half linked" if share >= 0.5 else "partly linked"]
        if words < 25 and LEGAL.search(text):
            bits |= BIT["legal line"]
        block, depth = len(self.texts), len(stack) - 1
        parent = stack[-2][2] if len(stack) > 1 and (tag in PARAGRAPHS or tag in HEADINGS or tag in LISTED) else number
        if block:
            low = min(self._low, depth, self._depth)
            apart = self._depth + depth - 2 * low
            self.edges.append((block - 1, block, NEXT if apart <= 2 else 2 * NEXT / apart))
        if (j := self._last.get(parent)) is not None and j < block - 1:
            self.edges.append((j, block, SIBLING))
        kind = self.kinds[around]
        self.edges.append((block, -1 - around, {"page": OUTSIDE, "on": IN_CONTENT, "off": IN_BOILERPLATE, "weak": IN_WEAK}[kind]))
        self._last[parent], self._depth, self._low = block, depth, depth
        self.texts.append(text)
        self.features.append(bits)
        self.inside.append(inside)

    def graph(self, weights: list[float]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Evidence of blocks and, behind them, of marked elements; edges and their capacities."""
        n, odds = len(self.texts), {}
        for bits in set(self.features):
            odds[bits] = round(SCALE * sum(w for i, w in enumerate(weights) if bits >> i & 1))
        evidence = [odds[b] for b in self.features] + [int(e) if abs(e) >= SEED else round(SCALE * e) for e in self.elements]
        unmarked = self.elements[0] == 0  # then the page as a whole tells nothing
        place = lambda k: k if k >= 0 else n - 1 - k
        return evidence, [(place(a), place(b), round(SCALE * w)) for a, b, w in self.edges if not (unmarked and -1 in (a, b))]


def minimum_cut(evidence: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut.

    A node has an edge from the source (evidence > 0) or to the sink
    (evidence < 0) of that capacity. Nodes whose evidence outweighs all their
    edges are settled first, as no minimum cut needs them elsewhere; what they
    cost their neighbours is added there. The others go through Dinic's flow.
    Of equal cuts it is the one with the fewest nodes on the source's side,
    but for settled ones.
    """
    n, e = len(evidence), list(evidence)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        around[i][j] = around[i].get(j, 0) + w
        around[j][i] = around[j].get(i, 0) + w
    weight = [sum(a.values()) for a in around]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(e[i]) > weight[i]:
            side[i] = e[i] > 0
            for j, w in around[i].items():
                if side[j] is None:
                    e[j] += w if side[i] else -w
                    weight[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, on in zip(rest, _flow([e[i] for i in rest], rest, around, side), strict=True):
            side[i] = on
    return [bool(s) for s in side]


def _flow(e: list[int], nodes: list[int], around: list[dict[int, int]], side: list[bool | None]) -> list[bool]:
    """Dinic's maximum flow among unsettled nodes; the source's side of its residual graph."""
    place = {v: k for k, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    graph: list[list[list[int]]] = [[] for _ in range(len(nodes) + 2)]  # [to, capacity, index of the reverse]

    def join(a: int, b: int, there: int, back: int) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for k, v in enumerate(nodes):
        if e[k] > 0:
            join(source, k, e[k], 0)
        elif e[k] < 0:
            join(k, sink, -e[k], 0)
        for u, w in around[v].items():
            if side[u] is None and u > v:
                join(k, place[u], w, w)
    while True:
        level = [-1] * len(graph)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, cap, _ in graph[a]:
                if cap > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        turn = [0] * len(graph)
        path: list[tuple[int, int]] = []
        a = source
        while True:
            if a == sink:
                push = min(graph[v][k][1] for v, k in path)
                for v, k in path:
                    edge = graph[v][k]
                    edge[1] -= push
                    graph[edge[0]][edge[2]][1] += push
                cut = next(i for i, (v, k) in enumerate(path) if graph[v][k][1] == 0)
                a = path[cut][0]
                del path[cut:]
                continue
            while turn[a] < len(graph[a]):
                b, cap, _ = graph[a][turn[a]]
                if cap > 0 and level[b] == level[a] + 1:
                    path.append((a, turn[a]))
                    a = b
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                level[a] = -1
                a, k = path.pop()
                turn[a] = k + 1


def fit(counts: dict[tuple[int, int], int]) -> list[float]:
    """Weights of the features from numbers of blocks by (features, is content): most likely under a normal prior around PRIOR's."""
    prior = np.array(list(PRIOR.values()))
    if not counts:
        return prior.tolist()
    x = np.array([[bits >> i & 1 for i in range(len(prior))] for bits, _ in counts], float)
    y, c = np.array([label for _, label in counts], float), np.array(list(counts.values()), float)
    c *= min(1.0, EFFECT / c.sum())
    w = prior.copy()
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (c * (y - p)) - (w - prior) / VARIANCE
        w += np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / VARIANCE, slope)
    return w.round(6).tolist()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of blocks by features and label, of pages that have an article or main."""
    counts: dict[tuple[int, int], int] = {}
    for batch in batches:
        for page in batch.column(0):
            blocks = Blocks(page.as_py() or "")
            if 1 in blocks.inside:
                for bits, label in zip(blocks.features, blocks.inside, strict=True):
                    if label >= 0:
                        counts[bits, label] = counts.get((bits, label), 0) + 1
    cols = zip(*((bits, label, n) for (bits, label), n in counts.items()), strict=True) if counts else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["bits", "label", "n"])


def learn_blocks(df: DataFrame, html_col: str = "html", id_col: str = "page_id", pages: int = SAMPLE) -> list[float]:
    """The classifier's weights, fitted to about `pages` whole pages of `df`, chosen by the hash of their ids.

    Labels are the blocks inside and outside `article` and `main`; boilerplate
    inside teaches nothing, and neither do marks of elements: the classifier
    sees words, links and tags of blocks alone. Null pages have no blocks.
    """
    n = df.count()
    if not n:
        return list(PRIOR.values())
    draw = F.pmod(F.xxhash64(F.coalesce(column(df, id_col).cast("string"), F.lit("")), F.lit(7)), F.lit(1_000_000)) / 1e6
    sample = df.where(draw < min(1.0, pages / n)).select(column(df, html_col).cast("string").alias("html"))
    found = sample.mapInArrow(_labelled, "bits bigint, label bigint, n bigint").groupBy("bits", "label").agg(F.sum("n").alias("n"))
    return fit({(r["bits"], r["label"]): r["n"] for r in found.orderBy("bits", "label").collect()})  # 2 ** 14 rows at most


def label(blocks: Blocks, weights: list[float]) -> list[bool]:
    """Which blocks are content: those on the source's side of the minimum cut."""
    evidence, edges = blocks.graph(weights)
    return minimum_cut(evidence, edges)[: len(blocks.texts)]


def main_text(page: str | None, weights: list[float] | None = None) -> str:
    """The content blocks of a page, in order, joined by two line breaks."""
    if not page:
        return ""
    blocks = Blocks(page)
    return "\n\n".join(t for t, keep in zip(blocks.texts, label(blocks, weights or list(PRIOR.values())), strict=True) if keep)


def _extract(weights: list[float], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch, 0, STEP):
                part = batch.slice(a, b - a)
                yield with_columns(part, names, pa.array([main_text(x.as_py(), weights) for x in part.column(0)], pa.string()))

    return run


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out: str = "text", weights: list[float] | None = None) -> DataFrame:
    """The columns `keep` and `out`, the main text of the whole page.

    Character references are decoded, white space in a block is one space,
    blocks are trimmed and joined by two line breaks; nothing else is dropped
    or capped. A null or empty page, or one without content, gives an empty
    text. `weights` are the classifier's, from `learn_blocks`, or the prior's.
    No shuffle; repeated rows give repeated results. `out` gets leading
    underscores where `keep` has it.
    """
    narrow, schema = beside(df.withColumn(html_col, column(df, html_col).cast("string")), html_col, keep, (out, T.StringType()))
    return narrow.mapInArrow(_extract(weights or list(PRIOR.values()), schema.names), schema)
