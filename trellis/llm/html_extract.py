"""The main text of web pages, by minimum cut.

A page becomes a row of text blocks. A linear classifier gives each block the log odds of being content, from its words, links, punctuation,
neighbours and place, whose weights fit_weights() learns, and from what the elements around it are called, whose weights are stated; they become the capacities of its
edges to the terminals. Blocks that
follow each other and blocks that are close in the tree of elements are joined by smoothness edges, weaker across the border of a
region. The minimum cut of the whole page separates content from boilerplate: no name decides by itself, so
short lines among content stay and a layout word on a wrapper does not drop what it wraps. Only text of scripts, styles and forms is no part of the network.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

# Names of HTML elements and words of class names, by their role.
SKIPPED = frozenset("script style noscript template title textarea select option datalist iframe object embed svg math canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose tags a trailing slash closes.
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link".split())
#: Never text of a page, wherever they stand.
FORMS = frozenset("form button fieldset".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
#: Parts of class names, ids and roles of what is no content, wherever it stands.
HARD_WORDS = frozenset(
    "ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus respond replies reply cookie cookies consent gdpr "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations".split()
)
#: Parts that boilerplate has, and layout too.
SOFT_WORDS = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside widget notice notices notification alert popup modal overlay masthead topbar toolbar "
    "pagination pager search skip form copyright".split()
)
#: Names that begin so say what a wrapper has, not what it is.
STATE_WORDS = frozenset("has with without no is show hide js".split())
#: Elements whose class names speak of the whole page.
PAGE = frozenset("html body".split())
CONTENT_WORDS = frozenset("article content entry post story main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
#: What may stand in a page's head; anything else ends it.
HEAD_ONLY = frozenset("head title meta link base script style noscript template".split())
#: What a block's text and place say, without any name of an element: weights for use without labels; fit_weights() learns others.
TEXT_WEIGHTS = {"bias": -1.0, "word": 0.12, "linked": -3.0, "sentence": 0.8, "around": 0.0, "edge": 0.0}
#: Bounds of what they say together, so that no text outweighs a region that is surely no content.
TEXT_LEAST, TEXT_MOST = -4.0, 2.8
#: Pages whose blocks the weights are learned from, on average; never more than twice as many.
FIT_PAGES = 2_000
#: Weights of the region a block stands in, in log odds.
WEIGHTS = {"heading": 0.4, "elsewhere": -3.0, "share": 3.0}
MOST_WORDS = 25
ARTICLE_REGION, NAMED_REGION, HARD_REGION, SOFT_REGION, MIXED = 4.5, 1.5, -5.0, -3.5, -3.0
#: Smoothness between neighbours, and between blocks of one container; how much of it a step in the tree and a region's border leave.
NEIGHBOURS, SIBLINGS, STEP, BORDER = 1.0, 1.0, 0.5, 0.1
#: A start tag of the key closes an open element of the set, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """A piece of text between block boundaries."""

    __slots__ = ("chars", "container", "depth", "heading", "in_article", "linked", "region", "text")

    def __init__(self, text, container, depth, region, in_article, heading, linked):
        self.text, self.container, self.depth, self.region = text, container, depth, region
        self.in_article, self.heading, self.linked, self.chars = in_article, heading, linked, len(text)


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role name an element as boilerplate, as what may be it, and (in a name of its own) as content."""
    hard = soft = content = False
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = _PART.findall(_CAMEL.sub(" ", name).lower())
            if not parts or parts[0] in STATE_WORDS:
                continue
            own_hard, own_soft = not HARD_WORDS.isdisjoint(parts), not SOFT_WORDS.isdisjoint(parts)
            hard, soft = hard or own_hard, soft or own_soft
            content = content or not (own_hard or own_soft or CONTENT_WORDS.isdisjoint(parts))
    return hard, soft, content


def _region(name: str, attributes: str, around: float, in_article: bool) -> float:
    """What an element says for its blocks being content, in log odds, given what the elements around it say."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return HARD_REGION
    article = name in ARTICLE
    hard, soft, content = _named(attributes) if attributes and name not in PAGE else (False, False, False)
    here = around
    if article and around > HARD_REGION:
        here = ARTICLE_REGION
    elif content and HARD_REGION < around < NAMED_REGION:
        here = NAMED_REGION
    if hard:
        return here + MIXED if (article or content) and here > HARD_REGION else HARD_REGION
    if soft and not (article or content or name in HEADINGS or name == "header"):
        return min(here, SOFT_REGION)
    return here


class _Page:
    """Reads a page into blocks. Open elements are kept as tuples: name, container, depth, region, in article, heading, form."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.regions = [0.0]  # log odds by number
        self.stack = [("", 0, 0, 0, False, False, False)]
        self.open: dict[str, int] = {}  # how many of a name are open
        self.boxes = [0]  # places of the open elements that are no inline ones
        self.pieces: list[str] = []
        self.links = self.linked = 0
        self.containers = 1

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            _, container, depth, region, in_article, heading, form = self.stack[-1]
            if text and not form:
                self.blocks.append(Block(text, container, depth, region, in_article, heading, min(self.linked, len(text))))
        self.linked = 0

    def say(self, raw: str) -> None:
        if self.open.get("head") and not raw.isspace():
            self.close("head")
        text = html.unescape(raw)
        self.pieces.append(text)
        if self.links:
            self.linked += len(text)

    def pop(self, index: int) -> None:
        if self.boxes[-1] >= index:
            self.end_block()
        while len(self.stack) > index:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            self.links -= name == "a"
        while self.boxes[-1] >= index:
            self.boxes.pop()

    def close(self, name: str) -> None:
        if self.open.get(name):
            # all that is looked at here is closed
            self.pop(next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] == name))
        elif name not in INLINE:
            self.end_block()

    def begin(self, name: str, attributes: str) -> None:
        # a slash at the end of a tag closes nothing in HTML; it may be the end of an unquoted address
        if name in VOID:
            if name not in INLINE:
                self.end_block()
            return
        if name not in INLINE:
            self.end_block()
            # a new block element ends an open paragraph; some end their like
            top = self.stack[self.boxes[-1]][0]
            if top == "p" or top in CLOSES.get(name, ()) or (name in HEADINGS and top == name):
                self.pop(self.boxes[-1])
        _, container, depth, region, in_article, heading, form = self.stack[-1]
        if name == "a":
            self.links += 1
        if name not in INLINE:
            says = _region(name, attributes, self.regions[region], in_article)
            if says != self.regions[region]:
                region = len(self.regions)
                self.regions.append(says)
            in_article, heading, form = in_article or name in ARTICLE, name in HEADINGS, form or name in FORMS or name == "head"
            if name not in ("p", "li", "td", "th", "dt", "dd") and name not in HEADINGS:
                container, depth, self.containers = self.containers, depth + 1, self.containers + 1
            self.boxes.append(len(self.stack))
        self.stack.append((name, container, depth, region, in_article, heading, form))
        self.open[name] = self.open.get(name, 0) + 1

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                self.say(page[at:])
                break
            if m.start() > at:
                self.say(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, attributes = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                self.close(name)
                continue
            if self.open.get("head") and name not in HEAD_ONLY:
                self.close("head")
            if name in SKIPPED and name != "head":
                if name not in VOID and not (name in FOREIGN and attributes.endswith("/")):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else n
                continue
            self.begin(name, attributes)
        self.end_block()


def blocks_of(page: str) -> tuple[list[Block], list[float]]:
    """The text blocks of a page in order, white space folded, character references decoded, empty ones left out; what each region says."""
    reader = _Page()
    reader.read(page)
    return reader.blocks, reader.regions


def text_features(blocks: list[Block]) -> list[list[float]]:
    """For each block, in the order of TEXT_WEIGHTS after the bias: words, share of linked text, end of a sentence, words of the blocks beside it, distance from the middle of the page."""
    words = [min(b.text.count(" ") + 1, MOST_WORDS) for b in blocks]
    beside, last = [0, *words, 0], max(len(blocks) - 1, 1)
    return [
        [float(n), b.linked / b.chars, float(b.text[-1] in ".!?\"'”»…"), (beside[k] + beside[k + 2]) / 2, abs(2 * k / last - 1)]
        for k, (b, n) in enumerate(zip(blocks, words, strict=True))
    ]


def content_logits(blocks: list[Block], regions: list[float], text_weights: dict[str, float] = TEXT_WEIGHTS) -> list[float]:
    """The classifier: log odds that each block is content."""
    own = [b.chars - b.linked for b in blocks]
    whole, of_region = sum(own) or 1, [0] * len(regions)
    for b, n in zip(blocks, own, strict=True):
        of_region[b.region] += n
    article = any(b.in_article and regions[b.region] > HARD_REGION for b in blocks)
    w, (bias, *by_feature), out = WEIGHTS, text_weights.values(), []
    for b, features in zip(blocks, text_features(blocks), strict=True):
        says = regions[b.region]
        text = bias + sum(x * y for x, y in zip(by_feature, features, strict=True))
        z = min(max(text, TEXT_LEAST), TEXT_MOST) + says + w["heading"] * (b.heading and features[0] > 2)
        if article:
            z += w["elsewhere"] * (not b.in_article)
        elif says < 0:
            # what holds most of a page's text is named for its layout rather
            z += w["share"] * of_region[b.region] / whole
        out.append(z)
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, after a maximum flow (Dinic) over undirected `edges` and terminal capacities."""
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    if all(x >= 0 for x in excess) or all(x <= 0 for x in excess):
        return [x >= 0 for x in excess]
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(u: int, v: int, forward: float, backward: float) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(forward)
        out[v].append(len(to))
        to.append(u)
        room.append(backward)

    for i, x in enumerate(excess):
        if x > 0:
            link(s, i, x, 0.0)
        elif x < 0:
            link(i, t, -x, 0.0)
    for i, j, w in edges:
        link(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
            while following[u] < len(out[u]):
                e = out[u][following[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                following[u] += 1
            else:
                if not path:
                    break
                following[to[path[-1] ^ 1]] += 1
                u = to[path.pop() ^ 1]


def smoothness(blocks: list[Block], neighbours: float = NEIGHBOURS, siblings: float = SIBLINGS) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, less for each step in the tree between them, and between blocks of one container."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            a = blocks[k - 1]
            steps = 0 if a.container == b.container else max(1, abs(a.depth - b.depth))
            edges.append((k - 1, k, neighbours * STEP**steps * (1.0 if a.region == b.region else BORDER)))
        before = last.get(b.container)
        if before is not None:
            edges.append((before, k, siblings * (1.0 if blocks[before].region == b.region else BORDER)))
        last[b.container] = k
    return edges


def extract(page: str | None, neighbours: float = NEIGHBOURS, siblings: float = SIBLINGS, text_weights: dict[str, float] = TEXT_WEIGHTS) -> str:
    """The content blocks of a page, joined by one space."""
    blocks, regions = blocks_of(page or "")
    logits = content_logits(blocks, regions, text_weights)
    source = [max(z, 0.0) + math.log1p(math.exp(-abs(z))) for z in logits]
    sink = [x - z for x, z in zip(source, logits, strict=True)]
    kept = minimum_cut(source, sink, smoothness(blocks, neighbours, siblings))
    return " ".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and label of each block of pages that have an article: content is what stands in it, but for what its elements name otherwise."""
    for batch in batches:
        features, labels = [], []
        for page in batch.column("html").to_pylist():
            blocks, regions = blocks_of(page)
            inside = [b.in_article and regions[b.region] > 0 for b in blocks]
            if any(inside):
                features += text_features(blocks)
                labels += inside
        yield pa.record_batch([pa.array(features, pa.list_(pa.float64())), pa.array(map(float, labels), pa.float64())], names=["features", "label"])


def fit_weights(pages: DataFrame, most_pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights like TEXT_WEIGHTS by logistic regression over the blocks of a sample of distinct pages (html) that have an article. What elements
    are called gives the labels only and is no feature, so text, links and place carry the decision on pages that name nothing.

    The sample has `most_pages` pages on average and never over twice as many; it is chosen by the hash of the page, and copies count once. Null pages are
    no part of it; other columns are ignored. Where no page of it has both kinds of blocks, the weights are TEXT_WEIGHTS.
    """
    share = min(1.0, most_pages / max(1, pages.count()))
    dealt = F.xxhash64("html")
    chosen = pages.filter(F.col("html").isNotNull() & (F.pmod(dealt, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).groupBy(dealt.alias("page")).agg(F.min("html").alias("html"))
    blocks = in_batches(chosen.limit(2 * most_pages).select("html"), _labelled, "features array<double>, label double").cache()
    try:
        if blocks.select("label").distinct().count() < 2:
            return dict(TEXT_WEIGHTS)
        model = LogisticRegression(regParam=0.01, maxIter=50).fit(blocks.select(array_to_vector("features").alias("features"), "label"))
    finally:
        blocks.unpersist()
    return dict(zip(TEXT_WEIGHTS, [model.intercept, *model.coefficients.tolist()], strict=True))


def _extractor(text_weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, text_weights=text_weights) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame, text_weights: dict[str, float] = TEXT_WEIGHTS) -> DataFrame:
    """Columns page_id, url, text for `pages` (page_id, url, html): the main text of each page, one row per row.

    A null page, an empty one or one without content has the empty text; repeated rows stay; other columns are ignored; an empty
    table gives no rows. Pages are worked on one by one, so a task holds one batch.
    """
    rows = pages.select("page_id", "url", "html")
    types = dict(rows.dtypes)
    return in_batches(rows, _extractor(text_weights), f"page_id {types['page_id']}, url string, text string")
