"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A page is parsed into its block elements and text runs. Gradient-boosted trees give each
node log-odds of being part of the article or around it, from features such as tag,
attribute tokens, depth, text, link and punctuation density of the subtree, and its
share among siblings. Decoding then picks the most likely labelling in which a dropped
node's descendants are all dropped, so no part of a menu is kept on its own.

The trees learn from a bounded sample of pages. Labels come from landmarks that some
pages have (``article``, ``main``, ``nav``, ``footer`` and the like); half of the samples
are shown with these landmarks disguised, so that form and density must do as well, and
with further boilerplate put in, made from text of other pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from heapq import nlargest
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import ready, thinned

#: Pages the trees are fitted on, chosen by hash, and the longest that is chosen.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 100_000
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32
#: Pages whose nodes are scored together.
BATCH_PAGES = 200

TEXT = "#text"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "meter nobr picture progress q rp rt ruby s samp small source span strike strong sub sup "
    "time tt u var wbr math merror mfrac mi mn mo mover mpadded mroot mrow ms msqrt mstyle msub "
    "msubsup msup mtext munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show no text of the page, or only labels of controls.
HIDDEN = frozenset(
    "annotation audio button canvas datalist embed iframe map noscript object script select style "
    "svg template textarea title video".split())
RAW = frozenset("script style textarea title".split())
#: What can stand in a head; any other start tag ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript template".split()) | RAW
#: Start tags that end an open element of the named kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
GROUPS = ("p h1 h2 h3 h4 h5 h6 li ul ol dl dd table tr td div section article main body html nav "
          "header footer aside form blockquote pre figure figcaption details address " + TEXT).split()
BAD_TOKENS = (
    "ad ads adv advert advertisement banner sponsor sponsored promo nav navigation menu navbar "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share "
    "social comment comments reply replies disqus cookie cookies consent notice alert popup modal "
    "subscribe newsletter signup login search form copyright legal pager pagination tags meta "
    "toolbar skip hidden rail").split()
GOOD_TOKENS = "article main content post entry body story text page blog prose".split()
DROPPED_LANDMARKS = frozenset("nav header footer aside form".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']"""
    # A quoted value may hold < and >, if what follows its end can follow a value.
    r"""|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|"[^"<]*"|'[^'<]*'|["'])*)>?""", re.S)
#: End tags of raw elements; upper and lower case agree in ASCII only, as in HTML.
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/<>]|\Z)[^<>]*>?", re.I | re.A) for tag in RAW}
_TOKENS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…]")


class Node:
    """A block element, or a run of text between block elements."""

    __slots__ = ("tag", "tokens", "parent", "children", "parts", "linked", "chars", "links",
                 "words", "marks", "nodes", "runs")

    def __init__(self, tag: str, tokens: frozenset[str], parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.linked = 0

    @property
    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def _tokens(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = [x for m in _TOKENS.findall(attributes) for x in m if x]
    return frozenset(w for x in found for w in _WORD.findall(x.lower()))


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html", frozenset(), None)
        self.open: list[Node] = [self.root]
        self.in_link = 0

    def text(self, text: str) -> None:
        top = self.open[-1]
        if not top.children or top.children[-1].tag != TEXT:
            if not text.strip():
                return
            top.children.append(Node(TEXT, frozenset(), top))
        run = top.children[-1]
        run.parts.append(text)
        if self.in_link:
            run.linked += len(text)

    def start(self, tag: str, attributes: str) -> None:
        closes = CLOSES.get(tag)
        if closes and self.open[-1].tag in closes:
            self.open.pop()
            if tag == "tr" and self.open[-1].tag == "tr":
                self.open.pop()
        if self.open[-1].tag == "p":
            self.open.pop()
        self.in_link = 0
        if tag in ("html", "body") and len(self.open) <= 2 and any(x.tag == tag for x in self.open):
            return
        node = Node(tag, _tokens(attributes), self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                self.in_link = 0
                return


def _tags(html: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag.

    Comments, and raw elements with their text, have an empty name. Without an end tag,
    scripts and styles go to the end of the page, of others only the start tag is left out.
    """
    tags, at = [], 0
    endless: set[str] = set()
    while m := _TAG.search(html, at):
        start, at = m.span()
        tag, closing, attributes = (m.group(2) or "").lower(), bool(m.group(1)), m.group(3) or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                stop = None if tag in endless else _RAW_ENDS[tag].search(html, at)
                if stop:
                    at = stop.end()
                else:
                    endless.add(tag)
                    if tag in ("script", "style"):
                        at = len(html)
            tag = ""
        tags.append((start, at, tag, closing, attributes))
    return tags


def _hidden_ends(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Index of the end tag of each hidden element that ends before its parent does."""
    ends: dict[int, int] = {}
    waiting: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    for i, (_, _, tag, closing, attributes) in enumerate(tags):
        if not tag or tag in VOID or tag in INLINE:
            continue
        if not closing:
            if tag not in HIDDEN or not attributes.endswith("/"):
                waiting.append((tag, i))
                count[tag] += 1
        elif count[tag]:
            name = ""
            while name != tag:
                name, first = waiting.pop()
                count[name] -= 1
            if tag in HIDDEN:
                ends[first] = i
    return ends


def parse(html: str) -> Node:
    """Block elements and text runs of a page; hidden elements and comments are left out.

    A hidden element without an end of its own hides nothing: its text stays and is
    judged like any other. A head ends where something stands that can't be in it.
    """
    builder, at, i, in_head = _Builder(), 0, 0, False
    tags = _tags(html)
    ends = _hidden_ends(tags)
    while i < len(tags):
        start, end, tag, closing, attributes = tags[i]
        if start > at:
            in_head = in_head and not html[at:start].strip()
            if not in_head:
                builder.text(html[at:start])
        at = end
        i += 1
        if not tag:
            continue
        if tag == "head":
            in_head = not closing
            continue
        if in_head:
            if closing or tag in HEAD and tag not in HIDDEN:
                continue
            in_head = tag in HEAD
        if tag in HIDDEN:
            if not closing and i - 1 in ends:
                at, i = tags[ends[i - 1]][1], ends[i - 1] + 1
        elif tag == "br":
            builder.text(" ")
        elif tag in INLINE:
            if tag == "a":
                builder.in_link = 0 if closing else 1
        elif closing:
            builder.end(tag)
        else:
            builder.start(tag, attributes)
    if at < len(html):
        builder.text(html[at:])
    return builder.root


def _ordered(root: Node) -> list[Node]:
    """Nodes in page order."""
    nodes, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        nodes.append(node)
        waiting += reversed(node.children)
    return nodes


def _measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        if n.tag == TEXT:
            joined = "".join(n.parts)
            n.chars, n.links, n.nodes, n.runs = len(joined), n.linked, 1, 1
            n.words, n.marks = joined.count(" ") + 1, len(_PUNCTUATION.findall(joined))
        else:
            n.chars = n.links = n.words = n.marks = n.runs = 0
            n.nodes = 1
            for c in n.children:
                n.chars += c.chars
                n.links += c.links
                n.words += c.words
                n.marks += c.marks
                n.runs += c.runs
                n.nodes += c.nodes


_GROUP = {tag: i for i, tag in enumerate(GROUPS)}
_BAD = {t: i for i, t in enumerate(BAD_TOKENS)}
_GOOD = {t: i for i, t in enumerate(GOOD_TOKENS)}


def features(nodes: list[Node]) -> np.ndarray:
    """One row of numbers per node, of a whole page in page order."""
    _measure(nodes)
    total = nodes[0].chars or 1
    rows = np.zeros((len(nodes), 24 + 2 * len(GROUPS) + len(BAD_TOKENS) + len(GOOD_TOKENS)),
                    dtype=np.float32)
    depth: dict[int, int] = {}
    bad_above: dict[int, int] = {}
    largest: dict[int, list[int]] = {}  # sizes of a parent's two largest children
    for n in nodes:
        largest[id(n)] = nlargest(2, [c.chars for c in n.children]) + [0, 0]
    seen = 0
    for i, n in enumerate(nodes):
        up = n.parent
        d = depth[id(n)] = depth[id(up)] + 1 if up else 0
        bad = sum(t in _BAD for t in n.tokens) + (n.tag in DROPPED_LANDMARKS)
        above = bad_above[id(up)] if up else 0
        bad_above[id(n)] = above + bad
        chars = n.chars or 1
        siblings = len(up.children) if up else 1
        rows[i, :24] = (
            d, math.log1p(n.chars), math.log1p(n.words), n.links / chars, n.marks / chars,
            n.words / n.runs if n.runs else 0, n.chars / n.nodes, n.chars / total,
            n.chars / (up.chars or 1) if up else 1, siblings, math.log1p(n.nodes), n.runs / n.nodes,
            seen / total, (total - seen - n.chars) / total, len(n.children), bad,
            sum(t in _GOOD for t in n.tokens), above, len(n.tokens),
            up.links / (up.chars or 1) if up else 0, math.log1p(up.chars) if up else 0,
            up.marks / (up.chars or 1) if up else 0,
            largest[id(up)][n.chars == largest[id(up)][0]] / chars if up else 0,
            n.marks / (n.words or 1))
        at = 24
        if n.tag in _GROUP:
            rows[i, at + _GROUP[n.tag]] = 1
        at += len(GROUPS)
        if up and up.tag in _GROUP:
            rows[i, at + _GROUP[up.tag]] = 1
        at += len(GROUPS)
        for t in n.tokens:
            if t in _BAD:
                rows[i, at + _BAD[t]] = 1
            if t in _GOOD:
                rows[i, at + len(_BAD) + _GOOD[t]] = 1
        if n.tag == TEXT:
            seen += n.chars
    return rows


class Trees:
    """Gradient-boosted trees of fixed depth for log-odds, over binned features."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.splits: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[np.ndarray] = []

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, rows[:, j]) for j, e in enumerate(self.edges)]
                               ).astype(np.uint8)

    @staticmethod
    def _leaf(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
        return at - (2 ** DEPTH - 1)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        bins, total = self.binned(rows), np.full(len(rows), self.base)
        for (feature, cut), value in zip(self.splits, self.values):
            total += value[self._leaf(bins, feature, cut)]
        return total


def fit_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Trees for labels 0 and 1 by Newton steps on the logistic loss."""
    share = min(max(labels.mean(), 0.01), 0.99)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS)[1:-1]))
             for j in range(rows.shape[1])]
    # Rare indicators have all quantiles at 0; their split is above it.
    model = Trees(edges, math.log(share / (1 - share)))
    bins = model.binned(rows).astype(np.int64)
    odds = np.full(len(rows), model.base)
    inner = 2 ** DEPTH - 1
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-odds))
        slope, bend = labels - chance, chance * (1 - chance)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS)
        at = np.zeros(len(rows), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            gain_best = np.full(width, 1e-6)
            for j in range(rows.shape[1]):
                key = (at - first) * BINS + bins[:, j]
                g = np.bincount(key, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(key, bend, width * BINS).reshape(width, BINS).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g ** 2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all ** 2 / (h_all + 1)
                where = gain.argmax(axis=1)
                value = gain[np.arange(width), where]
                better = value > gain_best
                gain_best[better] = value[better]
                feature[first:first + width][better] = j
                cut[first:first + width][better] = where[better]
            at = 2 * at + 1 + (bins[np.arange(len(rows)), feature[at]] > cut[at])
        leaf = at - inner
        g = np.bincount(leaf, slope, inner + 1)
        h = np.bincount(leaf, bend, inner + 1)
        value = RATE * g / (h + 1)
        model.splits.append((feature, cut))
        model.values.append(value)
        odds += value[leaf]
    return model


def _landmark(node: Node) -> bool | None:
    """What a node's own tag or tokens say: article, boilerplate, or nothing."""
    if node.tag in DROPPED_LANDMARKS or node.tokens & frozenset(BAD_TOKENS):
        return False
    if node.tag in ("article", "main") or node.tokens & {"article", "main"}:
        return True
    return None


def landmark_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for nodes of the article or around it, by landmarks; None without an article."""
    state: dict[int, bool | None] = {}
    for n in nodes:
        above = state[id(n.parent)] if n.parent else None
        own = _landmark(n)
        state[id(n)] = above if above is False or own is None else own
    if not any(state[id(n)] for n in nodes):
        return None
    keep = {id(n) for n in nodes if state[id(n)]}
    for n in reversed(nodes):  # what stands around the article is kept, too
        if id(n) in keep and n.parent and state[id(n.parent)] is not False:
            keep.add(id(n.parent))
    return np.array([id(n) in keep for n in nodes], dtype=np.float64)


def _filler(tag: str, token: str, parent: Node, texts: list[str], random: np.random.Generator) -> Node:
    node = Node(tag, frozenset([token]) if token else frozenset(), parent)
    for _ in range(int(random.integers(1, 5))):
        part = Node(str(random.choice(["p", "li", "div"])), frozenset(), node)
        run = Node(TEXT, frozenset(), part)
        words = texts[int(random.integers(len(texts)))].split()[:int(random.integers(2, 25))]
        run.parts.append(" ".join(words))
        run.linked = len(run.parts[0]) if random.random() < 0.5 else 0
        part.children.append(run)
        node.children.append(part)
    return node


def _disguised(root: Node, nodes: list[Node], texts: list[str], random: np.random.Generator) -> None:
    """Rename landmarks and add boilerplate, to learn from more than one kind of page."""
    tokens = {"nav": "menu", "header": "masthead", "footer": "copyright", "aside": "sidebar",
              "form": "subscribe"}
    for n in nodes:
        if n.tag in tokens and random.random() < 0.6:
            n.tokens, n.tag = frozenset([tokens[n.tag]]), "div"
        elif n.tag in ("article", "main") and random.random() < 0.6:
            n.tag = str(random.choice(["div", "section", "main", "article"]))
            n.tokens = frozenset([str(random.choice(["content", "post", "story", "entry"]))])
    kinds = [("aside", ""), ("div", "sidebar"), ("div", "comments"), ("section", "comments"),
             ("div", "cookie"), ("div", "notice"), ("form", ""), ("header", ""), ("div", "related"),
             ("div", "banner"), ("div", "newsletter"), ("div", "share")]
    hosts = [n for n in nodes if n.tag in ("body", "div", "section", "article", "main", "html")
             and n.children] or [root]
    for _ in range(int(random.integers(1, 5))):
        host = hosts[int(random.integers(len(hosts)))]
        tag, token = kinds[int(random.integers(len(kinds)))]
        at = int(random.integers(len(host.children) + 1))
        host.children.insert(at, _filler(tag, token, host, texts, random))


def fit_extractor(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                  html_column: str = "html") -> Trees | None:
    """Trees learned from a bounded sample of the pages; None if no page has landmarks."""
    ready(pages.sparkSession)
    html = F.col(html_column)
    order = F.xxhash64(F.col(id_column).cast("string"), F.col(url_column))
    # Thinned out first, so that what the tasks send doesn't grow with their number.
    thin = thinned(pages.select(order.alias("h"), html.alias("html")), F.col("h"), SAMPLE_PAGES)
    sample = (thin.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
              .orderBy("h", "html").limit(SAMPLE_PAGES))
    random = np.random.default_rng(7)
    roots = [parse(r["html"]) for r in sample.collect()]
    texts = [n.parts[0] for root in roots for n in _ordered(root) if n.tag == TEXT and n.parts[0].split()]
    rows, labels = [], []
    for k, root in enumerate(roots):
        nodes = _ordered(root)
        label = landmark_labels(nodes)
        if label is None:
            continue
        if k % 2:  # labels stay those of the landmarks; what is put in is boilerplate
            known = dict(zip(map(id, nodes), label))
            _disguised(root, nodes, texts, random)
            nodes = _ordered(root)
            label = np.array([known.get(id(n), 0.0) for n in nodes])
        rows.append(features(nodes))
        labels.append(label)
    return fit_trees(np.vstack(rows), np.concatenate(labels)) if rows else None


def kept_nodes(nodes: list[Node], odds: np.ndarray) -> list[Node]:
    """Most likely labelling in which all descendants of a dropped node are dropped."""
    keep: dict[int, float] = {}
    drop: dict[int, float] = {}
    score = dict(zip(map(id, nodes), np.clip(odds, -6, 6).tolist()))
    for n in reversed(nodes):
        s = score[id(n)]
        drop[id(n)] = -s + sum(drop[id(c)] for c in n.children)
        keep[id(n)] = s + sum(max(keep[id(c)], drop[id(c)]) for c in n.children)
    kept, chosen = {id(nodes[0])}, [nodes[0]]
    for n in nodes[1:]:
        if id(n.parent) in kept and keep[id(n)] > drop[id(n)]:
            kept.add(id(n))
            chosen.append(n)
    return chosen


def main_texts(pages: list[str], trees: Trees | None) -> list[str]:
    """Main text of each page; without trees all text that is shown."""
    parsed = [_ordered(parse(html)) for html in pages]
    if trees is None:
        return [" ".join(t for n in nodes if n.tag == TEXT and (t := n.text)) for nodes in parsed]
    rows = [features(nodes) for nodes in parsed]
    odds = trees.log_odds(np.vstack(rows)) if rows else np.zeros(0)
    texts, at = [], 0
    for nodes in parsed:
        kept = kept_nodes(nodes, odds[at:at + len(nodes)])
        at += len(nodes)
        texts.append(" ".join(t for n in kept if n.tag == TEXT and (t := n.text)))
    return texts


def _extract(batches: Iterator[pa.RecordBatch], trees: Trees | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_PAGES):
            part = batch.slice(i, BATCH_PAGES)
            texts = main_texts([x.as_py() or "" for x in part.column("html")], trees)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, trees: Trees | None, id_column: str = "page_id",
                 url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: the id, the url, ``text`` and ``n_chars``, its number of code points.

    White space within a block becomes one space, blocks are joined by one, character
    references are decoded. A null, empty or textless page has an empty text. Repeated
    rows are all returned, other columns are left out, and an empty table gives an empty
    one. Each page is worked on alone, so nothing is shuffled.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"),
                        F.col(html_column).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(partial(_extract, trees=trees), f"id {kind}, url string, text string, n_chars long")
            .select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars"))
