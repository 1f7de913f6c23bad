"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser (implied end tags, raw-text elements, excluded subtrees, cut-off pages) builds the tree of block
elements; runs of text between blocks are nodes of their own, and inline markup belongs to the
block around it. Each node has features: text and link lengths and density of its subtree, tags,
words of its id and class attributes (and of its ancestors'), depth, place among siblings and
their densities. Boosted trees in numpy, trained on generated labelled pages, give each node the probability that
it holds main text. Decoding takes the likeliest labelling in which no node is main under one that is not.

The text of the chosen nodes is given by block: character references decoded, white space turned
into one space, trimmed, blocks joined by two line ends.

Defined cases: a null or empty html, and a page without main text, give an empty text; text outside
of any tag is a block; every row gives one row, repeated rows alike; page_id and url may be null;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
# Fixed values of the language: elements without content, with raw text, and that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Elements whose subtrees hold no text of the page.
EXCLUDED = frozenset("noscript template iframe svg select optgroup option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag that ends an open element of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div section article main aside nav body header footer form".split())

#: Families of tags and of attribute words, each a feature.
TAG_FAMILIES = ["p blockquote pre", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer", "aside", "form fieldset", "ul ol li dl dt dd", "table tr td th tbody thead", "article", "main", "section", "div", "figure figcaption", "#text"]
WORD_FAMILIES = [
    "ad ads advert adverts advertisement sponsor sponsored promo banner", "nav navbar navigation menu breadcrumb breadcrumbs", "comment comments reply replies respond discussion disqus",
    "footer copyright legal", "header masthead topbar", "sidebar aside widget rail", "cookie consent notice alert popup modal gdpr message warning",
    "form search login signup subscribe newsletter", "share social related recommended tags pagination pager", "article content main post entry story body text",
]
#: Opening tags that end an excluded element left open: any block ends an image or a list of options; a part of the page ends a button.
BLOCKS = frozenset(t for f in TAG_FAMILIES for t in f.split()) - {"#text"}
PARTS = frozenset("article aside body footer form header main nav section table".split())
LISTS = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "button": {"button"}, "select": {"select", "optgroup", "option"}}
_TAG_OF = {t: k for k, f in enumerate(TAG_FAMILIES) for t in f.split()}
_WORD_OF = {w: k for k, f in enumerate(WORD_FAMILIES) for w in f.split()}


class Node:
    __slots__ = ("tag", "parent", "children", "text", "link", "words", "chars", "links", "tags", "depth")

    def __init__(self, tag: str, parent: Node | None, words: int = 0):
        self.tag, self.parent, self.words = tag, parent, words
        self.children: list[Node] = []
        self.text: list[str] = []  # of a #text node: pieces in order
        self.link = 0  # characters within links
        self.chars = self.links = 0
        self.tags = 1
        self.depth = parent.depth + 1 if parent else 0


def attribute_words(attributes: str) -> int:
    """Bits of the families of words in class, id and role."""
    bits = 0
    for a, b, c in ATTRIBUTE.findall(attributes):
        for word in TOKEN.findall((a or b or c).lower()):
            if word in _WORD_OF:
                bits |= 1 << _WORD_OF[word]
    return bits


def ends_excluded(open_tags: list[str], tag: str) -> bool:
    """Whether an opening tag stands after the excluded element (the first of its open tags), which was not closed."""
    outer = open_tags[0]
    if outer == "svg":
        return tag in BLOCKS and "foreignobject" not in open_tags
    if outer == "button":
        return tag in PARTS or (tag in CLOSES and SCOPE.isdisjoint(open_tags))
    return outer in LISTS and tag in BLOCKS


def parse(page: str) -> list[Node]:
    """The nodes in page order, the root first. Inline elements are part of the text around them, and excluded ones leave nothing."""
    root = Node("#root", None)
    nodes, here, run, in_link, at = [root], root, None, 0, 0
    out_of: list[str] = []  # the open tags of an excluded subtree

    def put(text: str) -> None:
        nonlocal run
        if out_of:
            return
        if run is None:
            if not text.strip():
                return
            run = Node("#text", here)
            here.children.append(run)
            nodes.append(run)
        run.text.append(text)
        if in_link:
            run.link += len(text)

    while True:
        m = TAG.search(page, at)
        if m is None:
            put(unescape(page[at:]))
            break
        if m.start() > at:
            put(unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if out_of and m[1]:
            if tag in out_of:
                del out_of[len(out_of) - 1 - out_of[::-1].index(tag) :]
                continue
            node = here
            while node.parent and node.tag != tag and not (tag == "p" and node.tag in SCOPE):
                node = node.parent
            if tag in INLINE or tag in EXCLUDED or node.tag != tag:
                in_link = 0 if tag == "a" else in_link
                continue
            out_of.clear()  # the end of an element around it
        elif out_of:
            if ends_excluded(out_of, tag):
                out_of.clear()
            else:
                while out_of and out_of[-1] in LISTS.get(tag, ()):
                    out_of.pop()
                if tag not in VOID and not m[3].rstrip().endswith("/"):
                    out_of.append(tag)
                continue
        elif tag in EXCLUDED:
            if not m[1] and not m[3].rstrip().endswith("/"):
                out_of.append(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            elif tag == "br":
                put(" ")
            continue
        run, in_link = None, 0
        if m[1]:
            node = here
            while node.parent and node.tag != tag and not (tag == "p" and node.tag in SCOPE):
                node = node.parent
            if node.parent and node.tag == tag:
                here = node.parent
            continue
        if here.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):  # a block ends an open paragraph
            here = here.parent
        if tag in CLOSES:
            node = here
            while node.parent and node.tag not in SCOPE and node.tag not in CLOSES[tag]:
                node = node.parent
            if node.tag in CLOSES[tag]:
                here = node.parent
        if tag in VOID:
            continue
        node = Node(tag, here, attribute_words(m[3]))
        here.children.append(node)
        nodes.append(node)
        if not m[3].rstrip().endswith("/"):
            here = node
    for node in reversed(nodes):
        if node.tag == "#text":
            node.chars = sum(map(len, node.text))
            node.links = node.link
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags
    return nodes


def node_features(nodes: list[Node]) -> list[list[float]]:
    """A row for each node, in the order of ``nodes``."""
    total = max(1, nodes[0].chars)
    above: dict[int, tuple[int, int]] = {}
    out = []
    place = {id(c): k for n in nodes for k, c in enumerate(n.children)}
    for n in nodes:
        words_above, tags_above = above.get(id(n.parent), (0, 0)) if n.parent else (0, 0)
        kind = _TAG_OF.get(n.tag, -1)
        above[id(n)] = (words_above | n.words, tags_above | (1 << kind if kind >= 0 else 0))
        siblings = n.parent.children if n.parent else [n]
        k = place.get(id(n), 0)
        before = siblings[k - 1] if k else None
        after = siblings[k + 1] if k + 1 < len(siblings) else None
        up = n.parent or n
        row = [
            n.chars, n.links / (n.chars + 1), n.chars / n.tags, n.tags, n.depth, n.chars / total, n.chars / (up.chars + 1),
            k, len(siblings), k / len(siblings), len(n.children),
            before.chars / before.tags if before else -1, before.links / (before.chars + 1) if before else -1,
            after.chars / after.tags if after else -1, after.links / (after.chars + 1) if after else -1,
            up.links / (up.chars + 1), kind,
        ]
        row += [(n.words >> b & 1) + 0.0 for b in range(len(WORD_FAMILIES))]
        row += [(words_above >> b & 1) + 0.0 for b in range(len(WORD_FAMILIES))]
        row += [(tags_above >> b & 1) + 0.0 for b in range(len(TAG_FAMILIES))]
        row += [float(kind == b) for b in range(len(TAG_FAMILIES))]
        out.append(row)
    return out


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss, as arrays."""

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.25, bins: int = 24, leaf: float = 8.0):
        self.depth, self.rounds, self.rate, self.bins, self.leaf = depth, rounds, rate, bins, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        width = self.bins + 1
        self.start = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
        score = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), np.int32)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.value = np.zeros((self.rounds, 2**self.depth))
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                split = [(0, len(cuts[0]))] * many
                base = (node - first) * width
                for j in range(len(cuts)):
                    if not len(cuts[j]):
                        continue
                    gs = np.bincount(base + binned[j], g, many * width).reshape(many, width).cumsum(1)
                    hs = np.bincount(base + binned[j], h, many * width).reshape(many, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.leaf / 10) | (ht - hs < self.leaf / 10)] = 0
                    gain = gain[:, : len(cuts[j])]
                    k = gain.argmax(1)
                    better = gain[np.arange(many), k] > best
                    best = np.where(better, gain[np.arange(many), k], best)
                    for i in np.flatnonzero(better):
                        split[i] = (j, int(k[i]))
                go = np.zeros(len(y), bool)
                for i, (j, k) in enumerate(split):
                    self.feature[r, first + i] = j
                    if best[i] > 1e-6:
                        self.cut[r, first + i] = cuts[j][k]
                        mine = node == first + i
                        go[mine] = binned[j][mine] > k
                node = 2 * node + 1 + go
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            self.value[r] = self.rate * gs / (hs + 1)
            score += self.value[r][leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = 2**self.depth - 1
        for r in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[r, node]] > self.cut[r, node])
            score += self.value[r][node - inner]
        return score


def sample_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A generated page and, for each of its text runs in order, whether it is main text."""
    out: list[str] = []
    truth: list[bool] = []
    syllables = "an en the of re ou th ti al in sch que mo la do er st ca ne vi".split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    def leaf(tag: str, n: int, main: bool, link: bool = False) -> None:
        text = words(max(1, n))
        if link:
            text = f'<a href="/x">{text}</a>'
        elif main and rng.random() < 0.2:
            text = f"<b>{text}</b> {words(3)}" if rng.random() < 0.5 else f'{text} <a href="/y">{words(2)}</a> {words(4)}'
        out.append(f"<{tag}>{text}</{tag}>")
        truth.append(main)

    def attr(names: str) -> str:
        kind = rng.choice(("class", "id", "class"))
        return f' {kind}="{rng.choice(names.split())}{rng.choice(("", "-box", "-1", " wrap"))}"'

    def links(tag: str, n: int, names: str) -> None:
        out.append(f"<{tag}{attr(names) if rng.random() < 0.6 or tag == 'div' else ''}><ul>")
        for _ in range(n):
            leaf("li", rng.randint(1, 3), False, True)
        out.append(f"</ul></{tag}>")

    def noise(tag: str, names: str, low: int, high: int, parts: int = 1) -> None:
        out.append(f"<{tag}{attr(names)}>")
        if parts == 1 and rng.random() < 0.5:
            out.append(words(rng.randint(low, high)))
            truth.append(False)
        else:
            for _ in range(parts):
                leaf(rng.choice(("p", "div")), rng.randint(low, high), False)
        out.append(f"</{tag}>")

    def maybe(p: float, f, *a) -> None:
        if rng.random() < p:
            f(*a)

    def article() -> None:
        tag = rng.choice(("article", "article", "main", "div", "section"))
        names = "article content main post entry story" if rng.random() < 0.8 else "c1 box col x9 wrapper"
        out.append(f"<{tag}{attr(names) if tag == 'div' or rng.random() < 0.4 else ''}>")
        maybe(0.8, leaf, rng.choice(("h1", "h2")), rng.randint(1, 12), True)
        n, paragraph = rng.choice((1, 2, 4, 8, 15)), "div" if tag in ("div", "section") and rng.random() < 0.3 else "p"
        for k in range(n):
            kind = rng.random()
            if kind < 0.75:
                leaf(paragraph, rng.choice((1, 2, 5, 12, 40, 90, 150)), True)
            elif kind < 0.82:
                leaf(rng.choice(("h2", "h3")), rng.randint(1, 6), True)
            elif kind < 0.88:
                out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    leaf("li", rng.randint(2, 20), True)
                out.append("</ul>")
            elif kind < 0.93:
                leaf("blockquote", rng.randint(5, 60), True)
            elif kind < 0.98:
                noise("div", WORD_FAMILIES[0] + " related share", 3, 25)
            else:
                noise("form", "form subscribe newsletter login search", 2, 15, rng.randint(1, 2))
        maybe(0.15, noise, "section", "comments comment discussion", 5, 60, rng.randint(1, 5))
        maybe(0.1, noise, "aside", "sidebar related widget", 3, 30)
        out.append(f"</{tag}>")

    out.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
    maybe(0.3, noise, "div", WORD_FAMILIES[6], 5, 40)
    if rng.random() < 0.6:
        out.append(f"<header{attr('header masthead topbar') if rng.random() < 0.5 else ''}>")
        leaf(rng.choice(("p", "h1", "div")), rng.randint(1, 8), False)
        maybe(0.5, links, "nav", rng.randint(2, 8), "nav menu")
        out.append("</header>")
    maybe(0.7, links, rng.choice(("nav", "div")), rng.randint(2, 12), "nav navbar menu navigation")
    maybe(0.4, noise, "div", WORD_FAMILIES[0], 2, 30)
    wrapped = rng.random() < 0.5
    out.append("<div>" if wrapped else "")
    maybe(0.2, noise, rng.choice(("aside", "div")), "sidebar widget rail aside", 3, 40, 2)
    article()
    maybe(0.3, noise, rng.choice(("aside", "div")), "sidebar widget rail aside", 3, 40, 2)
    maybe(0.35, noise, rng.choice(("section", "div")), "comments comment replies discussion", 3, 70, rng.randint(1, 6))
    maybe(0.2, links, "div", rng.randint(2, 6), "related recommended share social")
    out.append("</div>" if wrapped else "")
    maybe(0.25, noise, "form", "form subscribe newsletter login search", 2, 15, rng.randint(1, 2))
    maybe(0.2, noise, "div", WORD_FAMILIES[6], 5, 40)
    maybe(0.8, noise, rng.choice(("footer", "footer", "div")), "footer copyright legal", 3, 30)
    out.append("</body></html>" if rng.random() < 0.9 else "")
    return "".join(out), truth


@lru_cache
def model(pages: int = 700, seed: int = 5) -> Trees:
    """Trees trained on generated pages: a node is main if its subtree holds main text."""
    rng = random.Random(seed)
    rows, marks = [], []
    for _ in range(pages):
        page, truth = sample_page(rng)
        nodes = parse(page)
        main = {id(n): m for n, m in zip((n for n in nodes if n.tag == "#text"), truth, strict=True)}
        for n in reversed(nodes):
            main[id(n)] = main.get(id(n), False) or any(main[id(c)] for c in n.children)
        rows += node_features(nodes)
        marks += [main[id(n)] for n in nodes]
    return Trees().fit(np.array(rows, float), np.array(marks, float))


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """Ids of the main nodes: the likeliest labels with no main node under one that is not."""
    yes = dict(zip(map(id, nodes), -np.logaddexp(0, -odds), strict=True))
    no = dict(zip(map(id, nodes), -np.logaddexp(0, odds), strict=True))
    for n in reversed(nodes):
        for c in n.children:
            yes[id(n)] += max(yes[id(c)], no[id(c)])
            no[id(n)] += no[id(c)]
    chosen: set[int] = set()
    for n in nodes:
        if (n.parent is None or id(n.parent) in chosen) and yes[id(n)] > no[id(n)]:
            chosen.add(id(n))
    return chosen


def blocks(nodes: list[Node], chosen: set[int]) -> list[str]:
    out = []
    for n in nodes:
        if n.tag == "#text" and id(n) in chosen:
            text = " ".join("".join(n.text).split())
            if text:
                out.append(text)
    return out


def extract(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    for at in range(0, len(pages), 64):
        parsed = [parse(p) for p in pages[at : at + 64]]
        odds = trees.log_odds(np.array([row for nodes in parsed for row in node_features(nodes)], float))
        k = 0
        for nodes in parsed:
            out.append("\n\n".join(blocks(nodes, decode(nodes, odds[k : k + len(nodes)]))))
            k += len(nodes)
    return out


def main_text(docs: DataFrame, column: str = "html") -> Column:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series(extract(pages.tolist(), shared.value), dtype=object)

    return extracted(F.coalesce(F.col(column).cast("string"), F.lit("")))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    return pages.select("page_id", "url", main_text(pages).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


ship(__name__)
