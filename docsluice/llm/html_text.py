"""Operator 5: main text of web pages by gradient-boosted trees over DOM-node features.

A page is parsed into a tree as browsers do for the common omissions (paragraphs, list items and
cells end where the next begins, void elements, raw scripts and styles). Each element is described
by its tag, its depth, the text, link and mark densities of its subtree, the log-odds of the tokens
of its class, id and role, and what its siblings and ancestors are like. Boosted trees give the
log-odds that an element belongs to the main text. Decoding is hierarchical: an element can only be taken inside a
taken parent, and the choice with the greatest sum over the whole tree is found from the leaves up,
so no element contradicts its ancestors.

The trees are trained in numpy on TRAINING_PAGES pages drawn from a generator of page layouts with
known answers (a fixed seed; the corpus itself carries no answers to learn from). The log-odds of
attribute tokens are learnt on TOKEN_PAGES other pages of it; a token that was not seen there goes by
the longest known one in it.

Defined cases: null html counts as empty and has an empty text; text outside any body counts as the
body's; pages without an article give an empty text; repeated rows are extracted alike; other
columns of the input pass through.
"""

from __future__ import annotations

import functools
import operator
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .words import slices

TRAINING_PAGES, TOKEN_PAGES, TREES, DEPTH, SHRINK, BINS, SEED = 600, 600, 60, 4, 0.2, 32, 17
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template head title textarea select option button svg iframe object canvas".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What the start of a tag ends, up to the nearest of the tags behind the bar.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select"), "thead": ("tr td th tbody", "table"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th tbody", "table"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
TAGS = ["p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "a", "h1", "h2", "h3", "h4", "blockquote", "pre", "table", "td", "figure", "figcaption", "b", "i", "span", "br", "body", "html"]
TAG_NUMBER = {t: i + 1 for i, t in enumerate(TAGS)}
TOKEN = re.compile(r"[a-z]+")
#: Letters that a token must have to stand for a longer one, and the most that one token counts.
STEM, MOST = 4, 3.0
SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x85\x1c-\x1f]+")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    parent: Node | None = None
    children: list = field(default_factory=list)  # nodes and strings
    number: int = -1


class Builder(HTMLParser):
    """A tree of Nodes from any bytes of markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        #: The open elements, the root first, and at which places of that list each tag is.
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]
        self.body = False

    @property
    def at(self) -> Node:
        return self.open[-1]

    def _last(self, tags: frozenset) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _opened(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def _closed(self, place: int) -> None:
        """Ends the element at this place and all that are open in it; the root stays."""
        while len(self.open) > max(place, 1):
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def _end(self, tags: frozenset, fences: frozenset) -> None:
        """Ends the innermost open element of these tags, unless a fence is open inside of it."""
        place = self._last(tags)
        if place > self._last(fences):
            self._closed(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" or tag == "body" and self.body:
            return
        if tag in CLOSES:
            for _ in range(2):
                self._end(*CLOSES[tag])
        elif tag in BLOCKS:
            self._end(frozenset("p"), frozenset("article section div table td th li blockquote body form aside nav header footer main button".split()))
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v).lower()
        if any(k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs):
            marks += " hidden"
        node = Node(tag, marks, self.at)
        self.at.children.append(node)
        self.body |= tag == "body" and node.parent is self.root
        if tag not in VOID:
            self._opened(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self._closed(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        place = self._last(frozenset((tag,)))
        if place > 0 and (tag in BLOCKS or place > self.blocks[-1]):  # an inline end tag doesn't end a block
            self._closed(place)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html)
    if re.match(r"</?[A-Za-z]", b.rawdata):  # a tag that the page breaks off in is no text
        b.rawdata = ""
    b.close()
    return b.root


def elements(root: Node, first: int = 0) -> list[Node]:
    """All visible elements, parents before children, numbered from `first`."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.number = first + len(out)
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and c.tag not in HIDDEN_TAGS]
    return out


LINEAGE = (frozenset({"nav", "menu"}), frozenset({"article", "main"}), frozenset({"aside"}), frozenset({"footer", "header"}), frozenset({"form", "label", "fieldset"}), frozenset({"ul", "ol"}))


class TokenOdds:
    """Log-odds of attribute tokens to stand on main text, learnt from elements of known answer."""

    def __init__(self, seen: dict[str, list[int]]):
        self.odds = {t: float(np.clip(np.log((main + 0.5) / (other + 0.5)), -MOST, MOST)) for t, (other, main) in seen.items()}
        self.known: dict[str, tuple[float, float]] = {}

    def of(self, token: str) -> float:
        if token in self.odds:
            return self.odds[token]
        inside = [t for t in self.odds if len(t) >= STEM and t in token]
        return self.odds[max(inside, key=lambda t: (len(t), t))] if inside else 0.0

    def best(self, attributes: str) -> tuple[float, float]:
        """The greatest log-odds for main text and against it among the tokens."""
        if attributes not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            odds = [self.of(t) for t in TOKEN.findall(attributes)]
            self.known[attributes] = (max([0.0, *odds]), -min([0.0, *odds]))
        return self.known[attributes]


def node_features(nodes: list[Node], tokens: TokenOdds) -> np.ndarray:
    """A row of features for each element of one page or of several, each page's elements in one run."""
    n = len(nodes)
    parent, top = [-1] * n, [0] * n
    chars, words, links, marks, tags, paragraphs, items = ([0] * n for _ in range(7))
    good, bad, depth, place, siblings = ([0.0] * n for _ in range(5))
    lineage = [(0,) * 8] * n
    for i, x in enumerate(nodes):
        if x.parent is not None:
            p = parent[i] = x.parent.number
            top[i], depth[i], above = top[p], depth[p] + 1, lineage[p]
        else:
            top[i], above = i, (0,) * 8
        inner = []
        for c in x.children:
            if isinstance(c, str):
                text = c.strip()
                if text:
                    chars[i] += len(text)
                    words[i] += text.count(" ") + 1
                    marks[i] += text.count(".") + text.count(",") + text.count("?") + text.count(";")
            elif c.number >= 0:
                inner.append(c.number)
        for j, c in enumerate(inner):
            place[c] = (j + 0.5) / len(inner)
            siblings[c] = len(inner)
        tag = x.tag
        tags[i], paragraphs[i], items[i] = 1, tag == "p", tag == "li"
        if x.attributes:
            good[i], bad[i] = tokens.best(x.attributes)
        step = (good[i] >= 1, bad[i] >= 1, *(tag in group for group in LINEAGE))
        lineage[i] = tuple(map(operator.add, above, step)) if any(step) else above
    own = np.array(chars, dtype=float)
    for i in range(n - 1, -1, -1):  # children come after their parents
        if nodes[i].tag == "a":
            links[i] = chars[i]
        p = parent[i]
        if p >= 0:
            chars[p] += chars[i]
            words[p] += words[i]
            links[p] += links[i]
            marks[p] += marks[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
            items[p] += items[i]
    kind = np.array([TAG_NUMBER.get(x.tag, 0) for x in nodes])
    above = np.maximum(np.array(parent), 0)
    chars, words, links, marks, tags, paragraphs, items = (np.array(v, dtype=float) for v in (chars, words, links, marks, tags, paragraphs, items))
    share = links / np.maximum(chars, 1)
    return np.column_stack([
        kind, np.where(np.array(parent) >= 0, kind[above], 0), depth, np.log1p(chars), np.log1p(own), np.log1p(words), chars / np.maximum(chars[top], 1), share, marks / np.maximum(words, 1), chars / np.maximum(tags, 1),
        np.log1p(paragraphs), np.log1p(items), good, bad, np.array(lineage, dtype=float), place, np.log1p(siblings), chars / np.maximum(chars[above], 1), share[above],
    ])


class BoostedTrees:
    """Gradient-boosted regression trees for the logistic loss, on features cut into bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, tokens: TokenOdds):
        self.tokens = tokens
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        self.base = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        z = np.full(len(x), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(binned, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            z += self._value(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)])

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tree as arrays by heap number: feature (-1: leaf), bin, value."""
        size = 2 ** (DEPTH + 1)
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.ones(len(binned), np.int64)
        for at in range(1, size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = SHRINK * gs / (hs + 1)
            if at >= size // 2:
                continue
            best = (1e-3, -1, 0)
            for f in range(binned.shape[1]):
                a = np.cumsum(np.bincount(binned[rows, f], g[rows], minlength=BINS + 1))[:-1]
                b = np.cumsum(np.bincount(binned[rows, f], h[rows], minlength=BINS + 1))[:-1]
                gain = a**2 / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs**2 / (hs + 1)
                gain[(b < 0.5) | (hs - b < 0.5)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                feature[at], cut[at] = best[1], best[2]
                node[rows] = 2 * at + (binned[rows, best[1]] > best[2])
        return feature, cut, value

    @staticmethod
    def _value(tree: tuple, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.ones(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + (binned[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.base + sum(self._value(t, binned) for t in self.trees)


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The taken elements: the choice of greatest total log-odds in which every taken element's parent is taken."""
    text = [sum(len(c.strip()) for c in x.children if isinstance(c, str)) for x in nodes]
    best = (odds * (0.05 + np.log1p(text))).tolist()  # an element counts by the text that stands or falls with it
    parent = [x.parent.number if x.parent is not None else -1 for x in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        if best[i] > 0 and parent[i] >= 0:
            best[parent[i]] += best[i]
    taken = [False] * len(nodes)
    for i in range(len(nodes)):
        taken[i] = best[i] > 0 and (parent[i] < 0 or taken[parent[i]])
    return taken


def block_texts(root: Node, taken: list[bool]) -> list[str]:
    """The taken text in page order, a string for each block, white space collapsed."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text:
            out.append(text)

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x.number >= 0 and taken[x.number] or x.number < 0 and x.tag not in HIDDEN_TAGS:
            block = x.tag in BLOCKS
            if block:
                close()
                todo.append(None)
            todo += reversed(x.children)
        elif x.tag in BLOCKS:
            close()
    close()
    return out


@functools.lru_cache(maxsize=1)
def trained() -> BoostedTrees:
    """The model over generated pages; the same in every process."""
    rng = random.Random(SEED)
    seen: dict[str, list[int]] = {}
    for _ in range(TOKEN_PAGES):
        nodes, main = answered(made_page(rng))
        for x, y in zip(nodes, main):
            for t in set(TOKEN.findall(x.attributes)):
                seen.setdefault(t, [0, 0])[int(y)] += 1
    tokens = TokenOdds(seen)
    xs, ys, ws = [], [], []
    for _ in range(TRAINING_PAGES):
        nodes, main = answered(made_page(rng))
        xs.append(node_features(nodes, tokens))
        ys.append(main.astype(float))
        ws.append(np.array([0.3 + np.log1p(sum(len(c) for c in x.children if isinstance(c, str))) for x in nodes]))
    return BoostedTrees(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws), tokens)


def answered(page: str) -> tuple[list[Node], np.ndarray]:
    """The elements of a made page, and which of them are main text, as the generator marked them."""
    nodes = elements(parse(page))
    main = np.zeros(len(nodes), dtype=bool)
    for i, x in enumerate(nodes):
        main[i] = "@main" in x.attributes
        x.attributes = x.attributes.replace("@main", "").strip()
    for i, x in enumerate(nodes):  # inline elements and what lies inside share their block's answer; ancestors are open
        if x.parent is not None and main[x.parent.number] and x.tag not in BLOCKS:
            main[i] = True
    for i in range(len(nodes) - 1, 0, -1):
        if main[i]:
            main[nodes[i].parent.number] = True
    return nodes, main


def main_texts(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page; the model reads the elements of all of them at once."""
    roots = [parse(h) if h else None for h in pages]
    nodes: list[Node] = []
    for root in roots:
        if root is not None:
            nodes += elements(root, len(nodes))
    if not nodes:
        return [""] * len(pages)
    taken = decode(nodes, model.log_odds(node_features(nodes, model.tokens)))
    return ["\n".join(block_texts(root, taken)) if root is not None else "" for root in roots]


def made_page(rng: random.Random) -> str:
    """A page of a random layout; elements that hold main text carry the mark @main in their class."""

    def words(low: int, high: int) -> str:
        n = rng.randrange(low, high)
        out = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
        joint = rng.choice([" ", " ", " ", " | "])
        for i in range(7, n, rng.randrange(6, 16)):
            out[i] += rng.choice([".", ",", ".", ",", "?"])
        return joint.join(out) + rng.choice([".", "", "."])

    def attribute(names: str) -> str:
        name = rng.choice(names.split())
        return f' {rng.choice(["class", "class", "id"])}="{name}"' if rng.random() < 0.75 else ""

    def links(low: int, high: int) -> str:
        one = [f'<a href="/{i}">{words(1, 4)}</a>' for i in range(rng.randrange(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if rng.random() < 0.7 else " ".join(one)

    def paragraph() -> str:
        size = rng.choice([(1, 6), (10, 60), (30, 120), (20, 90)])
        text = words(*size)
        if rng.random() < 0.25:
            text = f"<{rng.choice(['b', 'i', 'em', 'strong'])}>{text}" + ("</b>" if rng.random() < 0.4 else "")
        if rng.random() < 0.2:
            text += f' <a href="/x">{words(1, 4)}</a> {words(1, 12)}'
        if rng.random() < 0.2:
            text += "<br>" + words(2, 20) * (rng.random() < 0.6)
        return f'<p class="@main">{text}' + ("</p>" if rng.random() < 0.85 else "")

    def inside() -> str:
        out = [f'<h1 class="@main">{words(2, 12)}</h1>'] if rng.random() < 0.85 else []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                out.append(paragraph())
            elif kind < 0.8:
                out.append(f'<h2 class="@main">{words(1, 8)}</h2>')
            elif kind < 0.88:
                tag = rng.choice(["ul", "ol"])
                out.append(f'<{tag} class="@main">' + "".join(f'<li class="@main">{words(2, 25)}</li>' for _ in range(rng.randrange(1, 6))) + f"</{tag}>")
            elif kind < 0.92:
                out.append(f'<blockquote class="@main">{words(5, 40)}</blockquote>')
            elif kind < 0.95:
                out.append('<table class="@main"><tr class="@main">' + "".join(f'<td class="@main">{words(1, 6)}</td>' for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                out.append(f'<figure class="@main"><img src="x"><figcaption class="@main">{words(3, 15)}</figcaption></figure>')
            elif kind < 0.985:
                out.append(f'<pre class="@main">{words(4, 40)}</pre>')
            if rng.random() < 0.08:
                out.append(boilerplate())
        return "".join(out)

    def boilerplate() -> str:
        kind = rng.randrange(11)
        if kind == 10:
            return f"<div {rng.choice(["hidden", "style='display: none'"])}><p>{words(3, 40)}</p></div>"
        if kind == 0:
            return f"<nav{attribute('nav menu main-nav breadcrumb navbar toc')}>{links(2, 9)}</nav>"
        if kind == 1:
            return f"<aside{attribute('sidebar related widget side-column')}><h3>{words(1, 4)}</h3>{links(2, 8) if rng.random() < 0.6 else '<p>' + words(5, 40) + '</p>'}</aside>"
        if kind == 2:
            return f'<div class="{rng.choice("ad ads advert advertisement sponsor sponsored promo promotion banner ad-slot".split())}">{words(2, 30)}</div>'
        if kind == 3:
            return f"<form{attribute('search newsletter login subscribe signup register')}><label>{words(1, 6)}</label><input><p>{words(2, 20)}</p><button>{words(1, 3)}</button></form>"
        if kind == 4:
            return f'<div class="{rng.choice("cookie cookie-banner consent notice alert gdpr-notice popup modal overlay privacy".split())}"><p>{words(4, 40)}</p><a href="/p">{words(1, 3)}</a></div>'
        if kind == 5:
            tag = rng.choice(["div", "section"])
            ones = "".join(f'<{rng.choice(["div", "li", "article"])} class="comment"><b>{words(1, 3)}</b><p>{words(3, 60)}</p></div>' for _ in range(rng.randrange(1, 6)))
            return f'<{tag} {rng.choice(["id", "class"])}="{rng.choice("comments comment-list discussion responses reader-comments replies respond".split())}">{ones}</{tag}>'
        if kind == 6:
            return f"<header{attribute('header masthead site-header top')}><a href='/'>{words(1, 4)}</a><p>{words(1, 10)}</p></header>"
        if kind == 7:
            return f'<div class="{rng.choice("share social related recommended recommend more-stories tags meta pagination pager toolbar print byline-tools".split())}">{links(1, 7)}</div>'
        if kind == 8:
            return f"<footer{attribute('footer site-footer bottom legal')}>&copy; {words(1, 4)} &middot; {words(2, 30)}</footer>"
        return f'<div class="{rng.choice("sidebar side-bar widget menu navigation copyright disclaimer legal-notice".split())}"><p>{words(2, 30)}</p>{links(0, 4)}</div>'

    lead = "".join(boilerplate() for _ in range(rng.randrange(0, 4)))
    tail = "".join(boilerplate() for _ in range(rng.randrange(0, 4)))
    nav = f"<nav>{links(2, 9)}</nav>" if rng.random() < 0.7 else ""
    foot = f"<footer>&copy; {words(1, 3)} &middot; {words(2, 40)}</footer>" if rng.random() < 0.7 else ""
    wrap = rng.choice(["article", "article", "article", "main", "div", "section", "main+article", "none"])
    core = inside()
    marks = rng.choice(["content", "article-body", "post", "entry-content", "story", "main-text", "prose", "chapter", "passage", "article", "post-text"])
    if wrap == "main+article":
        core = f'<main class="@main"><article class="@main">{core}</article></main>'
    elif wrap == "div" or wrap == "section":
        core = f'<{wrap} class="@main {marks}">{core}</{wrap}>'
    elif wrap != "none":
        core = f'<{wrap} class="@main {marks if rng.random() < 0.5 else ""}">{core}</{wrap}>'
    if rng.random() < 0.3:
        core = f'<div{attribute("wrapper page container columns")}>{core}{tail}</div>'
        tail = ""
    return f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{margin:0}}</style></head><body>{nav}{lead}{core}{tail}{foot}" + ("</body></html>" if rng.random() < 0.9 else "")


def page_texts(pages: DataFrame) -> DataFrame:
    """pages(html, ...) without html, with text."""
    own = [c for c in pages.columns if c.lower() not in {"html", "text"}]
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in own)
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # a fixed number of small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = main_texts(piece.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in own), pa.array(texts, pa.string())], [*own, "text"])

    return pages.select(*own, F.col("html").cast("string").alias("html")).mapInArrow(run, fields + "text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
