"""Main-text extraction with gradient-boosted trees over the nodes of a page.

A page becomes a tree of block elements with their texts as leaves. Each node is described by the
density of text and links in its subtree, its tag and attribute tokens and those of its ancestors,
its depth and its place among its siblings. Boosted trees give the odds that a node is main content;
they are trained on generated pages whose parts are known. Decoding is hierarchical: from the leaves
up, each node becomes main, boilerplate or mixed, whichever explains its subtree best. All below a
main node is main and all below a boilerplate node is boilerplate, so choices never contradict.

Scripts, styles, forms, comments and the like carry no text. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed and joined by one line break in page
order. Null, empty and text-free pages give an empty text. Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import slices

#: Elements whose content is no text of the page (fixed values); those of the first line hide the rest of the page where they aren't closed.
RUNS_ON = frozenset("script style".split())
HIDDEN = RUNS_ON | frozenset("noscript template svg math textarea select iframe object head title button label option optgroup datalist legend".split())
#: An attribute, as browsers read it: quotes count only after an equals sign, and no white space is needed between two.
ONE_ATTRIBUTE = r"""[^\s/>][^\s/>=]*(?:\s*=(?:\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)?"""
MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]+|{ONE_ATTRIBUTE})*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that neither break a block nor make a node (fixed values).
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr acronym picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element ends (fixed values).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Attribute tokens and tags that hint at main content and at everything else (fixed values).
GOOD_TOKENS = frozenset("article content main post entry story body text page blog prose document".split())
BAD_TOKENS = frozenset(
    "nav navbar navigation menu header masthead footer foot sidebar side aside ad ads adv advert advertisement banner promo promoted promotion sponsor sponsored comment comments reply replies "
    "discussion disqus cookie cookies consent gdpr notice notification alert share sharing social related recommended popular trending popup modal overlay newsletter subscribe subscription signup "
    "login breadcrumb breadcrumbs pagination pager form search widget copyright legal disclaimer toolbar tags skip".split()
)
TAGS = ("article", "main", "section", "div", "p", "h", "li", "list", "table", "quote", "nav", "header", "footer", "aside", "form", "text", "figure", "body")
BAD_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
KIND = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "blockquote": "quote", "pre": "quote", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "fieldset": "form", "dialog": "aside", "menu": "nav", "hgroup": "h", "html": "body"}
MIXED = 0.3  # what it costs a node, in log-odds, to be neither main nor boilerplate


class Node:
    __slots__ = ("tag", "good", "bad", "above_good", "above_bad", "parent", "depth", "place", "children", "text", "chars", "links", "tags", "paragraphs", "stops", "before", "main")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.children, self.text = tag, parent, [], None
        tokens = [t.lower() for m in ATTRIBUTE.finditer(attrs) for t in TOKEN.findall(m[2] or m[3] or m[4] or "")] if attrs else ()
        self.good = sum(t in GOOD_TOKENS for t in tokens) + (tag in ("article", "main"))
        self.bad = sum(t in BAD_TOKENS for t in tokens) + (tag in BAD_TAGS)
        self.depth = parent.depth + 1 if parent else 0
        self.above_good = parent.above_good + min(parent.good, 1) if parent else 0
        self.above_bad = parent.above_bad + min(parent.bad, 1) if parent else 0
        self.chars = self.links = self.tags = self.paragraphs = self.stops = self.before = self.place = 0
        self.main = None


def pieces_of(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The page's text and the tag after each piece of it, in order; what hidden elements hold is left out. Linear in the page:
    an end that isn't found is looked for once."""
    at, unclosed = 0, set()
    while m := MARKUP.search(page, at):
        text, at = page[at : m.start()], m.end()
        name = (m["name"] or "").lower()
        if name in HIDDEN and not m["close"] and name not in unclosed:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if end or name in RUNS_ON:
                at = end.end() if end else len(page)
            else:
                unclosed.add(name)
        yield text, m
    yield page[at:], None


def parsed(page: str) -> list[Node]:
    """All nodes of a page in order, the root first; leaves hold the text of one block."""
    root = Node("body", "", None)
    nodes, stack, pieces = [root], [root], []
    link, linked, inline = 0, 0, 0

    def flush() -> None:
        nonlocal linked, inline, pieces
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                leaf = Node("text", "", stack[-1])
                leaf.text, leaf.chars, leaf.links, leaf.tags = text, len(text), min(linked, len(text)), inline
                leaf.stops = text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
                stack[-1].children.append(leaf)
                nodes.append(leaf)
            pieces, linked, inline = [], 0, 0

    for piece, m in pieces_of(page):
        if piece:
            pieces.append(piece)
            linked += len(piece) if link else 0
        if m is None or m["name"] is None:
            continue
        name = m["name"].lower()
        if name in HIDDEN:
            pieces.append(" ")
            continue
        if name in INLINE:
            inline += 1
            if name == "a":
                link = 0 if m["close"] else 1
            elif name == "br":
                pieces.append(" ")
            continue
        flush()
        link = 0
        if name in ("html", "body"):
            continue
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if name in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in HOLDS[name] if name in HOLDS else False:
                    break
                if stack[k].tag in ENDS[name]:
                    del stack[k:]
                    break
        if name in VOID:
            continue
        node = Node(name, m["attrs"], stack[-1])
        stack[-1].children.append(node)
        nodes.append(node)
        stack.append(node)
    flush()
    upto = 0
    for n in nodes:
        n.before = upto
        if n.text is not None:
            upto += n.chars
    for n in reversed(nodes):
        for k, c in enumerate(n.children):
            c.place = k
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.links += n.links
            p.tags += n.tags + 1
            p.stops += n.stops
            p.paragraphs += n.paragraphs + (n.tag == "p")
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node."""
    whole = max(1, nodes[0].chars)
    out = np.zeros((len(nodes), 17 + len(TAGS)), np.float32)
    tags = {id(n): Counter(c.tag for c in n.children) for n in nodes if n.children}
    for k, n in enumerate(nodes):
        chars, p = n.chars, n.parent
        held = p if n.tag == "text" and p is not None else n
        kin = len(p.children) if p else 1
        alike = tags[id(p)][n.tag] / kin if p else 1.0
        kind = KIND.get(held.tag, held.tag)
        out[k, :17] = (
            np.log1p(chars), n.links / chars if chars else 0.0, chars / (n.tags + 1), n.stops / (chars + 1) * 100, n.paragraphs,
            held.good, held.bad, n.above_good, n.above_bad, n.depth, kin, n.place / kin, alike,
            n.before / whole, chars / whole, chars / max(1, p.chars) if p else 1.0, n.text is not None,
        )
        if kind in TAGS:
            out[k, 17 + TAGS.index(kind)] = 1
    return out


# ---------------------------------------------------------------- boosting
class Boosted:
    """Trees of fixed depth for the log-odds of a node being main content."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25):
        self.depth = depth
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 32))) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], 1)
        width = max(len(c) for c in self.cuts) + 1
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        odds = np.full(len(y), self.base)
        self.feature, self.limit, self.leaf = [], [], []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                n, begin = 2**level, 2**level - 1
                gain, where = np.zeros(n), np.zeros((n, 2), np.int64)
                for f, c in enumerate(self.cuts):
                    key = at * width + bins[:, f]
                    gs = np.bincount(key, weights=g, minlength=n * width).reshape(n, width)
                    hs = np.bincount(key, weights=h, minlength=n * width).reshape(n, width)
                    gl, hl = gs.cumsum(1)[:, : len(c)], hs.cumsum(1)[:, : len(c)]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    got = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    best = got.argmax(1)
                    value = got[np.arange(n), best]
                    better = value > gain + 1e-9
                    gain[better], where[better] = value[better], np.stack([np.full(n, f), best], 1)[better]
                for k in range(n):
                    if gain[k] > 0:
                        f, b = where[k]
                        feature[begin + k], limit[begin + k] = f, self.cuts[f][b]
                node = begin + at
                at = at * 2 + (x[np.arange(len(y)), feature[node]] > limit[node])
            leaf = rate * np.bincount(at, weights=g, minlength=2**depth) / (np.bincount(at, weights=h, minlength=2**depth) + 1)
            odds += leaf[at]
            self.feature.append(feature)
            self.limit.append(limit)
            self.leaf.append(leaf)

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = at * 2 + (x[rows, feature[node]] > limit[node])
            out += leaf[at]
        return out


def decoded(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """The texts of all main leaves in order, under the best labels without contradictions."""
    main, other, mixed = np.logaddexp(0, -odds), np.logaddexp(0, odds), np.full(len(nodes), MIXED)  # costs
    index = {id(n): k for k, n in enumerate(nodes)}
    parent = [index[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    free = np.zeros(len(nodes))  # of the children, each as it likes
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        mixed[k] = mixed[k] + free[k] if n.children else np.inf
        if parent[k] >= 0:
            main[parent[k]] += main[k]
            other[parent[k]] += other[k]
            free[parent[k]] += min(main[k], other[k], mixed[k])
    label, out = [0] * len(nodes), []
    for k, n in enumerate(nodes):
        above = label[parent[k]] if parent[k] >= 0 else 2
        label[k] = above if above != 2 else int(np.argmin((other[k], main[k], mixed[k])))
        if label[k] == 1 and n.text is not None:
            out.append(n.text)
    return out


# ---------------------------------------------------------------- training pages
def training_page(dice: random.Random) -> tuple[str, list[bool]]:
    """A generated page and, for each of its text blocks in order, whether it is main content."""
    words = lambda a, b: " ".join("".join(dice.choice(("ta", "re", "mi", "no", "sel", "un", "ter", "en", "lo", "vi")) for _ in range(dice.randint(1, 4))) for _ in range(dice.randint(a, b)))
    labels: list[bool] = []

    def said(a: int, b: int, main: bool) -> str:
        labels.append(main)
        return ". ".join(words(4, 14).capitalize() for _ in range(dice.randint(1, 1 + b // 12))) + "." if b > 12 else words(a, b)

    def some(tag: str, *names: str) -> str:
        return f'<{tag} {dice.choice(("class", "id"))}="{dice.choice(names)}">' if names and dice.random() < 0.85 else f"<{tag}>"

    def links(n: int, main: bool = False) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{said(1, 3, main)}</a></li>' for _ in range(n)) + "</ul>"

    def boiler(kind: str) -> str:
        if kind == "nav":
            return dice.choice(("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="navbar">{}</div>')).format(links(dice.randint(2, 9)))
        if kind == "header":
            tag = dice.choice(("header", "div"))
            return f'<{tag} class="site-header">' + f"<h1>{said(1, 4, False)}</h1>" + (f"<p>{said(3, 10, False)}</p>" if dice.random() < 0.5 else "") + (links(3) if dice.random() < 0.5 else "") + f"</{tag}>"
        if kind == "footer":
            tag = dice.choice(("footer", "div"))
            return f'<{tag} id="footer">' + f"&copy; {said(2, 14, False)}" + (f"<p>{said(5, 30, False)}</p>" if dice.random() < 0.4 else "") + f"</{tag}>"
        if kind == "ad":
            return some(dice.choice(("div", "aside", "section")), "ad", "ads", "advert", "banner", "sponsored", "promo") + (f"<p>{said(3, 40, False)}</p>" if dice.random() < 0.4 else said(3, 40, False)) + "</div>"
        if kind == "side":
            return dice.choice(('<aside>', '<div class="sidebar">', '<aside class="widget">')) + f"<h3>{said(1, 4, False)}</h3>" + (links(4) if dice.random() < 0.5 else f"<p>{said(5, 40, False)}</p>") + "</div></aside>"
        if kind == "comments":
            one = lambda: f'<div class="comment"><p>{said(4, 60, False)}</p></div>'
            return dice.choice(('<section id="comments">', '<div class="comments">')) + f"<h3>{said(1, 3, False)}</h3>" + "".join(one() for _ in range(dice.randint(1, 5))) + "</div></section>"
        if kind == "notice":
            return dice.choice(('<div class="cookie-notice">', '<div id="consent" role="dialog">', '<div class="alert notice">')) + f"<p>{said(6, 50, False)}</p></div>"
        if kind == "form":
            return f'<form action="/s"><p>{said(2, 20, False)}</p><label>{words(1, 3)}</label><input name="q"></form>'
        return '<div class="share social">' + links(3) + "</div>"

    def content() -> str:
        kind = dice.random()
        if kind < 0.68:
            return dice.choice(("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>")).format(said(2, dice.choice((5, 30, 80, 160)), True))
        if kind < 0.78:
            return f"<h{dice.randint(2, 4)}>{said(2, 9, True)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{said(2, 24, True)}</li>" for _ in range(dice.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote><p>{said(5, 40, True)}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{said(1, 6, True)}</td><td>{said(1, 6, True)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{said(4, 60, True)}</div>"

    page = ["<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"]
    page += [boiler(k) for k in ("notice", "header", "nav", "ad", "side") if dice.random() < 0.55]
    wrap = dice.random() < 0.3
    page += ['<div id="wrapper">'] * wrap
    opening = dice.choice(("<article>", "<main>", "<main><article>", '<div class="content">', '<div id="article-body" class="post">', '<section class="entry">', "<div>", "<article>", ""))
    page += [opening, f"<h1>{said(2, 12, True)}</h1>" if dice.random() < 0.85 else ""]
    for _ in range(dice.choice((1, 2, 4, 8, 14))):
        page.append(content())
        if dice.random() < 0.06:
            page.append(boiler(dice.choice(("ad", "share", "side"))))
    page += ["</div>" if "<div" in opening else "</article></main></section>" if opening else ""]
    page += [boiler(k) for k in ("share", "comments", "side", "form", "ad", "notice") if dice.random() < 0.35]
    page += ["</div>"] * wrap
    page += [boiler("footer") if dice.random() < 0.8 else "", "</body></html>"]
    return "".join(page), labels


def fit(pages: int = 1200, seed: int = 3) -> Boosted:
    """Trees grown on ``pages`` generated pages (a documented bound). A node's label is what most of its text is."""
    dice, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, labels = training_page(dice)
        nodes = parsed(page)
        leaves = [n for n in nodes if n.text is not None]
        for n, own in zip(leaves, labels, strict=True):
            n.main = n.chars if own else 0
        for n in reversed(nodes):
            if n.text is None:
                n.main = sum(c.main for c in n.children)
        xs.append(features(nodes))
        ys += [float(n.main > n.chars / 2) for n in nodes]
    return Boosted(np.concatenate(xs), np.array(ys))


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    trees = [parsed(p or "") for p in pages]
    rows = [features(t) for t in trees]
    ends = np.cumsum([len(r) for r in rows])
    odds = model.odds(np.concatenate(rows)) if rows else np.zeros(0)
    return ["\n".join(decoded(t, odds[e - len(t) : e])) for t, e in zip(trees, ends.tolist())]


def extract(pages: DataFrame, model: Boosted | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (its code points) for each row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html, 1 << 20):
                texts = pa.array(main_texts(part.column(html).to_pylist(), shared.value), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts, pc.utf8_length(texts).cast(pa.int64())], [*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html)) if html not in keep else pages.select(*keep)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")
