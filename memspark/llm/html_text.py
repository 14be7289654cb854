"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements, and the runs of text between block boundaries as leaves. Every node has a hidden
label: its subtree holds no content, or it does, and then a class of the share of its children that do. Node potentials say how
likely the node's features are with content and without, parent-child potentials how likely a child's label is under its
parent's; a parent with content in a few of its children expects that the others have none, however many there are. On a tree, one
pass of messages upward and one downward (sum-product) give the exact marginal of every node; runs whose marginal is
above one half are the text. Messages are logarithms, so thousands of children don't drive them out of range. The pages of
a slice are worked on at once, one level of their trees after the other.

The potentials are relative frequencies with smoothing, counted on labelled pages (:mod:`memspark.llm.html_pages`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.llm.textbatch import strings, tidy

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|math|object|xmp)\b[^>]*+(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark picture q s samp small source span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base col embed hr input link meta param track".split())
#: A start tag closes an open element of these, up to the nearest of the bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements whose text is never shown as text.
_NO_TEXT = frozenset({"head", "select", "option", "button", "canvas", "audio", "video", "map"})
# Parts of class names, ids and roles, by what they usually mark.
_WORDS = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip".split(),
    "footer": "footer foot copyright legal contentinfo colophon bottom".split(),
    "header": "header masthead topbar top branding logo".split(),
    "side": "sidebar side aside widget widgets related recommended recommend more popular trending complementary rail".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup banner paywall dialog".split(),
    "comment": "comment comments commentlist respond reply replies discussion disqus thread".split(),
    "share": "share sharing social follow tags tag meta byline author".split(),
    "form": "form search login signin searchbox contact poll".split(),
    "content": "content article main post entry story body text page maincontent articlebody postbody".split(),
}
_KIND = {word: kind for kind, words in _WORDS.items() for word in words}
_TAGS = {
    **dict.fromkeys(("article", "main"), "article"), **dict.fromkeys(("nav", "menu"), "menu"), "footer": "footer", "header": "header", "aside": "side",
    **dict.fromkeys(("form", "fieldset", "label", "button", "select", "dialog"), "form"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("p", "blockquote", "pre"), "paragraph"), **dict.fromkeys(("ul", "ol", "dl"), "list"), **dict.fromkeys(("li", "dt", "dd"), "item"),
    **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th"), "table"), **dict.fromkeys(("html", "body"), "page"),
}
_ARTICLES = [t for t, kind in _TAGS.items() if kind == "article"]
_SIGNS = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bsign up\b|\blog ?in\b|\bread more\b", re.I)
_TALK = re.compile(r"\b(?:comments?|replies|responses|discussion|leave a reply|join the conversation)\b", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node(NamedTuple):
    parent: int
    features: tuple[str, ...]
    text: str | None
    label: int | None


def _element_features(tag: str, attrs: str, in_article: bool) -> tuple[str, ...]:
    kind = _TAGS.get(tag, "block")
    out = [f"tag {kind}{' in article' if kind == 'header' and in_article else ''}"]
    if attrs:
        kinds = set()
        for name, *values in _ATTRIBUTE.findall(attrs):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name in ("class", "id", "role", "aria-label"):
                kinds |= {_KIND[w] for w in map(str.lower, _SPLIT.split(value)) if w in _KIND}
            elif name == "hidden" or "display:none" in value.replace(" ", "").lower():
                kinds.add("hidden")
        if len(kinds) > 1:
            kinds.discard("content")
        out += [f"name {k}" for k in sorted(kinds)]
    return tuple(out)


def _run_features(text: str, linked: int, tag: str) -> tuple[str, ...]:
    n = text.count(" ") + 1
    size = "1-3" if n < 4 else "4-9" if n < 10 else "10-29" if n < 30 else "30-"
    links = "none" if not linked else "some" if 2 * linked < len(text) else "most"
    out = [f"words {size} {_TAGS.get(tag, 'block')} links {links}"]
    if _SIGNS.search(text):
        out.append(f"sign {_TAGS.get(tag, 'block')}")
    if n < 10 and _TALK.search(text):
        out.append("talk")
    return tuple(out)


def parse(html: str, labels: dict[int, int] | None = None) -> list[Node]:
    """The page's nodes in document order, a parent before its children; the first is the root.

    ``labels`` of a training page: by the place of a start tag in ``html``, whether what the element holds is content.
    """
    nodes = [Node(-1, (), None, None)]
    stack: list[tuple[str, int]] = [("", 0)]
    open_at: dict[str, list[int]] = {}  # depths of the open elements of each tag
    deepest = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
    parts: list[str] = []
    linked = at = in_link = silent = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                tag, parent = stack[-1]
                nodes.append(Node(parent, _run_features(text, linked, tag), text, nodes[parent].label))
            linked = 0

    def close(depth: int) -> None:
        nonlocal silent, in_link
        flush()
        in_link = 0
        while len(stack) > depth:
            tag = stack.pop()[0]
            open_at[tag].pop()
            silent -= tag in _NO_TEXT

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())

    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        if m["end"]:
            if open_at.get(tag):
                close(open_at[tag][-1])
            else:
                flush()
            continue
        if tag in _VOID:
            flush()
            continue
        flush()
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag not in ("button", "label"):
            close(len(stack) - 1)  # a block ends an open paragraph
        closes, bounds = _CLOSES.get(tag, ((), ()))
        depth = deepest(closes)
        if depth > deepest(bounds):
            close(depth)
        if m["attrs"].endswith("/"):
            continue
        parent = stack[-1][1]
        features = _element_features(tag, m["attrs"], deepest(_ARTICLES) > 0)
        nodes.append(Node(parent, features, None, labels.get(m.start(), nodes[parent].label) if labels else None))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(nodes) - 1))
        silent += tag in _NO_TEXT
        in_link = 0
    text(html[at:])
    flush()
    return nodes


#: Labels of a node: 0 without content; 1 if it is a run of content, or if the share of its children that have content isn't below the first
#: bound; one more for each bound that the share is below.
SHARES = (1 / 3, 1 / 10, 1 / 40)
LABELS = 2 + len(SHARES)


class Model:
    """Potentials of the tree, as logarithms: ``edges[parent label, child label]`` and, for a feature, its likelihood without content and with it."""

    def __init__(self, pages: list[tuple[str, dict[int, int]]], smoothing: float = 0.5):
        edges, seen, features = np.full((LABELS, LABELS), smoothing), np.full(2, smoothing), Counter()
        names = set()
        for page, labels in pages:
            nodes = parse(page, labels)
            label = [n.label or 0 for n in nodes]
            children, content = [0] * len(nodes), [0] * len(nodes)
            for i in range(len(nodes) - 1, 0, -1):  # a subtree with content has content
                p = nodes[i].parent
                label[p] |= label[i]
                children[p] += 1
                content[p] += label[i]
            kinds = [y + sum(content[i] < share * children[i] for share in SHARES) if y else 0 for i, y in enumerate(label)]
            for i, n in enumerate(nodes[1:], 1):
                edges[kinds[n.parent], kinds[i]] += 1
                seen[label[i]] += 1
                for f in n.features:
                    names.add(f)
                    features[f, label[i]] += 1
        self.edges = np.log(edges / edges.sum(axis=1, keepdims=True))
        self.likelihood = {f: tuple(float(np.log((features[f, y] + smoothing) / seen[y])) for y in (0, 1)) for f in names}

    def log_odds(self, pages: list[list[Node]]) -> list[np.ndarray]:
        """The logarithm of the odds that a node has content, for the nodes of each page, by sum-product over all of them."""
        parent, depth, own, at = [], [], [], 0
        known: dict[tuple[str, ...], tuple[float, float]] = {}
        for nodes in pages:
            for n in nodes:
                if n.features not in known:
                    found = [self.likelihood.get(f, (0.0, 0.0)) for f in n.features]
                    known[n.features] = sum(x for x, _ in found), sum(y for _, y in found)
                own.append(known[n.features])
                parent.append(at + n.parent if n.parent >= 0 else -1)
                depth.append(depth[at + n.parent] + 1 if n.parent >= 0 else 0)
            at += len(nodes)
        parent, depth = np.array(parent), np.array(depth)
        up = np.array(own, float).reshape(-1, 2)[:, [0] + [1] * (LABELS - 1)]
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if at else []
        rise, fall = np.exp(self.edges.T), np.exp(self.edges)
        sent, down = np.zeros_like(up), np.zeros_like(up)
        for level in levels[:0:-1]:
            u = up[level]
            most = u.max(axis=1, keepdims=True)
            sent[level] = np.log(np.exp(u - most) @ rise) + most
            np.add.at(up, parent[level], sent[level])
        for level in levels[1:]:
            above = parent[level]
            d = down[above] + up[above] - sent[level]
            most = d.max(axis=1, keepdims=True)
            down[level] = np.log(np.exp(d - most) @ fall) + most
        both = up + down
        odds = np.logaddexp.reduce(both[:, 1:], axis=1) - both[:, 0]
        return np.split(odds, np.cumsum([len(nodes) for nodes in pages])[:-1])

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of each node of a page."""
        return (1 / (1 + np.exp(-np.clip(self.log_odds([nodes])[0], -700, 700)))).tolist()


def texts_of(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(page) for page in pages]
    found = model.log_odds(trees) if trees else []
    return ["\n\n".join(n.text for n, x in zip(nodes, odds.tolist(), strict=True) if n.text is not None and x > 0) for nodes, odds in zip(trees, found, strict=True)]


def main_text(html: str, model: Model) -> str:
    return texts_of([html], model)[0]


_models: dict[int, Model] = {}


def trained() -> Model:
    from memspark.llm.html_pages import labelled_pages

    return _models.get(0) or _models.setdefault(0, Model(labelled_pages()))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every row of ``pages``.

    A null or empty page has the empty text, and so has one without content. Repeated rows repeat; an empty table gives
    none. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            for part, texts in strings(batch, "_html"):
                found = texts_of(texts, model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, pages[html].alias("_html")).mapInArrow(tidy(run), f"{schema}, text string, n_chars long")
