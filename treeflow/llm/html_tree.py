"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of block elements with text leaves. Each node has a binary label, content or not. The
score of a labelling is the sum of node potentials (log-linear in features of the node: its tag, words in its class and
id, link density, length, landmarks above it) and parent-child potentials (a table for each kind of edge). Sum-product
messages go up the tree and down again and give each node's exact marginal; text leaves with a content marginal of at
least 1/2 are the page's text. Weights maximise the likelihood of labelled pages (``training_pages``: page layouts
written for this module, varied by a seeded generator) with exact gradients from the same messages.

Text: character references are decoded, white space within a block is one space, blocks are joined by a line end, inline
markup doesn't cut blocks, scripts, styles and the like have no text.

The model is fitted on the driver when it is first used in a session (about 10 s for 90 small pages, a fixed amount) and
sent to the tasks; it is a vector and three tables.

Defined results: null and empty pages give an empty text; text outside of any element is judged as a leaf of the root;
unclosed and stray tags are repaired; a tag without an end is text; ties (a marginal of exactly 1/2) count as content; very
long and broken pages take time in proportion to their length, but for deeply nested inline elements that are closed out of
order; repeated rows get equal results; null ids and urls stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SCHEMA = "page_id long, url string, text string, n_chars long"
STEPS, RATE, DECAY = 160, 0.15, 2e-3

# Element names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul select button label".split())
SILENT = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg object canvas audio video head datalist".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"label", "button", "select", "option", "optgroup", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
FENCES = frozenset("table ul ol dl div article section body html aside nav main form select blockquote".split())
GROUPS = {
    "main": "article main", "box": "div section center hgroup details", "p": "p", "head": "h1 h2 h3 h4 h5 h6", "list": "ul ol dir menu", "item": "li dd dt dl summary",
    "table": "table tbody thead tfoot tr td th caption", "nav": "nav search", "header": "header", "footer": "footer address", "aside": "aside dialog", "form": "form fieldset legend label button select option optgroup",
    "figure": "figure figcaption", "quote": "blockquote pre", "root": "html body", "text": "#text",
}
# Words in class, id and role attributes.
HINTS = {
    "good": "article content post entry story main body text prose page-content articlebody",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pager pagination toc",
    "edge": "header footer masthead foot copyright colophon banner site-header site-footer contentinfo",
    "side": "sidebar aside widget related recommended more trending popular complementary rail",
    "ad": "ad ads advert advertisement adbox promo promoted sponsor sponsored promotion adslot",
    "notice": "cookie cookies consent notice notification alert popup modal overlay gdpr newsletter subscribe signup paywall",
    "talk": "comment comments commentlist discussion replies reply respond disqus reader-comments responses",
    "share": "share sharing social follow tools tags meta byline author-box",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_GROUP = {t: g for g, tags in GROUPS.items() for t in tags.split()}
BAD_HINTS = ("menu", "edge", "side", "ad", "notice", "talk", "share")
BAD_GROUPS = ("nav", "footer", "aside", "form")

# a tag without quotes is matched whole (group 4), of others the end is looked for; nothing here runs past the next "<" but names
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^<>\"']*+)(>)?|(!--)|([!?/]))")
STOP = re.compile(r">|=\s*([\"'])")
COMMENT_END = re.compile(r"-->|--!>")
#: Tags with quotes but without an end up to which those of a page are read with quotes; in the rest a tag ends at the next ">".
BROKEN = 4
LONG_ATTRIBUTES = 4096
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
SPACE = re.compile(r"\s+")
HINT_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "hints", "hidden", "text", "chars", "links", "leaves", "label")

    def __init__(self, tag: str, parent: int, hints: frozenset = frozenset(), hidden: bool = False):
        self.tag, self.parent, self.hints, self.hidden = tag, parent, hints, hidden
        self.text, self.chars, self.links, self.leaves, self.label = "", 0, 0, 0, 0


@lru_cache(4096)
def _attributes(raw: str) -> tuple[frozenset, bool, bool]:
    """Hints, whether the element is hidden, and (for labelled pages) whether it is marked as content."""
    hints, hidden = set(), False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif name in ("class", "id", "role"):
            for w in HINT_WORD.findall(CAMEL.sub("-", value.replace("_", "-")).lower()):
                hints |= {_HINT[w]} if w in _HINT else {_HINT[p] for p in w.split("-") if p in _HINT}
    return frozenset(hints), hidden, False


def _hints(raw: str) -> tuple[frozenset, bool, bool]:
    return _attributes(raw) if len(raw) <= LONG_ATTRIBUTES else _attributes.__wrapped__(raw)


class _Ends:
    """Where tags end, in time linear in the page."""

    def __init__(self, page: str):
        self.page, self.last, self.broken = page, page.rfind(">"), 0

    def next(self, at: int) -> int:
        """The place after the next ">", or -1."""
        return self.page.find(">", at) + 1 if at <= self.last else -1

    def tag(self, at: int) -> int:
        """The same for a tag whose attributes begin at ``at``: quoted values may hold a ">"."""
        if at > self.last:
            return -1
        where = at
        while self.broken < BROKEN:
            m = STOP.search(self.page, where)
            if m and m[1] is None:
                return m.end()
            where = self.page.find(m[1], m.end()) + 1 if m else 0
            if not where:
                self.broken += 1
                break
        return self.next(at)


def parse(page: str | None) -> list[Node]:
    """The nodes of a page, parents before children, in page order. Node 0 is the root."""
    nodes = [Node("body", -1)]
    stack: list[tuple[str, int]] = [("", 0)]  # open elements with the block node they are in
    pieces: list[str] = []
    state = {"links": 0, "linked": 0}
    opened: Counter = Counter()  # open elements by name: what isn't open isn't looked for

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                leaf = Node("#text", stack[-1][1])
                leaf.text, leaf.chars, leaf.links, leaf.leaves = text, len(text), min(len(text), state["linked"]), 1
                nodes.append(leaf)
            pieces = []
        state["linked"] = 0

    def close(upto: int) -> None:
        for tag, _ in stack[upto:]:
            if tag in BLOCKS:
                flush()
            if tag == "a":
                state["links"] -= 1
            opened[tag] -= 1
        del stack[upto:]

    def innermost(names, fences) -> int:
        if not any(opened[x] for x in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in fences:
                return 0
        return 0

    page, at, silent = page or "", 0, 0
    ends = _Ends(page)
    while at < len(page):
        m = TAG.search(page, at)
        end = at if m is None else m.end() if m[4] else ends.tag(m.start(3)) if m[2] else 0 if m[5] else ends.next(m.end())
        if m is None or end < 0:  # no tag is left: the rest is text
            m, start = None, len(page)
        else:
            start = m.start()
        if start > at and not silent:
            text = page[at:start]
            pieces.append(html.unescape(text) if "&" in text else text)
            if state["links"]:
                state["linked"] += len(text.strip())
        if m is None:
            break
        if m[5]:
            over = page.startswith((">", "->"), m.end())
            stop = None if over else COMMENT_END.search(page, m.end())
            at = page.index(">", m.end()) + 1 if over else stop.end() if stop else len(page)
            continue
        at = end
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name in SILENT:
                silent = max(0, silent - 1)
            elif i := innermost((name,), ("td", "th", "table") if name not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "div", "article", "section", "body", "html") else ()):
                flush() if name in BLOCKS else None
                close(i)
            elif name in ("p", "br"):
                flush() if name == "p" else pieces.append(" ")
            continue
        raw = m[3] if m[4] else page[m.start(3) : at - 1]
        if name in RAW:
            stop = re.compile(rf"</{name}(?![^\s/>])", re.IGNORECASE).search(page, at)
            at = max(ends.next(stop.end()), 0) or len(page) if stop else len(page)
            continue
        if name in SILENT:
            if not raw.endswith("/"):
                silent += 1
            continue
        if silent:
            if name == "body":
                silent = 0
            else:
                continue
        if name == "br":
            pieces.append(" ")
        elif name == "hr":
            flush()
        elif name in VOID:
            pass
        elif name in BLOCKS:
            flush()
            if name in CLOSES_P and (i := innermost(("p",), FENCES)):
                close(i)
            if name[0] == "h" and name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close(len(stack) - 1)
            if name in IMPLIED and (i := innermost(IMPLIED[name], FENCES)):
                close(i)
                while len(stack) > 1 and stack[-1][0] in IMPLIED[name]:
                    close(len(stack) - 1)
            if name in ("html", "body"):
                hints, hidden, _ = _hints(raw)
                nodes[0].hints |= hints
                continue
            hints, hidden, _ = _hints(raw)
            nodes.append(Node(name, stack[-1][1], hints, hidden))
            if "data-main" in raw:
                nodes[-1].label = 1 if "data-main=1" in raw else -1
            stack.append((name, len(nodes) - 1))
            opened[name] += 1
        elif not raw.endswith("/"):
            if name == "a":
                if i := innermost(("a",), FENCES):
                    close(i)
                state["links"] += 1
            stack.append((name, stack[-1][1]))
            opened[name] += 1
    flush()
    for n in reversed(nodes):
        if n.parent >= 0:
            up = nodes[n.parent]
            up.chars, up.links, up.leaves = up.chars + n.chars, up.links + n.links, up.leaves + n.leaves
    return nodes


FEATURES = ["one", *(f"tag:{g}" for g in GROUPS), *(f"hint:{h}" for h in HINTS), "hidden", "links", "all links", "log chars", "no text", "short", "share of page", "sentence", "in main", "in good", "in bad", "in bad hint", "nearest main", "nearest bad", "main below", "leaf of box", "words a leaf"]
_AT = {f: i for i, f in enumerate(FEATURES)}
EDGES = 3  # to a text leaf, to a landmark (main or bad), to anything else


def features(nodes: list[Node]) -> tuple[np.ndarray, list[int], list[bool]]:
    """The feature matrix, the kind of the edge to each node's parent, and which nodes are hidden."""
    x = np.zeros((len(nodes), len(FEATURES)))
    kinds, total = [], max(1, nodes[0].chars)
    has_main = any(_GROUP.get(n.tag) == "main" for n in nodes)
    above: list[tuple[bool, ...]] = []  # in main, in good, in a bad element, in a bad hint; the nearest telling one is main, bad
    hidden: list[bool] = []
    for i, n in enumerate(nodes):
        row, group = x[i], _GROUP.get(n.tag, "box")
        up = above[n.parent] if i else (False,) * 6
        out = hidden[n.parent] if i else False
        bad = any(h in BAD_HINTS for h in n.hints) or (group == "header" and not (up[0] or up[1]))
        row[0] = 1
        row[_AT["tag:" + group]] = 1
        for h in n.hints:
            row[_AT["hint:" + h]] = 1
        row[_AT["hidden"]] = n.hidden
        density = n.links / n.chars if n.chars else 0.0
        row[_AT["links"]] = density
        row[_AT["all links"]] = density > 0.8
        row[_AT["log chars"]] = math.log1p(n.chars) / 6
        row[_AT["no text"]] = n.chars == 0
        row[_AT["short"]] = n.chars < 25
        row[_AT["share of page"]] = n.chars / total
        row[_AT["sentence"]] = n.tag == "#text" and n.text[-1:] in ".!?…:\"”»"
        row[_AT["in main"]], row[_AT["in good"]], row[_AT["in bad"]], row[_AT["in bad hint"]], row[_AT["nearest main"]], row[_AT["nearest bad"]] = up
        row[_AT["main below"]] = has_main and not up[0] and group != "main"
        row[_AT["leaf of box"]] = n.tag == "#text" and i > 0 and _GROUP.get(nodes[n.parent].tag, "box") == "box"
        row[_AT["words a leaf"]] = math.log1p(n.chars / max(1, n.leaves)) / 6
        near = (False, True) if bad or group in BAD_GROUPS else (True, False) if group == "main" or "good" in n.hints else up[4:]
        kinds.append(0 if n.tag == "#text" else 1 if group in ("main", *BAD_GROUPS, "header") else 2)
        above.append((up[0] or group == "main", up[1] or "good" in n.hints, up[2] or group in BAD_GROUPS, up[3] or bad, *near))
        hidden.append(out or n.hidden)
    return x, kinds, hidden


def marginals(parents: list[int], scores: list[float], kinds: list[int], edges: np.ndarray) -> tuple[list[float], np.ndarray, float]:
    """Sum-product on a tree. ``scores``: log potential of label 1 against 0; ``edges[kind][parent][child]``: log potentials.
    Gives P(label = 1) of each node, the expected edge counts by kind, and the log partition sum."""
    n = len(parents)
    tables = np.exp(edges).tolist()
    belief = [[1.0, math.exp(min(30.0, max(-30.0, s)))] for s in scores]  # a node's potential times the messages from below
    up = [[1.0, 1.0] for _ in range(n)]
    log_z = 0.0
    for i in range(n - 1, 0, -1):
        (a, b), t = belief[i], tables[kinds[i]]
        m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
        z = m0 + m1
        log_z += math.log(z)
        m0, m1 = m0 / z, m1 / z
        up[i] = [m0, m1]
        p = belief[parents[i]]
        p[0] *= m0
        p[1] *= m1
        s = p[0] + p[1]
        if s < 1e-100 or s > 1e100:
            log_z += math.log(s)
            p[0] /= s
            p[1] /= s
    z = sum(belief[0])
    log_z += math.log(z)
    one = [0.0] * n
    full = [[0.0, 0.0]] * n
    full[0] = [belief[0][0] / z, belief[0][1] / z]
    one[0] = full[0][1]
    counts = np.zeros((EDGES, 2, 2))
    for i in range(1, n):
        p, t, (a, b) = full[parents[i]], tables[kinds[i]], belief[i]
        d0, d1 = p[0] / max(up[i][0], 1e-300), p[1] / max(up[i][1], 1e-300)  # the message from above
        j = [[d0 * t[0][0] * a, d0 * t[0][1] * b], [d1 * t[1][0] * a, d1 * t[1][1] * b]]
        z = j[0][0] + j[0][1] + j[1][0] + j[1][1]
        counts[kinds[i]] += np.array(j) / z
        one[i] = (j[0][1] + j[1][1]) / z
        full[i] = [1 - one[i], one[i]]
    return one, counts, log_z


class Model:
    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def content(self, nodes: list[Node]) -> list[float]:
        x, kinds, hidden = features(nodes)
        p, _, _ = marginals([n.parent for n in nodes], (x @ self.weights).tolist(), kinds, self.edges)
        return [0.0 if h else v for v, h in zip(p, hidden)]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        return "\n".join(n.text for n, p in zip(nodes, self.content(nodes)) if n.tag == "#text" and p >= 0.5)


def labels_of(nodes: list[Node]) -> list[int]:
    """Labels of a labelled page: an element marked ``data-main=1`` starts content, one marked ``data-main=0`` ends it."""
    out: list[int] = []
    for n in nodes:
        up = out[n.parent] if n.parent >= 0 else 0
        out.append(up if n.label == 0 else int(n.label > 0))
    return out


def train(pages: list[str], steps: int = STEPS) -> Model:
    """Maximum likelihood on labelled pages, by Adam."""
    data = []
    for page in pages:
        nodes = parse(page)
        x, kinds, _ = features(nodes)
        data.append((x, kinds, [n.parent for n in nodes], labels_of(nodes)))
    w, e = np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(e), np.zeros_like(e)]
    size = sum(len(d[3]) for d in data)
    for step in range(1, steps + 1):
        gw, ge = -DECAY * size * w, -DECAY * size * e
        for x, kinds, parents, y in data:
            p, counts, _ = marginals(parents, (x @ w).tolist(), kinds, e)
            gw += x.T @ (np.array(y) - np.array(p))
            ge -= counts
            for i in range(1, len(y)):
                ge[kinds[i], y[parents[i]], y[i]] += 1
        for v, g, a, b in ((w, gw / size, 0, 1), (e, ge / size, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.99 * state[b] + 0.01 * g * g
            v += RATE * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.99**step)) + 1e-8)
    return Model(w, e)


def training_pages(count: int = 90, seed: int = 3) -> list[str]:
    """Labelled pages: layouts with and without landmarks and telling names, long and very short texts on both sides."""
    r = np.random.default_rng(seed)

    def words(low: int, high: int, stop: bool = True) -> str:
        out = " ".join("".join(r.choice(list("aeiourstnlmdbk"), r.integers(2, 8))) for _ in range(r.integers(low, high + 1)))
        return out.capitalize() + (r.choice([".", ".", ".", "!", "?", ""]) if stop else "")

    def pick(*xs):
        return xs[r.integers(len(xs))]

    def links(n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/x'>{words(1, 3, False)}</a></{tag}>" for _ in range(n))

    def para() -> str:
        size = pick((1, 2), (1, 6), (5, 20), (20, 60), (40, 120))
        body = words(*size)
        if r.random() < 0.25:
            body += f" <a href='/y'>{words(1, 3, False)}</a> {words(2, 12)}"
        if r.random() < 0.2:
            body = f"<b>{body}<br>"
        return "<p>" + body + pick("</p>", "</p>", "")

    def article() -> str:
        out = [f"<h1>{words(1, 9, False)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.2:
            out = ["<header>" + "".join(out) + "</header>"]
        for _ in range(r.integers(1, 9)):
            kind = r.random()
            if kind < 0.72:
                out.append(para())
            elif kind < 0.78:
                out.append(f"<h2>{words(1, 6, False)}</h2>")
            elif kind < 0.83:
                out.append("<ul>" + "".join(f"<li>{words(1, 12)}</li>" for _ in range(r.integers(1, 5))) + "</ul>")
            elif kind < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3, False)}<td>{words(1, 3, False)}</tr>" for _ in range(r.integers(1, 4))) + "</table>")
            elif kind < 0.91:
                out.append(f"<blockquote>{para()}</blockquote>")
            elif kind < 0.94:
                out.append(f"<pre>{words(2, 20)}</pre>")
            elif kind < 0.97:
                out.append(f"<figure><img src=a><figcaption>{words(2, 10)}</figcaption></figure>")
            else:
                out.append(f"<div>{words(3, 30)}</div>")
            if r.random() < 0.12:
                out.append(inner_junk())
        return "".join(out)

    def inner_junk() -> str:
        return pick(
            f"<div class=share data-main=0>{links(3, 'span')}</div>", f"<aside data-main=0>{para()}</aside>", f"<div class=ad data-main=0>{words(3, 15)}</div>",
            f"<form data-main=0><label>{words(1, 3)}</label><input><button>{words(1, 2, False)}</button></form>", f"<div class='related-posts' data-main=0><h3>{words(1, 3)}</h3><ul>{links(3)}</ul></div>",
            f"<nav class=toc data-main=0><ol>{links(4)}</ol></nav>", f"<div class='newsletter-signup' data-main=0><p>{words(4, 15)}</p></div>", f"<footer data-main=0><p>{words(3, 12)}</p></footer>",
        )

    def comments() -> str:
        body = "".join(f"<div class='{pick('comment', 'reply', 'c')}'><p>{words(1, 3)}</p>{para()}</div>" for _ in range(r.integers(1, 5)))
        return pick(f"<section id=comments><h2>{words(1, 3)}</h2>{body}</section>", f"<div class='comments-area'>{body}</div>", f"<ol class=commentlist><li>{body}</li></ol>", f"<div id='discussion'>{body}</div>")

    def junk_before() -> str:
        return "".join(
            x for x, p in (
                (f"<header><h1>{words(1, 3, False)}</h1><p>{words(2, 9)}</p></header>", 0.3), (f"<div id='header'><div class=logo>{words(1, 3, False)}</div></div>", 0.2),
                (f"<nav><ul>{links(r.integers(2, 8))}</ul></nav>", 0.6), (f"<div class='menu'>{links(5, 'span')}</div>", 0.25), (f"<ul id='navigation'>{links(4)}</ul>", 0.15),
                (f"<div class='cookie-notice'><p>{words(4, 30)}</p><button>{words(1, 2)}</button></div>", 0.3), (f"<div class=ad>{words(3, 25)}</div>", 0.4), (f"<div class='breadcrumbs'>{links(3, 'span')}</div>", 0.2),
                (f"<form action='/s'><input><button>{words(1, 2)}</button></form>", 0.2), (f"<div role='alert' class=notice>{words(5, 20)}</div>", 0.15), ("<!-- ad --><script>var a='</p>';</script>", 0.3),
            ) if r.random() < p
        )

    def junk_after() -> str:
        return "".join(
            x for x, p in (
                (f"<aside><h3>{words(1, 3)}</h3><ul>{links(4)}</ul><p>{words(4, 30)}</p></aside>", 0.35), (f"<div class='sidebar'>{para()}<ul>{links(3)}</ul></div>", 0.3), (comments(), 0.4),
                (f"<div class='related'><h4>{words(1, 4)}</h4>{links(4, 'div')}</div>", 0.2), (f"<form class='newsletter'><p>{words(3, 14)}</p><input></form>", 0.2), (f"<div class='advertisement'><p>{words(4, 40)}</p></div>", 0.25),
                (f"<footer>&copy; {words(1, 4)} &middot; {words(2, 25)}</footer>", 0.65), (f"<div id=footer><p>{words(3, 25)}</p>{links(3, 'span')}</div>", 0.25), (f"<div class='popup' hidden><p>{words(4, 30)}</p></div>", 0.1),
            ) if r.random() < p
        )

    out = []
    for _ in range(count):
        body = article()
        kind = r.random()
        if kind < 0.5:
            body = f"<article data-main=1>{body}</article>"
        elif kind < 0.62:
            body = f"<main data-main=1>{body}</main>"
        elif kind < 0.86:
            body = f"<div {pick('class', 'id')}='{pick('content', 'post-content', 'entry-content', 'article-body', 'story', 'main', 'text', 'page_content')}' data-main=1>{body}</div>"
        else:
            body = f"<div data-main=1>{body}{para()}<p>{words(40, 120)}</p><p>{words(30, 90)}</p></div>"
        if r.random() < 0.3:
            body = pick("<main>{}</main>", "<div id=wrap>{}</div>", "<section>{}</section>", "<div class=container>{}</div>").format(body)
        page = junk_before() + body + junk_after()
        if r.random() < 0.3:
            page = f"<div class='wrapper'><div class='col'>{page}</div></div>"
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{page}" + pick("</body></html>", ""))
    return out


@lru_cache(1)
def default_model() -> Model:
    return train(training_pages())


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = model or default_model()

    def make():
        def each(row):
            page, url, source = row
            text = model.text(source)
            yield page, url, text, len(text)

        return each

    return map_rows(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)), make, SCHEMA, size=512)
