"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed to block nodes (inline elements belong to the block around them). Each node
gets features of its tag, attribute words, depth, subtree density, links and siblings, and a
tree ensemble gives the odds that it is part of the article. Decoding is hierarchical: going
down from the body, a subtree is kept or dropped as a whole wherever that scores better, and
nothing below a dropped node can be kept, so an advert inside an article and an article inside
a wrapper are both possible, but no contradiction is. Reading a page takes time in proportion to its
length, whatever is broken in it: unclosed tags, quotes and comments, end tags without a beginning.

The trees are trained on the driver, from pages made by a seeded generator with known labels
(``PAGES`` of them, the only sample size); they are small and go to the tasks as they are.

Edge cases: a null or empty page, or one without an article, has an empty text; text without
any markup is judged as the root's own; broken markup is parsed leniently; whole pages stand
in a task's memory, some megabytes at a time (or one page); rows are independent, so repeated pages give
equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PAGES = 400
TREES = 60
DEPTH = 4
RATE = 0.25
BINS = 32

# Element names by their part in the markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = RAW | frozenset("head noscript template select button svg math object canvas audio video datalist".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"}}
BOUNDS = frozenset("html body div section article main aside td th table ul ol nav header footer form blockquote figure".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*+>""", re.S)
#: The same with quotes as any other character, for what the first does not fit.
_LENIENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>")
#: Tags with broken quotes after which a page is read leniently: each may take a look at all that is left.
BROKEN = 16
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tokens(source: str):
    """Matches of the markup in a page, in order: each has a begin and an end, and for tags a slash, a name
    and attributes. Takes time in proportion to the page, whatever is broken in it."""
    at, broken, last = 0, 0, source.rfind(">")
    while (at := source.find("<", at)) >= 0:
        if at > last and not source.startswith("<!--", at):
            return  # nothing is closed any more
        match = _TOKEN.match(source, at) if broken < BROKEN or source.startswith("<!--", at) else None
        if match is None:
            match = _LENIENT.match(source, at)
            broken += match is not None and match[2] is not None
        if match is None:
            at += 1
            continue
        at = yield match
        at = match.end() if at is None else at


class Page:
    """Block nodes in page order: ``tag, parent, depth, words`` (of attributes), and the texts
    ``(node, text, linked)``. Open elements are found by name, so that no tag looks through all of them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.words = ["#"], [-1], [0], [frozenset()]
        self.texts: list[tuple[int, str, bool]] = []
        self._stack: list[tuple[str, int]] = [("#", 0)]  # open elements with the block they are in
        self._open: dict[str, list[int]] = {}  # places in the stack by name
        self._bounds: list[int] = []  # places of elements that others do not reach across
        self._silent = self._links = 0
        at = 0
        tokens, jump = _tokens(source), None
        while True:
            try:
                match = next(tokens) if jump is None else tokens.send(jump)
            except StopIteration:
                break
            jump = None
            if match.start() > at and not self._silent:
                self.texts.append((self._stack[-1][1], source[at : match.start()], self._links > 0))
            at = match.end()
            name = match.group(2) if match.re.groups >= 2 else None
            if name is not None:
                name = name.lower()
                if match[1]:
                    self._end(name)
                elif name in RAW:
                    end = re.compile(f"</{name}", re.I).search(source, at)
                    stop = end.start() if end else len(source)
                    close = source.find(">", stop) if end else -1
                    at = jump = close + 1 if close >= 0 else len(source)
                elif name == "br" or name == "hr":
                    if not self._silent:
                        self.texts.append((self._stack[-1][1], "\n", False))
                elif name not in VOID:
                    self._begin(name, match[3])
        if at < len(source) and not self._silent:
            self.texts.append((self._stack[-1][1], source[at:], self._links > 0))

    def _begin(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._close({"p"})
        if name in SAME:
            self._close(SAME[name])
        if name == "body" and self._silent:  # whatever the head has left open
            self._cut(min(self._open[n][0] for n in NO_TEXT if self._open.get(n)))
        block = self._stack[-1][1]
        if name not in INLINE:
            self.tag.append(name)
            self.parent.append(block)
            self.depth.append(self.depth[block] + 1)
            self.words.append(frozenset(w.lower() for v in _ATTRIBUTE.findall(attributes) for w in _PART.findall(v)) if attributes else frozenset())
            block = len(self.tag) - 1
        if not attributes.endswith("/") or name not in ("svg", "math"):
            self._push(name, block)

    def _push(self, name: str, block: int) -> None:
        place = len(self._stack)
        self._stack.append((name, block))
        self._open.setdefault(name, []).append(place)
        if name in BOUNDS:
            self._bounds.append(place)
        self._silent += name in NO_TEXT
        self._links += name == "a"

    def _cut(self, place: int) -> None:
        """Close all that is open from ``place`` on."""
        while len(self._stack) > place:
            name, _ = self._stack.pop()
            self._open[name].pop()
            if name in BOUNDS:
                self._bounds.pop()
            self._silent -= name in NO_TEXT
            self._links -= name == "a"

    def _end(self, name: str) -> None:
        places = self._open.get(name)
        if not places or (name in INLINE and self._bounds and self._bounds[-1] > places[-1]):
            return
        self._cut(places[-1])
        if name not in INLINE and not self._silent:
            self.texts.append((self._stack[-1][1], "\n", False))

    def _close(self, names: set[str]) -> None:
        """End the nearest open element of some names, if no boundary of another name is nearer."""
        place = max((self._open[n][-1] for n in names if self._open.get(n)), default=0)
        if place and not (self._bounds and self._bounds[-1] > place):
            self._cut(place)


# Words in attributes, by what they are a sign of.
SIGNS = {
    "content": "article content main post entry story body text blog page single prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pagination pager",
    "header": "header masthead banner logo branding hero",
    "footer": "footer foot copyright colophon legal",
    "side": "sidebar side aside widget related recommended popular trending more teaser rail",
    "advert": "ad ads advert advertisement adsense adslot sponsor sponsored promo promotion dfp",
    "comments": "comment comments commentlist reply replies respond disqus discussion reader",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup warning",
    "share": "share sharing social tags tag meta byline author facebook twitter",
    "form": "form search login contact feedback field",
}
_SIGNS = [frozenset(v.split()) for v in SIGNS.values()]
KINDS = ["article main", "section div", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl", "nav menu", "header", "footer", "aside", "form fieldset", "table tbody tr td th", "body html #", "figure figcaption"]
_UPPER = re.compile("[A-Z\u00c0-\u00de]")
_KIND = {t: k for k, ts in enumerate(KINDS) for t in ts.split()}


def features(page: Page, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row per block node, and each node's own text length. ``texts``: as in ``page.texts``,
    decoded."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, linked, stops, upper = (np.zeros(n) for _ in range(4))
    start, pos = np.full(n, -1.0), 0
    for (node, _, link), text in zip(page.texts, texts):
        size = len(text) - text.count(" ") if not text.isspace() else 0
        if size:
            own[node] += size
            linked[node] += size * link
            stops[node] += text.count(". ") + text.count(", ") + text.rstrip().endswith((".", "!", "?"))
            upper[node] += len(_UPPER.findall(text))
            if start[node] < 0:
                start[node] = pos
            pos += size
    signs = np.zeros((n, len(_SIGNS)), bool)
    for k, w in enumerate(page.words):
        if w:
            signs[k] = [bool(w & s) for s in _SIGNS]
    kind = np.array([_KIND.get(t, len(KINDS)) for t in page.tag])
    own_kind = np.eye(len(KINDS) + 1, dtype=bool)[kind]
    marks = [sum(1 << i for i, s in enumerate(_SIGNS) if w & s) | 1 << (len(_SIGNS) + k) if w else 1 << (len(_SIGNS) + k) for w, k in zip(page.words, kind.tolist())]
    for k in range(1, n):  # parents stand before their children
        marks[k] |= marks[page.parent[k]]
    above = (np.array(marks)[:, None] >> np.arange(len(_SIGNS) + len(KINDS) + 1)) & 1
    # Sums over subtrees and counts among siblings, on plain lists as nodes are few.
    total, total_linked, total_stops = own.tolist(), linked.tolist(), stops.tolist()
    first = np.where(start < 0, np.inf, start).tolist()
    nodes, children, order, pairs = [1] * n, [0] * n, [0] * n, {}
    for k in range(1, n):
        p = page.parent[k]
        order[k] = children[p]
        children[p] += 1
        pairs[p, page.tag[k]] = pairs.get((p, page.tag[k]), 0) + 1
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        total[p] += total[k]
        total_linked[p] += total_linked[k]
        total_stops[p] += total_stops[k]
        nodes[p] += nodes[k]
        first[p] = min(first[p], first[k])
    like = np.array([0, *(pairs[page.parent[k], page.tag[k]] for k in range(1, n))])
    total, total_linked, total_stops, first, nodes, children, order = (np.array(x, float) for x in (total, total_linked, total_stops, first, nodes, children, order))
    pa_ = np.maximum(parent, 0)
    whole = max(total[0], 1.0)
    first[~np.isfinite(first)] = whole
    one = np.maximum(total, 1.0)
    numeric = np.stack(
        [np.log1p(own), np.log1p(total), total / whole, total_linked / one, total_linked[pa_] / one[pa_], np.log1p(total / nodes), np.log1p(total[pa_] / nodes[pa_]), total_stops / one * 100, total_stops[pa_] / one[pa_] * 100, np.array(page.depth, float), first / whole, order / np.maximum(children[pa_], 1),
         children[pa_], children, like / np.maximum(children[pa_], 1), np.log1p((total[pa_] - own[pa_]) / np.maximum(children[pa_], 1)), own / one, upper / np.maximum(own, 1), total / one[pa_]],
        axis=1,
    )
    return np.concatenate([numeric, signs, own_kind, above], axis=1).astype(np.float32), own


class Trees:
    """Boosted regression trees of equal depth for the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.feature = np.zeros((trees, (1 << depth) - 1), np.int64)
        self.cut = np.zeros((trees, (1 << depth) - 1), np.float32)
        self.leaf = np.zeros((trees, 1 << depth))
        self.depth = depth
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1)
        n, m = binned.shape
        flat = (binned + np.arange(m) * BINS).ravel()
        score = np.zeros(n)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, p * (1 - p) * weight
            at = np.zeros(n, np.int64)
            for level in range(depth):
                base = (1 << level) - 1
                for node in range(1 << level):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 8:
                        self.cut[t, base + node] = np.inf
                        continue
                    keys = flat.reshape(n, m)[rows].ravel()
                    gs = np.bincount(keys, np.repeat(g[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                    hs = np.bincount(keys, np.repeat(h[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + 1) + gr**2 / (hr + 1)
                    gain[:, -1] = -1
                    for f in range(m):
                        gain[f, len(cuts[f]) :] = -1
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    self.feature[t, base + node], self.cut[t, base + node] = f, cuts[f][b] if len(cuts[f]) else np.inf
                right = x[np.arange(n), self.feature[t, base + at]] > self.cut[t, base + at]
                at = 2 * at + right
            gs, hs = np.bincount(at, g, 1 << depth), np.bincount(at, h, 1 << depth)
            self.leaf[t] = rate * gs / (hs + 1)
            score += self.leaf[t, at]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        rows, score = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[rows, feature[node]] > cut[node])
            score += leaf[at]
        return score


def kept(page: Page, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which nodes' own text is kept, by the best cut of the tree."""
    n = len(own)
    vote = odds * (0.3 + np.log1p(own))
    keep, drop = vote.copy(), -vote
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    out = np.zeros(n, bool)
    out[0] = True
    for k in range(1, n):
        # The page itself is no choice: the root, html and body are always gone through.
        out[k] = out[page.parent[k]] and (keep[k] > drop[k] or page.tag[k] in ("html", "body"))
    for k in range(n):
        if page.tag[k] in ("#", "html", "body"):
            out[k] = odds[k] > 0 and own[k] > 0 if out[k] else False
    return out


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page; the trees see all nodes at once."""
    pages = [Page(s) for s in sources]
    texts = [[html.unescape(t) if "&" in t else t for _, t, _ in p.texts] for p in pages]
    rows = [features(p, t) for p, t in zip(pages, texts)]
    odds = trees(np.concatenate([x for x, _ in rows])) if rows else []
    out, at = [], 0
    for page, text, (x, own) in zip(pages, texts, rows):
        out.append(_joined(page, text, kept(page, odds[at : at + len(x)], own)))
        at += len(x)
    return out


def _joined(page: Page, texts: list[str], keep: np.ndarray) -> str:
    """Kept texts in page order; blocks stand apart, inline elements do not."""
    parts, last = [], -1
    for (node, _, _), text in zip(page.texts, texts):
        if keep[node]:
            parts.append(text if node == last else f"\n{text}")
            last = node
        else:
            last = -1
    return " ".join("".join(parts).split())


# ---------------------------------------------------------------- training pages
_YES, _NO = "\ue001", "\ue002"


class Generator:
    """Pages of many layouts, whose texts begin with a mark that says what they are."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "aeioustnrlmdcpgh"
        self.words = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(600)]

    def text(self, n: int, mark: str, end: str = ".") -> str:
        out = [self.r.choice(self.words) for _ in range(max(1, n))]
        for i in range(len(out)):
            if self.r.random() < 0.09:
                out[i] += self.r.choice(",.")
        return mark + " ".join(out).capitalize() + end

    def name(self, *some: str) -> str:
        """An attribute with a telling word, an empty one, or a meaningless one."""
        x = self.r.random()
        if x < 0.25:
            return ""
        if x < 0.4:
            return f' class="c-{self.r.randrange(16**5):05x} x{self.r.randrange(99)}"'
        word = self.r.choice(some)
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(["", "site-", "l-", "js-"])}{word}{self.r.choice(["", "", "-inner", "-wrap", " clearfix"])}"'

    def links(self, n: int) -> str:
        r = self.r
        item = r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/y'>{}</a> ", "<li class='item'><a href='#'>{}</a></li>"])
        inner = "".join(item.format(self.text(r.randint(1, 4), _NO, "")) for _ in range(n))
        return f"<ul>{inner}</ul>" if item[1] == "l" else inner

    def boilerplate(self, place: str) -> str:
        r, t = self.r, lambda a, b, e=".": self.text(r.randint(a, b), _NO, e)
        kind = r.choice({"top": ["nav", "nav", "header", "ad", "notice", "form"], "side": ["side", "side", "ad", "form", "nav"], "in": ["ad", "ad", "share", "form", "side", "notice"], "end": ["comments", "side", "share", "ad", "form"], "foot": ["footer", "footer", "nav", "notice", "ad"]}[place])
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "menu"])
            return f"<{tag}{self.name('nav', 'menu', 'navbar', 'breadcrumb')}>{self.links(r.randint(2, 12))}</{tag}>"
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            return f"<{tag}{self.name('header', 'masthead', 'banner', 'logo')}>{r.choice(['<h1>{}</h1>', '<p>{}</p>', '<div>{}</div>', '{}']).format(t(1, 12, ''))}{self.links(r.randint(0, 5)) if r.random() < 0.6 else ''}</{tag}>"
        if kind == "ad":
            tag = r.choice(["div", "div", "aside", "section", "ins"])
            return f"<{tag}{r.choice([' class=ad', self.name('ad', 'ads', 'advert', 'sponsored', 'promo')])}>{r.choice(['{}', '<p>{}</p>', '<a href=/b>{}</a>', '<h4>Sponsored</h4><p>{}</p>'.replace('Sponsored', t(1, 1, ''))]).format(t(2, 30))}</{tag}>"
        if kind == "notice":
            return f"<div{r.choice([' class=cookie-notice', self.name('cookie', 'notice', 'consent', 'newsletter')])}><p>{t(5, 40)}</p>{'<button>' + t(1, 1, '') + '</button>' if r.random() < 0.5 else ''}</div>"
        if kind == "form":
            return f"<form action=/s{self.name('search', 'login', 'newsletter', 'contact')}><label>{t(1, 4, '')}</label><input name=q>{'<p>' + t(3, 15) + '</p>' if r.random() < 0.5 else ''}<button>{t(1, 2, '')}</button></form>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            return f"<{tag}{self.name('sidebar', 'related', 'widget', 'aside')}><h3>{t(1, 4, '')}</h3>{self.links(r.randint(2, 8)) if r.random() < 0.6 else ''}{'<p>' + t(4, 40) + '</p>' if r.random() < 0.6 else ''}</{tag}>"
        if kind == "share":
            return f"<div{self.name('share', 'social', 'tags', 'meta')}>{self.links(r.randint(2, 6))}</div>"
        if kind == "comments":
            one = r.choice(["<li{}><p>{}</p></li>", "<div{}><b>x</b><p>{}</p></div>", "<article{}><p>{}</p></article>"])
            inner = "".join(one.format(r.choice([" class=comment", self.name("comment", "reply")]), t(4, 60)) for _ in range(r.randint(1, 8)))
            tag = r.choice(["section", "div", "ol"])
            return f"<{tag}{r.choice([' id=comments', self.name('comments', 'commentlist', 'discussion')])}><h3>{t(1, 3, '')}</h3>{inner}</{tag}>"
        tag = r.choice(["footer", "footer", "div"])
        return f"<{tag}{self.name('footer', 'copyright', 'legal')}>{r.choice(['{}', '<p>{}</p>', '<div><p>{}</p></div>']).format('&copy; ' + t(2, 35))}{self.links(r.randint(0, 8)) if r.random() < 0.5 else ''}</{tag}>"

    def article(self) -> str:
        r = self.r
        t = lambda a, b, e=".": self.text(r.randint(a, b), _YES, e)
        parts = []
        if r.random() < 0.8:
            h = r.choice(["h1", "h1", "h2"])
            parts.append(f"<{h}>{t(1, 14, r.choice(['', '.']))}</{h}>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            x = r.random()
            size = r.choice([(1, 4), (5, 20), (20, 80), (60, 200)])
            if x < 0.72:
                inline = r.choice(["{}", "{}", "<b>{}</b>", "{} <a href=/z>" + t(1, 3, "") + "</a>", "<b>{}.<br>", "<em>{}</em>"])
                parts.append(f"<p>{inline.format(t(*size))}{r.choice(['</p>', '</p>', ''])}")
            elif x < 0.78:
                parts.append(f"<h2>{t(1, 6, '')}</h2>")
            elif x < 0.84:
                parts.append("<ul>" + "".join(f"<li>{t(2, 15)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.88:
                parts.append(f"<blockquote><p>{t(5, 40)}</p></blockquote>")
            elif x < 0.91:
                parts.append("<table>" + "".join(f"<tr><td>{t(1, 5, '')}</td><td>{t(1, 5, '')}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.93:
                parts.append(f"<div>{t(*size)}</div>")
            elif x < 0.95:
                parts.append(f"<pre>{t(3, 20)}</pre>")
            else:
                parts.append(self.boilerplate("in"))
        inner = "".join(parts)
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        out = f"<{tag}{self.name('article', 'content', 'post', 'entry-content', 'story-body')}>{inner}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            out = f"<{r.choice(['div', 'main', 'section'])}{self.name('main', 'content', 'page', 'container')}>{out}{self.boilerplate('end') if r.random() < 0.4 else ''}</div>"
        return out

    def page(self) -> str:
        r = self.r
        some = lambda place, most: "".join(self.boilerplate(place) for _ in range(r.randint(0, most)))
        body = some("top", 4) + some("side", 1) + (self.article() if r.random() < 0.96 else "") + some("end", 2) + some("side", 1) + some("foot", 2)
        if r.random() < 0.3:
            body = f"<div{self.name('wrapper', 'page', 'container')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>x</title><script>a()</script></head><body>{body}</body></html>"


def trained(pages: int = PAGES, seed: int = 7, trees: int = TREES) -> Trees:
    """The ensemble, from ``pages`` generated pages."""
    generator = Generator(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page = Page(generator.page())
        texts = [html.unescape(t) for _, t, _ in page.texts]
        yes, all_ = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for (node, _, _), text in zip(page.texts, texts):
            size = len(text)
            yes[node] += size * (_YES in text)
            all_[node] += size * (_YES in text or _NO in text)
        for k in range(len(page.tag) - 1, 0, -1):
            yes[page.parent[k]] += yes[k]
            all_[page.parent[k]] += all_[k]
        x, own = features(page, [t.replace(_YES, "").replace(_NO, "") for t in texts])
        some = all_ > 0
        xs.append(x[some])
        ys.append((yes[some] > 0.5 * all_[some]).astype(float))
        ws.append(0.3 + np.log1p(own[some]) / 4)
    return Trees(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws), trees)


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or trained())

    def run(batch):
        texts = main_texts([s or "" for s in batch.column("text").to_pylist()], shared.value)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.text_rows(pages.select("page_id", "url", F.col("html").cast("string").alias("text")), run, f"page_id {dict(pages.dtypes)['page_id']}, url {dict(pages.dtypes)['url']}, text string, n_chars long")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
