"""HTML extraction: a tree-structured graphical model over the page's elements.

Each block element is a node with three states: content, something else, or a frame that may
hold either; an element's potential comes
from its tag, the words of its class, id and role, the length of its text, its share of link
text and its sentences, and each parent-child pair has a potential of its own. Both are
counted from labelled pages. Sum-product messages, once up and once down the tree, give
every node's marginal, and a text is kept if its node is content with probability 1/2 or
more. The labelled pages are written by rule (training_pages) as long as no table of
labelled ones is given.

Each page is worked on alone, in one pass and with explicit stacks, so deep nesting, long pages
and broken markup cost time in proportion.
"""

from __future__ import annotations

import bisect
import html as _html
import math
import operator
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML's elements, and words that pages use in class, id and role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
HIDDEN = frozenset("head noscript iframe template svg select button canvas object video audio map datalist dialog".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul center details".split())
#: What may stand in a head; anything else ends it, as its end tag and the body's start tag may be left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: Elements whose own text stands for itself: a block of its own, as they hold the whole page.
WHOLE = frozenset(("html", "body"))
#: Opening one of these closes an open one of the set, up to the enclosing list or table.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
AGAINST = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related reply replies respond rss search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets alert complementary contentinfo".split())
FOR = frozenset("article articlebody body content entry main maincontent post story text page hentry blog".split())
TAGS = frozenset("article aside blockquote body div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td text th tr ul span".split())

FRAME, CONTENT, OTHER = range(3)
STATES = 3
NOTHING = [0.0] * STATES
#: Facts that say much the same of an element count in part.
WEIGHT = {"chars": 0.4, "direct": 0.4, "sentences": 0.4, "links": 0.7}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
_COMMENT_END = re.compile(r"--!?>")
_SPECIAL = re.compile(r"""[>"']""")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_TOO_LARGE = re.compile(r"&#[0-9]{8,}")
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'data-y="([01])"')
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


class Scanner:
    """Tags and comments of a page, each found in time that grows with what it takes up."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = source.rfind(">")
        self.specials: list[int] | None = None
        self.ends: list[int] = []

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the first tag from at on; a comment has no name."""
        source = self.source
        while (i := source.find("<", at)) >= 0:
            if source.startswith(("<!", "<?"), i):
                if source.startswith(("<!-->", "<!--->"), i):
                    end = source.index(">", i) + 1  # empty comments
                elif source.startswith("<!--", i):
                    m = _COMMENT_END.search(source, i + 4)
                    end = m.end() if m else len(source)
                else:
                    end = source.find(">", i) + 1 or len(source)
                return i, end, False, "", ""
            if i < self.last and (m := _TAG.match(source, i)):
                end = self._end(m.end())
                return i, end, bool(m[1]), m[2].lower(), source[m.end() : end - 1]
            at = i + 1
        return None

    def _end(self, at: int) -> int:
        """Where a tag ends whose attributes start at: behind the first > that no quotes hold, or else the first at all."""
        if self.specials is None:
            if m := _ATTRIBUTES.match(self.source, at):
                return m.end()
            self._tabulate()
        k = bisect.bisect_left(self.specials, at)
        return self.ends[k] if self.ends[k] else self.source.find(">", at) + 1

    def _tabulate(self) -> None:
        """For the page with a quote left open: the end of a tag from each quote or > on (0: none), from the right."""
        self.specials = [m.start() for m in _SPECIAL.finditer(self.source)]
        self.ends = [0] * (len(self.specials) + 1)
        following: dict[str, int] = {}
        for k in range(len(self.specials) - 1, -1, -1):
            c = self.source[self.specials[k]]
            if c == ">":
                self.ends[k] = self.specials[k] + 1
            else:
                if c in following:
                    self.ends[k] = self.ends[following[c] + 1]
                following[c] = k


class Stack:
    """Open elements, with the places of each name."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {}
        self.hidden = self.links = 0

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, node))
        self.hidden += name in HIDDEN
        self.links += name == "a"

    def nearest(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of one of the names; 0 if none is."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, place: int) -> list[str]:
        """Closes the element at a place and all within; their names."""
        gone = [name for name, _ in self.open[place:]]
        for name in gone:
            self.places[name].pop()
            self.hidden -= name in HIDDEN
            self.links -= name == "a"
        del self.open[place:]
        return gone


class Page:
    """The parsed page: nodes (parent, tag, names, label), and pieces of text with their node."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.names, self.label = [-1], ["html"], [frozenset()], [None]
        #: (node, text, in a link) in page order; None where a block ends.
        self.pieces: list[tuple[int, str, bool] | None] = []
        #: The node of text that stands in the page itself, up to the next block's border.
        self.loose: int | None = None
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, scan = Stack(), Scanner(source)
        at, end = 0, len(source)
        while at < end:
            found = scan.next(at)
            start = found[0] if found else end
            if start > at:
                if stack.hidden and stack.open[-1][0] == "head" and not source[at:start].isspace():
                    stack.close(len(stack.open) - 1)
                if not stack.hidden:
                    self._text(stack.open[-1][1], source[at:start], stack.links > 0)
            if not found:
                break
            _, at, closes, name, attrs = found
            if not name:
                continue
            if not closes and stack.hidden == 1 and name not in IN_HEAD and (place := stack.nearest(("head",))):
                stack.close(place)
            if closes:
                if place := stack.nearest((name,)):
                    if any(gone not in INLINE for gone in stack.close(place)):
                        self._border()
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if name in ("br", "hr"):
                self._border()
            if name in VOID or (attrs.endswith("/") and name not in INLINE and name not in TAGS):
                continue
            if name == "html" and (m := _LABEL.search(attrs)):
                self.label[0] = int(m[1])
            if name == "html" or (name == "body" and stack.nearest(("body",))):
                continue
            shut, until = CLOSES.get(name, (None, None))
            if name in ENDS_P:
                shut, until = {"p"}, {"div", "article", "section", "td", "li", "body", "main", "aside", "blockquote", "form"}
            while shut and (place := stack.nearest(shut)) > stack.nearest(until):
                stack.close(place)
                self._border()
                if name not in ("tr", "tbody"):
                    break
            above = stack.open[-1][1]
            node = above
            words = _hints(attrs) if "=" in attrs else frozenset()
            if name not in INLINE or words & AGAINST:
                node = len(self.parent)
                label = _LABEL.search(attrs) if "data-y" in attrs else None
                self.parent.append(above)
                self.tag.append(name)
                self.names.append(words)
                self.label.append(int(label[1]) if label else None)
            if name not in INLINE:
                self._border()
            stack.push(name, node)

    def _text(self, node: int, text: str, link: bool) -> None:
        """A piece of text of a node; in the page itself, of a nameless block that ends with the next border."""
        if self.tag[node] in WHOLE and (self.loose is not None or not text.isspace()):
            if self.loose is None:
                self.loose = len(self.parent)
                self.parent.append(node)
                self.tag.append("text")
                self.names.append(frozenset())
                self.label.append(None)
            node = self.loose
        self.pieces.append((node, text, link))

    def _border(self) -> None:
        self.loose = None
        if self.pieces and self.pieces[-1] is not None:
            self.pieces.append(None)

    def facts(self) -> list[tuple]:
        """Each node's features, as values of the model's tables."""
        n = len(self.parent)
        chars, linked, sentences, direct = [0] * n, [0] * n, [0] * n, [0] * n
        for piece in self.pieces:
            if piece:
                node, text, link = piece
                size = len(text.strip())
                chars[node] += size
                direct[node] += size
                linked[node] += size * link
                sentences[node] += len(_SENTENCE.findall(text))
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            chars[p] += chars[v]
            linked[p] += linked[v]
            sentences[p] += sentences[v]
        out = []
        for v in range(n):
            names = self.names[v]
            share = linked[v] / chars[v] if chars[v] else 0.0
            out.append(
                (
                    ("tag", self.tag[v] if self.tag[v] in TAGS else "other"),
                    ("against", bool(names & AGAINST)),
                    ("for", bool(names & FOR) and not names & AGAINST),
                    ("chars", min(6, int(math.log2(chars[v] + 1) / 1.6))),
                    ("direct", min(4, int(math.log2(direct[v] + 1) / 2))),
                    ("links", 0 if share < 0.05 else 1 if share < 0.35 else 2 if share < 0.7 else 3),
                    ("sentences", min(4, sentences[v])),
                )
            )
        return out


@lru_cache(maxsize=4096)
def _hints(attrs: str) -> frozenset:
    found = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attrs))
    return frozenset(re.split(r"[^a-z]+", _CAMEL.sub(" ", found).lower())) - {""}


def marginals(page: Page, model: dict) -> list[float]:
    """Each node's probability of content, by sum-product up and then down the tree."""
    n = len(page.parent)
    unary, edge = model["unary"], model["edge"]
    belief = []  # a node's potential, then times its children's messages
    for facts in page.facts():
        x = [0.0] * STATES
        for f in facts:
            for s, value in enumerate(unary.get(f, NOTHING)):
                x[s] += value
        top = max(x)
        belief.append([math.exp(max(v - top, -60.0)) for v in x])
    up: list[list[float]] = [NOTHING] * n
    for v in range(n - 1, 0, -1):
        own, above = belief[v], belief[page.parent[v]]
        m = [sum(map(operator.mul, row, own)) for row in edge]
        scale = sum(m)
        up[v] = m = [x / scale for x in m]
        above[:] = map(operator.mul, above, m)
        scale = sum(above)
        above[:] = [x / scale for x in above] if scale > 1e-200 else [1 / STATES] * STATES
    down: list[list[float]] = [list(model["root"])] * n
    out = [0.0] * n
    for v in range(n):
        if v:
            p = page.parent[v]
            # The parent's belief without this child's message; edges are all positive, so no message is 0.
            rest = [b * d / max(m, 1e-30) for b, d, m in zip(belief[p], down[p], up[v], strict=True)]
            scale = sum(rest)
            rest = [x / scale for x in rest] if scale > 0 else [1 / STATES] * STATES
            down[v] = [sum(r * row[s] for r, row in zip(rest, edge, strict=True)) for s in range(STATES)]
        both = [b * d for b, d in zip(belief[v], down[v], strict=True)]
        scale = sum(both)
        out[v] = both[CONTENT] / scale if scale > 0 else 0.0
    return out


def extract(source: str | None, model: dict) -> str:
    """The page's main text: kept blocks in page order, white space as one space, joined by one space."""
    page = Page(source or "")
    keep = [p >= 0.5 for p in marginals(page, model)]
    blocks, held = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(text)
            held = []
        elif keep[piece[0]]:
            held.append(_unescaped(piece[1]))
    return " ".join(blocks)


def _unescaped(text: str) -> str:
    """The text with its character references decoded; a number beyond all characters gives U+FFFD, however long."""
    if "&#" in text:
        text = _TOO_LARGE.sub("&#1114112", _ZEROS.sub("&#", text))
    return _html.unescape(text)


def fit(pages: list[str]) -> dict:
    """Potentials counted from pages whose elements carry data-y="1" (content) or "0" (not); others inherit.

    What has no mark above it is a frame, which may hold either.
    """
    count: dict = {}
    values: dict = {}
    edge = [[0.1] * STATES for _ in range(STATES)]
    total = [1.0] * STATES
    for source in pages:
        page = Page(source)
        y = states(page)
        for v, facts in enumerate(page.facts()):
            total[y[v]] += 1
            for f in facts:
                count.setdefault(f, [0.5] * STATES)[y[v]] += 1
                values.setdefault(f[0], set()).add(f)
            if v:
                edge[y[page.parent[v]]][y[v]] += 1
    unary = {f: tuple(WEIGHT.get(f[0], 1.0) * math.log(c / (t + len(values[f[0]]))) for c, t in zip(n, total, strict=True)) for f, n in count.items()}
    return {"unary": unary, "edge": [[x / sum(row) for x in row] for row in edge], "root": (0.98, 0.01, 0.01)}


def states(page: Page) -> list[int]:
    """The labelled state of each node."""
    y = [FRAME] * len(page.parent)
    for v, label in enumerate(page.label):
        if label is not None:
            y[v] = CONTENT if label else OTHER
        elif v:
            y[v] = y[page.parent[v]]
    return y


def training_pages(n: int = 600, seed: int = 5) -> list[str]:
    """Labelled pages by rule: articles in various containers, among menus, headers, sidebars, notices, comments."""
    rng = random.Random(seed)
    some = lambda a, b: " ".join("".join(rng.choice("aeioumnrstl") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    said = lambda k: " ".join(some(4, 18).capitalize() + rng.choice(".....!?") for _ in range(k))
    link = lambda: f'<a href="/{some(1, 1)}">{some(1, 3)}</a>'
    y0 = ' data-y="0"'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 8)))
        return rng.choice([f"<nav{y0}><ul>{items}</ul></nav>", f'<div class="{rng.choice(["menu", "navbar", "nav-links", "breadcrumbs"])}"{y0}><ul>{items}</ul></div>', f"<ul{y0}>{items}</ul>", f'<div{y0}>{" ".join(link() for _ in range(6))}</div>'])

    def aside() -> str:
        body = rng.choice([f"<h3>{some(1, 3)}</h3><ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{said(rng.randint(1, 3))}</p>", f"{said(1)}"])
        kind = rng.choice(["sidebar", "widget", "related-posts", "promo", "ad", "advert", "sponsored", "cookie-notice", "banner", "newsletter", "share", "notice"])
        return rng.choice([f"<aside{y0}>{body}</aside>", f'<div class="{kind}"{y0}>{body}</div>', f'<section id="{kind}"{y0}>{body}</section>', f'<aside class="{kind}"{y0}>{body}</aside>'])

    def comments() -> str:
        one = lambda: f'<div class="comment"><b>{some(1, 2)}</b><p>{said(rng.randint(1, 4))}</p></div>'
        return rng.choice([f'<div id="comments"{y0}><h3>{some(1, 2)}</h3>{one()}{one()}</div>', f'<section class="comments"{y0}>{one()}{one()}{one()}</section>', f'<ol class="commentlist"{y0}><li class="comment"><p>{said(2)}</p></li></ol>'])

    def form() -> str:
        return f'<form{rng.choice(["", chr(32) + "class=" + chr(34) + "search" + chr(34)])}{y0}><label>{some(1, 3)}</label><input><p>{said(1)}</p></form>'

    def paragraph() -> str:
        text = said(rng.choice([1, 1, 2, 3, 5]))
        return rng.choice([f"<p>{text}</p>"] * 5 + [f"<p>{text} {link()} {said(1)}</p>", f"<p>{text}", f"<p><b>{text}</b><br>{said(1)}</p>", f"<h2>{some(1, 6)}</h2><p>{text}</p>", f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{said(1)}</li><li>{some(2, 6)}</li></ul>", f"<table><tr><td>{some(1, 3)}</td><td>{some(1, 3)}</td></tr></table>", f"<div>{text}</div>", f"<p>{some(1, 4)}.</p>", f"<pre>{text}</pre>", f"<figure><figcaption>{some(3, 8)}</figcaption></figure>"])

    def article() -> str:
        inner = [rng.choice([f"<h1>{some(2, 9)}</h1>", f"<header><h1>{some(2, 9)}</h1></header>", ""])]
        if rng.random() < 0.25:
            # Articles of many short lines.
            one = rng.choice([lambda: f"<p>{some(1, 3).capitalize()}.</p>", lambda: f"<p>{some(1, 2)}", lambda: f"<div>{some(1, 4)}.</div>", lambda: f"<p>{some(1, 5)}</p>"])
            inner += [one() for _ in range(rng.choice([3, 10, 30, 60]))]
        inner += [paragraph() for _ in range(rng.choice([0, 1, 2, 4, 8, 14]))] or [f"<p>{some(1, 4)}</p>"]
        for extra in (aside, form, comments, menu):
            if rng.random() < 0.12:
                inner.insert(rng.randint(1, len(inner)), extra())
        body = "".join(inner) if rng.random() < 0.85 else f"{inner[0]}<div>{''.join(inner[1:])}</div>"
        return rng.choice([f'<article data-y="1">{body}</article>'] * 3 + [f'<main data-y="1">{body}</main>', f'<main><article data-y="1">{body}</article></main>', f'<div class="{rng.choice(["content", "post", "entry-content", "article-body", "story"])}" data-y="1">{body}</div>', f'<div id="{rng.choice(["content", "main", "article"])}" data-y="1">{body}</div>', f'<section data-y="1">{body}</section>'])

    out = []
    for _ in range(n):
        top = [rng.choice([f"<header{y0}><h2>{some(1, 4)}</h2><p>{some(2, 7)}</p>{menu()}</header>", f'<div class="header"{y0}>{some(1, 4)}{menu()}</div>', ""]), menu()]
        top += [aside() for _ in range(rng.choice([0, 1, 1, 2]))]
        foot = [rng.choice([comments(), ""]), rng.choice([aside(), form(), ""]), rng.choice([f"<footer{y0}><p>&copy; {some(1, 3)} {said(1)}</p>{link()}</footer>", f"<footer{y0}>&copy; {some(1, 2)} &middot; {said(rng.randint(1, 3))}</footer>", f'<div id="footer"{y0}>{said(1)}{link()}</div>'])]
        middle = article() if rng.random() < 0.9 else f'<div class="wrapper">{article()}{aside()}</div>'
        out.append(f"<html><body>{''.join(top)}{middle}{''.join(foot)}</body></html>")
    # Pages of text alone, and text in the page itself beside menus and other matter: by a generator of their own.
    rng = random.Random(seed + 1)
    for _ in range(n // 6):
        bare = "<br>".join(said(rng.choice([1, 1, 2, 4])) for _ in range(rng.choice([1, 2, 5])))
        links = f"<div{y0}>{' | '.join(link() for _ in range(4))}</div>"
        out.append(rng.choice([f'<html data-y="1">{bare}</html>', f'<body data-y="1">{bare}</body>', f'<body data-y="1">{links}{bare}</body>', f'<body data-y="1">{bare}<p>{said(2)}</p>{aside()}</body>', f"<body{y0}>{' | '.join(link() for _ in range(5))}<article data-y=\"1\">{said(3)}</article></body>", f"<body{y0}>{some(1, 2)} <article data-y=\"1\"><p>{said(3)}</p></article></body>"]))
    return out


def _text_rows(model: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(x, model) for x in b["html"]]
            yield b.drop(columns="html").assign(text=text, n_chars=[len(t) for t in text])

    return run


def main_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    labelled: pages to learn from, with data-y marks (unset: training_pages()). Null and empty pages, and pages
    without content, have the text ''; repeated rows and null ids stay; broken markup is read as far as it goes; an
    empty table gives no rows. Other columns are left out.
    """
    model = fit(labelled if labelled is not None else training_pages())
    # Ids pass as text: pandas would make floating-point numbers of them beside a null.
    rows = pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(_text_rows(model), "page_id string, url string, text string, n_chars long")
    return rows.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
