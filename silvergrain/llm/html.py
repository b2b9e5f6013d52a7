"""Main text of web pages by composite text density.

A page is parsed into a tree that tolerates missing and stray tags. What is no text of a page by
its nature (scripts, styles, forms, hidden elements, ...) goes first. For every other block element
the density is its characters per tag, adjusted for the characters and tags in links; formatting
inside a block is text, not a tag. A node's density sum adds its children's densities, and the node
with the greatest sum is the article. The least density on its path to the body is the
threshold: subtrees beside the path of at least that density, whose sum comes near the article's
(``NEAR``), are further parts of it, as are headings there.

Tags, roles and the words in a class or id mark furniture (menus, sidebars, notices, adverts,
comments). Marks are second to density: a marked element can't be the article, and goes where it
lies inside what density chose. Where the article is as short as the notices around it,
density chooses the body, and marks alone tell them apart.

Each page is parsed, measured and written by itself, in time proportional to its length whatever
its nesting, so pages of any length need no more than a multiple of their own size.

Edge cases: null and empty html, and pages without text, give an empty text; unfinished
tags, comments and scripts at the end of a cut page hold no text; stray quotes in a tag don't
keep it open, and a tag left open by a quoted value ends at its first ``>``; repeated rows give equal
texts; an empty table stays empty; other columns pass through.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: For an opening tag: the open elements it closes, and those at which looking for them stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NO_TEXT = RAW | frozenset("head form button select option datalist input label object embed applet canvas svg math audio video map dialog progress meter".split())
FURNITURE_TAGS = frozenset("nav footer aside menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist note".split())
#: Words in a class or id that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip "
    "header masthead topbar footer bottombar copyright legal colophon "
    "sidebar aside rail widget widgets related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay lightbox dialog toast paywall "
    "newsletter subscribe subscription signup login register search form "
    "share sharing social follow tags "
    "comment comments commentlist reply replies respond disqus discussion".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())

#: A subtree beside the article is a part of it if its density sum is at least this share of the article's.
NEAR = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: An attribute as HTML reads it: a quote opens a value only after an equals sign, else it is a character like others.
_ATTRIBUTE_SOURCE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+"
_OPENS = r"<!--|<!|<\?|</?([a-zA-Z][^\s/>]*+)(%s)>|<(?=/?[a-zA-Z])"
_TAG = re.compile(_OPENS % rf"(?:[\s/]++|{_ATTRIBUTE_SOURCE})*+")
#: The same, but any ``>`` ends a tag; for pages in which a quoted value swallows the end of a tag.
_LOOSE_TAG = re.compile(_OPENS % r"[^>]*+")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))?+)?+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Tree:
    """Nodes in page order; children of a node have greater numbers than it has."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.attributes: list[str] = []
        self.content: list[list[int | str]] = []

    def add(self, tag: str, parent: int, attributes: str = "") -> int:
        n = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        self.content.append([])
        if parent >= 0:
            self.content[parent].append(n)
        return n

    def read(self, n: int) -> dict[str, str]:
        text = self.attributes[n]
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}


class _Open:
    """The stack of open elements, and where in it each tag stands."""

    def __init__(self, root: int):
        self.nodes, self.tags, self.places = [root], ["html"], {"html": [0]}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, at: int) -> None:
        """Close all elements from place ``at`` on."""
        while len(self.nodes) > at:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of ``tags`` above the root, 0 if there is none."""
        return max(p[-1] if (p := self.places.get(t)) else 0 for t in tags)

    def first_above(self, tags: set[str], at: int) -> int:
        """The place of the outermost open element of ``tags`` above ``at``, 0 if there is none."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, at)) < len(p)]
        return min(found, default=0)


def parse(page: str) -> Tree:
    tree = Tree()
    open_ = _Open(tree.add("html", -1))
    at, n, tags = 0, len(page), _TAG

    def text(piece: str) -> None:
        if piece:
            tree.content[open_.nodes[-1]].append(entities.unescape(piece) if "&" in piece else piece)

    while at < n:
        m = tags.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        tag = m[1]
        if tag is None:
            if m[0] == "<":  # a tag that never ends
                if page.find(">", m.end()) < 0:
                    break
                at, tags = m.start(), _LOOSE_TAG
                continue
            end = page.find("-->" if m[0] == "<!--" else ">", m.end() if m[0] != "<!--" else m.start() + 2)
            if end < 0:
                break
            at = end + (3 if m[0] == "<!--" else 1)
            continue
        at, tag = m.end(), tag.lower()
        if page[m.start() + 1] == "/":
            k = open_.last(tag)
            if k and (k >= open_.last("td", "th", "table") or tag in ("tr", "tbody", "thead", "tfoot", "table", "body", "html", "article", "main")):
                open_.cut(k)
            continue
        if tag in ("html", "body", "head") and open_.places.get(tag):
            continue
        if tag == "body":
            open_.cut(1)
        if tag in CLOSES_P and (k := open_.last("p")) > open_.last("td", "th", "table", "button", "object"):
            open_.cut(k)
        if tag in SIBLINGS:
            closed, until = SIBLINGS[tag]
            if k := open_.first_above(closed, open_.last(*until)):
                open_.cut(k)
        node = tree.add(tag, open_.nodes[-1], m[2])
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[2].endswith("/") and tag in ("path", "g", "use", "circle", "rect", "line")):
            open_.push(node, tag)  # a slash at the end of other tags means nothing to HTML
    return tree


def _marks(tree: Tree) -> tuple[list[bool], list[bool]]:
    """Which nodes are no text of the page, with all they hold, and which are marked as furniture, with all they hold."""
    n = len(tree.tag)
    holds_article = [False] * n
    for i in range(n - 1, 0, -1):
        if holds_article[i] or tree.tag[i] in ("article", "main"):
            holds_article[tree.parent[i]] = True
    gone, marked, inside = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = tree.parent[i], tree.tag[i]
        inside[i] = inside[up] or tag in ("article", "main")
        if gone[up] or tag in NO_TEXT and not (holds_article[i] and tag in ("form", "label")):
            gone[i] = True
            continue
        a = tree.read(i) if tree.attributes[i] and tag not in ("body", "html") else {}
        if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
            gone[i] = True
            continue
        if marked[up] or tag in FURNITURE_TAGS or tag == "header" and not inside[up] and not holds_article[i]:
            marked[i] = True
            continue
        words = {w.lower() for k in ("class", "id") if k in a for w in _WORD.findall(a[k])}
        role = a.get("role", "").lower()
        if tag in ("article", "main"):
            marked[i] = bool(words & COMMENT_WORDS)
        elif tag in HEADINGS or tag == "p" and not role:
            marked[i] = bool(words & (FURNITURE_WORDS - {"header", "tags", "toc", "popular", "legal"})) or role in FURNITURE_ROLES
        elif (words & FURNITURE_WORDS or role in FURNITURE_ROLES) and not holds_article[i]:
            marked[i] = not (inside[up] and words & FURNITURE_WORDS <= {"header"} and not role)
    return gone, marked


def _densities(tree: Tree, gone: list[bool], body: int) -> tuple[list[float], list[float]]:
    """(density, density sum) of each node; of inline elements the density is 0."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    block = [t not in INLINE for t in tree.tag]
    for i in range(n):
        if not gone[i]:
            in_link[i] = tree.tag[i] == "a" or (i > 0 and in_link[tree.parent[i]])
            chars[i] = sum(len(" ".join(c.split())) for c in tree.content[i] if isinstance(c, str))
            link_chars[i] = chars[i] if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + (block[i] and tree.tag[i] not in VOID or tree.tag[i] == "a")
            link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    density, total = [0.0] * n, [0.0] * n
    body_share = link_chars[body] / chars[body] if chars[body] else 0.0
    for i in range(n):
        if gone[i] or not chars[i] or not block[i]:
            continue
        density[i] = chars[i] / max(1, tags[i])
        if body_share:
            base = math.log(chars[i] / max(1, chars[i] - link_chars[i]) * link_chars[i] + body_share * chars[i] + math.e)
            ratio = chars[i] / max(1, link_chars[i]) * max(1, tags[i]) / max(1, link_tags[i])
            density[i] *= max(0.0, math.log(ratio)) / math.log(base) if base > 1 else 1.0
    for i in range(n - 1, 0, -1):
        total[tree.parent[i]] += density[i] if block[i] else total[i]
    return density, [t or d for t, d in zip(total, density, strict=True)]


def extract(page: str | None) -> str:
    """The main text: blocks with single spaces, joined by one space."""
    if not page:
        return ""
    tree = parse(page)
    n = len(tree.tag)
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    gone, marked = _marks(tree)
    density, total = _densities(tree, gone, body)
    lead = body
    for i in range(body + 1, n):
        if total[i] > total[lead] and not gone[i] and not marked[i]:
            lead = i
    path = [lead]
    while path[-1] > body:
        path.append(tree.parent[path[-1]])
    on_path = set(path[1:])
    threshold = min(density[i] for i in path if tree.tag[i] not in INLINE or i == lead)
    kept = [False] * n
    for i in range(body, n):
        beside = tree.parent[i] in on_path and i not in on_path and density[i] >= threshold and (total[i] >= NEAR * total[lead] or tree.tag[i] in HEADINGS)
        kept[i] = (i == lead or beside or i > body and kept[tree.parent[i]]) and not gone[i] and not marked[i]
    return _write(tree, kept, gone)


def _write(tree: Tree, kept: list[bool], gone: list[bool]) -> str:
    blocks, run = [], []

    def flush() -> None:
        if run:
            words = "".join(run).split()
            if words:
                blocks.append(" ".join(words))
            run.clear()

    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, k = todo.pop()
        inline = tree.tag[i] in INLINE
        if not k and not inline:
            flush()
        content = tree.content[i]
        while k < len(content):
            c = content[k]
            k += 1
            if isinstance(c, str):
                if kept[i]:
                    run.append(c)
            elif not gone[c]:
                todo.append((i, k))
                todo.append((c, 0))
                break
        else:
            if not inline:
                flush()
    flush()
    return " ".join(blocks)


def extract_pages(pages: DataFrame, html: str = "html", text_name: str = "text", chars_name: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of each and its length in code points."""

    @F.arrow_udf(T.StringType())
    def main_text(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in chunks:
            yield pa.array([extract(p) for p in chunk.to_pylist()], pa.string())

    return pages.withColumn(text_name, main_text(F.col(html))).withColumn(chars_name, F.length(text_name).cast("long"))
