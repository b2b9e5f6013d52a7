"""Density decides what a page shows, by a slow reckoning over the same tree."""

import math
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from silvergrain.llm import html


def slow_kept(tree, gone, marked):
    """Numbers of the elements that are roots of what is shown; every figure is reckoned anew from the tree."""
    n = len(tree.tag)
    kids = {i: [j for j in range(1, n) if tree.parent[j] == i and not gone[j]] for i in range(n)}
    block = lambda i: tree.tag[i] not in html.INLINE
    below = lambda i: [i, *(x for j in kids[i] for x in below(j))]
    own = lambda i: sum(len(" ".join(c.split())) for c in tree.content[i] if isinstance(c, str))
    linked = lambda i: tree.tag[i] == "a" or i > 0 and linked(tree.parent[i])
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    chars = {i: sum(own(j) for j in below(i)) for i in range(n)}
    link_chars = {i: sum(own(j) for j in below(i) if linked(j)) for i in range(n)}
    counts = lambda j: block(j) and tree.tag[j] not in html.VOID or tree.tag[j] == "a"
    tags = {i: sum(counts(j) for j in below(i)[1:]) for i in range(n)}
    link_tags = {i: sum(tree.tag[j] == "a" for j in below(i)[1:]) for i in range(n)}

    def density(i):
        if gone[i] or not chars[i] or not block(i):
            return 0.0
        d, share = chars[i] / max(1, tags[i]), link_chars[body] / chars[body]
        if share:
            base = math.log(chars[i] / max(1, chars[i] - link_chars[i]) * link_chars[i] + share * chars[i] + math.e)
            d *= max(0.0, math.log(chars[i] / max(1, link_chars[i]) * max(1, tags[i]) / max(1, link_tags[i]))) / math.log(base) if base > 1 else 1.0
        return d

    spread = lambda i: sum(density(j) if block(j) else spread(j) for j in kids[i])
    total = lambda i: spread(i) or density(i)
    lead = max((i for i in range(body, n) if i == body or not gone[i] and not marked[i]), key=lambda j: (round(total(j), 9), -j))
    path = [lead]
    while path[-1] > body:
        path.append(tree.parent[path[-1]])
    threshold = min(density(i) for i in path if block(i) or i == lead)
    beside = {k for i in path[1:] for k in kids[i] if k not in path and density(k) >= threshold and (total(k) >= 0.5 * total(lead) or tree.tag[k] in ("h1", "h2", "h3", "h4", "h5", "h6"))}
    return {lead} | beside


@pytest.mark.parametrize("seed", range(25))
def test_small_pages_equal_the_slow_reckoning(seed):
    rng = random.Random(seed)
    words = lambda: " ".join("w" * rng.randint(2, 9) for _ in range(rng.randint(1, 25)))

    def node(depth):
        tag = rng.choice(["div", "section", "p", "ul", "h2", "a", "b", "span", "aside", "form"])
        inner = words() if depth == 0 or tag in ("p", "h2", "a", "b") else "".join(node(depth - 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inner}</{tag}>"

    page = "<body>" + "".join(node(3) for _ in range(3)) + "</body>"
    tree = html.parse(page)
    gone, marked = html._marks(tree)
    roots = slow_kept(tree, gone, marked)
    kept = [False] * len(tree.tag)
    for i in range(len(tree.tag)):
        kept[i] = (i in roots or i > 0 and kept[tree.parent[i]]) and not gone[i] and not marked[i]
    assert html.extract(page) == html._write(tree, kept, gone)


def test_headings_lists_and_formatting_stay_without_an_article_tag():
    text = "A sentence of the story that is long enough to be read as one. " * 3
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div><h1>A heading</h1><p><b>{text}<br>{text}</b><p>{text}</div><div><a href=z>Terms</a></div></body>"
    assert html.extract(page) == " ".join(["A heading", *[text.strip()] * 3])


def bare(page):
    """A page without classes, ids and telling tags."""
    page = re.sub(r"<(/?)(nav|aside|footer|header|article|main|section|menu)\b", r"<\1div", page)
    return re.sub(r"(<div)\s+[^>]*>", r"\1>", page)


def test_density_finds_the_article_without_tags_and_names(data, monkeypatch):
    """The generator's articles, from pages that tell nothing but text, tags and links; most are lost without density."""
    pages = [p for p in pq.read_table(f"{data.replace('0.001', '0.01')}/pages.parquet")["html"].to_pylist() if p]
    want = [html.extract(p) for p in pages]
    assert sum(html.extract(bare(p)) == w for p, w in zip(pages, want, strict=True)) >= 0.95 * len(pages)
    monkeypatch.setattr(html, "_densities", lambda tree, gone, body: ([1.0] * len(tree.tag), [1.0] * len(tree.tag)))
    assert sum(html.extract(bare(p)) == w for p, w in zip(pages, want, strict=True)) <= 0.05 * len(pages)


def test_parts_of_an_article_and_its_heading_stay_together():
    text = "A sentence of the story that is long enough to be read as one. " * 3
    part = f"<div><p>{text}</p><p>{text}</p><p>{text}</p></div>"
    page = f"<body><div><a href=x>Home</a></div><h1>Heading of it all</h1>{part}<div><a href=y>More</a></div>{part}<div><a href=z>Terms</a> of use</div></body>"
    assert html.extract(page) == " ".join(["Heading of it all", *[text.strip()] * 6])


def test_marks_are_second_to_density():
    text = "A sentence of the story that is long enough to be read as one. " * 3
    page = f"<body><div class=comments><p>{text * 4}</p><p>{text * 4}</p></div><div><p>{text}<p>{text}<aside>{text}</aside></div></body>"
    assert html.extract(page) == " ".join([text.strip()] * 2)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<p><table><td>" + "<div>" * 50_000 + "x", "<table>" + "<tr><td>x" * 30_000, "<ul>" + "<li><ul>" * 30_000, "<td><b>" * 30_000 + "</p>" * 30_000])
def test_nesting_takes_linear_time(page):
    start = time.monotonic()
    html.extract(page[: len(page) // 10])
    middle = time.monotonic()
    html.extract(page)
    assert time.monotonic() - middle < max(2.0, 30 * (middle - start))
