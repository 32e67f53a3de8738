"""Main text of pages written by hand."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pytest

from tableloom.llm import queries
from tableloom.llm.html import lines_of, main_text, smooth

BODY = "This sentence is part of the article and long enough to count as text of its own, so it stays. " * 2
P = BODY.strip()

PAGES = {
    "article": (f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></article><footer>© me</footer></body></html>", f"Title {P} {P}"),
    "entities": (f"<body><main><p>{BODY} a &lt; b &amp;&nbsp;c &#8364;</p></main></body>", f"{P} a < b & c €"),
    "inline markup": (f"<body><article><p>{BODY}Some <b>bold</b> and <a href=x>linked</a>\n  words</p></article></body>", f"{P} Some bold and linked words"),
    "scripts and styles": (f"<head><title>t</title><style>p {{}}</style></head><body><article><script>var x = '<p>no</p>';</script><p>{BODY}</p><noscript>on</noscript></article></body>", P),
    "comments of readers": (f"<body><article><p>{BODY}</p></article><div class='comments'><article><p>{BODY}{BODY}{BODY}</p></article></div></body>", P),
    "sidebar and forms": (f"<body><div class=sidebar><p>{BODY}</p></div><article><p>{BODY}</p><form><label>Name</label><input></form></article><aside>{BODY}</aside></body>", P),
    "cookie notice": (f"<body><div id='cookie-notice'><p>We use cookies. {BODY}</p></div><article><p>{BODY}</p></article></body>", P),
    "no article element": (f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><p>{BODY}</p><p>{BODY}</p></div><div class=footer>end</div></body>", f"{P} {P}"),
    "empty": ("<html><body><nav>only menu</nav></body></html>", ""),
    "unclosed": (f"<body><article><p>{BODY}<p>{BODY}", f"{P} {P}"),
    "markup comment": (f"<body><article><!-- hidden --><p>{BODY}</p></article></body>", P),
}

WHOLE = {
    "sibling articles": (f"<body><article><p>{BODY}</p></article><article><p>{BODY}</p></article></body>", f"{P} {P}"),
    "article in main": (f"<body><main><h1>Title</h1><p>{BODY}</p><article><p>{BODY}</p></article></main></body>", f"Title {P} {P}"),
    "article with links at its end": (f"<body><article><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p>" + "<p><a href=x>Other story</a></p>" * 6 + "</article></body>", f"{P} {P} {P}"),
    **{f"wrapper {c}": (f"<body><div class='{c}'><p>{BODY}</p></div></body>", P) for c in ("layout has-sidebar", "no-comments", "ad-free", "widget")},
    "named by a part": (f"<body><article><p>{BODY}</p><div class=post-footer><p>{BODY}</p></div></article></body>", P),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_pages(name):
    html, want = WHOLE[name]
    assert main_text(html) == want


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert main_text(html) == want


def test_nothing():
    assert main_text(None) == main_text("") == main_text(" \n") == ""


def test_smoothing_keeps_a_constant_and_spreads_a_peak():
    assert np.allclose(smooth(np.full(9, 3.0), 1.0), 3.0)
    peak = smooth(np.eye(1, 11, 5)[0], 1.0)
    assert peak.argmax() == 5 and 0 < peak[4] < peak[5] and np.allclose(peak, peak[::-1])


def test_lines_carry_tags_and_links():
    lines = lines_of("<div><p>one <a href=x>two</a></p></div>")
    assert [(t, linked) for t, _, linked, *_ in lines] == [("one two", 3)]


LINKS = "<li><a href=1>One place</a></li><li><a href=2>Two places</a></li><li><a href=3>Three</a></li>"
#: Pages on which ratios, not names of elements, decide.
BY_RATIO = {
    "menu in the article": (f"<body><article><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></article></body>", f"Title {P} {P}"),
    "list of links in the article": (f"<body><article><p>{BODY}</p><p>Short.</p><p>{BODY}</p><div><h3>More</h3><ul>{LINKS}</ul></div></article></body>", f"{P} Short. {P}"),
    "links between paragraphs": (f"<body><article><p>{BODY}</p><ul>{LINKS}</ul><p>{BODY}</p><p>End.</p></article></body>", f"{P} {P} End."),
    "labels after links": (f"<body><article><p>{BODY}</p><p>{BODY}</p><div><ul>{LINKS}</ul></div><div><span>3 of 5</span></div></article></body>", f"{P} {P}"),
    "no article": (f"<body><div><ul>{LINKS}</ul></div><div><h2>Title</h2><p>{BODY}</p><p>So it ends.</p></div><div><ul>{LINKS}</ul></div><div>All pages</div></body>", f"Title {P} So it ends."),
}
#: Elements of an article whose names only contain the name of something else.
KEPT_NAMES = ("section id=search-algorithms", "div class='related-work'", "section id=comments", "div class='legal-history'", "div class='no-share'", "section class='notice-periods'")
DROPPED = ("div class='ad'", "div id='cookie-notice'", "ul class='share-buttons'", "div class='related-posts'", "section class='comment-list'", "div class='siteFooter'", "p class='advert'")


@pytest.mark.parametrize("name", BY_RATIO)
def test_ratios_decide(name):
    html, want = BY_RATIO[name]
    assert main_text(html) == want


@pytest.mark.parametrize("start", KEPT_NAMES)
def test_names_inside_longer_names_stay(start):
    assert main_text(f"<body><article><p>{BODY}</p><{start}><h2 id=share>Part</h2>{BODY}</{start.split()[0]}><p>{BODY}</p></article></body>") == f"{P} Part {P} {P}"


@pytest.mark.parametrize("start", DROPPED)
def test_whole_names_go(start):
    assert main_text(f"<body><article><p>{BODY}</p><{start}>{BODY}</{start.split()[0]}><p>{BODY}</p></article></body>") == f"{P} {P}"


def plain(html: str | None) -> str:
    """The article element of the driver's pages, by patterns alone."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", found[1])) if found else ""
    return " ".join(entities.unescape(text).split())


def test_all_pages_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op2_html(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in pages}
