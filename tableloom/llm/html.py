"""Main text of web pages from text-to-tag ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pick, slices, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article's text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class, id and role names of what surrounds an article.
DROPPED_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments complementary consent"
    " contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter"
    " notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription toolbar widget widgets alert".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Words that may stand beside such a name in a compound one (site-footer, comment-list); beside any other word it names something else.
BESIDE_NAMES = frozenset(
    "site page post entry article story blog main top bottom left right primary secondary global inner outer user reader readers wrapper wrap container holder box"
    " block area section list item items link links bar slot unit rail panel buttons button group content posts stories articles inline sticky floating mobile desktop this media".split()
)
#: Elements whose id names what they are; in others it is an anchor.
IDENTIFIED = frozenset("aside div dl ol table ul".split())
#: Elements that hold lines which belong together.
CONTAINERS = frozenset("article aside blockquote body details div dl figure main ol section table ul".split())
#: Elements whose start ends an open one of the second kind.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form header html main nav section table ul ol dl blockquote".split())


class Lines(HTMLParser):
    """Parser events gathered into lines: one for each block of text.

    A line is (text, tags before and in it, characters inside links, region,
    heading, container, names); region is the number of the outermost article
    or main element around it, 0 for none; container that of the innermost
    element of CONTAINERS; names are the numbers of the elements around it that
    their attributes name as no part of the article, judged at the end.  Text
    in dropped elements makes no line.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, int, tuple[int, ...]]] = []
        self.open: list[tuple[str, bool, int, bool, int, tuple[int, ...]]] = []  # tag, dropped, region, in a header of an article, container, names
        self.comments: list[bool] = []  # of each named element, whether it holds comments
        self.regions = self.containers = self.tags = self.linked = 0
        self.parts: list[str] = []
        self.place = (0, False, 0, ())  # region, heading, container and names of the line's first text

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, *self.place))
            self.tags = self.linked = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES:
            self.leave(CLOSES[tag])
        elif tag in BLOCKS:
            self.leave({"p"})
        _, dropped, region, header, container, names = self.open[-1] if self.open else ("", False, 0, False, 0, ())
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        if not dropped:
            dropped = tag in DROPPED or tag == "header" and not region or self.hidden(dict(attrs))
            header = header or tag == "header" and bool(region)
        if not dropped and (found := self.named(tag, dict(attrs))):
            names = (*names, len(self.comments))
            self.comments.append(not found.isdisjoint(COMMENT_NAMES))
        if tag in ("article", "main") and not dropped and not region:
            self.regions += 1
            region = self.regions
        self.open.append((tag, dropped, region, header, container, names))

    @staticmethod
    def hidden(attrs: dict[str, str | None]) -> bool:
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I))

    @staticmethod
    def named(tag: str, attrs: dict[str, str | None]) -> set[str]:
        """The names among attributes of something around the article: whole tokens, or compounds of such a name and words of BESIDE_NAMES."""
        if tag in ("html", "body", "main") or tag in HEADINGS:
            return set()
        found = set()
        for token in " ".join(attrs.get(k) or "" for k in ("class", "id", "role") if k != "id" or tag in IDENTIFIED).split():
            parts = re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
            if all(p in DROPPED_NAMES or p in BESIDE_NAMES for p in parts):
                found |= DROPPED_NAMES.intersection(parts)
        return found & COMMENT_NAMES if tag == "article" else found

    def kept(self) -> list[tuple[str, int, int, int, bool, int]]:
        """Lines outside named elements; one that holds most of the text is the article's wrapper if no region is elsewhere."""
        total = sum(len(x[0]) for x in self.lines)
        sizes = [0] * len(self.comments)
        for text, *_, names in self.lines:
            for k in names:
                sizes[k] += len(text)
        around = {k for k, size in enumerate(sizes) if self.comments[k] or 2 * size <= total or any(x[3] and k not in x[6] for x in self.lines)}
        out, tags = [], 0
        for text, n, linked, region, heading, container, names in self.lines:
            tags += n
            if around.isdisjoint(names):
                out.append((text, tags, linked, region, heading, container))
                tags = 0
        return out

    def leave(self, tags: set[str]) -> None:
        """End an open element of these within the innermost scope."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self.end_line()
                del self.open[k:]
                if len(tags) == 1:
                    return
            elif self.open[k][0] in SCOPES:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag not in BLOCKS and any(t in BLOCKS for t, *_ in self.open[k + 1 :]):
                    # an inline element around blocks ends without them
                    del self.open[k]
                else:
                    del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        _, dropped, region, header, container, names = self.open[-1] if self.open else ("", False, 0, False, 0, ())
        heading = any(t in HEADINGS for t, *_ in self.open)
        if dropped or header and not heading:
            return
        if not self.parts or self.parts == [" "]:
            self.place = (region, heading, container, names)
        self.parts.append(data)
        if any(t == "a" for t, *_ in self.open):
            self.linked += len(data)


def lines_of(html: str) -> list[tuple[str, int, int, int, bool, int]]:
    for source in (html, html.replace("<![", "&lt;![")):  # the parser refuses unknown marked sections
        parser = Lines()
        try:
            parser.feed(source)
            parser.close()
        except AssertionError:
            continue
        parser.end_line()
        return parser.kept()
    return []


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian of three sigmas either side."""
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(values)), kernel, "full")[radius : radius + len(values)]
    return np.convolve(values, kernel, "full")[radius : radius + len(values)] / total


def runs(values: np.ndarray) -> list[np.ndarray]:
    """Numbers of neighbouring lines with equal values."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values)) + 1)


def clusters(links: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring lines that hold a seed: lines over the threshold.  Lines of links, unless they are seeds, part runs."""
    return [r for r in runs(links & ~seeds) if seeds[r].any()]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of a page: blocks of text joined by single spaces."""
    lines = lines_of(html or "")
    if not lines:
        return ""
    ratio = np.array([max(0, len(text) - linked) / max(1, tags) for text, tags, linked, *_ in lines])
    smoothed = smooth(ratio, sigma)
    links, size = np.array([(2 * linked > len(text), len(text)) for text, _, linked, *_ in lines]).T
    links = links.astype(bool)
    region, headings, container = (np.array([x[k] for x in lines]) for k in (3, 4, 5))
    seeds = smoothed >= min(smoothed.std(), smoothed.max())
    for r in runs(links):  # prose beside a list of links lifts its ends only
        seeds[r] &= not links[r[0]] or bool(seeds[r].all())
    # article and main elements weigh in: nothing outside them counts if they hold most of the content
    inside = region > 0
    if 2 * size[seeds & inside].sum() < size[seeds].sum():
        inside[:] = False
        region[:] = 0
    chosen = np.zeros(len(lines), bool)
    for r in sorted({*region[inside].tolist()}) or [0]:
        own = np.flatnonzero(region == r)
        found = [own[c] for c in clusters(links[own], seeds[own])]
        for c in found:
            at = np.flatnonzero(seeds[c])
            chosen[c if r else c[at[0] : at[-1] + 1]] = True
        # headings belong to what follows them, short lines beside content in one element to that
        beside = np.isin(container[own], container[own][seeds[own] & ~headings[own]]) & ~links[own]
        for k, after in zip(own[-2::-1].tolist(), own[:0:-1].tolist()):
            if headings[k]:
                chosen[k] = chosen[after]
        chosen[own[beside]] = True
    return " ".join(x[0] for x, c in zip(lines, chosen.tolist(), strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page.

    Input: `page_id`, `url`, `html`; further columns are ignored.  Events of
    the standard library's streaming parser are gathered into lines, one a
    block; lines inside menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments are dropped: these elements, and others
    whose class, id or role is the whole name of such a thing.  The others'
    text-to-tag ratios are smoothed by a Gaussian; those over a threshold (one
    standard deviation) are seeds.  Clusters are runs of lines between lines of
    links, and those with a seed are content, with the short lines that share
    an element with a seed and the headings before them.  Article and main
    elements weigh in only as a whole: if they hold most of the seeds' text,
    clusters elsewhere do not count, and theirs are not trimmed to the seeds.
    Null or empty html gives an empty text and n_chars 0; a broken page gives
    what the parser can read of it; equal pages give equal texts.  One row
    out for each row in, repeated rows included; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8_000_000):
            found = [main_text(x) for x in texts(batch.column("html"))]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    d = pick(pages, page_id="bigint", url="string", html="string")
    return d.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
