"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page as events. Text is collected into lines, one per block
element, and every line counts the characters and tags it took. The ratio of text to tags is smoothed
along the page with a Gaussian; two clusters of the smoothed ratios give the threshold between
content and the rest. The container that holds most of the content lines is the content region, and
all its lines are the page's text, short ones too, except those in parts that are no article.

Names of classes and ids only mark parts; a marked part that holds most of the page's content lines is a
wrapper and stays, unless its name is that of comments and the like. Levels are numbered as they open, so the lines
below a level are a range of numbers and sums go up the tree once: work is linear in the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a line.
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section
summary table tbody td tfoot th thead title tr ul""".split())
#: Elements whose text is never part of an article.
OUTSIDE = frozenset("""head title script style noscript template nav footer aside button select option textarea input label iframe
object embed svg math canvas audio video menu dialog""".split())
#: Elements without content, which never open a level.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may hold the article.
HOLDER = frozenset("article main section div td body".split())
#: Elements that a following sibling of the same group closes.
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: What stops that.
LIMIT = frozenset("table ul ol dl div article section main body nav form select blockquote aside header footer td".split())
#: Names that mark a part of a page which is no article, as whole words of class, id or role.
NOISE = frozenset("""ad ads adv advert advertisement advertising banner billboard breadcrumb breadcrumbs byline comment comments
commentlist consent cookie cookies copyright disqus disclaimer dropdown footer form gdpr header hidden masthead menu menubar modal
nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related
replies reply respond search share sharing shoutbox sidebar skip skyscraper social sponsor sponsored subscribe subscription
tags teaser toolbar tracking trending widget widgets complementary contentinfo alert""".split())
#: Of these, those that are no wrapper however much they hold.
FIRM = frozenset("""comment comments commentlist disqus reply replies respond related recommended trending teaser tags consent
cookie cookies gdpr advert advertisement advertising sponsored promo promoted promotion copyright disclaimer breadcrumb
breadcrumbs newsletter skyscraper billboard shoutbox""".split())
#: A name that begins so tells of a part elsewhere.
ABOUT = frozenset("no has with without".split())
#: Elements of text, which a compound name such as share-price does not mark.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre span em strong b i a".split())
_NAME = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
#: Gaussian smoothing, in lines.
SIGMA = 1.0


@dataclass
class Line:
    text: str
    tags: int
    level: int
    outside: bool
    marked: int
    ratio: float = 0.0


@dataclass
class Level:
    tag: str
    number: int
    outside: bool
    marked: int = 0  # the nearest level around that a name marks
    named: bool = False  # inside of article or main
    stop: int = 0  # the place of the nearest level that a start tag may close, or that stops it
    limit: int = 0  # the place of the nearest level that stops inline end tags


def _noise(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """`firm` for a part that is no article, `marked` for one that its name only makes likely to be none, else empty."""
    found = "marked" if tag == "form" else ""
    for name, value in attrs:
        if name in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                # "contentAd" and "content-ad" are both (content, ad)
                parts = _NAME.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token).lower())
                hits = NOISE.intersection(parts)
                if not hits or parts[0] in ABOUT or (tag in TEXTUAL and len(parts) > 1):
                    continue
                if hits == {"header"} and not {"article", "entry", "post", "story"}.isdisjoint(parts):
                    continue  # the title of an article
                if hits & FIRM:
                    return "firm"
                found = "marked"
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "firm"
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "firm"
    return found


class _Lines(HTMLParser):
    """Lines of a page, fed event by event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.levels: list[Level] = [Level("", 0, False)]
        self.parent: list[int] = [0]  # of each level ever opened
        self.around: dict[int, int] = {0: 0}  # marked level -> the marked level around it
        self.places: dict[str, list[int]] = {}  # tag -> places of its open levels
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = 0
        self.holders: dict[int, str] = {0: ""}

    def _end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            top = self.levels[-1]
            self.lines.append(Line(text, self.tags, top.number, top.outside, top.marked))
            self.tags = 0
        self.text = []

    def _cut(self, depth: int) -> None:
        for v in reversed(self.levels[depth:]):
            self.places[v.tag].pop()
        del self.levels[depth:]

    def _pop_to(self, depth: int) -> None:
        self._end_line()
        self._cut(depth)

    def handle_starttag(self, tag, attrs):
        i = self.levels[-1].stop
        while i > 0:
            open_tag = self.levels[i].tag
            if tag in CLOSED_BY.get(open_tag, ()):
                self._pop_to(i)
                break
            if open_tag in LIMIT:
                break
            i = self.levels[i - 1].stop
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        top, number, place = self.levels[-1], len(self.parent), len(self.levels)
        kind = _noise(tag, attrs)
        # a header inside the article holds its title; one of the page is no article
        outside = top.outside or tag in OUTSIDE or kind == "firm" or (tag == "header" and not top.named)
        marked = top.marked
        if kind == "marked" and not outside:
            self.around[number] = marked
            marked = number
        if (outside and not top.outside) or marked != top.marked:
            self._end_line()
        stops = tag in LIMIT or tag in CLOSED_BY
        self.levels.append(Level(tag, number, outside, marked, top.named or tag in ("article", "main"),
                                 place if stops else top.stop, place if tag in LIMIT else top.limit))
        self.parent.append(top.number)
        self.places.setdefault(tag, []).append(place)
        if tag in HOLDER:
            self.holders[number] = tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        places = self.places.get(tag)
        if places:
            i = places[-1]
            if tag not in LIMIT and tag not in BLOCK and self.levels[-1].limit > i:
                return  # an inline end tag doesn't reach out of its container
            here, before = self.levels[i], self.levels[i - 1]
            if any(v.tag in BLOCK for v in self.levels[i:]) or (here.outside and not before.outside) or here.marked != before.marked:
                self._pop_to(i)
            else:
                self._cut(i)
        elif tag in BLOCK:
            self._end_line()

    def handle_data(self, data):
        self.text.append(data)

    def parse_html_declaration(self, i):
        # marked sections are comments in HTML; the parser's own reading of them raises on malformed ones
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines; the kernel is cut at the page's ends."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    total = np.convolve(values, kernel)[reach:reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Midpoint of two clusters of values (2-means, started at the extremes)."""
    lo, hi = float(values.min()), float(values.max())
    for _ in range(30):
        cut = (lo + hi) / 2
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean()), float(high.mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def read_lines(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    return parser


def _content(lines: list[Line], out: list[bool]) -> list[Line]:
    """The lines whose smoothed ratio is that of content; all lines inside if none is."""
    smoothed = smooth(np.array([0.0 if o else v.ratio for v, o in zip(lines, out)]))
    cut = threshold(smoothed)
    inside = [(v, s) for v, o, s in zip(lines, out, smoothed) if not o]
    return [v for v, s in inside if s >= cut] or [v for v, _ in inside]


def _weights(page: _Lines, content: list[Line], of=lambda v: len(v.text)) -> list[int]:
    """Characters of content at or below each level; children have larger numbers than their parents."""
    weight = [0] * len(page.parent)
    for v in content:
        weight[v.level] += of(v)
    for n in range(len(weight) - 1, 0, -1):
        weight[page.parent[n]] += weight[n]
    return weight


def main_text(html: str | None) -> str:
    """The article of a page, one line per block; empty if there is none."""
    page = read_lines(html or "")
    lines = page.lines
    if not lines:
        return ""
    for line in lines:
        line.ratio = len(line.text) / max(line.tags, 1)
    out = [v.outside for v in lines]
    if len(page.around) > 1:
        # a marked part that holds most of the content, by lines and by characters, is a wrapper
        content = _content(lines, out)
        weight, count = _weights(page, content), _weights(page, content, lambda v: 1)
        dropped = {0: False}
        for n, around in sorted(page.around.items())[1:]:
            dropped[n] = dropped[around] or 2 * weight[n] <= weight[0] or 2 * count[n] <= count[0]
        out = [v.outside or dropped[v.marked] for v in lines]
    content = _content(lines, out)
    if not content:
        return ""
    # a named article or main element that holds most of the content, else the deepest container that does
    weight = _weights(page, content)
    total = weight[0]
    named = [n for n, tag in page.holders.items() if tag in ("article", "main") and weight[n] and 2 * weight[n] >= total]
    holding = named or [n for n in page.holders if 10 * weight[n] >= 9 * total]
    region = max(holding, key=lambda n: (weight[n], n)) if named else max(holding)
    last = list(range(len(page.parent)))  # the last level below each one
    for n in range(len(last) - 1, 0, -1):
        last[page.parent[n]] = max(last[page.parent[n]], last[n])
    return "\n".join(v.text for v, o in zip(lines, out) if region <= v.level <= last[region] and not o)


def with_main_text(pages: DataFrame, name: str = "main_text", column: str = "html") -> DataFrame:
    """Add `name`: the text of `column`; null and empty pages, and pages without an article, give empty text."""
    @F.arrow_udf("string")
    def extract(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([main_text(v.as_py()) for v in part], pa.string())

    return pages.withColumn(name, extract.asNondeterministic()(F.col(column)))


def page_texts(pages: DataFrame) -> DataFrame:
    """`(page_id, url, text, n_chars)` of every row of `pages`; other columns are ignored."""
    out = with_main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
