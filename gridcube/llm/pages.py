"""Main text of web pages.

The standard library's parser gives a stream of events; these become lines
(blocks) with their text-to-tag ratio. The ratios are smoothed with a Gaussian
and clustered by a threshold; the articles, or else the smallest region, that hold
the lines above it are the content, without what their elements declare as
boilerplate, whatever its length. Names that articles use as well declare it only
where most of the text is links, and layouts only where most of the page is elsewhere.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import need

# Element names of the HTML standard.
_BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup
option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("""head title script style noscript template svg math iframe object canvas audio video button
select option textarea input label nav footer aside menu dialog""".split())
_REGION = frozenset("article main section div td body".split())
_CLOSES_P = _BLOCK - {"br", "option", "optgroup", "caption"}
#: Elements whose names can mark boilerplate; headings, paragraphs and inline elements are text.
_CONTAINER = frozenset("article center dd details div dl fieldset header li ol section table tbody td tr ul".split())
#: Words that mark boilerplate where a class, id or role has no others but them and the neutral ones.
_MARKED = re.compile(r"""(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|
    menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|complementary|contentinfo|cookies?|consent|
    notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|
    comments?|commentlist|replies|reply|disqus|respond|reviews|discussion|pagination|pager|tags?|widget|toolbar|skip|
    copyright|legal|disclaimer)""", re.X | re.I)
_NEUTRAL = frozenset("""site page main global top bottom left right post posts article articles blog content primary secondary inner
    outer bar box block container wrapper wrap area section list item items link links button buttons icon icons form col column
    text thread user users reader readers customer customers visitor visitors""".split())
#: Of the marked words, the ones that also name a layout around the article.
_LAYOUT = frozenset("nav navbar navigation menu header masthead footer foot sidebar side aside banner toolbar overlay".split())
#: Of the marked words, the ones that articles use as well, for their own parts or for the page as a whole.
_AMBIGUOUS = re.compile("legal|social|discussion|related|recommend.*|tags?|promo.*|disclaimer|header|banner|overlay|toolbar|widget|reviews")


def marked_words(named: str) -> set[str]:
    """The marked words of the names that as a whole are marked."""
    found = set()
    for name in named.split():
        words = [w for w in re.split(r"[\s_-]+", name) if w]
        marked = {w for w in words if _MARKED.fullmatch(w)}
        if all(w in marked or w in _NEUTRAL for w in words):
            found |= marked
    return found


@dataclass
class Mark:
    """An element that is boilerplate for certain or, if not ``certain``, where
    most of its text is links or (``wraps``) where it holds the lesser part of
    the page's articles, or of its text if there are none. ``layout`` is undone
    by an article inside. ``around`` is the mark around it; then its characters:
    in all, in links, in articles."""
    around: int
    layout: bool = False
    certain: bool = False
    wraps: bool = False
    chars: int = 0
    links: int = 0
    in_articles: int = 0


@dataclass
class Line:
    """A block of text: its tags, whether boilerplate elements hold it, the
    element it belongs to, the outermost article or main around it, the mark
    it is in (see Mark), whether it is a main heading, and its characters in links."""
    text: str
    tags: int
    links: int
    dropped: int
    region: int
    article: int
    mark: int
    title: bool


class Lines(HTMLParser):
    """Collects the lines of a page from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # open elements: name, whether boilerplate (see marked), region, article, mark
        self.open: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
        self.at: defaultdict[str, list[int]] = defaultdict(list)    # name: where it is open
        self.marks = [Mark(0)]
        self.around = {0: 0}       # region: the region around it
        self.parts: list[str] = []
        self.tags = self.elements = self.linked = 0

    def updatepos(self, i, j):
        return j        # line numbers are not needed

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, max(1, self.tags), min(self.linked, len(text)), *self.open[-1][1:],
                                       bool(self.at["h1"])))
            self.parts = []
        self.tags = self.linked = 0

    def close_from(self, k):
        for e in self.open[k:]:
            self.at[e[0]].pop()
        del self.open[k:]

    def close_to(self, tag):
        if self.at[tag]:
            self.close_from(self.at[tag][-1])

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
            if tag in _CLOSES_P:
                self.close_to("p")
            if tag in ("article", "main") and not self.open[-1][3]:     # a menu left open ends where the article begins
                first = [self.at[x][0] for x in ("nav", "header", "head", "title") if self.at[x]]
                if first:
                    self.close_from(min(first))
        self.tags += 1
        if tag in _VOID:
            return
        self.elements += 1
        _, dropped, region, article, mark = self.open[-1]
        if tag in ("article", "main"):
            if dropped == 1:
                dropped = 0
            while self.marks[mark].layout:
                mark = self.marks[mark].around
        if not dropped:
            dropped = 2 if tag in _DROPPED or tag == "header" and not article else 0
            if not dropped and (attrs or tag == "form"):
                dropped, new = self.marked(tag, attrs, article)
                if new:
                    new.around, mark = mark, len(self.marks)
                    self.marks.append(new)
        if tag in _REGION:
            self.around[self.elements] = region
            region = self.elements
            if not article and tag in ("article", "main"):
                article = self.elements
        self.at[tag].append(len(self.open))
        self.open.append((tag, dropped, region, article, mark))

    @staticmethod
    def marked(tag, attrs, article):
        """Whether the element itself declares boilerplate: 2 for certain, 1
        unless an article begins inside, 0 not; and a mark where its text tells."""
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return 2, None
        if tag == "form":
            return 0, Mark(0, layout=True, wraps=True)
        if tag not in _CONTAINER:
            return 0, None
        words = marked_words(" ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower())
        if not words or article and words <= {"header"}:
            return 0, None
        if tag == "article" and not article:
            return 0, None
        layout = words <= _LAYOUT
        if any(k == "role" and v and v.lower() in words for k, v in attrs):
            return 1 if layout else 2, None
        if all(_AMBIGUOUS.fullmatch(w) for w in words):
            return 0, Mark(0, layout=layout, wraps=not article)
        return 0, Mark(0, layout=layout, certain=True)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        self.close_to(tag)

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.parts.append(data)
            if self.at["a"]:
                self.linked += len(data.strip())

    def close(self):
        if self.rawdata.startswith("<"):
            self.rawdata = ""      # a tag or comment that the page's end cuts off
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, normalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return pad / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Where the best two clusters of the values part (least squares)."""
    v = np.sort(values)
    n, left = np.arange(1, len(v)), np.cumsum(v)[:-1]
    if not len(n) or v[0] == v[-1]:
        return float(v[0])
    between = (left / n - (v.sum() - left) / (len(v) - n)) ** 2 * n * (len(v) - n)
    at = int(between.argmax())
    return float(v[at] + v[at + 1]) / 2


def unmarked(page: Lines) -> list[Line]:
    """The lines that no element declares boilerplate (see Mark)."""
    lines = [x for x in page.lines if not x.dropped]
    marks = page.marks
    for x in lines:
        mark = marks[x.mark]
        mark.chars += len(x.text)
        mark.links += x.links
        mark.in_articles += len(x.text) * bool(x.article)
    for m in reversed(marks[1:]):      # a mark comes after the one around it
        around = marks[m.around]
        around.chars += m.chars
        around.links += m.links
        around.in_articles += m.in_articles
    whole, out = marks[0], [False]
    for m in marks[1:]:
        part, total = (m.in_articles, whole.in_articles) if whole.in_articles else (m.chars, whole.chars)
        gone = m.certain or 2 * m.links > m.chars or m.wraps and 2 * part <= total
        out.append(out[m.around] or gone)
    return [x for x in lines if not out[x.mark]]


def dense_lines(lines: list[Line], sigma: float) -> list[Line]:
    """The lines above the threshold of the smoothed text-to-tag ratios."""
    ratios = smoothed(np.array([len(x.text) / x.tags for x in lines]), sigma)
    least = threshold(ratios)
    return [x for x, r in zip(lines, ratios) if r >= least]


def in_articles(lines: list[Line], around: dict[int, int], sigma: float) -> list[Line]:
    """The lines of the articles that hold dense lines, of those beside them,
    and the main heading before the first where the articles have none."""
    inside = [x for x in lines if x.article]
    beside = {around[x.article] for x in dense_lines(inside, sigma)}
    chosen = [x for x in inside if around[x.article] in beside]
    if not any(x.title for x in chosen):
        before = [x for x in lines[:lines.index(chosen[0])] if x.title and not x.article]
        chosen = before[-1:] + chosen
    return chosen


def common_region(regions: set[int], around: dict[int, int]) -> set[int]:
    """The smallest region that holds all ``regions``, and all inside it."""
    left = [-r for r in regions]
    heapify(left)
    while True:        # a region comes after the one around it
        last = heappop(left)
        while left and left[0] == last:
            heappop(left)
        if not left:
            break
        heappush(left, -around[-last])
    inside = {-last}
    for r, outer in around.items():
        if outer in inside:
            inside.add(r)
    return inside


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The text of the page's content regions, a line for each block."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    lines = unmarked(page)
    if not lines:
        return ""
    if any(x.article for x in lines):
        return "\n".join(x.text for x in in_articles(lines, page.around, sigma))
    regions = {x.region for x in dense_lines(lines, sigma)}
    inside = common_region(regions, page.around)
    # inside, lists of links that hold no dense line are none of the content
    return "\n".join(x.text for x in lines if x.region in regions or x.region in inside and 2 * x.links <= len(x.text))


def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array((main_text(x) for x in pages.to_pylist()), pa.string())


def extract_text(pages: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out``.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by one line end in page order. A null or empty page, and
    one without content, gives an empty text; unclosed and misnested elements
    end where the next block allows it. Repeated rows get equal texts; other
    columns pass through, an existing ``out`` is replaced.
    """
    need(pages, html)
    return pages.withColumn(out, F.arrow_udf(_extract, "string")(F.col(f"`{html}`").cast("string")))
