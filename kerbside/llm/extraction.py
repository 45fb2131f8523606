"""Operator 3: main text of web pages by the density of text among tags.

The events of the standard library's HTML parser are taken one by one; no tree is built. They
cut a page into lines (one per block of text), each with its characters, its tags and the
characters inside links. A line's ratio is text to tags. The ratios are smoothed with a
Gaussian and split into two clusters by a threshold (two means). Lines of the high cluster are
the cores of content regions. A region reaches as far as the article element around its core or,
where the page marks none, over the short lines between cores. Text inside scripts, styles, menus,
headers, footers, sidebars, notices, adverts, forms and comments is never a line.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is never content.
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea "
    "label fieldset iframe object svg canvas audio video dialog menu".split()
)
#: Elements that end the line before and after them.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
    "td th caption blockquote pre figure figcaption address details summary hr br header footer nav aside "
    "form fieldset center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark something other than the article.
_OTHER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|"
    r"header|masthead|topbar|footer|sidebar|side|aside|widget\w*|related|recommend\w*|popular|comments?|replies|"
    r"reply|disqus|respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"login|search|share|social|toolbar|pagination|pager|tags|copyright|legal|hidden|complementary|contentinfo)"
    r"(?:$|[\s_-])",
    re.IGNORECASE,
)
_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main)(?:$|[\s_-])", re.IGNORECASE
)
#: Smoothing, in lines.
SIGMA = 1.0


class _Line:
    __slots__ = ("article", "linked", "parts", "tags")

    def __init__(self, article: int) -> None:
        self.parts: list[str] = []
        self.tags = 1
        self.linked = 0
        self.article = article  # number of the outermost article around it, or 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Lines(HTMLParser):
    """Lines of a page from its events; the open elements are the only state."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self._open: list[tuple[str, bool, bool]] = []  # name, not content, article
        self._names: Counter[str] = Counter()
        self._never = 0
        self._marked = 0
        self._articles = 0
        self._links = 0
        self._now = _Line(0)

    def _article(self) -> int:
        return self._articles if self._marked else 0

    def _end_line(self) -> None:
        if self._now.parts:
            self.lines.append(self._now)
        self._now = _Line(self._article())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._now.tags += 1
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        own = tag in ("article", "main")
        never = tag in NEVER or hidden or (tag == "header" and not self._marked)
        # the page as a whole may be named after anything
        never = never or bool(names and tag not in ("html", "body", "article", "main") and _OTHER.search(names))
        never = never or bool(tag == "article" and re.search(r"comment|repl(?:y|ies)", names, re.IGNORECASE))
        marks = not never and (own or bool(names and tag in ("div", "section") and _ARTICLE.search(names)))
        self._open.append((tag, never, marks))
        self._names[tag] += 1
        self._never += never
        self._articles += marks and not self._marked
        self._marked += marks
        self._links += tag == "a"
        self._now.article = self._article()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._now.tags += 1
        if not self._names[tag]:
            return
        while self._open:
            name, never, marks = self._open.pop()
            self._names[name] -= 1
            self._never -= never
            self._marked -= marks
            self._links -= name == "a"
            if name == tag:
                break
        self._now.article = self._article()

    def handle_data(self, data: str) -> None:
        if not self._never:
            self._now.parts.append(data)
            self._now.linked += len(data) if self._links else 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections that the parser does not know are skipped up to their ``>``, as browsers do."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def close(self) -> None:
        super().close()
        self._end_line()


def _smooth(values: list[float]) -> list[float]:
    reach = math.ceil(3 * SIGMA)
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in zip(range(-reach, reach + 1), weights):
            if 0 <= i + d < len(values):
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Between two clusters of the values (two means), from their extremes on."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below = [v for v in values if v <= cut]
        above = [v for v in values if v > cut]
        if not above:
            return low
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by a space; empty if there is none.

    Character references are decoded and white space inside a block is one space. Broken markup
    is read as far as the parser's events go."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = [(line, line.text()) for line in parser.lines]
    lines = [(line, text) for line, text in lines if text]
    if not lines:
        return ""
    # text to tags, without the characters of links
    ratios = [max(0, len(text) - 2 * line.linked) / line.tags for line, text in lines]
    smooth = _smooth(ratios)
    cut = _threshold(smooth)
    even = max(smooth) == min(smooth)
    dense = [i for i, v in enumerate(smooth) if v > cut or even]
    articles = {lines[i][0].article for i in dense} - {0}
    if articles:
        return " ".join(text for line, text in lines if line.article in articles)
    kept: list[int] = []
    for a, b in zip([None, *dense], dense):
        if a is not None and b - a <= 3:
            kept += [i for i in range(a + 1, b) if lines[i][0].linked * 2 <= len(lines[i][1])]
        kept.append(b)
    return " ".join(lines[i][1] for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    Null or empty html, and pages without an article, give an empty text. Rows that repeat are
    returned each. Other columns are not read."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column(0),
                    "url": batch.column(1),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(find, "page_id long, url string, text string, n_chars long")
