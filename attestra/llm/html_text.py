"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing and threshold clustering.

The standard library's parser streams events; block tags cut them into lines. Each line has a text-to-tag
ratio; ratios are smoothed with a Gaussian, and two clusters around a threshold part content lines from the
others. Elements that say they are something else (menus, adverts, forms, comments and so on) have the ratios of
their lines lowered, unless they hold half of the content text found without regard to what elements say (elements
that are menus, footers and so on by their tag: nine tenths), and no article or main element stands outside; then ratios are smoothed and clustered again. The content region is the innermost element that
holds nearly all content text, or the article it is in, with the content lines beside it, so short paragraphs and
headings of an article stay; where that is the page's body itself, it is the span from the first to the last
content line with the headings right before it.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import slices

FEED = 1 << 20
SIGMA, RADIUS = 1.0, 2
SHARE = 0.9

_words = str.split
BLOCKS = frozenset(_words("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul"))
CONTAINERS = frozenset(_words("article aside blockquote body details dialog div dl fieldset figure footer form header li main menu nav ol section table tr td th ul dt dd option span p button select label noscript template svg iframe object canvas video audio textarea head title script style math"))
SPACES = frozenset(_words("br td th wbr img input"))
HEADINGS = frozenset(_words("h1 h2 h3 h4 h5 h6"))
#: Elements that can be a page's content region.
REGIONS = frozenset(_words("html body main article section div td"))
#: Elements that hold no text of the page, and those that mostly hold other text than the article.
EMPTY = frozenset(_words("button select textarea noscript template svg iframe object canvas video audio head title script style math"))
FOREIGN = frozenset(_words("nav aside footer form dialog menu"))
#: What the ratios of lines in such elements are multiplied by.
LOWERED = 0.02
#: Elements whose end tag may be left out: a start tag of the first kind ends an open one of the second, up to the third.
ENDED = {
    **{t: ({"li"}, {"ul", "ol", "menu", "dir"}) for t in ("li",)},
    **{t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")},
    **{t: ({"td", "th"}, {"table", "tr"}) for t in ("td", "th")},
    **{t: ({"td", "th", "tr"}, {"table"}) for t in ("tr", "tbody", "thead", "tfoot")},
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
TRUSTED = frozenset(_words("html body main article"))
#: Parts of class and id names, and roles, of elements that are not the article.
NAMES = frozenset(_words("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar rail menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead footer comment comments reply replies disqus respond share sharing social related recommended widget login signin signup register search paywall"))
ROLES = frozenset(_words("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar"))
_PART = re.compile(r"[a-z]+")


class Lines(HTMLParser):
    """Lines of a page, (text, tags, element, heading), and its elements by number: names, parents, whether they say they
    are something else, and whether they hold no text. An element comes after its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.names, self.parents, self.foreign, self.empty = ["html"], [0], [False], [False]
        self._open, self._kinds = [0], Counter(["html"])
        self._parts, self._tags, self._heading = [], 0, False

    def _cut(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text and not self.empty[self._open[-1]]:
            self.lines.append((text, self._tags, self._open[-1], self._heading))
            self._tags = 0
        self._parts = []

    def _says(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in FOREIGN:
            return True
        if tag == "header":  # an article's own header has its headline
            return not (self._kinds["article"] or self._kinds["main"])
        if tag in TRUSTED:
            return False
        for name, value in attrs:
            if value and name in ("class", "id") and not NAMES.isdisjoint(_PART.findall(value.lower())):
                return True
            if value and name == "role" and value.lower() in ROLES:
                return True
        return False

    def _close(self) -> str:
        name = self.names[self._open.pop()]
        self._kinds[name] -= 1
        return name

    def _end(self, tags: set[str], within: set[str]) -> None:
        """Close the innermost open element of these, and what is open in it, if none of `within` stands between."""
        if not any(self._kinds[t] for t in tags):
            return
        for at in range(len(self._open) - 1, 0, -1):
            name = self.names[self._open[at]]
            if name in tags:
                self._cut()
                while len(self._open) > at:
                    self._close()
                return
            if name in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._cut()
            self._heading = tag in HEADINGS
            if self._kinds["p"] and self.names[self._open[-1]] == "p":  # a paragraph ends where the next block begins
                self._close()
        elif tag in SPACES:
            self._parts.append(" ")
        self._tags += 1
        if tag in ENDED:
            self._end(*ENDED[tag])
            if tag in ("tr", "tbody", "thead", "tfoot"):
                self._end({"tr"}, {"table"})
        if tag in CONTAINERS:
            parent = self._open[-1]
            foreign, empty = self._says(tag, attrs), tag in EMPTY
            if foreign or empty:
                self._cut()
            self._open.append(len(self.names))
            self._kinds[tag] += 1
            self.names.append(tag)
            self.parents.append(parent)
            self.foreign.append(foreign)
            self.empty.append(empty or self.empty[parent])

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._cut()
        elif tag in SPACES:
            self._parts.append(" ")
        self._tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._cut()
            self._heading = False
        self._tags += 1
        if tag in CONTAINERS and self._kinds[tag] and tag != "html":
            while True:
                own = self._open[-1]
                if self.foreign[own] or self.empty[own]:
                    self._cut()
                if self._close() == tag:
                    return

    def handle_data(self, data):
        if self.names[self._open[-1]] not in ("script", "style"):
            self._parts.append(data)

    def close(self):
        super().close()
        self._cut()


def smooth(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Between two one-dimensional clusters of log ratios; where all are alike, everything is above."""
    x = np.log1p(values)
    low, high = float(x.min()), float(x.max())
    if high - low < 0.5:
        return -1.0
    cut = (low + high) / 2
    for _ in range(50):
        nxt = (x[x <= cut].mean() + x[x > cut].mean()) / 2
        if abs(nxt - cut) < 1e-9:
            break
        cut = nxt
    return float(np.expm1(cut))


def clusters(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines are content, and the ratio between the two clusters."""
    smoothed = smooth(ratios)
    cut = threshold(smoothed)
    return smoothed > cut, cut


def _held(page: Lines, sizes: np.ndarray) -> np.ndarray:
    """The sum of sizes of lines in each element."""
    held = np.bincount([x[2] for x in page.lines], weights=sizes, minlength=len(page.names)).tolist()
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    return np.array(held)


def select(page: Lines) -> list[str]:
    lines, names, parents = page.lines, page.names, page.parents
    if not lines:
        return []
    sizes = np.array([len(x[0]) for x in lines], float)
    ratios = sizes / np.maximum([x[1] for x in lines], 1)
    element = np.array([x[2] for x in lines])
    held = _held(page, np.where(clusters(ratios)[0], sizes, 0))
    told = [False] * len(names)  # in an element that says it is the article
    for e in range(1, len(names)):
        told[e] = told[parents[e]] or names[e] in ("article", "main")
    told_in = _held(page, np.array(told)[element].astype(float))  # how many such lines an element has
    lowered = [False] * len(names)
    for e in range(1, len(names)):
        least = 0.5 if told_in[e] or names[e] not in FOREIGN else SHARE
        holds = held[e] >= least * held[0] and (told_in[e] or told[e] or not told_in[0])
        lowered[e] = lowered[parents[e]] or (page.foreign[e] and not holds)
    own = ~np.array(lowered)[element]
    if not own.any():
        return []
    ratios = np.where(own, ratios, LOWERED * ratios)
    content, cut = clusters(ratios)
    content &= own | (content & (ratios >= ratios[own].max()))
    if not content.any():
        content = own
    held = _held(page, np.where(content, sizes, 0))
    # elements are numbered in page order, so of those that hold the text the largest number is the innermost
    region = max((e for e in np.flatnonzero(held >= SHARE * held[0]).tolist() if names[e] in REGIONS), default=0)
    article, e = None, region
    while e and article is None:
        article, e = (e if names[e] in ("article", "main") else None), parents[e]
    around = article if article is not None else region
    while article is None and held[around] < held[0] and names[parents[around]] not in ("html", "body"):
        around = parents[around]
    inside = [False] * len(names)
    inside[around] = True
    for e in range(around + 1, len(names)):
        inside[e] = inside[parents[e]]
    within = np.array(inside)[element]
    if article is not None:
        return [x[0] for x, keep in zip(lines, within & own) if keep]
    if around != region:  # content beside the region, in the element that has them both
        inside = [e == region for e in range(len(names))]
        for e in range(region + 1, len(names)):
            inside[e] = inside[parents[e]]
        at = np.flatnonzero(within & own & (np.array(inside)[element] | content))
    elif names[region] in ("html", "body") and not content.all():
        at = np.flatnonzero(content & (ratios > cut)) if (content & (ratios > cut)).any() else np.flatnonzero(content)
    else:
        at = np.flatnonzero(within & own)
    first, last = int(at[0]), int(at[-1])
    while first and lines[first - 1][3] and own[first - 1]:
        first -= 1
    return [x[0] for x, keep in zip(lines[first : last + 1], own[first : last + 1]) if keep]


def main_text(html: str) -> str:
    parser = Lines()
    for at in range(0, len(html), FEED):
        parser.feed(html[at : at + FEED])
    parser.close()
    return "\n\n".join(select(parser))


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (main text, empty if there is none), n_chars (its code points).

    A null or empty page has empty text; markup of any kind is read without error. Null ids and urls stay null,
    repeated rows give repeated results, other columns are not read. One pass, no shuffle.
    """

    def work(batches):
        for batch in slices(batches):
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(work, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
