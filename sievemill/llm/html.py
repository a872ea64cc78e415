"""Main text of web pages by text-to-tag ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("aside button canvas datalist dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Class and id words: of asides wherever they stand, of asides that may also name a part of a text, and what such names are made of besides.
ASIDE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disqus footer gdpr login masthead"
    " menu nav navbar navigation newsletter paywall popup sidebar signup sponsor sponsored".split()
)
DOUBTFUL_WORDS = frozenset(
    "banner banners disclaimer header modal notice notices notification overlay pager pagination promo promoted recommended related replies reply respond share sharing"
    " social subscribe toolbar widget widgets".split()
)
FILL_WORDS = frozenset(
    "area articles bar block bottom box button buttons container count group icons inner item items left links list outer page panel post posts right section site small"
    " stories top wrap wrapper".split()
)
#: What the smoothed ratios of lines count for: in marked asides, under doubtful names, in marked main parts.
ASIDE_WEIGHT, DOUBTFUL_WEIGHT, MAIN_WEIGHT = 0.02, 0.1, 1.5
CONTAINERS = MAIN | frozenset("body div section td".split())
_TAG = re.compile(r"<[A-Za-z/!?]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def named_weight(names: str) -> float:
    """What the names of a class or id say: a weight for the lines in the element."""
    weight = 1.0
    for name in names.split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & ASIDE_WORDS:
            return ASIDE_WEIGHT
        if parts & DOUBTFUL_WORDS and parts <= DOUBTFUL_WORDS | FILL_WORDS:
            weight = DOUBTFUL_WEIGHT
    return weight


class Lines(HTMLParser):
    """Turns parser events into lines, one for each run of text between borders of blocks: (text, characters outside links,
    tags, region). Regions are numbered as they open; 0 is what elements, roles or attributes say is no content. Events are taken
    as they come; only the lines and the open elements are kept. Time is linear in the page: what is never closed (a tag, a quoted value,
    a comment) reaches to the page's end, as HTML has it, and isn't looked for again; unknown sections are comments up to the next >."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names: Counter[str] = Counter()  # of open elements
        self.endless = False  # a tag or comment has no end
        self.lines: list[tuple[str, int, int, int]] = []
        self.open: list[tuple[str, bool, int]] = []  # name, content, region
        self.outer, self.weight, self.main = [0, 0], [0.0, 1.0], [False, False]  # by region
        self.text: list[str] = []
        self.loose = self.tags = self.links = 0

    def read(self, html: str) -> None:
        """The whole page. A tag that begins behind the last > has no end, so it and what follows are left out."""
        last = html.rfind(">") + 1
        self.feed(html[:last])
        self.close()
        if not self.endless:
            begun = _TAG.search(html, last)
            self.handle_data(unescape(html[last : begun.start() if begun else len(html)]))
        self.end_line()

    def to_the_end(self, end: int) -> int:
        self.endless = self.endless or end < 0
        return end if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return self.to_the_end(super().parse_starttag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self.to_the_end(super().parse_comment(i, report))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def state(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (True, 1)

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:  # tags without text between them count for the line after them
            content, region = self.state()
            self.lines.append((text, min(self.loose, len(text)), self.tags, region if content else 0))
            self.tags = 0
        self.text, self.loose = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        content, region = self.state()
        within = self.main[region]
        given = dict(attrs)
        role = (given.get("role") or "").lower()
        if content and tag not in ("html", "body"):
            content = not (
                tag in ASIDE and not (tag == "header" and within)
                or role in ASIDE_ROLES
                or "hidden" in given or given.get("aria-hidden") == "true"
                or "display:none" in (given.get("style") or "").replace(" ", "").lower()
            )
            if tag == "article" and self.names["article"]:
                content = False  # an article in an article is a reader's comment, as HTML has it
        elif not content and tag in HEADINGS and self.open[-1][0] == "header" and within:
            content = True
        if content:
            weight = 1.0 if tag in MAIN or tag in ("html", "body") else named_weight(f"{given.get('class') or ''} {given.get('id') or ''}")
            main = tag in MAIN or role == "main"
            if tag in CONTAINERS or weight < 1 or main:
                self.outer.append(region)
                self.weight.append(min(self.weight[region], 1.0) * weight * (MAIN_WEIGHT if (main or within) and weight == 1 else 1.0))
                self.main.append((main or within) and weight == 1)
                region = len(self.outer) - 1
        self.links += tag == "a"
        self.open.append((tag, content, region))
        self.names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if not self.names[tag]:
            return
        while True:  # what was opened since closes as well
            name, *_ = self.open.pop()
            self.names[name] -= 1
            self.links -= name == "a"
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if not self.links:
            self.loose += len(data)


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = 3
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach), kernel / kernel.sum(), "valid")


def scores(page: Lines) -> np.ndarray:
    """A score for each line: square roots of the characters outside links for each tag, smoothed by a Gaussian, times the weight of
    the line's region; 0 for what is no content and for lines of links alone."""
    ratio = np.array([loose / max(1, tags) if region else 0.0 for _, loose, tags, region in page.lines])
    weight = np.array(page.weight)[[region for *_, region in page.lines]]
    return np.where(ratio > 0, smoothed(np.sqrt(ratio)) * weight, 0.0)


def content_regions(page: Lines, score: np.ndarray) -> set[int]:
    """Regions that are content: those with a line over the threshold (one standard deviation of the scores), the regions in them
    and those between them under the same one, unless these are of less weight or consist of links."""
    regions = np.array([region for *_, region in page.lines], np.int64)
    inside = regions > 0
    best = set(regions[(score > 0) & (score >= min(score[inside].std(), score[inside].max()))].tolist())
    text, loose = np.zeros(len(page.outer)), np.zeros(len(page.outer))
    np.add.at(text, regions, [len(t) for t, *_ in page.lines])
    np.add.at(loose, regions, [n for _, n, *_ in page.lines])

    def joins(region: int, other: int) -> bool:
        return page.weight[region] >= min(1.0, page.weight[other]) and 2 * loose[region] >= text[region]

    between: dict[int, list[int]] = {}
    for region in sorted(best):
        between.setdefault(page.outer[region], []).append(region)
    for region in range(1, len(page.outer)):  # outer regions come first
        outer = page.outer[region]
        same = between.get(outer, [])
        if outer in best and joins(region, outer) or same and same[0] < region < same[-1] and joins(region, same[0]):
            best.add(region)
    return best


def main_text(html: str) -> str:
    """The main text of a page: blocks in page order, white space inside each made one space, joined by one space.

    On every page, smoothed text-to-tag ratios and the threshold select the regions (see scores, content_regions); elements such as
    menus, forms and scripts are no content, while names of classes and marks of articles only weight the ratios, so that a page
    whose whole text bears such a name still has its text. Ties: lines of equal score are both content or both not."""
    page = Lines()
    page.read(html)
    score = scores(page) if page.lines else np.zeros(0)
    if not (score > 0).any():
        return ""
    best = content_regions(page, score)
    return " ".join(text for text, _, _, region in page.lines if region in best)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page (see main_text). Null or empty html: empty text, 0. Null keys and repeated rows
    are rows like others. Malformed and very long pages are read whole, in linear time. Empty table: no rows. Other columns play no part."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(apply, f"page_id {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long")
