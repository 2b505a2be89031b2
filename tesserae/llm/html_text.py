"""Main text of HTML pages from streaming parser events and text-to-tag ratios.

The standard library's parser reports tags and text one after the other; nothing builds a tree, only the stack of open
blocks is kept. Block-level tags cut the page into lines. What is no text (scripts, styles) and what the page itself
declares to be no content by its element or role (nav, footer, aside, form and the like) is left out as it streams by.

Each line has a ratio of characters outside links to tags. Logarithms of the ratios (so that one long paragraph does not lift what
stands beside it) are smoothed with a Gaussian and clustered by the threshold that leaves the least variance on both sides; lines above it are the
content clusters. The region of the page is the innermost block that holds all content clusters but for LEFT_OUT of their
characters, and grows to a block around it as long as what comes in is as dense as content. article and main are blocks like any
other here.

All lines of the region are returned, short ones included, but for blocks inside it that hold no content line and are
named like boilerplate (class or id) or consist of links for the most part. A name only lowers the ratio of the lines below it, and
only where the block is less than WRAPPER of the page's text, unless it names reader comments.

Python runs inside tasks over Arrow batches; no row leaves its partition. Defined results: null or empty html gives an
empty text; malformed markup is read as the parser reads it; repeated rows are all returned; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import common

DROPPED = frozenset("script style noscript template nav footer aside form iframe svg button select textarea menu dialog head title object audio video canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that end where another of these begins: p at any block, the others at their like.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: A header in one of these is the header of a part, not of the page.
PARTS = frozenset("article main section".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|sidebar|share|sharing|social|recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|breadcrumbs?|pagination|pager|navbar|navigation|masthead|toolbar|copyright|disclaimer)(?:$|[\s_-])"
    r"|(?:^|\s)(?:banner|menu|nav|notice|alert|footer|header|related|tags|side|widget|skip)(?:$|\s)"
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|disqus|respond)(?:$|[\s_-])")
#: Standard deviation of the smoothing, in lines; factor of a ratio below a name; share of the content that may lie outside;
#: share of the page from which a block is a wrapper, whatever its name.
SIGMA, LOWERED, LEFT_OUT, WRAPPER = 1.0, 0.2, 0.1, 0.9
_KERNEL = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-3, 4)]


class Line:
    __slots__ = ("linked", "path", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, path: tuple[int, ...]):
        self.text, self.tags, self.linked, self.path = text, tags, linked, path


class Lines(HTMLParser):
    """Collects the lines of a page; a line's path has the numbers of the blocks around it, outermost first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.anchors = 0
        self.dropped: str | None = None
        self.depth = self.numbered = 0
        self.open: list[tuple[str, int]] = []
        self.named: dict[int, bool] = {}  # by block: whether it names reader comments
        self.headed: set[int] = set()  # blocks with a heading of the page

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, tuple(n for _, n in self.open)))
        self.parts, self.tags, self.linked = [], 0, 0

    def _no_content(self, tag: str, attributes: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED or (tag == "header" and not any(t in PARTS for t, _ in self.open)):
            return True
        for name, value in attributes:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if value and ((name == "role" and value.lower() in ROLES) or (name == "style" and "display:none" in value.replace(" ", "").lower())):
                return True
        return False

    def _enter(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self.open and self.open[-1][0] == "p":
            self.open.pop()
        ends = {t for t, by in ENDED_BY.items() if tag in by}
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                del self.open[k:]
            elif self.open[k][0] in ("ul", "ol", "dl", "table"):
                break
        self.numbered += 1
        self.open.append((tag, self.numbered))
        if tag in ("h1", "h2"):
            self.headed.update(n for _, n in self.open)
        for name, value in attributes:
            if name in ("class", "id") and value and tag not in ("body", "html", "main"):
                value = value.lower()
                if _COMMENTS.search(value):
                    self.named[self.numbered] = True
                elif _NAMES.search(value):
                    self.named.setdefault(self.numbered, False)

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self.dropped is not None:
            if tag == self.dropped:
                self.depth += 1
            elif tag in ("article", "main") and self.dropped in ("nav", "header", "head", "title") and not self._no_content(tag, attributes):
                self.dropped = None  # the region was never closed
            elif self.dropped in ("p", "li") and tag in BLOCKS:
                self.dropped = None  # these need no end tag
            if self.dropped is not None:
                return
        if tag in BLOCKS:
            self.line()
        if tag not in VOID and self._no_content(tag, attributes):
            if tag in BLOCKS:
                self.line()
            self.dropped, self.depth = tag, 1
            return
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.anchors += 1
        if tag in BLOCKS and tag not in VOID:
            self._enter(tag, attributes)

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped is not None:
            if tag == self.dropped:
                self.depth -= 1
                if not self.depth:
                    self.dropped = None
                return
            if self.dropped in ("p", "li") and any(t == tag for t, _ in self.open):
                self.dropped = None
            else:
                return
        if tag in BLOCKS:
            self.line()
        self.tags += 1
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if tag in BLOCKS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data: str) -> None:
        if self.dropped is None:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self.line()
        return self.lines


def smoothed(ratios: list[float]) -> list[float]:
    n = len(ratios)
    out = []
    for i in range(n):
        total = weight = 0.0
        for k, g in enumerate(_KERNEL, i - 3):
            if 0 <= k < n:
                total += g * ratios[k]
                weight += g
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The least value of the upper one of two clusters: the cut of the sorted values with the most variance between its sides."""
    ordered = sorted(values)
    best, cut, below, total = 0.0, ordered[0], 0.0, sum(ordered)
    for k in range(1, len(ordered)):
        below += ordered[k - 1]
        if ordered[k] > ordered[k - 1]:
            between = k * (len(ordered) - k) * (below / k - (total - below) / (len(ordered) - k)) ** 2
            if between > best:
                best, cut = between, ordered[k]
    return cut


def clusters(lines: list[Line], lowered: list[bool]) -> tuple[list[float], float]:
    """The smoothed logarithms of the ratios, and the threshold of the content clusters."""
    levels = smoothed([math.log1p(max(0, len(line.text) - line.linked) / max(1, line.tags)) for line in lines])
    levels = [(LOWERED if low else 1.0) * x for x, low in zip(levels, lowered, strict=True)]
    return levels, threshold(levels)


def region(lines: list[Line], levels: list[float], least: float) -> int:
    """The block that holds the content clusters; 0 is the page."""
    mass: dict[int, int] = {}
    total = 0
    for line, level in zip(lines, levels, strict=True):
        if level >= least:
            total += len(line.text)
            for block in line.path:
                mass[block] = mass.get(block, 0) + len(line.text)
    first = max((line for line, level in zip(lines, levels, strict=True) if level >= least), key=lambda line: len(line.text))
    path = [block for block in first.path if mass[block] >= (1 - LEFT_OUT) * total]
    if path and all(line.path[-1] == path[-1] for line in lines if path[-1] in line.path):
        path.pop()  # a paragraph of its own: its block is what holds it
    while path:
        outer = path[-2] if len(path) > 1 else 0
        more = [k for k, line in enumerate(lines) if (not outer or outer in line.path) and path[-1] not in line.path]
        size = sum(len(lines[k].text) for k in more)
        if more and sum(len(lines[k].text) for k in more if levels[k] >= least) < 0.5 * size:
            break
        path.pop()
    return path[-1] if path else 0


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    sizes: dict[int, int] = {}
    for line in lines:
        for block in line.path:
            if block in parser.named:
                sizes[block] = sizes.get(block, 0) + len(line.text)
    page = sum(len(line.text) for line in lines)
    named = {block for block, size in sizes.items() if parser.named[block] or size < WRAPPER * page}
    levels, least = clusters(lines, [not named.isdisjoint(line.path) for line in lines])
    chosen = region(lines, levels, least)
    # Per block inside the region: characters, those in links, and whether a line of it is content.
    inside: dict[int, list] = {}
    kept = [k for k, line in enumerate(lines) if not chosen or chosen in line.path]
    for k in kept:
        line = lines[k]
        for block in line.path[line.path.index(chosen) + 1 if chosen else 0 :]:
            row = inside.setdefault(block, [0, 0, False])
            row[0] += len(line.text)
            row[1] += line.linked
            row[2] |= levels[k] >= least
    gone = {b for b, (size, linked, content) in inside.items() if (b in named and (parser.named[b] or (not content and b not in parser.headed))) or (not content and 2 * linked > size)}
    return "\n\n".join(lines[k].text for k in kept if gone.isdisjoint(lines[k].path))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
