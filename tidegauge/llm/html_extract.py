"""Main text of web pages from the standard library's streaming parser.

Parser events become lines (blocks), each with its text, the number of tags that
fell in it and the share of its characters inside links. Blocks in page furniture
(menus, headers of the page, footers, sidebars, notices, adverts, forms, reader
comments) are told from the element and its class, id or role. For the rest, on
every page, the method is the text-to-tag ratio of each line, smoothed with a
Gaussian and split in two clusters by a threshold. Article and main elements are
borders of regions: one with more than half of its characters in lines of
content, or with more than half of the page's, is content as a whole, any other, and any
that is mostly links, is left out. Outside of them the region runs from the first to the last line that
is content by itself, with headings before it and without runs of links.

Null and empty pages, and pages of furniture alone, give an empty text. Equal
pages give equal texts. Elements may be nested to any depth and pages may have
any length; time grows with both in proportion.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names, roles, and words in class and id attributes.
SILENT = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas select option textarea button datalist audio video map".split())
FURNITURE = frozenset("nav footer aside menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a head can hold; any other element, or text, ends a head without end tag.
HEAD_CONTENT = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What the start of a new block closes, as a browser does.
CLOSES_P = BLOCKS - frozenset("br body html td th tr tbody thead tfoot caption dd dt legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN = frozenset(("article", "main"))
#: Words that mark furniture wherever they are a part of a name, also inside an article.
MARKS = re.compile(r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|ads?|advert\w*|sponsor(?:ed|s)?|promo(?:s|tions?)?|cookies?|consent|popup|modal|newsletter|subscribe|comments?|commentlist|disqus|pagination|pager|footer|widget")
#: Words that do so outside of articles alone; inside they must be the whole name, or stand beside one of BOXES.
WEAK = re.compile(r"header|masthead|banner|side|notice|alert|share|sharing|social|related|recommend\w*|replies|respond|reply|login|search|skip|toolbar|teaser|form")
OUTSIDE = re.compile(r"legal|copyright|contentinfo")
BOXES = frozenset("articles area bar block box buttons content icons items links list panel posts section stories tools wrap wrapper container".split())
#: Part of a name that is the article's own, whatever stands beside it.
OWN = frozenset("article post entry story content main".split())
#: Clusters nearer than this in log ratio are one.
APART = 0.7
#: Lines of links in a row that are a menu, not part of a text.
LINK_RUN = 3


def marks(names: str, inside: bool) -> bool:
    """Whether class or id names mark furniture; inside: in an article or main element."""
    for name in names.split():
        parts = [x for x in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
        for i, x in enumerate(parts):
            if MARKS.fullmatch(x) and not (x == "footer" and inside and parts[0] in OWN):
                return True
            if x == "side" and parts[i + 1 : i + 2] != ["bar"]:
                continue  # side by side is a layout
            if WEAK.fullmatch(x):
                if not inside:
                    if not (x in ("header", "banner") and parts[0] in OWN):
                        return True
                elif x not in ("header", "form") and (len(parts) == 1 or x == "side" or any(y in BOXES for y in parts[i + 1 :])):
                    return True
            if not inside and OUTSIDE.fullmatch(x):
                return True
    return False


class Blocks(HTMLParser):
    """Blocks of a page in order: [text, tags in it, furniture, number of the outermost article or main element around it, from 1, or 0, share of links, whether a heading]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # element, silent, furniture (1: only as part of a form), main
        self.blocks: list[list] = []
        self.parts: list[str] = []
        self.tags = self.mains = self.main = self.furniture = self.links = self.linked = 0
        self.silent = False

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append([text, self.tags, self.furniture > 0, self.main, self.linked / sum(len(x) for x in self.parts), any(x[0] in HEADINGS for x in self.open[-4:])])
                self.tags = 0
            self.parts = []
            self.linked = 0

    def _state(self):
        _, self.silent, self.furniture, self.main = self.open[-1] if self.open else ("", False, 0, 0)

    def _leave_head(self):
        """Ends an open head and all in it, unless a template is open there: that holds any element."""
        names = [x[0] for x in self.open]
        if "head" in names and "template" not in names:
            self.links -= sum(x == "a" for x in names[names.index("head") :])
            del self.open[names.index("head") :]
            self._state()

    def handle_starttag(self, tag, attrs):
        if self.silent and tag not in HEAD_CONTENT:
            self._leave_head()
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self.tags = 0  # a line's tags are those inside it
            if tag in CLOSES_P or tag == "li":
                top = self.open[-1][0] if self.open else ""
                if tag in CLOSES_P and any(x[0] == "p" for x in self.open[-8:]):
                    self._close("p", 8)
                elif tag == "li" and top == "li":
                    self._close("li", 1)
        if tag in VOID:
            return
        self.links += tag == "a"
        furniture, main = self.furniture, self.main
        given = {k: v or "" for k, v in attrs}
        starts = tag in MAIN or given.get("role") == "main"
        if starts and furniture == 1:
            furniture = 0  # some pages are one form as a whole
        if furniture < 2:
            names = f"{given.get('class', '')} {given.get('id', '')}"
            if tag in FURNITURE or (tag == "header" and not main) or given.get("role") in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
                furniture = 2
            elif names != " " and tag not in ("html", "body") and marks(names, bool(main) or starts):
                furniture = 2
            elif tag == "form":
                furniture = max(furniture, 1)
        if not main and starts:
            self.mains += 1
            main = self.mains
        self.open.append((tag, self.silent or tag in SILENT, furniture, main))
        self._state()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag, depth):
        for k in range(len(self.open) - 1, max(-1, len(self.open) - 1 - depth), -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS:
                    self.flush()
                self.links -= sum(x[0] == "a" for x in self.open[k:])
                del self.open[k:]
                self._state()
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self.tags = 0
        if tag == "p":
            # an end tag p closes only a p inside the same container
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    break
                if self.open[k][0] in BLOCKS:
                    return
        self._close(tag, len(self.open))

    def handle_data(self, data):
        if self.silent and self.open[-1][0] == "head" and data.strip():
            self._leave_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with renormalised borders."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[r : r + len(values)] / np.convolve(np.ones(len(values)), kernel)[r : r + len(values)]


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of one dimension: the mean of their means, to a fixed point (at most 50 steps).

    Clusters less than APART apart (in log ratio) are one, and all of it is content.
    """
    cut = values.mean()
    for _ in range(50):
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            return -np.inf
        if high.mean() - low.mean() < APART:
            return -np.inf
        new = (low.mean() + high.mean()) / 2
        if new == cut:
            break
        cut = new
    return cut


def extract(html: str | None) -> str:
    """The page's main text, one block a line; empty for null, empty or furniture-only pages."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = [b for b in parser.blocks if not b[2]]
    if not blocks:
        return ""
    ratio = np.array([len(b[0]) / (1 + b[1]) for b in blocks], float)
    level = smoothed(ratio)
    cut = threshold(np.log1p(level))
    keep = (np.log1p(level) > cut) | (np.log1p(ratio) > cut)
    main = np.array([b[3] for b in blocks])
    chars = np.array([len(b[0]) for b in blocks])
    kept, total = np.bincount(main, chars * keep), np.bincount(main, chars)
    links = np.bincount(main, chars * np.array([b[4] for b in blocks]))
    inside = (main > 0) & (((2 * kept > total) | (2 * total > chars.sum())) & (2 * links <= total))[main]  # whole elements; smoothing alone can lift a line at a border
    outside = np.flatnonzero(keep & (main == 0) & (np.log1p(ratio) > cut))
    if len(outside):  # a region: short lines between content lines belong to it, and headings before it; runs of links do not
        at = np.arange(len(blocks))
        first = outside[0]
        while first and blocks[first - 1][5] and not main[first - 1]:
            first -= 1
        linked = np.array([b[4] > 0.5 for b in blocks]) & (main == 0)
        run = np.cumsum(np.concatenate([[True], linked[1:] != linked[:-1]]))
        inside |= (main == 0) & (at >= first) & (at <= outside[-1]) & ~(linked & (np.bincount(run)[run] >= LINK_RUN))
    return "\n".join(b[0] for b, x in zip(blocks, inside, strict=True) if x)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per page: id, the columns in keep, text, n_chars (code points). Null and empty pages have an empty text.

    Repeated rows, null ids and other columns (of any name) change nothing: each row is read by itself.
    """
    keep = [c for c in keep or [] if c not in (id_col, "text", "n_chars")]
    read = pages.select(F.col(id_col), *keep, F.col(html_col).alias("_html"))
    fields = read.schema.fields[:-1]
    names = [f.name for f in fields] + ["text", "n_chars"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars bigint"

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract(h.as_py()) for h in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return read.mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. A null html is an empty one."""
    return extract_pages(common.table(spark, sf_dir, "pages"), keep=["url"]).select("page_id", "url", "text", "n_chars")


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLE_SQL: dict[str, str] = {}
