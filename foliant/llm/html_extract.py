"""Main text of web pages: flat text blocks, told apart by a decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Elements whose content is never text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements that stand in a line of text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold no article, wherever they stand.
ASIDE = set("nav aside footer form menu dialog noscript template select button svg object canvas audio video head datalist map".split())
MAIN = {"article", "main"}
#: Parts of a class, id or role that tell what an element holds.
ASIDE_WORDS = set(
    "ad ads adv banner nav navbar topnav menu sidebar side aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter signup login search share sharing social related recommended comment comments disqus respond reply replies widget pagination pager "
    "breadcrumb breadcrumbs copyright legal disclaimer hidden promo sponsor sponsored navigation contentinfo complementary dialog form skip".split()
)
ASIDE_STEMS = ("advert", "cookie", "comment", "sponsor", "promo", "subscri", "newsletter", "breadcrumb", "sidebar", "navig", "recommend")
HEADER_WORDS = {"header", "head", "banner", "hero"}
MAIN_WORDS = set("article content main post story entry body text".split())

#: Of those, what repeats on a page as articles of its own.
REPEATED_STEMS = ("comment", "disqus", "respon", "repl", "relat", "recommend", "teaser", "widget")
#: Parts that make a class name tell how a page is laid out and not what an element holds.
STATE_FIRST, STATE_LAST = {"with", "has", "no", "is", "page", "theme", "layout", "without", "single"}, {"open", "closed", "enabled", "disabled", "active", "layout", "page", "theme", "board"}
#: Words without links from which a block counts as prose.
PROSE = 20

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    words: int
    linked: int
    heading: bool
    context: int  # -1 in something that holds no article, 1 in an article, 0 in neither
    within: tuple[int, ...] = ()  # the open elements that only their names tell to be no article
    title: bool = False  # in an h1

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


class Tags:
    """The places where tags end, each found once, so that a page takes time in proportion to its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Place after the tag whose attributes begin at `at`. A quote opens a value after = only, and only if it is closed."""
        page = self.page
        while found := _STOP.search(page, at):
            at, c = found.end(), found[0]
            if c == ">":
                return at
            if self.last[c] >= at and page[max(0, at - 65) : at - 1].rstrip().endswith("="):
                at = page.index(c, at) + 1
        return len(page)


def _names(value: str) -> set[str]:
    """The lower-case parts of a class, id or role, but of names that tell a layout or a state."""
    parts: set[str] = set()
    for name in value.split():
        found = [p.lower() for p in _PART.findall(name)]
        if len(found) > 1 and (found[0] in STATE_FIRST or found[-1] in STATE_LAST):
            continue
        parts |= {*found, name.lower()}
    return parts


def _kind(tag: str, attributes: str, inside: int) -> tuple[int, bool, bool]:
    """What an element says of its content: -1 no article, 1 an article, 0 nothing; whether only its names say -1; whether as one of many."""
    if tag in ASIDE or (tag == "header" and inside != 1):
        return -1, False, False
    parts: set[str] = set()
    if attributes and not attributes.isspace():
        for name, *values in _NAMED.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return -1, False, False
            if name in ("class", "id", "role"):
                parts |= _names(value)
    if parts and tag not in ("body", "html"):
        if parts & ASIDE_WORDS or any(p.startswith(ASIDE_STEMS) for p in parts) or (inside != 1 and parts & HEADER_WORDS):
            return -1, True, any(p.startswith(REPEATED_STEMS) for p in parts)
    return int(tag in MAIN or bool(parts & MAIN_WORDS)), False, False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order; white space in a block is one space.

    Whatever the markup, each character is looked at a bounded number of times.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, tuple[int, ...], bool]] = []  # open elements but inline ones: the context inside, the elements that names speak against, whether one of many
    still: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    linked: list[str] = []
    link = heading = title = False
    tags, n_open = Tags(page), 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n = len(html.unescape("".join(linked)).split()) if linked else 0
                context, within = stack[-1][1:3] if stack else (0, ())
                out.append(Block(" ".join(words), len(words), min(n, len(words)), heading, context, within, title))
            parts, linked = [], []

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            parts.append(page[at:start])
            if link:
                linked.append(page[at:start] + " ")
        if start == end:
            break
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            at = at if at > 2 else end
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1 or end
            continue
        found = _NAME.match(page, start)
        if not found:
            parts.append("<")
            at = start + 1
            continue
        tag, closing, at = found[1].lower(), page[start + 1] == "/", tags.end(found.end())
        attributes = page[found.end() : at].removesuffix(">")
        if tag == "a":
            link = not closing
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        close()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                ends = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = tags.end(ends.end()) if ends else end
            continue
        if tag in VOID or tag == "p":
            heading = heading and tag != "p"
            continue
        link = False
        heading, title = tag in HEADINGS and not closing, tag == "h1" and not closing
        if closing:
            if still[tag]:
                while (top := stack.pop()[0]) != tag:
                    still[top] -= 1
                still[tag] -= 1
        elif not attributes.endswith("/"):
            _, inside, within, many = stack[-1] if stack else ("", 0, (), False)
            firm = inside == -1 and not within
            kind, by_name, repeated = (-1, False, False) if firm else _kind(tag, attributes, max(inside, 0) if within else inside)
            if inside == -1 and not firm:
                if kind == -1 and not by_name:
                    within = ()
                elif kind == 1 and tag in MAIN and not many:
                    inside, within = 1, ()  # an article is one, though an element about it has a name that speaks against it
                else:
                    many, kind = many or repeated, -1
            elif kind == -1 and by_name:
                n_open += 1
                within, many = (n_open,), repeated
            stack.append((tag, kind or inside, within, many))
            still[tag] += 1
    close()
    # an element that holds the page's title and prose is no aside, whatever its names say
    held = {w for b in out if b.title for w in b.within} & {w for b in out if b.words - b.linked >= PROSE for w in b.within}
    for b in out:
        if held.intersection(b.within):
            b.context = 0
    return out


#: What a block is judged by.
FEATURES = ("context", "density", "words", "previous_density", "next_density", "previous_words", "next_words", "heading")

#: Blocks of pages of several makes, by hand: the features above, then 1 for article text.
LABELLED = """
-1 1.00 1 0 1.00 0 1 0 0
-1 1.00 2 1.00 1.00 1 3 0 0
-1 1.00 4 1.00 0 2 8 0 0
-1 0 9 1.00 0 4 6 1 0
-1 0 25 1.00 0 9 12 0 0
-1 0.10 60 0 0 25 40 0 0
-1 0 140 0 0.20 80 30 0 0
-1 0.20 6 0 0 200 0 0 0
-1 0 12 0 1.00 90 2 0 0
-1 0 35 0 0 120 20 0 0
1 0 10 0 0 12 150 1 1
1 0 3 1.00 0 5 90 1 1
1 0 1 0 0 9 60 1 1
1 0 150 0 0 10 80 0 1
1 0.05 80 0 0 150 7 0 1
1 0 7 0 0 80 110 0 1
1 0 2 0 0 110 0 0 1
1 0 4 0 0 2 3 0 1
1 0.30 45 0 0 60 20 0 1
1 0.50 20 0.30 0 45 90 0 1
1 0 12 0 0.20 35 8 0 1
1 0 1 0 0 40 50 0 1
1 1.00 6 0 1.00 90 5 0 0
1 1.00 3 1.00 0 6 0 0 0
1 1.00 14 0 1.00 70 12 0 0
1 0.90 9 0.90 0.90 9 9 0 0
1 1.00 2 0 0 0 10 0 0
0 0 120 0 0 8 90 0 1
0 0.05 60 0 0 120 70 0 1
0 0 35 0.05 0 60 12 0 1
0 0 60 0 0 0 0 0 1
0 0 26 0 0 0 40 0 1
0 0 90 0 0 30 0 0 1
0 0.10 22 0 0 90 40 0 1
0 0 18 0 0 45 55 0 1
0 0.25 16 0 0 30 30 0 1
0 0 8 1.00 0 3 120 1 1
0 0 5 0 0 60 70 1 1
0 0 9 0 0 70 80 0 1
0 0 6 0 0 90 45 0 1
0 0 11 0 0 40 35 0 1
0 1.00 1 1.00 1.00 2 1 0 0
0 1.00 3 1.00 1.00 1 2 0 0
0 0 2 1.00 1.00 1 3 0 0
0 0.60 5 1.00 1.00 3 4 0 0
0 0.80 15 1.00 0.90 4 20 0 0
0 0.75 40 0.80 1.00 15 10 0 0
0 0.60 25 0.70 0.65 30 25 0 0
0 0 7 1.00 0 2 3 0 0
0 0 4 0 0.50 7 3 0 0
0 0 6 0 0 120 0 0 0
0 0.30 8 0 1.00 60 2 0 0
0 0 3 0 1.00 0 2 0 0
0 0 9 1.00 1.00 3 4 0 0
0 0 4 1.00 1.00 4 3 1 0
-1 0 11 1.00 0 1 9 0 0
-1 0 8 1.00 0 1 60 0 0
-1 0 75 0 0 90 120 0 0
-1 0 18 0 0 150 70 0 0
-1 0.05 220 0 0 40 200 0 0
-1 0 14 0 1.00 80 1 0 0
-1 0 5 0 0 60 45 1 0
-1 0 30 1.00 0 4 12 0 0
-1 0.40 10 0 0 110 0 0 0
-1 0 3 0 0 2 2 0 0
-1 0 90 0 0.10 12 33 0 0
-1 1.00 1 0 0 100 100 0 0
-1 0 50 0 0 0 0 0 0
-1 0.15 26 0.20 0.30 31 17 0 0
1 0 1 0 0 10 6 0 1
1 0 6 0 0 30 2 0 1
1 0 9 0 1.00 40 7 0 1
1 0 16 1.00 0 1 12 0 1
1 0 30 0 0.40 20 5 0 1
1 0 210 0 0.20 60 4 0 1
1 0 5 0 0 0 8 0 1
1 0 11 1.00 0 2 25 1 1
1 0 22 0 1.00 14 1 0 1
1 0 40 0 0.10 7 11 0 1
1 0 8 0 0 4 3 0 1
1 0.20 5 0 0 12 6 0 1
1 0.10 13 0 0 9 70 0 1
1 0.60 8 0 0 80 50 0 1
1 0.40 4 0 0 25 30 0 1
1 0 60 0 0.30 14 9 0 1
1 0 12 0 0 242 2 0 1
1 0 46 0 0 154 1 0 1
1 0 30 0 0 300 3 0 1
1 0 4 0 0 130 2 0 1
""".strip()


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7):
        self.label, self.split = bool(y.mean() >= 0.5), None
        if depth == 0 or y.min() == y.max():
            return
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                impurity = sum(p.size * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut)
        if best:
            _, f, cut = best
            low = x[:, f] < cut
            self.split = f, float(cut), Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def __call__(self, row: tuple) -> bool:
        node = self
        while node.split:
            f, cut, low, high = node.split
            node = low if row[f] < cut else high
        return node.label


@cache
def trained() -> Tree:
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.splitlines()])
    return Tree(table[:, :-1], table[:, -1])


def rows_of(blocks: list[Block]) -> Iterator[tuple]:
    """The features of each block."""
    for i, b in enumerate(blocks):
        p, n = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        yield b.context, b.density, b.words, p.density if p else 0.0, n.density if n else 0.0, p.words if p else 0, n.words if n else 0, int(b.heading)


def main_text(page: str | None) -> str:
    """The blocks of a page that the tree takes for article text, joined by an empty line. Null has none.

    Surrogates that a character reference may yield are replaced, as no UTF-8 text has them.
    """
    blocks, tree = blocks_of(page or ""), trained()
    text = "\n\n".join(b.text for b, row in zip(blocks, rows_of(blocks)) if tree(row))
    return text.encode("utf-8", "replace").decode("utf-8")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), one row per row of pages: the main text of each whole html.

    Null or empty html, and pages without article text, have empty text. page_id and
    url are passed on as they are, null or repeated; other columns are not read. Each
    row is worked on alone, so there is no shuffle.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = rows.drop("html").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, schema)
