"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at block-level tags. Each block is described
by its number of words and the share of them in links, by the same of the
blocks before and after it, and by what kinds of elements enclose it. A
decision tree trained on the small labelled table below says which blocks are
main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sonaria.llm.common import bound_batches

# Element names of the HTML standard, by their part in a page.
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe object embed applet svg math canvas audio video map select datalist option button textarea head title".split())
#: Hidden elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements around what belongs to the site and not to the page.
FRAME = frozenset("nav header footer aside form dialog menu fieldset".split())
#: Words in class, id and role that name such parts.
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus dialog "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related "
    "reply replies search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget alert contentinfo complementary".split()
)
#: Elements and names around the main text.
MAIN = frozenset("article main".split())
MAIN_NAMES = frozenset("article content main post story entry body text".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|$)|<[/A-Za-z][^<>]*$", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")

#: What a block is described by.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_frame", "in_main", "heading")


def _names(attributes: str) -> tuple[set[str], bool]:
    """(words of class, id and role; whether the element is hidden)."""
    found, hidden = set(), False
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if m[1].lower() == "hidden":
            hidden = True
        elif m[1].lower() == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            found.update(NAME.findall(value.lower()))
    return found, hidden


class Block:
    __slots__ = ("text", "words", "linked", "frame", "main", "heading")

    def __init__(self, text: str, linked: int, frame: bool, main: bool, heading: bool) -> None:
        self.text, self.words, self.linked = text, len(text.split(" ")), linked
        self.frame, self.main, self.heading = frame, main, heading


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, references decoded and white space folded."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, and whether it or one around it is a frame, main, hidden
    frame = main = hidden = False
    link = heading = 0

    def end() -> None:
        text = BLANK.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text:
            n = len(BLANK.sub(" ", html.unescape("".join(linked))).split())
            out.append(Block(text, n, frame, main, heading > 0))
        parts.clear()
        linked.clear()

    at, low = 0, None
    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not hidden:
            parts.append(piece)
            if link:
                linked.append(piece)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            end()
        elif name == "img" or name == "wbr":
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for closed in stack[k:]:
                        if closed[0] == "a":
                            link -= 1
                            linked.append(" ")  # the next link's words are its own
                        heading -= len(closed[0]) == 2 and closed[0][0] == "h" and closed[0][1] in "123456"
                    del stack[k:]
                    _, frame, main, hidden = stack[-1] if stack else ("", False, False, False)
                    break
                if stack[k][0] in MAIN or stack[k][0] in FRAME and name not in FRAME and name not in MAIN:
                    break  # a stray end tag closes nothing outside
        elif name in VOID or m[3].endswith("/") and name not in ("p", "div", "a"):
            continue
        else:
            names, unseen = _names(m[3]) if m[3] else (set(), False)
            top = name in ("html", "body")
            if name in RAW:
                low = low or page.lower()
                close = low.find(f"</{name}", at)
                at = len(page) if close < 0 else page.find(">", close) + 1 or len(page)
                continue
            frame = frame or not top and (name in FRAME or bool(names & FRAME_NAMES))
            main = main or name in MAIN or not top and bool(names & MAIN_NAMES)
            hidden = hidden or unseen or name in HIDDEN and name != "head"
            stack.append((name, frame, main, hidden))
            link += name == "a"
            heading += len(name) == 2 and name[0] == "h" and name[1] in "123456"
    end()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in found], float)
        density = np.array([min(1.0, b.linked / b.words) for b in found])
        x[:, 0], x[:, 1] = words, density
        x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
        x[:, 6] = [b.frame for b in found]
        x[:, 7] = [b.main for b in found]
        x[:, 8] = [b.heading for b in found]
    return x


#: The labelled table: FEATURES, then 1 for main text. Blocks of invented pages, labelled by hand: articles with
#: and without enclosing elements, menus, notices, adverts, side columns, forms, comments and footers.
LABELLED = np.array(
    [
        # links in menus, with and without an enclosing element
        (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0),
        (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 1.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0),
        (6, 0.8, 3, 1.0, 4, 1.0, 0, 0, 0, 0), (8, 1.0, 30, 0.1, 7, 1.0, 0, 0, 0, 0), (9, 0.6, 8, 0.7, 8, 0.9, 0, 0, 0, 0),
        # adverts, notices, side columns, forms, footers and comments inside their elements
        (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (14, 0.0, 2, 1.0, 10, 0.0, 1, 0, 0, 0), (30, 0.0, 8, 0.0, 60, 0.0, 1, 0, 0, 0),
        (45, 0.1, 70, 0.0, 20, 0.0, 1, 0, 0, 0), (12, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0), (20, 0.2, 40, 0.0, 3, 1.0, 1, 0, 0, 0),
        (60, 0.0, 40, 0.0, 55, 0.0, 1, 0, 0, 0), (5, 0.0, 1, 0.0, 2, 0.0, 1, 0, 0, 0), (3, 0.0, 4, 0.0, 40, 0.0, 1, 0, 1, 0),
        (25, 0.0, 90, 0.0, 31, 0.0, 1, 1, 0, 0), (9, 0.0, 120, 0.0, 6, 0.0, 1, 1, 0, 0), (4, 1.0, 60, 0.0, 50, 0.0, 1, 1, 0, 0),
        (70, 0.0, 12, 0.0, 44, 0.0, 1, 1, 0, 0), (2, 0.0, 70, 0.0, 30, 0.0, 1, 1, 1, 0), (1, 1.0, 3, 1.0, 2, 1.0, 1, 1, 0, 0),
        # paragraphs and headings of an article in its element, short ones and such with links too
        (9, 0.0, 8, 0.0, 30, 0.0, 0, 1, 1, 1), (30, 0.0, 9, 0.0, 60, 0.0, 0, 1, 0, 1), (120, 0.0, 45, 0.0, 80, 0.0, 0, 1, 0, 1),
        (1, 0.0, 90, 0.0, 70, 0.0, 0, 1, 0, 1), (3, 0.0, 60, 0.0, 12, 0.0, 0, 1, 0, 1), (55, 0.1, 40, 0.0, 30, 0.0, 0, 1, 0, 1),
        (18, 0.4, 50, 0.0, 45, 0.0, 0, 1, 0, 1), (6, 1.0, 80, 0.0, 66, 0.0, 0, 1, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 0, 1, 0, 1),
        (5, 0.0, 70, 0.0, 90, 0.0, 0, 1, 1, 1), (40, 0.0, 6, 0.0, 11, 0.0, 0, 1, 0, 1), (75, 0.0, 100, 0.0, 0, 0.0, 0, 1, 0, 1),
        (1, 1.0, 40, 0.2, 35, 0.0, 0, 1, 0, 1), (4, 0.0, 1, 1.0, 22, 0.0, 0, 1, 1, 1), (12, 0.0, 9, 0.0, 0, 0.0, 0, 1, 0, 1),
        # text without any enclosing element
        (60, 0.0, 5, 0.0, 80, 0.0, 0, 0, 0, 1), (95, 0.1, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (16, 0.0, 50, 0.0, 64, 0.0, 0, 0, 0, 1),
        (4, 0.0, 70, 0.0, 85, 0.0, 0, 0, 0, 1), (7, 0.0, 4, 1.0, 60, 0.0, 0, 0, 1, 1), (24, 0.0, 33, 0.0, 28, 0.0, 0, 0, 0, 1),
        (35, 0.2, 90, 0.0, 41, 0.0, 0, 0, 0, 1), (50, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (11, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
        (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (6, 0.0, 0, 0.0, 45, 0.0, 0, 0, 1, 1), (5, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 1),
        # main text beside menus and lists of links, and small labels between links
        (60, 0.0, 40, 0.0, 1, 1.0, 0, 1, 0, 1), (25, 0.1, 30, 0.0, 2, 1.0, 0, 1, 0, 1), (7, 0.0, 44, 0.0, 3, 1.0, 0, 1, 0, 1),
        (1, 1.0, 0, 0.0, 20, 0.0, 0, 1, 0, 1), (1, 1.0, 25, 0.0, 0, 0.0, 0, 1, 0, 1), (2, 1.0, 12, 0.0, 3, 1.0, 0, 1, 0, 1),
        (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1), (2, 1.0, 1, 1.0, 30, 0.0, 0, 1, 0, 1), (5, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1),
        (20, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0, 1), (22, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
        (1, 1.0, 1, 1.0, 20, 0.0, 0, 0, 0, 0), (2, 1.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 1.0, 25, 0.0, 1, 1.0, 0, 0, 0, 0),
        (2, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1), (33, 0.0, 2, 1.0, 5, 1.0, 0, 1, 0, 1), (80, 0.0, 60, 0.0, 1, 1.0, 0, 1, 0, 1),
        (60, 0.0, 50, 0.0, 3, 1.0, 0, 0, 0, 1), (38, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 1), (90, 0.1, 70, 0.0, 2, 1.0, 0, 0, 0, 1),
        (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (2, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 4, 1.0, 0, 0, 1, 0),
        (1, 0.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0), (3, 0.0, 2, 1.0, 60, 0.0, 1, 0, 0, 0), (40, 0.0, 2, 1.0, 3, 1.0, 1, 1, 0, 0),
        # lines of pages without any enclosing element: what stands beside them tells mottos and notes from short paragraphs
        (6, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0), (12, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (9, 0.0, 5, 1.0, 0, 0.0, 0, 0, 0, 0),
        (14, 0.0, 6, 1.0, 4, 1.0, 0, 0, 0, 0), (8, 0.0, 8, 0.9, 0, 0.0, 0, 0, 0, 0), (10, 0.0, 3, 1.0, 6, 1.0, 0, 0, 0, 0),
        (9, 0.0, 4, 1.0, 6, 0.0, 0, 0, 0, 0), (7, 0.0, 6, 1.0, 5, 0.0, 0, 0, 0, 0), (12, 0.0, 3, 1.0, 8, 0.0, 0, 0, 0, 0),
        (7, 0.0, 5, 0.0, 4, 1.0, 0, 0, 0, 0), (6, 0.0, 9, 0.0, 3, 1.0, 0, 0, 0, 0), (11, 0.0, 7, 0.0, 2, 1.0, 0, 0, 0, 0),
        (6, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 1), (9, 0.0, 60, 0.0, 35, 0.0, 0, 0, 0, 1), (12, 0.0, 25, 0.0, 70, 0.0, 0, 0, 0, 1),
        (8, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 1), (10, 0.0, 4, 1.0, 50, 0.0, 0, 0, 0, 1), (12, 0.0, 45, 0.0, 5, 1.0, 0, 0, 0, 1),
        (3, 1.0, 6, 0.0, 20, 0.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 25, 0.0, 0, 0, 0, 0), (5, 0.9, 40, 0.0, 50, 0.0, 0, 0, 0, 0),
        (40, 0.0, 4, 0.0, 2, 0.5, 0, 0, 0, 1), (20, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 1), (60, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0, 1),
        (30, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 1), (18, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 1), (45, 0.1, 0, 0.0, 3, 1.0, 0, 0, 0, 1),
        (2, 0.0, 2, 1.0, 18, 0.0, 0, 0, 1, 1), (4, 0.0, 1, 1.0, 13, 0.0, 0, 0, 1, 1), (3, 0.0, 2, 0.5, 22, 0.0, 0, 0, 1, 1),
        (6, 0.0, 3, 1.0, 28, 0.0, 0, 0, 1, 1), (5, 0.0, 33, 0.0, 3, 1.0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 8, 0.0, 0, 0, 0, 1),
    ]
)


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1) -> None:
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        best = (1e-12, -1, 0.0)
        if depth and len(y) >= 2 * least and 0 < y.mean() < 1:
            impurity = y.mean() * (1 - y.mean())
            for j in range(x.shape[1]):
                v = np.unique(x[:, j])
                for cut in (v[1:] + v[:-1]) / 2:
                    left = x[:, j] < cut
                    a, b = y[left], y[~left]
                    if min(len(a), len(b)) >= least:
                        gain = impurity - (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) / len(y)
                        best = max(best, (gain, -j, -cut), key=lambda g: g[0])
        if best[1] <= 0 and best[0] > 1e-12:
            j, cut = -best[1], -best[2]
            left = x[:, j] < cut
            kids = self._grow(x[left], y[left], depth - 1, least), self._grow(x[~left], y[~left], depth - 1, least)
            self.nodes[at] = (j, cut, *kids, float(y.mean()))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of main text in the leaf of each row."""
        out = np.empty(len(x))
        rows = [(0, np.arange(len(x)))]
        while rows:
            at, some = rows.pop()
            j, cut, left, right, share = self.nodes[at]
            if j < 0:
                out[some] = share
            else:
                low = x[some, j] < cut
                rows += [(left, some[low]), (right, some[~low])]
        return out


def train(table: np.ndarray = LABELLED) -> Tree:
    return Tree(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = tree.predict(describe(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """pages with the main text of column html in a column text, and n_chars, its code points.

    pages: html and any other columns, which stay, unless they are named text or n_chars. A null or empty page,
    and one without main text, has the empty text; equal pages have equal texts; broken markup is read as far as
    it goes; an empty table stays empty.
    """
    bound_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    names = pages.columns
    told = pages.sparkSession.sparkContext.broadcast(tree or train())
    pages = pages.withColumn("html", F.col("html").cast("string"))
    schema = StructType(pages.schema.fields + StructType.fromDDL("text string, n_chars long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                texts = [main_text(p, told.value) for p in some.column(names.index("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
