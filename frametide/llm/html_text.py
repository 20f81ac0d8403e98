"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block tag ends a line. A line weighs as many characters as it has outside links (a heading: all of
them). Containers only weigh lines: what a page's navigation, footer, aside, form, script or hidden elements hold has no
line at all, what a class, id or role names as boilerplate weighs ``MARKED`` of its length, and where a page marks an article
only the unmarked lines in it weigh anything. Both kinds of container stand apart by ``BLOCK`` empty lines.

The weights of each ``BLOCK`` consecutive lines are summed. Text dives where a sum falls to the dive level and surges where it rises
above it; a region is what lies between. In an article the dive level is zero, so that only menus (``BLOCK`` lines or more of links
alone), boilerplate and gaps are cut, and every region stays. On any other page it is ``DIVE`` of the page's densest block.
There the heaviest region stays, with each whose densest block surges to ``DENSITY`` of that one's, each that has lines in the
element around it or in a sibling like that one (a page's body counts only for what stands in it directly), and the unmarked lines
between these. White space between tags is not a line.

Defined results: a null or empty page has an empty text; a page without markup is one text; unclosed tags, a cut-off page
and stray ``<`` are read as browsers do, as far as a scan without a tree can; very long pages are scanned in linear time and held by
their own task alone; repeated rows are each returned; of equally heavy regions the first leads; null ids and urls are kept; an empty
table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import table

#: Lines in a block.
BLOCK = 3
#: Of the densest block of the heaviest region: what a region outside that one's container must surge to.
DENSITY = 0.35
#: Of the page's densest block: at or below this a block dives, on a page without a marked article.
DIVE = 0.02
#: What a character of a heading counts there, so that one alone between other elements doesn't dive.
HEADING = 8
#: What a character counts in a container that a class, id or role names as boilerplate.
MARKED = 1 / 64

#: Elements whose content is never text: skipped up to their end tag.
OPAQUE = frozenset("script style noscript template svg math iframe object canvas select option textarea button head title video audio map".split())
#: Elements that hold no main text; header only outside an article.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense banner promo promotion promoted sponsor sponsored menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar sidebars widget footer masthead comment comments commentlist disqus respond reply replies notice notices cookie cookies consent "
    "alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager "
    "toolbar search complementary contentinfo disclaimer paywall".split()
)
#: Words beside these that leave a name what it is: main-menu and ad-box mark boilerplate, search-algorithms and related-work don't.
NEUTRAL = frozenset(
    "area bar block box bottom button buttons col column container count feed field footer foot form global google group head header inner item items left link links "
    "list main media message page panel post posts primary reader readers right row secondary section site slot sub text title top unit user users wrap wrapper".split()
)
#: A class that begins so (with-sidebar, no-ads) describes the layout around the main text.
LAYOUT = frozenset("with has no without is not".split())
#: Further words that are neutral after a mark: comment-body, but not content-sidebar.
AFTER = frozenset("body content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a whole page or article, whatever their classes say.
KEPT = frozenset(("html", "body", "main", "article"))

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
#: What stands between the links of a menu.
BETWEEN_LINKS = re.compile(r"[^\w]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _marked(attributes: str, whole: bool = False) -> bool:
    """Whether a class, id or role names boilerplate; ``whole``: only by a class that is such a word itself."""
    if not attributes or attributes.isspace():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [token] if whole else WORDS.findall(token)
                if words and words[0] not in LAYOUT and not MARKS.isdisjoint(words):
                    others = MARKS | NEUTRAL | AFTER if words[0] in MARKS else MARKS | NEUTRAL
                    if others.issuperset(words):
                        return True
    return False


def _hidden(attributes: str) -> bool:
    if not attributes or attributes.isspace():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden" or name == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true":
            return True
    return bool(HIDDEN_STYLE.search(attributes))


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE)


class Element:
    """An element that holds lines ``start`` to ``end`` of the page."""

    __slots__ = ("name", "attributes", "parent", "start", "end")

    def __init__(self, name: str, attributes: str, parent: Element | None, start: int) -> None:
        self.name, self.attributes, self.parent, self.start, self.end = name, " ".join(attributes.split()), parent, start, start


@dataclass(slots=True)
class Line:
    """A line of text. ``plain``: characters outside links; ``kind``: the block tag before it. A gap is a line without text."""

    text: str = ""
    plain: int = 0
    kind: str = ""
    marked: bool = False
    inside: bool = False
    holder: Element | None = None


class _Open:
    """Open elements, with how often each name is open, so that a stray end tag costs no search."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def pop(self) -> str:
        name = self.names.pop()
        self.count[name] -= 1
        return name


def lines_of(page: str) -> tuple[list[Line], list[Element]]:
    """The lines of a page, and its elements; the first of these is the page itself."""
    out: list[Line] = []
    line: list[str] = []
    linked: list[bool] = []  # of each part of the line
    open_ = _Open()  # elements that are open, but paragraphs and other leaves
    elements = [Element("html", "", None, 0)]
    around = [elements[0]]  # the page and the elements of open_
    within = _Open()  # elements that are open inside boilerplate; the first is its container
    hard: list[bool] = []  # of those: whether it holds no line at all
    dropped = 0  # how many of them hold none
    never_closed: set[str] = set()
    depth = 0  # of article and main
    at, kind, link = 0, "", False

    def end_line() -> None:
        nonlocal link
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                plain = len(text)
                if kind not in HEADINGS and any(linked):
                    plain = len(BETWEEN_LINKS.sub("", html.unescape("".join(x for x, y in zip(line, linked) if not y))))
                out.append(Line(text, plain, kind, bool(within.names), depth > 0, around[-1]))
            line.clear()
            linked.clear()
        link = False

    def gap_here() -> None:
        end_line()
        out.extend(Line(inside=depth > 0, holder=around[-1]) for _ in range(BLOCK))

    def leave() -> None:
        nonlocal dropped
        within.pop()
        dropped -= hard.pop()

    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not dropped:
            line.append(page[at:end])
            linked.append(link)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name == "a":
                link = False
            if within.names:
                if within.count[name]:
                    if name in BLOCKS and not dropped:
                        end_line()
                    cut = False
                    while within.names:
                        cut |= hard[-1]
                        top = within.names[-1]
                        if len(within.names) == 1:  # the container itself: its lines end here
                            gap_here()
                        leave()
                        if top == name:
                            break
                    if cut and within.names:
                        gap_here()
                    continue
                if name not in KEPT or not open_.count[name]:
                    if name in BLOCKS and not dropped:
                        end_line()
                    continue
                gap_here()  # a container that was never closed ends with the element around it
                while within.names:
                    leave()
            if name in BLOCKS:
                end_line()
            if open_.count[name]:
                while open_.names:
                    top = open_.pop()
                    around.pop().end = len(out)
                    if top in ("article", "main"):
                        depth -= 1
                    if top == name:
                        break
            continue
        if name in OPAQUE:
            if m[3].rstrip().endswith("/") or name in never_closed:
                continue
            close = _closing(name).search(page, at)
            if close:
                at = close.end()
            elif name in ("script", "style", "textarea", "svg"):
                at = len(page)
            else:
                never_closed.add(name)
            continue
        if name in VOID:
            if name in BLOCKS and not dropped:
                end_line()
            continue
        if name == "a":
            link = not dropped
        if m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS and not dropped:
            end_line()
            kind = name
        none = name in ASIDE or name == "header" and not depth or name not in KEPT and _hidden(m[3])
        if within.names:
            if name not in ("p", "li", "dt", "dd", "tr", "td", "th") or none or name == within.names[0]:
                if none and not dropped:
                    gap_here()
                within.push(name)
                hard.append(none)
                dropped += none
            continue
        if none or name not in KEPT and _marked(m[3]) or name == "article" and depth > 0 and _marked(m[3], whole=True):
            gap_here()
            within.push(name)
            hard.append(none)
            dropped += none
            continue
        if name in ("article", "main", "body", "html", "section", "div"):
            open_.push(name)
            elements.append(Element(name, m[3], around[-1], len(out)))
            around.append(elements[-1])
            if name in ("article", "main"):
                depth += 1
    end_line()
    for element in around:
        element.end = len(out)
    return out, elements


def beside(own: Element, elements: list[Element], lines: list[Line]) -> bytearray:
    """Marks the lines in the element ``own``, or in a sibling of it that is like it."""
    marks = bytearray(len(lines))
    if own.name in ("html", "body"):
        for i, x in enumerate(lines):
            marks[i] = x.holder is own
        return marks
    for x in elements:
        if x is own or x.parent is own.parent and x.name == own.name and (x.name == "section" or x.attributes == own.attributes):
            marks[x.start : x.end] = b"\1" * (x.end - x.start)
    return marks


def block_sums(weights: list[float], block: int = BLOCK) -> list[float]:
    """The sums of each ``block`` consecutive weights, from the block that ends with the first one to that which begins with the last one."""
    total, sums = 0, []
    padded = [*weights, *[0] * (block - 1)]
    for i, w in enumerate(padded):
        total += w - (padded[i - block] if i >= block else 0)
        sums.append(total)
    return sums


def regions(weights: list[float], low: float = 0, ends: bool = True, block: int = BLOCK, cuts: list[bool] | None = None) -> list[tuple[int, int, float, float]]:
    """``(start, end, weight, densest block)`` of each run of lines between a surge and a dive of the block sums.

    A line is outside if it is in a block with a sum of ``low`` or less, or is one of ``cuts``. ``ends``: blocks that reach beyond the first
    or last line count, too.
    """
    n = len(weights)
    sums = block_sums(weights, block)  # that of lines i - block + 1 to i is at i
    found, start, out_to, densest, total = [], -1, -1, 0.0, 0.0
    for i in range(n):
        for j in (range(i, min(i + block, len(sums))) if i == 0 else (i + block - 1,)):  # the blocks that line i is the first to be in
            if sums[j] <= low and (ends or block - 1 <= j < n):
                out_to = j
        if i <= out_to or cuts and cuts[i]:
            if start >= 0:
                found.append((start, i, total, densest))
                start = -1
            continue
        if start < 0:
            start, total, densest = i, 0.0, 0.0
        total += weights[i]
        densest = max(densest, sums[i])
    if start >= 0:
        found.append((start, n, total, densest))
    return found


def main_text(page: str | None) -> str:
    lines, elements = lines_of(page or "")
    if any(x.inside and not x.marked and x.plain for x in lines):
        lines = [x for x in lines if x.inside]
        found = regions([0 if x.marked else x.plain for x in lines], ends=False)
        return " ".join(x.text for a, b, _, _ in found for x in lines[a:b] if x.text and not x.marked)
    return " ".join(x.text for x in _unmarked(lines, elements))


def _unmarked(lines: list[Line], elements: list[Element]) -> list[Line]:
    """The main text of a page without a marked article."""
    marked = 0 if any(e.name in ("article", "main") for e in elements) else MARKED  # beside an empty article boilerplate is nothing else
    weights = [x.plain * (marked if x.marked else HEADING if x.kind in HEADINGS else 1) for x in lines]
    menus = [not x.plain and bool(x.text) and x.kind != "p" for x in lines]  # a line of links alone, but in a paragraph
    found = regions(weights, DIVE * max(block_sums(weights), default=0), cuts=menus)
    if not found:
        return []
    best = max(found, key=lambda r: (r[2], -r[0]))
    share: Counter[int] = Counter()
    for x, w in zip(lines[best[0] : best[1]], weights[best[0] : best[1]]):
        share[id(x.holder)] += w
    most = max(share.values())
    own = beside(next(x.holder for x in lines[best[0] : best[1]] if share[id(x.holder)] == most), elements, lines)
    held = bytearray(a and not x.marked and w > 0 and not m for a, x, w, m in zip(own, lines, weights, menus))
    kept = [r for r in found if r is best or r[3] >= DENSITY * best[3] or any(held[r[0] : r[1]])]
    keep = bytearray(held)
    for a, b, _, _ in kept:
        keep[a:b] = b"\1" * (b - a)
    first, last = keep.find(1), keep.rfind(1)
    between = (not x.marked and not m for x, m in zip(lines[first:last], menus[first:last]))
    keep[first:last] = bytes(bool(k or x) for k, x in zip(keep[first:last], between))
    return [x for k, x in zip(keep, lines) if k and x.text]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page. No shuffle."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return slim.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
