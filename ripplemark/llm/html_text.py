"""Main text of web pages by tag-path ratios.

A page is read into leaf blocks, each with its root-to-leaf path of elements.
Text length and punctuation are summed per path; a path's ratios are these sums
per block. A block's ratios are those of its path, smoothed over its neighbours
in page order and fused with the path's share of the page's text; paths whose
blocks come out above a threshold are content.

What the ratios select decides where the article is: all of the article or main
element around the selected blocks, or else all from the first selected block to
the last, with the heading before them. Short paragraphs, headings and captions
in between belong to it. Elements and names that speak of boilerplate are weaker
evidence: they lower a block's score and leave out what is not selected, and
count for nothing where they would leave hardly any text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A comment, a tag with its attributes, a declaration, or a tag that the page's end cuts.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
      |<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]++)?)?)*+)>
      |<[!?/][^>]*(?:>|\Z)
      |<[a-zA-Z][^<>]*\Z""",
    re.S | re.X,
)
_NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Without text of the page: skipped to their end. The first two run to the page's end where that is missing.
_SKIPPED = set("script style noscript template textarea title svg iframe object canvas select annotation annotation-xml datalist".split())
_TO_THE_END = {"script", "style"}
_UNSEEN = {"head"}
#: Elements that speak of something beside the article.
_BESIDE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "header"}
_INLINE = set(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle
    msub msubsup msup mtext munder munderover none semantics""".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = re.compile(r"<(?:p|div|article|section|main|h[1-6]|table|ul|ol|blockquote|footer)[\s/>]", re.I)
#: Elements whose start ends an open one of the same kind, and within what.
_SIBLING = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_HEADINGS = {"h1", "h2", "h3"}
#: Names of parts that are not the article, and words that may stand beside one in a name.
_NAMES = set(
    """ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
    menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside complementary contentinfo widget notice
    notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login search social share
    sharing related recommended comment comments disqus reply replies respond discussion pagination pager toolbar""".split()
)
_NEUTRAL = set("site page top bottom left right main box container wrapper wrap block area section bar list links link item items inner outer".split())
#: Names that within an article are its own heading.
_TOP = {"header", "masthead", "banner"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_MARKS = re.compile(r"""[.,;:!?"'()’“”«»、。，]""")
#: A block is content from this share of the mean score on; names and elements that speak against it weigh so much.
THRESHOLD, DOUBT = 0.5, 0.1
#: Names and elements count as long as they leave this share of the text, and a heading as long as it is so many blocks ahead.
LEAST_LEFT, _AHEAD = 0.2, 6
_KERNEL = np.array([0.25, 0.5, 0.25])
_INLINE_LIMIT = 300


def _speaks_against(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element or a whole name of it says that it is not the article."""
    if name in _BESIDE and not (name == "header" and in_article):
        return True
    if name in ("html", "body", "main", "article"):
        return False
    for m in _NAMED.finditer(attributes):
        for one in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in _WORD.findall(one)]
            named = [w for w in words if w in _NAMES and not (in_article and w in _TOP)]
            if named and all(w in _NAMES or w in _NEUTRAL or w.isdigit() for w in words):
                return True
    return False


class Page:
    """Elements in page order, as parallel lists, and leaf blocks: their element, text and characters within links."""

    def __init__(self, html: str):
        self.names, self.up, self.against, self.paths = [""], [-1], [False], [0]
        self.element: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._known: dict[tuple[int, str], int] = {}
        self._read(html)
        n = len(self.names)
        #: blocks of an element are those from ``first`` to before ``last``
        self.first, self.last = [len(self.text)] * n, [0] * n
        for i, e in enumerate(self.element):
            self.first[e] = min(self.first[e], i)
            self.last[e] = i + 1
        for e in range(n - 1, 0, -1):
            p = self.up[e]
            self.first[p] = min(self.first[p], self.first[e])
            self.last[p] = max(self.last[p], self.last[e])

    def _open(self, name: str, parent: int, against: bool) -> int:
        self.names.append(name)
        self.up.append(parent)
        self.against.append(against)
        self.paths.append(self._path(self.paths[parent], name))
        return len(self.names) - 1

    def _path(self, parent: int, name: str) -> int:
        return self._known.setdefault((parent, name), len(self._known) + 1)

    def _read(self, html: str) -> None:
        stack, articles, unseen = [0], 0, 0  # open elements, and how many of them are articles or not seen
        parts: list[str] = []
        link_from, linked = -1, 0  # parts since a link's start, characters of links that have ended
        unclosed: set[str] = set()
        at, end = 0, len(html)

        def flush():
            nonlocal linked, link_from
            if link_from >= 0:
                linked += sum(map(len, parts[link_from:]))
                link_from = 0
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.element.append(stack[-1])
                    self.text.append(text)
                    self.linked.append(min(linked, len(text)))
                parts.clear()
            linked = 0

        def close(to: int):
            nonlocal articles, unseen
            flush()
            for e in stack[to:]:
                articles -= self.names[e] in ("article", "main")
                unseen -= self.names[e] in _UNSEEN
            del stack[to:]

        while at < end:
            m = _TAG.search(html, at)
            if not unseen and (m.start() if m else end) > at:
                parts.append(html[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name in _SKIPPED and not m[1]:
                if m[3].rstrip().endswith("/") and name == "svg":
                    continue
                stop = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if stop and name in ("svg", "select") and _BLOCK.search(html, at, stop.start()) and "foreignobject" not in html[at : stop.start()].lower():
                    continue  # its own end is missing
                if stop:
                    at = stop.end()
                elif name in _TO_THE_END:
                    at = end
                else:
                    unclosed.add(name)
                    continue
                if name not in ("svg", "canvas", "annotation", "annotation-xml"):
                    flush()
                continue
            if name in _INLINE:
                if name == "a":
                    if m[1] and link_from >= 0:
                        linked += sum(map(len, parts[link_from:]))
                        link_from = -1
                    elif not m[1] and link_from < 0:
                        link_from = len(parts)
                elif not m[1] and m[3] and _speaks_against(name, m[3], True):  # a short advert or the like within a line
                    stop = re.compile(rf"</{name}\s*>", re.I).search(html, at, at + _INLINE_LIMIT)
                    if stop and not _BLOCK.search(html, at, stop.start()):
                        at = stop.end()
                continue
            if m[1]:
                opened = next((i for i in range(len(stack) - 1, 0, -1) if self.names[stack[i]] == name), None)
                if opened is not None:
                    close(opened)
                elif name in ("p", "br"):
                    flush()
                continue
            if name in _VOID:
                if name in ("br", "hr") and not unseen:
                    parts.append(" ")
                continue
            if name == "body":  # whatever of the head is still open ends here
                close(next((i for i, e in enumerate(stack) if self.names[e] == "head"), len(stack)))
            for i in range(len(stack) - 1, 0, -1):
                inner = self.names[stack[i]]
                if inner == "p" or inner == name and name in _SIBLING:
                    close(i)
                    break
                if inner in ("article", "div", "section", "main", "body", "td", *_SIBLING.get(name, ())):
                    break
            flush()
            stack.append(self._open(name, stack[-1], _speaks_against(name, m[3], articles > 0)))
            articles += name in ("article", "main")
            unseen += name in _UNSEEN
        flush()

    def around(self, e: int) -> Iterator[int]:
        """An element and those around it, outwards."""
        while e > 0:
            yield e
            e = self.up[e]

    def common(self, elements: list[int]) -> int:
        """The innermost element around all of these."""
        ways = [list(self.around(e))[::-1] for e in {*elements}]
        shared = [level[0] for level in zip(*ways) if len(set(level)) == 1]
        return shared[-1] if shared else 0


def path_ratios(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block's path: characters a block, punctuation marks a block (and one for all), share of all text.

    Blocks that are mostly links have a path of their own under their element, and no punctuation to speak of.
    """
    chars, linked = np.array([len(t) for t in page.text], float), np.array(page.linked, float)
    links = linked * 2 > chars
    _, path = np.unique([2 * page.paths[e] + x for e, x in zip(page.element, links, strict=True)], return_inverse=True)
    marks = np.array([0 if x else len(_MARKS.findall(t)) for t, x in zip(page.text, links, strict=True)], float)
    blocks = np.bincount(path)
    length, points = np.bincount(path, chars - linked), np.bincount(path, marks)
    return (length / blocks)[path], ((points + 1) / blocks)[path], (length / max(1.0, (chars - linked).sum()))[path]


def doubted(page: Page) -> np.ndarray:
    """Blocks inside an element that speaks against them, unless this would leave hardly any text."""
    mass = np.array([len(t) - x for t, x in zip(page.text, page.linked, strict=True)], np.int64)
    upto, n_against = np.concatenate(([0], np.cumsum(mass))), np.zeros(len(mass), np.int64)
    elements = [e for e in range(len(page.names)) if page.against[e] and page.first[e] < page.last[e]]
    for e in elements:
        n_against[page.first[e] : page.last[e]] += 1
    # the element with the most text first, an outer one before those inside
    for e in sorted(elements, key=lambda e: (upto[page.first[e]] - upto[page.last[e]], e)):
        if mass[n_against == 0].sum() >= LEAST_LEFT * mass.sum():
            break
        n_against[page.first[e] : page.last[e]] -= 1
    return n_against > 0


def scores(page: Page, doubt: np.ndarray) -> np.ndarray:
    """Smoothed and fused path ratios, less where there is doubt."""
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), _KERNEL, mode="valid")
    length, points, share = path_ratios(page)
    return np.sqrt(smooth(length) * smooth(points) * share) * np.where(doubt, DOUBT, 1.0)


def content(page: Page, named: bool = True) -> list[int]:
    """Numbers of the blocks of the article; without ``named`` by the ratios alone."""
    if not page.text:
        return []
    doubt = doubted(page) if named else np.zeros(len(page.text), bool)
    score = scores(page, doubt)
    mass = np.array([len(t) - x for t, x in zip(page.text, page.linked, strict=True)], float)
    mean = float(score @ mass / mass.sum()) if mass.sum() else 0.0
    chosen = score >= THRESHOLD * mean
    plain = np.array(page.linked) * 2 <= np.array([len(t) for t in page.text])
    picked = np.flatnonzero(chosen)
    box = page.common([page.element[i] for i in picked])
    whole = next((e for e in page.around(box) if page.names[e] == "article"), 0) or next(
        (e for e in list(page.around(box))[::-1] if page.names[e] == "main"), 0
    )
    if named and whole:
        return [i for i in range(page.first[whole], page.last[whole]) if chosen[i] or not doubt[i]]
    first, last = int(picked[0]), int(picked[-1]) + 1
    for i in range(first - 1, max(-1, first - 1 - _AHEAD), -1):  # the heading, if only plain text is between
        if doubt[i] or not plain[i]:
            break
        if page.names[page.element[i]] in _HEADINGS:
            first = i
            break
    return [i for i in range(first, last) if chosen[i] or plain[i] and not doubt[i]]


def main_text(html: str | None) -> str:
    """The main text of one page; empty for null, for empty pages and for pages without text."""
    page = Page(html or "")
    return " ".join(page.text[i] for i in content(page))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null and empty html give the empty text; bytes that are not UTF-8 become
    replacement characters. Rows may repeat, ids and urls may be null. Extra columns, whatever their names, play no part.
    """
    rows = pages.select(
        F.col(html_col).cast("binary").alias("_html"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text((h.as_py() or b"").decode("utf-8", "replace")) for h in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["_id", "_url", "text", "n_chars"],
            )

    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return (
        rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], *added]))
        .withColumnRenamed("_id", id_col)
        .withColumnRenamed("_url", url_col)
    )
