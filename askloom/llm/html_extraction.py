"""Main-text extraction (op 9) by composite text density.

A page is parsed to a tree in which left-open paragraphs, list items and cells end where the next begins. Menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by element, role or
the words of id and class, are no part of the tree. For each node the density is characters per tag, adjusted by the
share of link text:

    density = C/T * log(C/LC * T/LT) / log(log(C/NC * LC + LCb/Cb * C + e))

with C characters, T tags, LC and LT those in links, NC = C - LC, and b the body; a zero denominator counts as 1. A
run of text directly in a node counts as a child of it. The node whose children's densities have the greatest sum
leads; the least density on its path to the body is the threshold. Of every node of the tree that reaches it, the node
below with the greatest sum is content, with all it holds.

An empty or null page, or one without text, gives an empty string. A page that is cut off ends where it ends; every
open element is closed there. Pages are rows of their own, so repeated rows give repeated results; depth and length of
a page are not limited (no recursion).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import table

# fixed values: classes of HTML elements, from the public standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea select title noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html dd dt li option legend summary tbody td tfoot th thead tr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
FORMAT = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
SCOPE = frozenset("table ul ol dl body article section div main td th blockquote".split())
# fixed values: elements, roles and words of id and class that mark what is no main text
ASIDE = frozenset("nav footer aside form dialog menu head button input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar sidebars aside widget widgets related recommended share sharing social comment comments commentlist discussion respond replies reply disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search pagination pager toolbar copyright outbrain taboola paywall".split()
)
OUTSIDE = frozenset({"header", "topbar", "top"})
TAG = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTR.findall(text)}


def is_aside(tag: str, rest: str, inside: bool) -> bool:
    """Whether an element is no main text; inside: it stands in an article."""
    if tag in ASIDE or tag == "header" and not inside:
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    own = attributes(rest)
    if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    found = {x.lower() for x in NAME.findall(f"{own.get('id', '')} {own.get('class', '')}")}
    return bool(found & NAMES or not inside and found & OUTSIDE)


class Tree:
    """Nodes in page order (a parent stands before its children) and runs of text with the node that holds each.
    Parsing takes time in proportion to the page, however broken it is: nothing is scanned twice."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.texts = ["body"], [-1], []
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}  # by name: places in the stack
        self.scopes: list[int] = []
        self._parse(html)

    def _last(self, names: tuple[str, ...]) -> int:
        return max((held[-1] for n in names if (held := self.open.get(n))), default=0)

    def _close(self, upto: tuple[str, ...], stop: int) -> None:
        """Ends the innermost open element of these names and all inside it, unless it stands before place `stop`."""
        k = self._last(upto)
        if k and k >= stop:
            self._cut(k)

    def _cut(self, k: int) -> None:
        block = False
        last = self.stack[-1]
        for i in reversed(self.stack[k:]):
            tag = self.tags[i]
            block |= tag in BLOCK
            self.open[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
        if block:
            self.texts.append((last, None))
        del self.stack[k:]

    def _push(self, tag: str) -> None:
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def _parse(self, html: str) -> None:
        at, skip, depth = 0, "", 0  # within `skip` nothing counts; depth: open elements of that name
        unquoted = set()  # quotes that do not occur again
        while True:
            m = TAG.search(html, at)
            if not skip and (end := m.start() if m else len(html)) > at:
                self.texts.append((self.stack[-1], html[at:end]))
            if m is None:
                return
            tag = m[2]
            if tag is None:
                closer = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                end = html.find(closer, m.end())
                at = end + len(closer) if end >= 0 else len(html)
                continue
            at = m.end()
            while (found := STOP.search(html, at)) and (quote := found[1]):
                end = -1 if quote in unquoted else html.find(quote, found.end())
                if end < 0:
                    unquoted.add(quote)
                at = end + 1 if end >= 0 else found.end()
            if found is None:
                return  # the page ends inside a tag
            rest, at = html[m.end() : found.start()], found.end()
            tag, ends = tag.lower(), m[1]
            if skip:
                if tag == skip:
                    depth += -1 if ends else not rest.endswith("/")
                    if depth <= 0:
                        skip = ""
                continue
            if ends:
                if tag == "br":
                    self.texts.append((self.stack[-1], " "))
                elif tag not in ("body", "html"):
                    self._close((tag,), 0 if tag in SCOPE or not self.scopes else self.scopes[-1])
                continue
            if tag in RAW:
                if not rest.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                    at = close.end() if close else len(html)
                continue
            if tag in ("html", "body"):
                continue
            if tag in ENDS_P:
                self._close(("p",), self.scopes[-1] if self.scopes else 0)
            if tag in ENDS:
                self._close(ENDS[tag], self._last(("table", "ul", "ol", "dl")))
            if is_aside(tag, rest, bool(self.open.get("article") or self.open.get("main"))):
                self.texts.append((self.stack[-1], None))
                if tag not in VOID and not rest.endswith("/"):
                    skip, depth = tag, 1
                continue
            if tag in VOID:
                self.texts.append((self.stack[-1], " " if tag == "br" else None if tag == "hr" else ""))
                continue
            self._push(tag)
            if tag in BLOCK:
                self.texts.append((self.stack[-1], None))
            if rest.endswith("/") and tag not in BLOCK:
                self._cut(len(self.stack) - 1)


def content(tree: Tree) -> set[int]:
    """The nodes whose text is the main text. Elements that only format text are no tags: they belong to the node around."""
    n = len(tree.tags)
    node = list(range(n))  # what stands for each element
    for i in range(1, n):
        if tree.tags[i] in FORMAT:
            node[i] = node[tree.parents[i]]
    kept = [i for i in range(n) if node[i] == i]
    above = [-1, *(node[p] for p in tree.parents[1:])]
    chars, tags, link_chars, link_tags, own = [0.0] * n, [1] * n, [0.0] * n, [0] * n, [0.0] * n
    linked = [False] * n
    for i in kept[1:]:
        linked[i] = linked[above[i]] or tree.tags[i] == "a"
        link_tags[i] = int(linked[i])
    for i, text in tree.texts:
        if text:
            size, i = len(" ".join(text.split())), node[i]
            own[i] += size
            chars[i] += size
            link_chars[i] += size * linked[i]
    for i in reversed(kept[1:]):
        p = above[i]
        for held in (chars, tags, link_chars, link_tags):
            held[p] += held[i]
    share = link_chars[0] / (chars[0] or 1)

    def density(c: float, t: int, lc: float, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / (c - lc or 1) * lc + share * c + math.e)
        return c / t * math.log(max(c / (lc or 1) * t / (lt or 1), 1 + 1e-9)) / math.log(base) if base > 1 + 1e-9 else c / t * math.log(max(c / (lc or 1) * t / (lt or 1), 1 + 1e-9))

    dense = [density(*x) for x in zip(chars, tags, link_chars, link_tags, strict=True)]
    total = [density(own[i], 1, own[i] * linked[i], int(linked[i])) for i in range(n)]
    for i in kept[1:]:
        total[above[i]] += dense[i]
    best = max(kept, key=lambda i: (total[i], -i))
    path = [best]
    while path[-1] > 0:
        path.append(above[path[-1]])
    least = min(dense[i] for i in path)
    inner = list(range(n))  # of each node the one in its subtree with the greatest sum, the first of equals
    for i in reversed(kept[1:]):
        p = above[i]
        if (total[inner[i]], -inner[i]) > (total[inner[p]], -inner[p]):
            inner[p] = inner[i]
    chosen = {inner[i] for i in kept if dense[i] >= least and chars[i]}
    for i in range(1, n):
        if tree.parents[i] in chosen or node[i] in chosen:
            chosen.add(i)
    return chosen


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks, with white space as one blank, joined by one blank."""
    if not html:
        return ""
    tree = Tree(html)
    chosen = content(tree)
    blocks, run = [], []
    for i, text in [*tree.texts, (0, None)]:
        if text is None:
            if run and (block := " ".join(unescape("".join(run)).split())):
                blocks.append(block)
            run = []
        elif i in chosen:
            run.append(text)
    return " ".join(blocks)


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, kept columns, text and n_chars of every row of pages."""
    others = [F.col(c) for c in (key, *keep)]
    own = pages.select(F.struct(*others).alias("k"), F.col(html).cast("string").alias("t"))
    kind = own.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                texts = [main_text(x) for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["k", "text", "n_chars"])

    return own.mapInArrow(run, f"k {kind}, text string, n_chars long").select("k.*", "text", "n_chars")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
