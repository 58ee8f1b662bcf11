"""Main text of web pages by consensus host paths.

Each page scores its containers: the share of the page's good words that a container holds, times how pure it is (good words
of all its words, links and notices included), times a hint of its tag or class.  Its best container's *generalised
path* (tags and classes from the root down, digits as ``#``) is the page's vote.  Spark counts the votes per host;
paths with at least ``MIN_SHARE`` of a host's votes win there.  Then every page is read again: all elements on the first winning path that
holds at least ``MIN_COVER`` of the page's good words give the text, so a page whose own score is misled follows its host.  A page on which
no winner holds so much keeps its own best path.

Inside the chosen elements menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out, by tag or by words of their classes, ids and roles; all other text stays.  Character references are decoded, white
space inside a block becomes one space, blocks are joined by a line feed in page order.

Defined cases: null or empty html, and a page without a word outside those parts, give an empty text; pages with a null url or one
without a host share the host ``''``; repeated pages vote and are read each; a cut-off page ends all open elements where it stops; an
empty table gives an empty result; extra columns are ignored.  Whole pages are read, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berthwise.llm.common import saved

MIN_SHARE = 0.05                 # so a host has at most 20 winning paths
MIN_COVER = 0.5
SALTS = 32
GENERATIONS = 40                 # a path names its element and this many above it

# HTML's void, raw, block and container elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th
    thead title tr ul""".split())
CONTAINER = frozenset("article aside body blockquote center div dd form main section table tbody td".split())
# An opening tag of the key ends open elements of the value, up to the nearest of SCOPE.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("html body table ul ol dl menu select article section main div".split())
# What isn't the article, by tag and by words of class, id and role.
OUT_TAGS = frozenset("""head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu
    audio video math""".split())
OUT_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar rail
    nav navbar navigation menu breadcrumb breadcrumbs toolbar footer footnav header masthead topbar cookie cookies consent gdpr notice
    disclaimer popup modal overlay share sharing social related recommended recommendations trending newsletter subscribe subscription
    signup login search widget pagination pager skip hidden form contentinfo complementary""".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus respond reply replies".split())
GOOD_TAGS, GOOD_WORDS = frozenset(("article", "main")), frozenset("article content entry main post story text".split())
HOLDERS = frozenset(("article", "main", "h1"))
GOOD_HINT = 1.25
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NEGATED = re.compile(r"(?i)^(no|not|has|with|without|is)[-_]")
_DIGITS = re.compile(r"\d+")

PATH = "array<string>"


class _Element:
    __slots__ = ("tag", "up", "label", "out", "good_hint", "link", "words", "good", "weak")

    def __init__(self, tag, up, label, out, weak, good_hint, link):
        self.tag, self.up, self.label, self.out, self.weak = tag, up, label, out, weak
        self.good_hint, self.link, self.words, self.good = good_hint, link, 0, 0


def _hints(attrs) -> tuple[str, set[str]]:
    """Generalised classes of a tag, and the words of its class, id and role."""
    a = {k: v or "" for k, v in attrs}
    names = a.get("class", "").split()
    words = set()
    for name in [*names, a.get("id", ""), a.get("role", "")]:
        if not _NEGATED.match(name):
            words.update(w.lower() for w in _WORDS.findall(name))
    if "hidden" in a or a.get("aria-hidden") == "true":
        words.add("hidden")
    return "".join(sorted("." + _DIGITS.sub("#", n) for n in set(names))), words


class Page(HTMLParser):
    """Elements of a page in order, and its text: (element, piece), or None where a block begins or ends."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.text: list[tuple[_Element, str] | None] = []
        self.open: list[_Element] = [_Element("", None, "", False, False, False, False)]
        self.feed(html)
        self.close()
        self._count()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append((self.open[-1], " "))
            return
        if tag in BLOCK:
            self.text.append(None)
            self._end(("p",), SCOPE)
        if tag in ENDS:
            self._end(ENDS[tag], SCOPE - {tag})
        if tag in VOID:
            return
        up = self.open[-1]
        classes, words = _hints(attrs)
        root = tag in ("html", "body", "article", "main")
        # A header inside the article is its heading.
        header = tag == "header" and not any(e.tag in GOOD_TAGS for e in self.open)
        weak = not root and bool(words & OUT_WORDS) and tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "span", "b", "i", "em", "strong")
        out = up.out or tag in OUT_TAGS or header or (not root and bool(words & COMMENT_WORDS) and tag in BLOCK)
        good = tag in GOOD_TAGS or bool(words & GOOD_WORDS)
        e = _Element(tag, up, tag + classes, out, weak, good, up.link or tag == "a")
        self.elements.append(e)
        self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.text.append(None)
        if tag != "p":
            self._end((tag,), frozenset() if tag in SCOPE else SCOPE)
        else:
            self._end(("p",), SCOPE)

    def handle_data(self, data):
        self.text.append((self.open[-1], data))

    def _end(self, tags, scope) -> None:
        """End the nearest open element of ``tags`` and all inside it, unless one of ``scope`` is met before."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in scope:
                return

    def _count(self) -> None:
        """Words of every element's subtree, and which elements are out.  A class word doesn't leave out what holds the
        article: an element with an article, main or h1 in it, or, on pages without article or main, with more than half of the words."""
        holds = set()
        for e in self.elements:
            if e.tag in HOLDERS and not e.out:
                up = e.up
                while up is not None and id(up) not in holds:
                    holds.add(id(up))
                    up = up.up
        marked = any(e.tag in GOOD_TAGS for e in self.elements)
        for piece in self.text:
            if piece and not piece[0].out:
                piece[0].words += len(piece[1].split())
        for e in reversed(self.elements):
            e.up.words += e.words
        half = self.open[0].words / 2
        for e in self.elements:
            e.out = e.out or e.up.out or (e.weak and id(e) not in holds and (marked or e.words <= half))
        for e in [self.open[0], *self.elements]:
            e.words = 0
        for piece in self.text:
            if piece and piece[0].tag not in ("script", "style", "head", "title"):
                e, n = piece[0], len(piece[1].split())
                e.words += n
                if not (e.out or e.link):
                    e.good += n
        for e in reversed(self.elements):
            e.up.words += e.words
            e.up.good += e.good
        self.good = self.open[0].good

    def path(self, e: _Element) -> tuple[str, ...]:
        out = []
        while e.up is not None and len(out) <= GENERATIONS:
            out.append(e.label)
            e = e.up
        return tuple(reversed(out))

    def best(self) -> tuple[str, ...] | None:
        """Path of the best container; of equal ones the innermost, then the first."""
        top, found, depth = 0.0, None, 0
        deep = {id(self.open[0]): 0}
        for e in self.elements:
            deep[id(e)] = d = deep[id(e.up)] + 1
            if e.tag in CONTAINER and e.good and not e.out:
                score = e.good / self.good * e.good / e.words * (GOOD_HINT if e.good_hint else 1.0)
                if score > top or (score == top and d > depth):
                    top, found, depth = score, e, d
        return self.path(found) if found else None

    def on(self, path: tuple[str, ...]) -> list[_Element]:
        return [e for e in self.elements if e.label == path[-1] and e.tag in CONTAINER and not e.out and self.path(e) == path]

    def cover(self, chosen: list[_Element]) -> float:
        ids = {id(e) for e in chosen}
        outer = [e for e in chosen if not self._inside(e.up, ids)]
        return sum(e.good for e in outer) / self.good if self.good else 0.0

    @staticmethod
    def _inside(e, ids) -> bool:
        while e is not None:
            if id(e) in ids:
                return True
            e = e.up
        return False

    def text_of(self, chosen: list[_Element] | None) -> str:
        """Text of the chosen elements (of the whole page for None) without the parts that are out."""
        inside = {id(self.open[0]): chosen is None}
        ids = {id(e) for e in chosen or ()}
        for e in self.elements:
            inside[id(e)] = inside[id(e.up)] or id(e) in ids
        blocks, now = [], []
        for piece in [*self.text, None]:
            if piece is None:
                line = " ".join("".join(now).split())
                if line:
                    blocks.append(line)
                now = []
            elif inside[id(piece[0])] and not piece[0].out:
                now.append(piece[1])
        return "\n".join(blocks)


def main_text(html: str, winners: list[tuple[str, ...]]) -> str:
    page = Page(html)
    for path in winners:
        chosen = page.on(path)
        if chosen and page.cover(chosen) >= MIN_COVER:
            return page.text_of(chosen)
    own = page.best()
    return page.text_of(page.on(own) if own else None)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        host_of(F.col("url").cast("string")).alias("host"))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of a host have their best container on a path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [Page(h).best() for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([list(b) if b else None for b in best], pa.list_(pa.string()))],
                                             names=["host", "path"])
    cast = _pages(pages).select("host", "html").mapInArrow(run, f"host string, path {PATH}")
    return cast.where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(voted: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, paths): the paths with at least ``min_share`` of a host's votes, most votes first."""
    total = voted.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = voted.join(total, "host").where(F.col("votes") >= F.lit(min_share) * F.col("total"))
    ranked = kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("x"))
    return ranked.select("host", F.col("x.path").alias("paths"))


def extracted(pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text) of every page.  Pages meet their host's winners over ``SALTS`` copies, so a host's pages are spread."""
    won = saved(winners(saved(votes(pages), "path-votes"), min_share), "host-paths")
    salted = won.select("host", "paths", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    src = _pages(pages).withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    src = src.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "paths")
    kind = src.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, [tuple(p) for p in paths or ()])
                    for h, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())],
                                             names=["page_id", "url", "text"])
    return src.mapInArrow(run, f"page_id {kind}, url string, text string")
