"""Operator 8, HTML extraction with a site style tree.

The pages of a host are merged node by node: a node is an element that begins a
block, known by the tags and classes on the way to it, and the nodes of one way are
one node of the tree. For each the tree counts, over the host's different pages, its
presentations (which kinds of children follow each other) and its contents. With m
pages and l presentations its importance is ``(1 - g**l) * H(presentations) + g**l *
H(contents)``, entropies in logarithms to the base m, ``g = 0.9``. A node that looks
and reads the same on page after page has little. What few pages say weighs less:
``CAUTION`` pages of full importance are added to the m there are, so no number of
pages is a threshold, and copies of one article on a host are still articles.

What a page's own markup says is a prior: an element of navigation, form, advert,
comment and so on, by tag, role or class, has ``PRIOR``; any other has 1. An element's
worth is the product of both, and one below ``LEAST`` goes with all it holds, whether
it is a container, a paragraph, or the article itself. Everything else is main text:
no region is preferred to another. Words such as header or register in a class count
only outside articles and main regions, which have headers of their own.

Only counts travel: a page sends one small row for each node, rows of one node are
added up before the shuffle, so a host of any size is no hot group.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from seriesloom.llm.common import slices, stored

DAMPING = 0.9
LEAST = 0.2
PRIOR = 0.1
CAUTION = 2
#: Removed nodes up to which their table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000

_BLOCKS = frozenset(
    "html body head div section article main aside nav header footer form ul ol dl table figure blockquote details dialog fieldset menu select button iframe noscript hgroup center title svg audio video object canvas map label"
    " p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre address figcaption summary legend option textarea".split()
)
_ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup main menu nav ol p pre section table ul".split())
_BREAKS = _BLOCKS | frozenset("br hr".split()) - {"label"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE_TAGS = frozenset("head title nav aside footer form menu select button iframe noscript dialog svg audio video object canvas map".split())
_RAW = "script|style|template|textarea|xmp"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*(?:>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Parts of class names and ids that tell noise anywhere, those that tell
# it outside articles only, and whole names that tell an article or a main region.
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager"
    " cookie cookies consent gdpr newsletter subscribe comment comments commentlist reply replies disqus share sharing social related recommended recommendations".split()
)
_OUTER_WORDS = frozenset(
    "banner header masthead topbar footer foot bottombar sidebar aside widget widgets rail notice notices alert popup modal overlay lightbox subscription signup login signin"
    " register search searchbox form respond discussion trending tags tagcloud skip copyright legal disclaimer toolbar".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_CONTENT_WORDS = frozenset("articlebody post-content entry-content article-content article-body post-body entry-body story-body main-content page-content content main article post entry story".split())
_PLAIN_TOKEN = re.compile(r"[^a-z]+")


def host_of(url: str | None) -> str:
    """The host of a URL, lower-cased; empty where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Page:
    """A page cut into blocks of text, each with the node it belongs to."""

    __slots__ = ("blocks", "nodes")

    def __init__(self, source: str | None):
        #: key (a hash of the way to it), number of the node around, tag and names,
        #: whether its markup calls it noise, whether it is in an article or main region
        self.nodes: list[tuple[int, int, str, bool, bool]] = [(0, -1, "", False, False)]
        self.blocks: list[tuple[int, str]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        open_tags: dict[str, int] = {}
        text: list[str] = []

        def flush() -> None:
            if text:
                whole = " ".join(html.unescape("".join(text)).split())
                if whole:
                    self.blocks.append((stack[-1][1], whole))
                text.clear()

        def close(k: int) -> None:
            for tag, _ in stack[k:]:
                open_tags[tag] -= 1
            del stack[k:]

        at = 0
        for m in _MARKUP.finditer(source):
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            rest = m["rest"] or m["rest2"] or ""
            if tag in _BREAKS:
                flush()
            if m["end"] or m["end2"]:
                if open_tags.get(tag):
                    flush()
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                continue
            if tag in _VOID:
                continue
            if stack[-1][0] == tag and tag in ("p", "li", "dt", "dd") or stack[-1][0] == "p" and tag in _ENDS_P:
                close(len(stack) - 1)  # an end tag that may be left out
            key, _, _, _, inside = self.nodes[stack[-1][1]]
            noise, region, name = self._kind(tag, rest, inside) if rest and not rest.isspace() else (False, tag in ("article", "main"), "")
            if tag in _BLOCKS or noise:
                if rest.rstrip().endswith("/") and tag not in _BLOCKS:
                    continue
                flush()
                noise = noise or tag in _NOISE_TAGS or (tag == "header" and not inside)
                own = xxh3_64_intdigest(f"{key}/{tag}{name}") - (1 << 63)
                self.nodes.append((own, stack[-1][1], tag + name, noise, inside or region))
                stack.append((tag, len(self.nodes) - 1))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < len(source):
            text.append(source[at:])
        flush()

    @staticmethod
    def _kind(tag: str, rest: str, inside: bool) -> tuple[bool, bool, str]:
        noise, region, names = False, tag in ("article", "main"), []
        for a in _ATTRIBUTE.finditer(rest):
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if key == "hidden":
                noise = True
            elif key == "aria-hidden":
                noise |= value == "true"
            elif key == "role":
                noise |= value in _NOISE_ROLES
                region |= value in ("main", "article")
            else:
                for word in value.split():
                    names.append(("." if key == "class" else "#") + re.sub(r"\d+", "0", word))
                    parts = _PLAIN_TOKEN.split(word)
                    if word in _CONTENT_WORDS:
                        region = True
                    elif tag not in ("html", "body", "article", "main"):
                        noise |= not _NOISE_WORDS.isdisjoint(parts) or (not inside and not _OUTER_WORDS.isdisjoint(parts))
        return noise, region, "".join(names)

    def facts(self) -> list[tuple[int, int, int]]:
        """(key, presentation, content) of each node that holds text, once a key."""
        own: list[list[str]] = [[] for _ in self.nodes]
        kinds: list[list[str]] = [[] for _ in self.nodes]
        for i, t in self.blocks:
            own[i].append(t)
        for _, above, name, _, _ in self.nodes[1:]:
            if not kinds[above] or kinds[above][-1] != name:
                kinds[above].append(name)
        number = lambda parts: xxh3_64_intdigest("\n".join(parts)) - (1 << 63)
        content: list[int | None] = [None] * len(self.nodes)
        below: list[list[int]] = [[] for _ in self.nodes]
        for i in range(len(self.nodes) - 1, 0, -1):  # what a node holds comes after it
            if own[i] or below[i]:
                content[i] = number([*own[i], *map(str, reversed(below[i]))])
                below[self.nodes[i][1]].append(content[i])
        merged: dict[int, tuple[list[str], list[str]]] = {}
        for i, (key, *_) in enumerate(self.nodes):
            if content[i] is not None:
                looks, contents = merged.setdefault(key, ([], []))
                contents.append(str(content[i]))
                looks += [k for k in kinds[i] if not looks or looks[-1] != k]
        return [(key, number(looks), number(contents)) for key, (looks, contents) in merged.items()]

    def text(self, worth=None) -> str:
        """The main text: the blocks of which no element around is worth less than
        ``LEAST``. worth: importance by key; 1 for what it does not name."""
        gone = [False] * len(self.nodes)
        for i, (key, above, _, noise, _) in enumerate(self.nodes[1:], 1):
            known = worth.get(key, 1.0) if worth else 1.0
            gone[i] = gone[above] or known * (PRIOR if noise else 1.0) < LEAST
        return " ".join(t for i, t in self.blocks if not gone[i])


def style_nodes(pages: DataFrame) -> DataFrame:
    """``(host, page, path, look, content)``: one row for each node of a page; page
    is a hash of its whole text. ``pages`` has url and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 300, "html"):
            rows = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                whole = xxh3_64_intdigest("\n".join(t for _, t in page.blocks)) - (1 << 63)
                rows += [(host_of(url), whole, *f) for f in page.facts()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(columns[i], pa.int64()) for i in range(1, 5)]], names=["host", "page", "path", "look", "content"])

    return pages.select("url", "html").mapInArrow(run, "host string, page long, path long, look long, content long")


def importance(nodes: DataFrame) -> DataFrame:
    """``(host, path, pages, importance)`` of each node over a host's pages."""
    once = nodes.distinct()

    def entropy(what: str) -> DataFrame:
        counts = once.groupBy("host", "path", what).agg(F.count("*").alias("c"))
        sums = counts.groupBy("host", "path").agg(F.sum("c").alias("m"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log("c")).alias("s"))
        h = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
        return sums.select("host", "path", F.col("m").alias("pages"), F.col("kinds").alias(f"{what}s"), h.alias(f"h_{what}"))

    both = entropy("look").join(entropy("content").drop("pages"), ["host", "path"])
    weight = F.pow(F.lit(DAMPING), F.col("looks"))
    found = (1 - weight) * F.col("h_look") + weight * F.col("h_content")
    return both.select("host", "path", "pages", ((F.col("pages") * found + CAUTION) / (F.col("pages") + CAUTION)).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text; a null or odd URL has the
    empty host. Repeated rows stay and count as one page of the tree. An empty table
    gives no rows. Other columns are not read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # A node of more importance than this is kept or goes by its prior alone.
    low = stored(importance(style_nodes(pages)).where(F.col("importance") < least).select("host", "path", "importance"), "style")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def texts(batch: pa.RecordBatch, low: list) -> pa.RecordBatch:
        found = [Page(source).text(worth) for source, worth in zip(batch.column(2).to_pylist(), low, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    size = low.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host")), F.lit(0)).alias("chars")).first()
    if size.n <= BROADCAST_ROWS and size.chars <= 64 * BROADCAST_ROWS:
        by_host: dict[str, dict[int, float]] = {}
        for r in low.collect():  # bounded in rows and in bytes
            by_host.setdefault(r.host, {})[r.path] = r.importance
        table = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 300, "html"):
                yield texts(batch, [table.value.get(host_of(u)) for u in batch.column(1).to_pylist()])

        return pages.mapInArrow(run, schema)

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 300, "html"):
            yield texts(batch, [dict(zip(g["path"], g["importance"], strict=True)) if g else None for g in batch.column(3).to_pylist()])

    with_host = pages.mapInArrow(hosts, f"{schema.split(',')[0]}, url string, html string, host string")
    lists = low.groupBy("host").agg(F.struct(F.collect_list("path").alias("path"), F.collect_list("importance").alias("importance")).alias("low"))
    # Both sides are plain exchanges, so adaptive execution splits a host of many pages.
    return with_host.join(lists, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run_joined, schema)
