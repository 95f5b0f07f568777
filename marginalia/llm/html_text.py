r"""HTML extraction with site template removal.

One pass over a page's markup gives its blocks of text, and its element subtrees: a hash of each and the run of blocks
that it covers. Spark counts, for each host, in how many different pages a subtree occurs; blocks in subtrees that recur
across many pages of a host are deleted, whatever the subtrees are called. Of what is left, and where a host has too few
pages to count on, what an element's name, role, class or id declares to be a menu, header, footer, sidebar, notice,
advert, form or reader comment goes too, and where a page marks its article or main part, only that stays. Inside a marked
article a recurring paragraph, heading, list, list item, quotation, table or preformatted text goes only if it stands on
most pages of the host: copies of one article do not delete it. Pages of equal main part count once. Columns n_template
and n_declared say how many blocks of the page each of the two steps took.

Of nested subtrees that cover the same blocks the innermost counts, which recurs at least as often; so a page gives no
more subtrees than blocks allow, however deeply it nests, and the work is linear in its length.

Character references are decoded, white space inside a block becomes one space, blocks are joined by \n in page
order. Null html is empty; an empty page or one without text gives the empty text; an empty table gives an empty result.
Null or odd urls count as one host of their own. Broken markup is read as browsers do where that matters for text:
paragraphs and list items end where the next begins, unclosed elements end with the page, an unclosed script or comment
hides the rest. Repeated rows are each returned. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, prepare, written

#: A subtree is a template if it occurs in so many different pages of its host, and in this share of them or in MANY.
PAGES, SHARE, MANY = 4, 0.2, 10
#: Prose inside an article or main part goes if it occurs in MANY different pages and in this share of them.
MOST = 0.5
#: The table of blocks to delete is broadcast up to so many bytes on disk, and joined by a shuffle beyond.
BROADCAST_BYTES = 4 << 20

_TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
GONE = frozenset("nav footer aside form script style noscript template iframe svg button select textarea menu dialog canvas object head title math datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre table tbody thead tr dd dt dl ol ul figcaption article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DECLARED = frozenset(
    "nav navbar navigation menu submenu sidebar sidenav footer cookie cookies consent gdpr notice notices notification banner ad ads adv advert adverts advertisement adsense advertising sponsor sponsored "
    "promo promotion comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager newsletter subscribe "
    "subscription signup login popup modal overlay toolbar search masthead copyright skip widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr", ("table",)), "tbody": ("tr tbody thead tfoot", ("table",)), "thead": ("tr tbody thead tfoot", ("table",)), "tfoot": ("tr tbody thead tfoot", ("table",))}
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _declared(attributes: str, inside: bool) -> bool:
    """Whether an element's attributes say that it is none of the article's text."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            words = {w.lower() for w in _NAMES.findall(value)}
            if words & DECLARED or ("header" in words and not inside):
                return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Element:
    __slots__ = ("tag", "gone", "place", "heads", "digest", "first")

    def __init__(self, tag: str, gone: bool, place: int, heads: bool, first: int):
        self.tag, self.gone, self.place, self.heads, self.first = tag, gone, place, heads, first
        self.digest = xxhash.xxh64(tag.encode())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def blocks_of(html: str) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int, bool]], int]:
    """The page's blocks (text, whether declared to be no main text); its subtrees (hash, first block, past the last block,
    whether they are prose inside a marked part); a hash of the main part."""
    found: list[tuple[str, int, str, int, bool]] = []  # text, place, innermost tag, characters of links, declared
    trees: list[tuple[int, int, int, bool]] = []
    stack = [_Element("html", False, 0, False, 0)]
    opened: dict[str, int] = {}
    text: list[str] = []
    away: list[str] = []  # text of a declared element inside a block
    links = places = 0
    marked: dict[int, str] = {}  # marked parts of the page: number, tag
    in_link = False

    def emit(pieces: list[str], linked: int, declared: bool) -> None:
        joined = " ".join("".join(pieces).split())
        pieces.clear()
        if joined:
            top = stack[-1]
            top.digest.update(joined.encode())
            found.append((joined, top.place, top.tag, linked, declared))

    def flush() -> None:
        nonlocal links
        if away:
            emit(away, 0, True)
        if text and not stack[-1].gone:
            emit(text, links, False)
            links = 0

    def close(n: int) -> None:
        while len(stack) > n:
            flush()
            e = stack.pop()
            opened[e.tag] -= 1
            value = e.digest.intdigest()
            stack[-1].digest.update(e.tag.encode() if e.gone and not stack[-1].gone else value.to_bytes(8, "big"))
            if e.first < len(found) and e.tag not in ("body", "html") and not (e.place and e.tag in ("article", "main")):
                tree = (_signed(value), e.first, len(found), e.place > 0 and e.tag in PROSE)
                if not trees or trees[-1][1:] != tree[1:]:
                    trees.append(tree)

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece:
            top = stack[-1]
            piece = unescape(piece) if "&" in piece else piece
            if top.gone or top.heads and top.tag not in HEADINGS:
                away.append(piece)
            else:
                text.append(piece)
                if in_link:
                    links += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, shut, attributes = m[2].lower(), m[1], m[3]
        if shut:
            if tag == "a":
                in_link = False
            if opened.get(tag):
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        close(n)
                        break
                    if stack[n].tag in ("table", "td", "th") and tag != "table" or stack[n].tag in BLOCKS and tag not in BLOCKS and tag not in GONE:
                        break
            elif tag in BLOCKS and (tag == "table" or not opened.get("table")):
                flush()
            if tag in ("td", "th"):
                (away if stack[-1].gone else text).append(" ")
            continue
        if tag in ("br", "img", "td", "th", "input"):
            (away if stack[-1].gone else text).append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID or tag == "html":
            continue
        block, top = tag in BLOCKS, stack[-1]
        if tag == "a":
            in_link = True
        gone = tag in GONE or (tag == "header" and not top.place) or (bool(attributes) and tag not in ("body", "main") and not (tag == "article" and not top.place and "comment" not in attributes.lower()) and _declared(attributes, top.place > 0))
        if not block and not gone:
            continue
        if block:
            flush()
            if opened.get("p"):
                for n in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block begins
                    if stack[n].tag == "p":
                        close(n)
                        break
                    if stack[n].tag in ("table", "button"):
                        break
            if tag in _ENDS and any(opened.get(t) for t in _ENDS[tag][0].split()):
                names, within = _ENDS[tag]
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag in within:
                        break
                    if stack[n].tag in names.split():
                        close(n)
                        break
            top = stack[-1]
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        gone = gone or top.gone
        place = top.place
        if not gone and not place and (tag in ("article", "main") or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)):
            places += 1
            place = places
            marked[place] = tag
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Element(tag, gone, place, top.heads or (tag == "header" and place > 0), len(found)))
    close(1)
    flush()
    filled = {p for _, p, _, _, declared in found if not declared}
    mains = {p for p, t in marked.items() if t != "article" and p in filled} or {p for p in marked if p in filled}
    out, whole = [], xxhash.xxh64()
    for joined, p, tag, linked, declared in found:
        # not in a main part, or a menu's entry
        declared = declared or bool(mains) and p not in mains or not mains and tag == "li" and linked > 0.8 * len(joined)
        if not declared:
            whole.update(joined.encode())
        out.append((joined, declared))
    return out, trees, _signed(whole.intdigest())


_ROW = "page_id long, url string, host string, page_key long, texts array<string>, declared array<boolean>, trees array<struct<h long, a int, b int, inside boolean>>"


def _parsed(pages: DataFrame, lists: bool) -> DataFrame:
    """A row for each page. lists: declared blocks go anyway, so their text is not carried along."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("inside", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [blocks_of(h or "") for h in b.column(2).to_pylist()]
            hosts = [host_of(u) for u in b.column(1).to_pylist()]
            trees = [[dict(zip(("h", "a", "b", "inside"), t, strict=True)) for t in x] for _, x, _ in got]
            columns = [pa.array(hosts, pa.string()), pa.array([k for *_, k in got], pa.int64()), pa.array([[None if d and lists else t for t, d in x] for x, *_ in got], pa.list_(pa.string())), pa.array([[d for _, d in x] for x, *_ in got], pa.list_(pa.bool_())), pa.array(trees, kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["page_id", "url", "host", "page_key", "texts", "declared", "trees"])

    fields = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return fields.mapInArrow(run, _ROW)


def _cut(rows: DataFrame, lists: bool) -> DataFrame:
    """page_id, url, text and counts of rows with gone, the runs of blocks that templates cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, templates, others = [], [], [], []
            for blocks, declared, gone in zip(*(b.column(c).to_pylist() for c in ("texts", "declared", "gone")), strict=True):
                steps = np.zeros(len(blocks) + 1, np.int64)
                for g in gone or ():
                    steps[g["a"]] += 1
                    steps[g["b"]] -= 1
                recurs = np.cumsum(steps)[:-1] > 0
                left = np.array(declared, bool) & lists & ~recurs
                text = "\n".join(t for t, r, d in zip(blocks, recurs, left, strict=True) if not (r or d))
                texts.append(text)
                sizes.append(len(text))
                templates.append(int(recurs.sum()))
                others.append(int(left.sum()))
            added = [pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (sizes, templates, others))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *added], ["page_id", "url", "text", "n_chars", "n_template", "n_declared"])

    return rows.select("page_id", "url", "texts", "declared", "gone").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long, n_declared long")


def extracted(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE, lists: bool = True) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_template, n_declared. lists: whether declared blocks go."""
    prepare(pages.sparkSession)
    parsed = written(_parsed(pages, lists).withColumn("row", F.monotonically_increasing_id()), "blocks")
    under = parsed.select(F.xxhash64("host").alias("host"), "page_key", "row", F.explode("trees").alias("t")).select("host", "page_key", "row", "t.h", "t.a", "t.b", "t.inside")
    times = under.select("host", "page_key", "inside", "h").distinct().groupBy("host", "inside", "h").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("inside"), MANY).otherwise(least_pages))
    sizes = written(parsed.select(F.xxhash64("host").alias("host"), "page_key").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages), "hosts")
    recurs = F.when(F.col("inside"), F.col("n") >= MOST * F.col("pages")).otherwise((F.col("n") >= share * F.col("pages")) | (F.col("n") >= MANY))
    templates = times.join(sizes, "host").where(recurs).select("host", "inside", "h")
    gone = written(under.join(templates, ["host", "inside", "h"]).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("gone")), "gone")
    small = F.broadcast(gone) if input_bytes(gone) <= BROADCAST_BYTES else gone
    return _cut(parsed.join(small, "row", "left"), lists)
