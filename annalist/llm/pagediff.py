"""Main text of web pages: nearest-URL page differencing over blocks of text.

1. A page becomes lines, one for each block of text, those of menus and other frames included. Only what is never text (scripts,
   styles, the head, hidden elements) is left out.
2. Pages are laid out in the order of host and URL path, and each is paired with the neighbour of its host whose path has more
   in common with its own. The lines of the two are aligned by a longest common subsequence, and shared lines are deleted: that
   takes the menus, notices, adverts and footers of a site, whatever their markup.
3. Pages with the same text are copies: the nearest page that is no copy is asked, however long the run of copies and
   wherever a task ends. Where the shared lines hold half of a page's text or more, the neighbour on the other side is asked;
   where they do so on both sides, what both share is the frame.
4. Markup then decides what a pair cannot tell. A line that no neighbour shares goes if HTML itself marks it as no article
   (nav, header, footer, aside, form, ...) or a whole token of its class, id or role does (``HINTS``): comments and adverts of one
   page alone, and hosts with one page. Where a page has an article or main element with text, the lines outside of it go too.
   A shared line within article or main stays: passages recur from article to article, and they are text. Only under the few
   names that frames and articles have in common (``UNSURE``) does differencing decide there as well.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import few_at_once, lean, stored

#: Element names of HTML.
RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|math|canvas|audio|video"
OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset"}
ARTICLE = {"article", "main"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose id says what they hold; that of a heading or a paragraph is the anchor of a link.
BOXES = set("aside center dialog dir div dl figure form iframe menu nav ol section span table td ul".split())
#: Whole tokens of class, id and role names that mark what is not the article.
HINTS = set(
    "ad ads advert adverts advertisement advertising adsense ad-slot ad-banner sponsor sponsored promo promotion banner cookie cookies cookie-notice cookie-banner "
    "cookie-bar cookie-consent consent gdpr notice notices alert popup modal overlay newsletter newsletter-signup subscribe subscription signup login sidebar rail "
    "menu main-menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead header site-header page-header footer site-footer page-footer copyright "
    "comment comments comment-list comments-area user-comments reader-comments commentlist disqus disqus_thread respond reply replies discussion share sharing "
    "share-buttons share-bar social social-links social-share related related-posts related-articles recommended recommendations widget search search-form "
    "pagination pager skip skip-link contentinfo complementary form dialog".split()
)
#: Those of them that an article may as well use for its own parts (the discussion of a paper, related work, a dialog).
#: Within article or main they are no verdict: there the lines go only if the nearest page has them too.
UNSURE = set("discussion related search share rail overlay dialog".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_MARK = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
#: Where a line lies: within an article element but under a name of ``UNSURE``, within one, in no element that says, or in one that
#: is no article.
HINTED, IN_ARTICLE, PLAIN, OUT = 3, 2, 1, 0


def _marks(name: str, attributes: str) -> set[str]:
    found: set[str] = set()
    for m in _MARK.finditer(attributes):
        if m[1].lower() != "id" or name in BOXES:
            found |= HINTS.intersection((m[2] or m[3] or m[4] or "").lower().split())
    return found


def blocks_of(page: str) -> list[tuple[str, int]]:
    """All blocks of text of a page in order, each with where it lies. Hidden elements and the head have none."""
    out: list[tuple[str, int]] = []
    held: dict[bool, list[str]] = {False: [], True: []}  # text of the block, and what lies outside of the article within it
    stack: list[tuple[str, str, int]] = []  # open elements that say something (unseen, outside, article, hinted), and their depth
    depth: dict[str, int] = defaultdict(int)  # open elements of the names on the stack
    now = {"unseen": 0, "outside": 0, "article": 0, "hinted": 0}

    def flush() -> None:
        for outside, parts in held.items():
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, OUT if outside else (HINTED if now["hinted"] else IN_ARTICLE) if now["article"] else PLAIN))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not now["unseen"]:
            held[now["outside"] > 0].append(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            held[now["outside"] > 0].append(" ")
        if m[2]:
            if depth[name]:
                depth[name] -= 1
                if stack and stack[-1][0] == name and stack[-1][2] == depth[name]:
                    now[stack.pop()[1]] -= 1
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        kind = None
        if name == "head" or (m[4] and _HIDDEN.search(m[4])):
            kind = "unseen"
        elif name in OUTSIDE:
            kind = "outside"
        elif name in ARTICLE:
            kind = "article"
        elif m[4] and name not in ("html", "body") and (marks := _marks(name, m[4])):
            kind = "hinted" if now["article"] and name in BLOCKS and marks <= UNSURE else "outside"
        if kind:
            stack.append((name, kind, depth[name]))
            now[kind] += 1
        if kind or depth[name]:
            depth[name] += 1
    if at < len(page) and not now["unseen"]:
        held[now["outside"] > 0].append(page[at:])
    flush()
    return out


def lines_of(page: str) -> list[tuple[str, bool]]:
    """The blocks of text that markup does not put outside of the article, each with whether an article element holds it."""
    return [(text, where >= IN_ARTICLE) for text, where in blocks_of(page) if where != OUT]


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of the lines of a longest common subsequence of the two."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    shared = {*range(lo), *range(len(a) - hi, len(a))}
    places = defaultdict(list)
    for j in range(len(b) - hi - 1, lo - 1, -1):
        places[b[j]].append(j)
    tails: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple] = []
    for i in range(lo, len(a) - hi):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _may_stay(blocks: list[tuple[str, int]]) -> list[bool]:
    """What markup leaves of the blocks of a page: its article elements, or all that lies in no element that is no article."""
    floor = IN_ARTICLE if any(where >= IN_ARTICLE for _, where in blocks) else PLAIN
    return [where >= floor for _, where in blocks]


def text_of(blocks: list[tuple[str, int]], shared: set[int]) -> tuple[str, int, int]:
    """The main text, and how many lines differencing deleted and how many more markup did."""
    gone = {i for i in shared if blocks[i][1] != IN_ARTICLE}
    left = [text for i, ((text, _), stays) in enumerate(zip(blocks, _may_stay(blocks), strict=True)) if stays and i not in gone]
    return "\n".join(left), len(gone), len(blocks) - len(gone) - len(left)


class _Page:
    """A page as the keys of its lines."""

    def __init__(self, key, host, path, listing, keys, sizes, guest):
        self.key, self.host, self.path, self.listing, self.guest = key, host, path, listing, guest
        self.keys, self.sizes = keys, sizes


def _shared(page: _Page, neighbours: list[_Page]) -> list[int]:
    """The places of the lines of a page that are shared with its nearest page."""
    half = sum(page.sizes)
    both: set[int] | None = None
    for other in sorted(neighbours, key=lambda p: -_alike(page.path, p.path)):
        shared = common_lines(page.keys, other.keys)
        if 2 * sum(page.sizes[i] for i in shared) < half:
            return sorted(shared)
        both = shared if both is None else both & shared
    return sorted(both or ())


def _measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of all lines of pages, and the sizes of those that differencing alone may delete; copies have equal listings."""
    for part in parts:
        listings, keys, sizes = [], [], []
        for page in part.column("html").to_pylist():
            blocks = blocks_of(page or "")
            stays = _may_stay(blocks)
            listings.append(_key("\n".join(text for (text, _), s in zip(blocks, stays, strict=True) if s)))
            keys.append([_key(text) for text, _ in blocks])
            sizes.append([len(text) if s else 0 for (text, _), s in zip(blocks, stays, strict=True)])
        made = [pa.array(listings, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
        names = ["k1", "k2", "host", "path"]
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], names=[*names, "listing", "keys", "sizes"])


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _differ(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared lines of pages that come in the order of part, host and path. A run of copies waits for the page after it."""
    run: list[_Page] = []
    before: _Page | None = None
    now = None
    out: list[tuple] = []

    def settle(after: _Page | None) -> None:
        for page in run:
            if not page.guest:
                out.append((*page.key, _shared(page, [p for p in (before, after) if p is not None and p.host == page.host])))

    def batch() -> pa.RecordBatch:
        k1, k2, shared = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(shared, pa.list_(pa.int32()))], names=["a1", "a2", "shared"])

    for part in parts:
        for number, guest, k1, k2, *rest in zip(*(part.column(c).to_pylist() for c in ("part", "guest", "k1", "k2", "host", "path", "listing", "keys", "sizes")), strict=True):
            page = _Page((k1, k2), *rest, guest)
            if number != now:
                settle(None)
                run, before, now = [], None, number
            elif (run[-1].host, run[-1].listing) != (page.host, page.listing):
                settle(page)
                run, before = [], run[-1]
            if run and page.keys == run[0].keys:  # copies hold one list of keys
                page.keys, page.sizes = run[0].keys, run[0].sizes
            run.append(page)
        if out:
            yield batch()
    settle(None)
    if out:
        yield batch()


def _guests(ends: list) -> list[tuple]:
    """(part, k1, k2): the pages of other parts that a part asks: the nearest ones beyond its ends that are no copies of them."""
    found = []
    kind = lambda x: (x["host"], x["listing"])
    for step, end, next_, beyond in ((-1, "first", "last", "other_last"), (1, "last", "first", "other_first")):
        for k, row in enumerate(ends):
            j = k + step
            while 0 <= j < len(ends):
                page = ends[j][next_]
                if kind(page) == kind(row[end]):
                    page = ends[j][beyond]
                    if page is None:  # a part of copies only
                        j += step
                        continue
                if page["host"] == row[end]["host"]:
                    found.append((row["part"], page["k1"], page["k2"]))
                break
    return found


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_shared (lines that differencing deleted) and n_marked (lines that markup
    deleted of the others) for every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. A null url is a page of the empty host. Repeated pages are copies of one another
    and have the text of one. Keys of lines are laid out by ranges of (host, path), so a host of any size is many tasks; the
    pages that tasks ask beyond their ends are sent to them, and two rows of keys a task go to the driver to find these. The
    text of a page does not depend on the number of tasks. Pages of unmarked text that have all but a few lines in common count
    as pages of one frame. A run of copies is held by its task as keys. Other columns are ignored; an empty table gives an
    empty result. Whole pages of any length are read.
    """
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    laid = few_at_once(pages).select(
        F.xxhash64(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url").alias("k1"),
        F.xxhash64(F.coalesce("html", F.lit(""))).alias("k2"),
        "page_id",
        "url",
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        "html",
    )
    order = ["host", "path", "k1", "k2"]
    lines = laid.select(*order, "html").mapInArrow(lean(_measure), "k1 long, k2 long, host string, path string, listing long, keys array<long>, sizes array<int>")
    lines = stored(lines.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).dropDuplicates(["part", *order]), "page-lines")

    row = F.struct(*order, "listing")
    ends = lines.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    unlike = lambda end: (F.col("host") != F.col(f"{end}.host")) | (F.col("listing") != F.col(f"{end}.listing"))
    others = lines.join(F.broadcast(ends), "part").groupBy("part", "first", "last").agg(F.min(F.when(unlike("first"), row)).alias("other_first"), F.max(F.when(unlike("last"), row)).alias("other_last"))
    ends = sorted(others.collect(), key=lambda r: r["part"])
    guests = spark.createDataFrame(_guests(ends), "to int, k1 long, k2 long").distinct()
    sent = lines.join(F.broadcast(guests), ["k1", "k2"]).withColumn("part", F.col("to")).drop("to").withColumn("guest", F.lit(True))
    met = lines.withColumn("guest", F.lit(False)).unionByName(sent)
    met = met.repartition(max(len(ends), 1), "part").sortWithinPartitions("part", *order)
    answers = met.mapInArrow(lean(_differ), "a1 long, a2 long, shared array<int>")

    kind = pages.schema["page_id"].dataType.simpleString()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [text_of(blocks_of(page or ""), set(shared or ())) for page, shared in zip(part.column("html").to_pylist(), part.column("shared").to_pylist(), strict=True)]
            texts, shared, marked = zip(*found, strict=True) if found else ((), (), ())
            made = [pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in (map(len, texts), shared, marked)]]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *made], names=["page_id", "url", "text", "n_chars", "n_shared", "n_marked"])

    rows = laid.join(answers, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left").select("page_id", "url", "html", "shared")
    return rows.mapInArrow(lean(cut), f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_marked long")
