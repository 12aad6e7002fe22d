"""HTML extraction by nearest-URL page differencing.

A page is cut into lines (its blocks' texts), furniture included.  Pages are put in order of host, path and query
string; each is compared with the nearest before and after it on its host that has another path or query string and
other content, lines are aligned by their longest common subsequence, and shared lines are deleted.  Structure decides
where differencing cannot (the README has figures): a shared line inside ``article`` or ``main`` stays, since mirrors of
an article share all of it; and a line inside an element that says what it is (``nav``, ``footer``, ``class="ad"``...)
goes even where the neighbours have other ones.

The order is one range-partitioned sort of narrow rows (line hashes, not texts), so a host with a third of all
pages is spread over many tasks; each task streams through its rows and knows the rows at its neighbours' edges.

Edge cases: NULL or empty html has an empty text; NULL URLs have an empty host and path; pages that repeat a URL go in
order of their content and are not compared with each other, repeated rows count once and get equal texts; ids of any
type, NULL among them, stay as they are; very long pages are aligned in bounded memory; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import beside, durable, written
from nearfield.llm.urls import parts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_CLASS = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_QUERY = re.compile(r"[^?#]*(\?[^#]*)?")
_CONTENT = re.compile(r"<(?:html|body|main|article)\b", re.I)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
# Elements by what they mean for the text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu script style noscript template iframe svg canvas object audio video textarea title".split())
MAIN = frozenset(["article", "main"])
WHOLE = frozenset(["html", "body", "main"])
FURNITURE = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar widget cookie cookies consent notice popup modal overlay newsletter subscribe share social comment comments disqus related".split())
#: Names of several words; others that merely hold a word of FURNITURE (has-sidebar, section-header, related-work) say nothing.
COMPOUND = frozenset(
    "site-header page-header main-header global-header site-footer page-footer main-footer global-footer site-nav main-nav top-nav bottom-nav side-nav page-nav post-nav post-navigation primary-nav primary-navigation main-navigation site-navigation nav-bar nav-menu main-menu top-menu side-menu menu-bar"
    " left-sidebar right-sidebar sidebar-left sidebar-right main-sidebar side-bar ad-banner ad-slot ad-container ad-wrapper ad-unit ad-box ad-block google-ad banner-ad cookie-banner cookie-notice cookie-consent cookie-bar cookie-popup consent-banner newsletter-signup newsletter-form newsletter-box"
    " social-share social-links social-icons social-media share-buttons share-links share-bar comment-list comments-area comments-section comment-form comment-respond related-posts related-articles related-links related-content promo-box promo-banner sponsored-content modal-dialog popup-overlay breadcrumb-nav breadcrumb-list".split()
)


#: Marks of shared lines that are sent to every task; more of them are joined by page.
MARK_BYTES = 32 << 20
#: Bits of a table of subsequences that is held at once (32 MB).
TABLE_BITS = 1 << 28


def _furniture(attributes: str, main: bool) -> bool:
    """Whether a whole class, id or role says so.  A header inside article or main is the article's own."""
    for m in _CLASS.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split():
            if word in COMPOUND or word == "complementary" or word == "contentinfo" or (word in FURNITURE and not (main and word == "header")):
                return True
    return False


def _end(stack: list[tuple], name: str) -> None:
    """An end tag closes what is open inside its element; without a start tag it closes nothing."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            if name not in INLINE or all(x[0] in INLINE for x in stack[i + 1 :]):
                del stack[i:]
            break


def _implied(stack: list[tuple], name: str) -> None:
    """A paragraph or list item ends the one before it."""
    if name == "p" or name == "li":
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                break
            if stack[i][0] not in INLINE:
                break


def _raw_end(page: str, name: str, at: int) -> int:
    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _holders(page: str) -> set[int]:
    """Places after the start tags of the elements that contain the body, a main or, of the page's articles, every one:
    they hold the page's content.  (Comments and teasers are articles beside or in another one.)"""
    held: set[int] = set()
    stack: list[tuple[str, int]] = []
    around: Counter[int] = Counter()
    total = at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            _end(stack, name)
        elif name in RAW:
            at = _raw_end(page, name, at)
        else:
            _implied(stack, name)
            if name in WHOLE:
                held.update(x[1] for x in stack)
            if name in MAIN:
                total += 1
                around.update(x[1] for x in stack)
            if name not in VOID and not m[3].endswith("/"):
                stack.append((name, at))
    return held | {x for x, n in around.items() if n == total}


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, main, named) of each block: main is inside article or main, named inside an element that is furniture by
    name.  Named words within a block are a line of their own behind it."""
    out: list[tuple[str, bool, bool]] = []
    if not page:
        return out
    stack: list[tuple[str, bool, bool]] = []  # name, named, main
    now: tuple[list[str], list[str]] = ([], [])  # the block's own words, and named ones
    holders: set[int] | None = None
    named = main = False
    at = 0

    def flush() -> None:
        for held, by_name in zip(now, (False, True)):
            if held:
                text = _SPACE.sub(" ", _html.unescape("".join(held))).strip(" ")
                held.clear()
                if text:
                    out.append((text, main and not by_name, by_name))

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            now[named].append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            flush()
        if m[1]:
            _end(stack, name)
        else:
            if name in RAW:
                at = _raw_end(page, name, at)
                continue
            _implied(stack, name)
            if name not in VOID and not m[3].endswith("/"):
                inside = name in MAIN
                header = name == "header" and not main
                by_class = not named and not inside and name not in WHOLE and _furniture(m[3], main)
                if by_class and _CONTENT.search(page, at):
                    holders = _holders(page) if holders is None else holders
                    by_class = at not in holders
                stack.append((name, named or name in DROPPED or header or by_class, main or inside))
        named, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    if at < len(page):
        now[named].append(page[at:])
    flush()
    return out


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """Bit-parallel rows of the subsequence table: bit j is clear where place j of y lengthens the subsequence."""
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    for v in x:
        u = row & places.get(v, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of x and each beginning of y."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), "u1"), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a belong to a longest common subsequence with b.  Up to TABLE_BITS the rows are kept and walked
    back; a larger table is halved at the place where both halves' lengths add up to most, so that memory is bounded."""
    hit = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        hit[lo] = True
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        hit[ea] = True
    x, y = a[lo:ea].tolist(), b[lo:eb].tolist()
    if not set(y) & set(x):
        return hit
    if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        hit[lo : lo + half] = common(a[lo : lo + half], b[lo : lo + cut])
        hit[lo + half : ea] = common(a[lo + half : ea], b[lo + cut : eb])
        return hit
    rows = list(_rows(x, y))
    i, j = len(x), len(y)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i - 1] & bit:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] & bit:
                hit[lo + i] = True
                j -= 1
    return hit


_Row = tuple[str, tuple[str, str], bytes, np.ndarray]  # host, path and query string, content, lines


def _partner(near: list[_Row], url: tuple[str, str], content: bytes) -> _Row | None:
    """The nearest of the rows with another URL and other content: a copy tells nothing of what a site repeats."""
    return next((r for r in near if r[1] != url and r[2] != content), None)


def _nearer(near: list[_Row], row: _Row) -> list[_Row]:
    """The rows, nearest first, that can be a later row's partner once row has passed: those of its host that are the
    nearest with another URL and content for some URL and content (a handful)."""
    out = [row]
    for r in near:
        if r[0] != row[0]:
            break
        taken = [(u, c) for u in [None, *{x[1] for x in out}] for c in [None, *{x[2] for x in out}] if all(x[1] == u or x[2] == c for x in out)]
        if any(r[1] != u and r[2] != c for u, c in taken):
            out.append(r)
    return out


_ORDER = ("host", "path", "query", "content", "page")


def _packed(p: int | None, near: list[_Row]) -> list[tuple]:
    return [(p, i, host, *url, content, x) for i, (host, url, content, x) in enumerate(near)]


def _passed(ordered: DataFrame, back: bool) -> DataFrame:
    """(page, shared) of each page and its partner before it in the order (back: after it)."""
    ranked = ordered.sortWithinPartitions(*[F.col(c).desc() for c in _ORDER]) if back else ordered

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes, _Row]]:
        for pdf in batches:
            for p, page, h, u, q, c, x in zip(*[pdf[c] for c in ("_p", "page", "host", "path", "query", "content", "lines")], strict=True):
                yield p, bytes(page), (h, (u, q), bytes(c), np.asarray(x, "i8"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, near, out = None, [], []
        for p, _, row in rows(batches):
            if p != part:
                out += _packed(part, near)
                part, near = p, []
            near = _nearer(near, row)
        yield pd.DataFrame(out + _packed(part, near), columns=["p", "i", "host", "path", "query", "content", "lines"])

    edges: dict[int, list[_Row]] = {}
    for r in sorted(ranked.mapInPandas(ends, "p int, i int, host string, path string, query string, content binary, lines array<bigint>").collect(), key=lambda r: (r["p"], r["i"])):
        edges.setdefault(r["p"], []).append((r["host"], (r["path"], r["query"]), bytes(r["content"]), np.asarray(r["lines"], "i8")))
    before, near = {}, []
    for p in sorted(edges, reverse=back):
        before[p] = near
        for row in edges[p][::-1]:
            near = _nearer(near, row)
    sent = ordered.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, near, last, out = None, [], None, []
        for p, page, row in rows(batches):
            if p != part:
                part, near = p, sent.value[p]
            if page == last:  # a repeated page
                continue
            last = page
            near = near if near and near[0][0] == row[0] else []
            other = _partner(near, row[1], row[2])
            if other is not None and (hit := common(row[3], other[3])).any():
                out.append((page, hit))
            near = _nearer(near, row)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["page", "shared"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["page", "shared"])

    return ranked.mapInPandas(run, "page binary, shared array<boolean>")


def shared_lines(narrow: DataFrame) -> DataFrame:
    """(page, shared) for narrow(page, host, path, query, content, lines): which lines of a page the nearest page before or
    after it on the host, of another URL and with other content, has in order too; pages without any are left out.
    Repeated pages count once."""
    n = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(narrow.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("_p", F.spark_partition_id()))
    both = _passed(ordered, False).unionByName(_passed(ordered, True))
    either = F.reduce(F.collect_list("shared"), F.array().cast("array<boolean>"), lambda s, x: F.zip_with(s, x, lambda a, b: F.coalesce(a, F.lit(False)) | b))
    return both.groupBy("page").agg(either.alias("shared"))


def _page_key(url: str | None, page: str | None) -> bytes:
    return xxhash.xxh3_128_digest(f"{url is None}{url}\0{page is None}{page}".encode("utf-8", "surrogatepass"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structure: bool = True) -> DataFrame:
    """(id, url, text, n_chars).  structure=False: differencing alone, without the two guards (for comparison)."""
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    cut = lines if structure else lambda page: [(t, False, False) for t, _, _ in lines(page)]

    def parsed(urls: list, texts: list) -> list[list]:
        out = []
        for url, page in zip(urls, texts, strict=True):
            host, path = parts(url)
            own, hashes = [], []
            for text, main, named in cut(page):
                if not named:
                    own.append({"x": text, "at": -1 if main else len(hashes)})
                if not main:
                    hashes.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            out.append((_page_key(url, page), host, path, _QUERY.match(url or "")[1] or "", _page_key(None, page), hashes, own))
        return [list(x) for x in zip(*out)]

    made = "page binary, host string, path string, query string, content binary, lines array<bigint>, t array<struct<x:string,at:int>>"
    held = written(beside(base, ["_id", "_url"], ["_url", "_html"], made, parsed), "html")  # pages are parsed once
    marks = durable(shared_lines(held.select("page", *_ORDER[:-1], "lines")))
    if (marks.agg(F.sum(F.size("shared") + 64)).first()[0] or 0) <= MARK_BYTES:
        marks = F.broadcast(marks)
    joined = held.select("_id", "_url", "page", "t").join(marks, "page", "left")
    # lines outside article and main have a place in the marks; marked ones go
    own = F.filter("t", lambda x: (x["at"] < 0) | ~F.coalesce(F.get("shared", x["at"]), F.lit(False)))
    text = F.array_join(F.transform(F.when(F.col("shared").isNull(), F.col("t")).otherwise(own), lambda x: x["x"]), " ")
    out = joined.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
