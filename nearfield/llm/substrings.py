"""Suffix-array dedup: removal of every byte that a repeated 400-byte string covers.

A suffix array of all bytes holds a row of some ninety bytes for each of them through several sorts; beyond a few
megabytes that is neither disk nor time one has (figures in the README).  So the strings are contracted first, without
loss, and the suffix array is built of what is still open.

1. Anchors: of the 16-byte grams of a window (a 400-byte string) the one with the smallest hash is its anchor.  Equal
   windows have their anchor at the same offset.  Windows of a text with one anchor and offsets in one block of 128
   are a piece.  What all windows of a block share is the piece's core; what they cover is its span.
2. A core that occurs once: none of its windows repeats.  A span that occurs twice: all do.  Other pieces are open,
   and a piece of each repeated span among the same core goes along as known.
3. Open pieces are halved, four times, and settled in the same way: those that stay are at the ends of matches.
4. A piece of a block of 8 is the string of its bytes left of the core, the core as one symbol, and the bytes right
   of it; its windows are the 8-symbol substrings over the core.  These strings' suffixes are sorted by a difference
   cover (suffixes.py: triples, recursion on names, merging), and windows that equal an adjacent one in the order repeat.

Whole texts that occur more than once (by a 128-bit digest) are repeated by that alone.  Counts use partial sums, and
only hashes travel but for the open pieces.  A span counts as equal by its hash and its core's, 128 bits together.

Edge cases: NULL is empty; texts under 400 bytes lose nothing; rows that repeat are copies of each other; ids of any
type, NULL among them, stay as they are; a text of over 16 MB is cut into overlapping parts for the anchors and loses none
of its windows; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import suffixes
from nearfield.llm.common import beside, bounded, documents, durable, joinable, small, values
from nearfield.llm.textnum import Prefix, U, chunks, mix

LENGTH, GRAM, BLOCK, LAST = 400, 16, 128, 8
#: Entries of a reducing task, about.
GROUP = 1 << 20


def anchors(buf: np.ndarray, sums: Prefix, width: int) -> np.ndarray:
    """For every window start of the buffer, the place of the gram with the smallest hash (ties: the first)."""
    n = len(buf) - GRAM + 1
    at = np.arange(n)
    key = (sums.of(at, at + GRAM) >> U(24) << U(24)) | (at & 0xFFFFFF).astype(U)  # chunks are under 2**24 bytes, or cut
    pad = -n % width
    rows = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    return (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & U(0xFFFFFF)).astype("i8")


def pieces(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, high, n, core, span) of every piece: its first window's start in the text, that window's offset
    to the anchor, the number of windows, and the hashes of core and span."""
    buf = np.frombuffer(b"".join(texts), "u1")
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    none = tuple(np.empty(0, "i8") for _ in range(4)) + (np.empty(0, U), np.empty(0, U))
    if len(buf) < LENGTH:
        return none
    sums = Prefix(buf)
    a = anchors(buf, sums, LENGTH - GRAM + 1)
    p = np.concatenate([np.arange(x, y - LENGTH + 1) for x, y in zip(begin[:-1], begin[1:]) if y - x >= LENGTH] or [np.empty(0, "i8")]).astype("i8")
    if not len(p):
        return none
    own, off = a[p], a[p] - p
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1) | (off[1:] // BLOCK != off[:-1] // BLOCK)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(p)))
    start, high = p[first], off[first]
    anchor, base = start + high, high // BLOCK * BLOCK
    core = sums.of(anchor - base, anchor - base - BLOCK + 1 + LENGTH)
    core = mix(core ^ base.astype(U) * U(0x9E3779B97F4A7C15))
    span = mix(sums.of(start, start + count - 1 + LENGTH) ^ high.astype(U) << U(50))
    text = np.searchsorted(begin, start, "right") - 1
    return text, start - begin[text], high, count.astype("i8"), core, span


def _segments(text: bytes) -> list[tuple[int, bytes]]:
    """The text, or parts of 8 MB of a longer one that overlap by a window less a byte."""
    step = 1 << 23
    return [(0, text)] if len(text) <= 2 * step else [(i, text[i : i + step + LENGTH - 1]) for i in range(0, len(text) - LENGTH + 1, step)]


def _pack(start, high, n, code):
    return start << 18 | high << 9 | (n - 1) << 2 | code


def _unpack(x: np.ndarray):
    return x >> 18, x >> 9 & 511, (x >> 2 & 127) + 1, x & 3


REPEATED, OPEN, KNOWN = 1, 2, 3  # KNOWN: repeated, and goes along with open pieces of its core


def _entries(texts: DataFrame, groups: int) -> DataFrame:
    """(p, e): packed (core, span, blob, place) of all pieces, by the leading bits of the core."""
    shift = U(64 - (groups.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for blobs, texts in values(batches):
            blob, got = np.array(blobs, "i8"), []
            first = [i for i, x in enumerate(blobs) if x not in done and not done.add(x)]  # copies count once a task
            parts = [(i, o, t) for i, x in ((i, texts[i]) for i in first) for o, t in _segments((x or "").encode("utf-8", "surrogatepass")) if len(t) >= LENGTH]
            for lo, hi in chunks([t for *_, t in parts]):
                text, start, high, n, core, span = pieces([t for *_, t in parts[lo:hi]])
                if len(text):
                    owner, offset = np.array([q[0] for q in parts[lo:hi]])[text], np.array([q[1] for q in parts[lo:hi]])[text]
                    got.append(np.stack([core, span, blob[owner].astype(U), _pack(start + offset, high, n, 0).astype(U)], 1))
            if not got:
                continue
            e = np.concatenate(got)
            p = (e[:, 0] >> shift).astype("i8") if groups > 1 else np.zeros(len(e), "i8")
            order = np.argsort(p, kind="stable")
            e, p = e[order], p[order]
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            ends = np.append(at[1:], len(p))
            yield pa.RecordBatch.from_pydict({"p": p[at], "e": [e[x:y].tobytes() for x, y in zip(at, ends)]})

    return texts.mapInArrow(run, "p bigint, e binary")


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """(blob, places) for pieces that are not unique."""
    e = np.frombuffer(b"".join(pdf["e"]), U).reshape(-1, 4)
    e = e[np.lexsort((e[:, 3], e[:, 2], e[:, 1], e[:, 0]))]
    e = e[np.concatenate([[True], (e[1:] != e[:-1]).any(1)])]  # copies of a text give equal entries
    core = np.concatenate([[True], e[1:, 0] != e[:-1, 0]])
    span = core | np.concatenate([[True], e[1:, 1] != e[:-1, 1]])
    c, s = core.cumsum() - 1, span.cumsum() - 1
    twice = np.bincount(s)[s] > 1
    shared = np.bincount(c)[c] > 1
    opened = np.bincount(c, ~twice)[c] > 0
    code = np.where(twice, np.where(span & opened, KNOWN, REPEATED), OPEN)[shared]
    e = e[shared]
    blob, place = e[:, 2].astype("i8"), e[:, 3].astype("i8") | code
    order = np.argsort(blob, kind="stable")
    blob, place = blob[order], place[order]
    if not len(blob):
        return pd.DataFrame({"blob": [], "places": [], "open": []})
    at = np.flatnonzero(np.concatenate([[True], blob[1:] != blob[:-1]]))
    places = [place[x:y] for x, y in zip(at, np.append(at[1:], len(blob)))]
    return pd.DataFrame({"blob": blob[at], "places": [x.tobytes() for x in places], "open": [bool((x & 3 >= OPEN).any()) for x in places]})


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
_PIECE = "core bigint, span bigint, blob bigint, anchor bigint, base int, lo int, hi int, l binary, r binary, known boolean"


def _cut_open(joined: DataFrame) -> DataFrame:
    """The open and known pieces of (blob, text, places) with the bytes beside their cores."""

    schema = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in _PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in values(batches):
            got = []
            for blob, text, packed in zip(*columns, strict=True):
                t = None
                start, high, n, code = _unpack(np.concatenate([np.frombuffer(x, "i8") for x in packed]))
                for s, h, m, k in zip(*(x[code >= OPEN].tolist() for x in (start, high, n, code)), strict=True):
                    t = t or text.encode("utf-8", "surrogatepass")
                    a, base, lo = s + h, h // BLOCK * BLOCK, h - m + 1
                    core = t[a - base : a - base - BLOCK + 1 + LENGTH]
                    got.append((_core(core, base), 0, blob, a, base, lo, h, t[s : a - base], t[a - base - BLOCK + 1 + LENGTH : a - lo + LENGTH], k == KNOWN))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*got), schema, strict=True)] if got else [pa.array([], f.type) for f in schema], schema.names)

    return joined.select("blob", "text", "places").mapInArrow(run, _PIECE)


def _core(*parts: bytes | int) -> int:
    h = xxhash.xxh3_64()
    for x in parts:
        h.update(x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little", signed=True)


def _halved(block: int):
    """Pieces of a block as those of its two halves."""
    half = block // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for core, _, blob, a, base, lo, hi, left, right, known in pdf.itertuples(index=False, name=None):
                mid = base + half
                if lo < mid:  # the half next to the core's left end: it takes bytes on the right
                    h = min(hi, mid - 1)
                    l, r = left[len(left) - (h - base) :], right[half:]
                    c = _core(core, 0, right[:half])
                    got.append((c, _core(c, lo, h, l, r), blob, a, base, lo, h, l, r, known))
                if hi >= mid:
                    low = max(lo, mid)
                    l, r = left[: len(left) - half], right[: base + block - 1 - low]
                    c = _core(core, 1, left[len(left) - half :])
                    got.append((c, _core(c, low, hi, l, r), blob, a, mid, low, hi, l, r, known))
            yield pd.DataFrame(got, columns=[x.split()[0] for x in _PIECE.split(", ")])

    return run


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): of pieces with core and span, the intervals found repeated, and the rows that go on."""
    spans = rows.groupBy("core", "span").agg(F.count("*").alias("n"), F.max("known").alias("k"), F.min(F.struct("blob", "anchor", "base", "lo")).alias("first"))
    # what is joined stands written: a join of such splits a core or span of any number of pieces
    spans = durable(spans.withColumn("twice", F.col("k") | (F.col("n") > 1)))
    cores = joinable(spans.groupBy("core").agg(F.count("*").alias("m"), F.sum(F.when(F.col("twice"), 0).otherwise(1)).alias("opened")))
    marked = durable(rows.join(small(spans.select("core", "span", "twice", "first")), ["core", "span"]).join(cores, "core"))
    found = marked.filter("twice and not known").select("blob", (F.col("anchor") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + 1).cast("bigint").alias("n"))
    first = F.struct("blob", "anchor", "base", "lo") == F.col("first")
    on = marked.filter((~F.col("twice") & (F.col("m") > 1)) | (F.col("twice") & (F.col("opened") > 0) & first))
    return found, on.withColumn("known", F.col("twice")).select(*rows.columns)


def _sorted_out(rows: DataFrame) -> DataFrame:
    """(blob, start, n) of the repeated windows of pieces of the last block size, by their suffix order."""
    named = durable(rows.withColumn("s", F.monotonically_increasing_id()))

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sym = [[*left, (core & 0x3FFFFFFFFFFFFFFF) + 1024, *right] for core, left, right in zip(pdf["core"].tolist(), pdf["l"], pdf["r"], strict=True)]
            yield pd.DataFrame({"s": pdf["s"], "symbols": sym})

    strings = durable(named.mapInPandas(contract, "s bigint, symbols array<bigint>"))
    order = suffixes.ranked(strings, LAST)
    prefix = F.xxhash64(F.slice("symbols", F.col("i") + 1, F.lit(LAST)))
    # place i of a piece is the window with offset hi - i: it starts i bytes behind the piece
    some = named.select("s", "blob", "anchor", "lo", "hi", "known")
    starts = order.join(strings, "s").select("s", "i", "rank", prefix.alias("prefix")).join(some.select("s", "lo", "hi"), "s").filter(F.col("i") <= F.col("hi") - F.col("lo"))
    hit = suffixes.repeated(starts.drop("lo", "hi"))
    return hit.join(some.filter("not known"), "s").select("blob", (F.col("anchor") - F.col("hi") + F.col("i")).alias("start"), F.lit(1).cast("bigint").alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row, and with_text the remaining bytes as ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text.cast("binary"))
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("bigint")
    blobs = durable(docs.select(half(1).alias("blob"), half(17).alias("other"), F.octet_length(text).cast("bigint").alias("n")))
    total = blobs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the name of a text is half of its 128-bit digest; where two texts share that half (by chance, a handful in 10**10)
    # it is the other half
    clash = [r[0] for r in blobs.groupBy("blob").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x <> y").select("blob").collect()]
    name = (lambda a, b: F.when(a.isin(clash), -b - 1).otherwise(a)) if clash else (lambda a, b: a)
    blobs = blobs.select(name(F.col("blob"), F.col("other")).alias("blob"), "n")
    base = docs.select(F.col(id_col).alias("_id"), name(half(1), half(17)).alias("blob"), text.alias("text"))
    groups = 1 << (max(1, total // 75 // GROUP) - 1).bit_length()
    copies = blobs.groupBy("blob").agg(F.count("*").alias("c")).filter("c > 1").select("blob")
    with bounded(docs.sparkSession):
        settled = durable(_entries(base.select("blob", "text"), groups).groupBy("p").applyInPandas(_settled, "blob bigint, places binary, open boolean"))
    mine = settled.groupBy("blob").agg(F.collect_list("places").alias("places"))
    # what joins the texts stands written, so that a text with any number of copies is split
    todo = durable(settled.filter("open").groupBy("blob").agg(F.collect_list("places").alias("places")))
    rows = _cut_open(base.select("blob", "text").join(todo, "blob")).dropDuplicates(["blob", "anchor", "base", "hi"])
    found = None
    block = BLOCK
    while block > LAST:
        with bounded(docs.sparkSession):
            rows = durable(rows.mapInPandas(_halved(block), _PIECE))
        block //= 2
        got, rows = _settle(rows)
        found = got if found is None else found.unionByName(got)
    found = durable(found.unionByName(_sorted_out(rows)))
    single = found.groupBy("blob").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    marks = durable(mine.join(single, "blob", "full").join(copies.withColumn("copied", F.lit(True)), "blob", "full"))
    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    done = beside(base.join(marks, "blob", "left"), ["_id"], ["text", "places", "windows", "copied"], made, lambda *x: _assemble(with_text, *x))
    return done.withColumnRenamed("_id", id_col)


def _assemble(with_text: bool, texts: list[str], places: list, windows: list, copied: list) -> list[list]:
    """n_bytes, n_removed, n_spans, kept_sha256 (and kept) of each text, from its repeated windows."""
    got = []
    for text, packed, single, whole in zip(texts, places, windows, copied, strict=True):
        t = text.encode("utf-8", "surrogatepass")
        starts, ns = [], []
        if whole and len(t) >= LENGTH:
            starts, ns = [np.zeros(1, "i8")], [np.array([len(t) - LENGTH + 1])]
        else:
            if packed is not None:
                s, _, n, code = _unpack(np.concatenate([np.frombuffer(x, "i8") for x in packed]))
                starts, ns = [s[code != OPEN]], [n[code != OPEN]]
            if single is not None:
                starts.append(np.array([w["start"] for w in single], "i8"))
                ns.append(np.array([w["n"] for w in single], "i8"))
        removed = n_spans = 0
        kept = t
        if starts and len(s := np.concatenate(starts)):
            edge = np.zeros(len(t) + 1, "i8")
            np.add.at(edge, s, 1)
            np.add.at(edge, s + np.concatenate(ns) - 1 + LENGTH, -1)
            gone = edge.cumsum()[:-1] > 0
            removed = int(gone.sum())
            n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(t, "u1")[~gone].tobytes()
        got.append((len(t), removed, n_spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
    return [list(x) for x in zip(*got)]


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
