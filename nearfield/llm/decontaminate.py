"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's normalised word windows.

Texts are lower-cased (A-Z) and cut into words of digits, ASCII letters and any non-ASCII characters.  A window is
``n`` consecutive words of an item (all of a shorter one).  The automaton holds every window as a string of word
numbers; each text runs through it once, and hits map back to code-point spans of the original text.

The benchmark is the stated query set: it is read in blocks of BLOCK_WORDS words, each with an automaton of bounded
size that every Python worker builds once.  A worker holds HELD of them and runs each text through all; a larger
benchmark takes a pass over the texts for each HELD blocks.  Hits are the same however it is cut, since a window lies in
one item.

Edge cases: NULL or empty texts and items have no words; items that repeat count once by id; a NULL item id is written
as an empty string; document ids of any type, NULL among them, stay as they are; a very long text is scanned whole, alone
in its slice of a batch; rows that repeat get equal results; an empty table gives an empty result; an empty benchmark
hits nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import beside, documents, durable
from nearfield.llm.rowwise import keep_rows

WINDOW = 10
#: Words of a block of items, and automata that a worker holds.
BLOCK_WORDS, HELD = 100_000, 4

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Windows of a block of items, found in texts."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - n + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, of in owners.items():
            self.machine.add_word(key, (len(key), sorted(of)))
        self.size = len(owners)
        if owners:
            self.machine.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with occurring windows."""
        hit, items = np.zeros(len(found) + 1, "i8"), set()
        if self.size:
            get = self.number.get
            for end, (n, of) in self.machine.iter(tuple([get(w, 0) for w in found])):
                hit[end - n + 1] += 1
                hit[end + 1] -= 1
                items.update(of)
        return hit.cumsum()[:-1] > 0, items


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the original text from the first to the last word of each run of hit words."""
    out: list[list[int]] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if hit[i]:
            if last == i - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return [(a, b) for a, b in out]


_held: dict[tuple[str, int], Automaton] = {}


def _machine(name: str, items, n: int) -> Automaton:
    """The automaton of a broadcast block, built once in each Python worker, which holds HELD of them."""
    if (name, n) not in _held:
        while len(_held) >= HELD:
            _held.pop(next(iter(_held)))
        _held[name, n] = Automaton(items.value, n)
    return _held[name, n]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The (id, text) rows in blocks of about BLOCK_WORDS words; one empty block if there are none.  They come to the
    driver one partition at a time, and a block is let go once it is sent."""
    block, size, none = [], 0, True
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(item_text), F.lit(""))).distinct()
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(words(text))
        if size >= BLOCK_WORDS:
            yield block
            block, size, none = [], 0, False
    if block or none:
        yield block


def _sent(spark, blocks: Iterator[list], n: int) -> list[list[tuple]]:
    """The broadcast blocks by rounds of HELD: a round is one pass over the texts, and its automata fit a worker."""
    sent = [(uuid.uuid4().hex, spark.sparkContext.broadcast(b), n) for b in blocks]
    return [sent[i : i + HELD] for i in range(0, len(sent), HELD)]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every text; spans are code points of the original.  Up to HELD blocks of
    items take one pass; further ones take a pass for each HELD, in which a row carries its hit words so far."""
    rounds = _sent(docs.sparkSession, item_blocks(benchmark, item_col, item_text), n)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(None).cast("binary").alias("_hit"), F.array().cast("array<string>").alias("_items"))

    def further(blocks: list[tuple]) -> Callable:
        def run(texts: list, hits: list, items: list) -> tuple[list, list]:
            got = [_found(words(t), blocks, h, i) for t, h, i in zip(texts, hits, items, strict=True)]
            return [np.packbits(h).tobytes() for h, _ in got], [sorted(i) for _, i in got]

        return run

    def last(blocks: list[tuple]) -> Callable:
        def run(texts: list, hits: list, items: list) -> list[list]:
            out = []
            for text, before, of in zip(texts, hits, items, strict=True):
                hit, of = _found(words(text), blocks, before, of)
                many = int(hit.sum())
                out.append((len(hit), many, sorted(of), [{"start": a, "end": b} for a, b in spans(text, hit)] if many else []))
            return [list(x) for x in zip(*out)]

        return run

    for blocks in rounds[:-1]:
        rows = durable(beside(rows, ["_id", "_text"], ["_text", "_hit", "_items"], "_hit binary, _items array<string>", further(blocks)))
    made = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    return beside(rows, ["_id"], ["_text", "_hit", "_items"], made, last(rounds[-1])).withColumnRenamed("_id", id_col)


def _found(found: list[bytes], blocks: list[tuple], before: bytes | None, items: list[str]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit and the items, by these blocks and before."""
    hit = np.unpackbits(np.frombuffer(before, "u1"))[: len(found)].astype(bool) if before is not None else np.zeros(len(found), bool)
    every = set(items)
    for name, block, n in blocks:
        own, of = _machine(name, block, n).scan(found)
        hit |= own
        every |= of
    return hit, every


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any hit word, in their own columns.  A map-only pass for each round of blocks: the verdict
    travels with the row.  NULL and empty texts have no words and stay; columns of any name stay as they are."""
    for blocks in _sent(docs.sparkSession, item_blocks(benchmark, item_col, item_text), WINDOW):

        def clean(texts: list[str | None], blocks: list[tuple] = blocks) -> list[bool]:
            return [not any(_machine(name, block, n).scan(found)[0].any() for name, block, n in blocks) for found in map(words, texts)]

        docs = keep_rows(docs, text_col, clean)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    got = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM win),
occ AS (SELECT r, p, l, array_to_string(list_slice(w, p, p + l - 1), ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, ls WHERE len(w) >= l)),
hit AS (SELECT r, p, occ.l AS l, item_id FROM occ JOIN win USING (l, g)),
hw AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(p, p + l)) AS x FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
