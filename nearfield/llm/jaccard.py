"""N-gram Jaccard join by parity sketches.

A text's set is that of its distinct five-word shingles.  Each set is cut into parts by hash, and a part's sketch is
the XOR of its shingles' 64-bit hashes, so that a shingle in one set only flips one part: the number of parts that
differ is at most the size of the symmetric difference.  Texts with a similarity of at least 0.8 and sizes n and n'
differ in at most n/4 shingles, so that they have equal parts as soon as more than n/4 parts are not empty
(pigeonhole).  Sizes are banded by powers of two, which set the number of parts; a text near the upper end of its
band also stands in the next one.  Of its parts a text enters the n/4 + 1 that come first in one order of all
sketches (fullest first): two sets with enough equal parts have one of them in common there.  A text with too few
non-empty parts for that also enters by its n/4 + 1 smallest shingle hashes.  So no link is lost.

Equal sets are one node from the start.  Nodes that share a sketch form a bucket.  Buckets are settled without
looking at all their pairs: each is compared with one node of every component in it, components are joined, and
this repeats until no bucket has two components that a comparison joins; then the pairs of a bucket that are
still in different components, and whose bit sketches (XOR folds of their shingles) allow it, are all compared.
Large buckets are cut into blocks for that, and blocks are compared by twos.  Comparisons are exact.

Edge cases: NULL and empty texts have empty sets, and link with nothing; rows that repeat are one document (they get
one component), rows that share an id get their own text's; NULL ids are ignored when the smallest id is taken, and a
component of such rows only has NULL; a very long text is hashed whole, alone in its slice of a batch; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import BROADCAST_KEYS, beside, bounded, compact, documents, durable, joinable, keyed, small, unkeyed, values
from nearfield.llm.graph import components
from nearfield.llm.textnum import U, chunks, mix, shingle_sets

SHINGLE = 5
#: Similarity in hundredths.
LEAST = 80
#: Entries of a reducing task, about.
GROUP = 1 << 20
#: Nodes of a bucket that are compared at a time.
BLOCK = 4096


def folded(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 with A-Z lower-cased."""
    return [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]


def halves(s: np.ndarray) -> tuple[int, int]:
    """Two 63-bit hashes of a set, from its sum, XOR and size."""
    x = np.array([s.sum(dtype=U), np.bitwise_xor.reduce(s) if len(s) else 0, len(s)], U)
    y = mix(mix(x) * np.array([1, 3, 5], U))
    return int(mix(y[:1] + y[1:2] * U(7) + y[2:])[0] >> U(1)), int(mix(y[:1] * U(11) + y[1:2] + y[2:] * U(13))[0] >> U(1))


def node_of(s: np.ndarray, clash: frozenset = frozenset()) -> int:
    """The identity of a set: half of its hash, or the other half where unlike sets share the first."""
    a, b = halves(s)
    return b if a in clash else a


def allowed(n: int) -> int:
    """Most shingles by which a set of n and one that links with it differ."""
    return n * (100 - LEAST) // LEAST


def bands(n: int) -> list[int]:
    """Lower ends of the bands that a set of n enters."""
    low = 1 << (n.bit_length() - 1)
    return [low, 2 * low] if 100 * n >= LEAST * 2 * low else [low]


def keys(s: np.ndarray) -> np.ndarray:
    """The sketches by which a set enters."""
    n, out = len(s), []
    d = allowed(n)
    if not d:
        return np.empty(0, U)  # it links with equal sets only
    for low in bands(n):
        m = -(-6 * low // 10) + 16
        part = ((s >> U(32)) % U(m)).astype("i8")
        order = np.argsort(part, kind="stable")
        own = part[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sketch = mix(np.bitwise_xor.reduceat(mix(s[order] ^ U(0x5851F42D4C957F2D)), first) + U(low * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + own[first].astype(U))
        count = np.diff(np.append(first, n))
        out.append(sketch[np.lexsort((sketch, -count))[: d + 1]])
        if len(first) <= d:
            out.append(mix(s[: d + 1] ^ U(0xD1B54A32D192ED03)))
    return np.unique(np.concatenate(out))


def fold(s: np.ndarray, bits: int) -> np.ndarray:
    """The set's parities over so many places."""
    return np.bincount((mix(s) & U(bits - 1)).astype("i8"), minlength=bits) & 1


def _blobs(docs: DataFrame, text: str, groups: int, clash: frozenset) -> DataFrame:
    """(p, keys, nodes): packed entries of all texts, by the leading bits of the sketch.  A task sends those of equal sets
    once, so that a text's copies, however many, count once a task."""
    shift = U(64 - (groups.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for (held,) in values(batches):
            texts, ks, ns = folded(held), [], []
            for lo, hi in chunks(texts):
                for s in shingle_sets(texts[lo:hi], SHINGLE):
                    if not len(s) or (node := node_of(s, clash)) in done:
                        continue
                    done.add(node)
                    if len(k := keys(s)):
                        ks.append(k)
                        ns.append(np.full(len(k), node, "i8"))
            if not ks:
                continue
            k, v = np.concatenate(ks), np.concatenate(ns)
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v = k[new], v[new]
            p = (k >> shift).astype("i8") if groups > 1 else np.zeros(len(k), "i8")
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            ends = np.append(at[1:], len(p))
            yield pa.RecordBatch.from_pydict({"p": p[at], "keys": [k[a:b].tobytes() for a, b in zip(at, ends)], "nodes": [v[a:b].tobytes() for a, b in zip(at, ends)]})

    return docs.select(text).mapInArrow(run, "p bigint, keys binary, nodes binary")


def _buckets(pdf: pd.DataFrame) -> pd.DataFrame:
    k = np.frombuffer(b"".join(pdf["keys"]), U)
    v = np.frombuffer(b"".join(pdf["nodes"]), "i8")
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
    k, v = k[new], v[new]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(at, len(k)))
    name = mix(np.add.reduceat(mix(v.astype(U)), at)).astype("i8")  # buckets with the same nodes are one
    keep = np.zeros(len(at), bool)
    keep[np.unique(name, return_index=True)[1]] = True
    keep &= size > 1
    rows = np.repeat(keep, size)
    return pd.DataFrame({"bucket": np.repeat(name, size)[rows], "node": v[rows]})


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n, node, other, entries) of every row; node and other, the halves of a hash, are NULL for an empty set."""

    def sets(texts: list[str | None]) -> list[list]:
        n, node, other, entries = [], [], [], []
        whole = folded(texts)
        for lo, hi in chunks(whole):
            for s in shingle_sets(whole[lo:hi], SHINGLE):
                n.append(len(s))
                a, b = halves(s) if len(s) else (None, None)
                node.append(a)
                other.append(b)
                entries.append((allowed(len(s)) + 1) * len(bands(len(s))) if len(s) else 0)
        return [n, node, other, entries]

    return beside(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], ["_text"], "n bigint, node bigint, other bigint, entries bigint", sets)


BLOOM_MAX = 1 << 26


def _bloom(found: DataFrame, count: int) -> tuple[bytes, int]:
    """A bit table of the nodes: ten bits each, at most BLOOM_MAX bits (8 MB) whatever their number."""
    bits = min(BLOOM_MAX, 1 << max(16, (10 * count).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(bits, bool)
        for pdf in batches:
            table[(mix(pdf["node"].to_numpy().astype(U)) & U(bits - 1)).astype("i8")] = True
        yield pd.DataFrame({"t": [np.packbits(table, bitorder="little").tobytes()]})

    whole = np.zeros(bits // 8, "u1")
    for r in found.coalesce(8).mapInPandas(run, "t binary").toLocalIterator():
        whole |= np.frombuffer(r["t"], "u1")
    return whole.tobytes(), bits


def _sets(docs: DataFrame, text_col: str, found: DataFrame, clash: frozenset) -> DataFrame:
    """(node, s): the packed sets of the nodes in buckets.  Texts are hashed again and only those that pass the bit
    table leave their task, once a task; a join then keeps exactly the wanted ones."""
    wanted_nodes = compact(found.select("node").distinct())
    table, bits = _bloom(wanted_nodes, wanted_nodes.count())
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, done = np.frombuffer(sent.value, "u1"), set()
        for (held,) in values(batches):
            texts, got = folded(held), []
            for lo, hi in chunks(texts):
                for s in shingle_sets(texts[lo:hi], SHINGLE):
                    if len(s):
                        node = node_of(s, clash)
                        at = int(mix(np.array([node], U))[0]) & (bits - 1)
                        if node not in done and wanted[at >> 3] >> (at & 7) & 1:
                            done.add(node)
                            got.append((node, s.tobytes()))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["node", "s"])

    rows = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "node bigint, s binary")
    return compact(rows.join(wanted_nodes, "node", "left_semi").dropDuplicates(["node"]), 10_000)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= LEAST * max(len(p), len(q)) else 0
                ok.append(100 * both >= LEAST * (len(p) + len(q) - both))
            yield pdf.loc[ok, ["a", "b"]]

    a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint")


_WORDS = 16


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, n, f): size and bit sketch of 1,024 parities."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [np.frombuffer(x, U) for x in pdf["s"]]
            yield pd.DataFrame({"node": pdf["node"], "n": [len(x) for x in s], "f": [np.packbits(fold(x, 64 * _WORDS)).view("i8") for x in s]})

    return compact(sets.mapInPandas(sketch, "node bigint, n bigint, f array<bigint>"))


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link: parities that differ are no more than the shingles that
    do, which are at most a ninth of both sizes together."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("f").alias(f"f{c}"))
    apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (100 * F.least("na", "nb") >= LEAST * F.greatest("na", "nb")) & ((100 + LEAST) * apart <= (100 - LEAST) * (F.col("na") + F.col("nb")))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b")


def _cells(labelled: DataFrame) -> DataFrame:
    """(bucket, main, kr, km) of the buckets with several components.  One of more than BLOCK nodes is cut: the nodes of
    its largest component, main, into km blocks and the others into kr; a smaller one is a block (main is NULL)."""
    own = labelled.groupBy("bucket", "c").agg(F.count("*").alias("m"))
    open_ = own.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top")).filter("parts > 1")
    large = F.col("m") > BLOCK
    count = lambda c, small: F.when(large, F.ceil(c / BLOCK)).otherwise(small).cast("bigint")
    return open_.select("bucket", F.when(large, F.col("top.c")).alias("main"), count(F.col("m") - F.col("top.m"), 1).alias("kr"), count(F.col("top.m"), 0).alias("km"))


def _rest(labelled: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of one bucket in different components, where sizes and bit sketches allow a link.  A task streams through
    cells (i, j), pairs of a bucket's blocks: it holds two blocks at a time, and no cell pairs main blocks."""

    def near(i: np.ndarray, j: np.ndarray, n: np.ndarray, f: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(f[i] ^ f[j]).sum(1, dtype="i8")
        return (100 * n[i] >= LEAST * n[j]) & ((100 + LEAST) * apart <= (100 - LEAST) * (n[i] + n[j]))

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        k = pdf[["bucket", "i", "j"]].to_numpy()
        return np.concatenate([[False], (k[1:] != k[:-1]).any(1)])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.cumsum(starts(pdf))
        n, c, v, own = (pdf[x].to_numpy() for x in ("n", "c", "node", "own"))
        one = pdf["i"].to_numpy() == pdf["j"].to_numpy()
        f = np.stack(pdf["f"].to_numpy()).view(U)
        got = []
        step, live = 1, np.arange(len(b) - 1)
        while len(live):  # partners so many places on; sizes ascend, so that a row is done at the first too large one
            live = live[live + step < len(b)]
            on = (b[live] == b[live + step]) & (100 * n[live] >= LEAST * n[live + step])
            live = live[on]
            some = live[(c[live] != c[live + step]) & (one[live] | (own[live] != own[live + step]))]
            some = some[near(some, some + step, n, f)]
            got.append(np.stack([np.minimum(v[some], v[some + step]), np.maximum(v[some], v[some + step])], 1))
            step += 1
        out = np.unique(np.concatenate(got), axis=0) if got else np.empty((0, 2), "i8")
        return pd.DataFrame(out, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cut = int(np.flatnonzero(starts(pdf)).max(initial=0)) if len(pdf) else 0
            held = pdf.iloc[cut:]
            if cut:
                yield pairs(pdf.iloc[:cut])
        if held is not None and len(held):
            yield pairs(held)

    block = lambda k: F.pmod(F.xxhash64("node"), F.greatest(k, F.lit(1).cast("bigint")))
    own = F.when(F.col("c") == F.col("main"), F.col("kr") + block(F.col("km"))).otherwise(block(F.col("kr")))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("own") >= F.col("kr"), F.col("kr")).otherwise(F.col("kr") + F.col("km")) - 1)
    rows = labelled.join(joinable(_cells(labelled)), "bucket").join(sketches, "node").withColumn("own", own)
    rows = rows.select("bucket", "n", "node", "c", "f", "own", F.explode(others).alias("o"))
    rows = rows.select("bucket", "n", "node", "c", "f", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "n", "node").mapInPandas(run, "a bigint, b bigint").distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): (_id, n, node) of every row, and (node, root) of the linked nodes."""
    with bounded(docs.sparkSession):
        held = durable(nodes(docs, id_col, text_col))
        total = held.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
        groups = max(1 << (max(1, total // GROUP) - 1).bit_length(), 1)
        # halves that unlike sets share (by chance, a handful in 10**10 sets): these sets go by the other half
        twice = held.groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b")
        clash = frozenset(r[0] for r in twice.select("node").collect())
        if clash:
            held = durable(held.withColumn("node", F.when(F.col("node").isin(list(clash)), F.col("other")).otherwise(F.col("node"))))
        blobs = _blobs(docs, text_col, groups, clash)
        found = compact(blobs.groupBy("p").applyInPandas(_buckets, "bucket bigint, node bigint").dropDuplicates(["bucket", "node"]))
        return held, small(_roots(docs, text_col, found, clash))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): a row for each row of docs."""
    held, roots = _linked(docs, id_col, text_col)
    # a row a node from here on: copies of one text, however many, are added up before they meet
    own = held.filter("node is not null").groupBy("node").agg(F.min("_id").alias("_least")).join(roots, "node", "left").withColumn("c", F.coalesce("root", "node"))
    own = durable(own.select("node", "c", "_least"))
    least = joinable(own.groupBy("c").agg(F.min("_least").alias("component_id")))
    by_node = durable(own.select("node", "c").join(least, "c").select("node", "component_id"))
    # the row's own component: by node, as rows with one id may differ in text
    out = held.join(by_node, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def _roots(docs: DataFrame, text_col: str, found: DataFrame, clash: frozenset) -> DataFrame:
    """(node, root) of the linked nodes.  A node's weight is how many others its buckets hold: what a group of near
    copies comes from outweighs its variants.  First every node is compared with the weightiest node that it shares a
    bucket with, then each component of a bucket with the weightiest one.  That leaves few components in a bucket,
    and then all of its pairs in different components are compared."""
    sets = _sets(docs, text_col, found, clash)
    sketches = _sketches(sets)
    # tables that are joined stand written: a join of such splits a key of any number of rows
    sizes = joinable(found.groupBy("bucket").agg(F.count("*").alias("m")))
    weights = found.join(sizes, "bucket").groupBy("node").agg(F.sum("m").alias("w"))
    found = compact(found.join(weights, "node").select("bucket", F.struct("w", "node").alias("x")))
    lead = joinable(found.groupBy("bucket").agg(F.max("x").alias("l")))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    tried = found.join(lead, "bucket").filter("x <> l").groupBy("x.node").agg(F.max("l").alias("l")).select(*pair("node", "l.node")).distinct()
    tried = compact(_possible(tried, sketches))
    links = compact(_links(tried, sets))
    roots = components(links)
    for last in (False, True):
        label = compact(found.withColumn("node", F.col("x.node")).join(small(roots), "node", "left").select("bucket", "node", "x", F.coalesce("root", "node").alias("c")))
        if last:
            new = _rest(label.drop("x"), sketches).join(tried, ["a", "b"], "left_anti")
        else:
            one = compact(label.groupBy("bucket", "c").agg(F.max("x").alias("x")))
            first = joinable(one.groupBy("bucket").agg(F.max(F.struct("x", "c")).alias("l")))
            stars = one.join(first, "bucket").filter("c <> l.c").select(*pair("x.node", "l.x.node")).distinct()
            new = _possible(stars.join(tried, ["a", "b"], "left_anti"), sketches)
        new = compact(new)
        tried = tried.unionByName(new)
        more = compact(_links(new, sets))
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    return roots


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the smallest id's (NULL ids last), of several such the one with the smallest
    hash.  Rows are told apart by a 128-bit key of all their columns, so that NULL and repeated ids do no harm; of rows that
    are equal in all of them one stays.  Rows without a set all stay."""
    hashed = [c for c, kind in docs.dtypes if kind != "void" and "map<" not in kind]
    rows = keyed(docs, hashed)
    one = F.struct(F.col("_row")[id_col].isNull().alias("none"), F.col("_row")[id_col].alias("id"), "_k1", "_k2").alias("_o")
    held, roots = _linked(rows.select(one, F.col("_row")[text_col].alias("_t")), "_o", "_t")
    named = held.filter("node is not null").join(roots, "node", "left").select(F.coalesce("root", "node").alias("c"), F.col("_id").alias("o"))
    times = durable(named.groupBy("c", "o").agg(F.count("*").alias("n")))
    first = joinable(times.groupBy("c").agg(F.min("o").alias("w")))
    marked = durable(times.join(first, "c").select("o._k1", "o._k2", "n", F.col("o").eqNullSafe(F.col("w")).alias("stays")))
    gone, again = (joinable(marked.filter(f).select("_k1", "_k2"), BROADCAST_KEYS) for f in ("not stays", "stays and n > 1"))
    left = rows.join(gone, ["_k1", "_k2"], "left_anti")
    single = left.join(again, ["_k1", "_k2"], "left_anti")
    return unkeyed(single.unionByName(left.join(again, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
