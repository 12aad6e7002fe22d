"""Suffix sorting by a difference cover modulo 3, in DataFrames.

For a table of strings of numbers, each followed by END for ever: triples at positions 1 and 2 modulo 3 are sorted and
named; where names are not unique, the names of each string's two classes are strings themselves and are ranked by the
same function (the recursion).  The other suffixes are merged in: a suffix's rank is the number of smaller ones of each
class, and for any two classes one sorted order compares them (by a symbol or two, and the rank behind these).  Equal
suffixes get equal ranks, in one string or in several.

Every order is a range-partitioned sort of distinct keys; numbers before a key are sums within its partition and of the
partitions before it.  Nothing but a value or two of each partition comes to the driver.

Edge cases: empty strings have no suffixes; NULL strings and symbols are not allowed; strings may repeat; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import durable, shuffle_parts

END = -1  # the symbol behind a string's last one, below all
#: Rows of a sorted partition, about.
ROWS = 200_000
#: The classes of each order, and the key by which it compares them.
ORDERS = (((0, 1), ("c0", "r1")), ((0, 2), ("c0", "c1", "r2")), ((1, 2), ("r0",)))


def _sorted(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows in order of the key over some partitions, with ``_p``, the partition's number in that order."""
    n = max(1, min(shuffle_parts(rows.sparkSession), rows.count() // ROWS + 1))
    return durable(rows.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_p", F.spark_partition_id()))


def _before(keys: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """Distinct keys with, for each count, its sum over the keys before."""
    held = _sorted(keys, key)
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = held.groupBy("_p").agg(*[F.sum(c).alias(c) for c in counts])
    parts = parts.select("_p", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in counts])
    own = Window.partitionBy("_p").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    return held.join(F.broadcast(parts), "_p").select(*key, *[(F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"_{c}")).alias(c) for c in counts])


def _named(rows: DataFrame, key: list[str], name: str) -> tuple[DataFrame, bool]:
    """rows with the number of rows whose key is smaller, and whether all keys differ."""
    keys = durable(rows.groupBy(*key).agg(F.count("*").alias(name)))
    unique = keys.filter(F.col(name) > 1).isEmpty()
    return rows.join(_before(keys, key, [name]), key), unique


def ranked(strings: DataFrame, symbols: int | None = None) -> DataFrame:
    """(s, i, rank) of every suffix of strings(s, symbols: array<bigint>): the number of smaller suffixes.  With
    ``symbols``, suffixes that agree in so many at least may share a rank (the recursion then ends as soon as names stand
    for as many)."""
    strings = durable(strings.filter(F.size("symbols") > 0))
    at = lambda j: F.coalesce(F.get("symbols", F.col("i") + j), F.lit(END).cast("bigint"))
    longest = strings.agg(F.max(F.size("symbols"))).first()[0] or 0
    every = strings.select("s", "symbols", F.posexplode("symbols").alias("i", "c0"))
    triples = every.select("s", "i", "c0", at(1).alias("c1"), at(2).alias("c2"))
    if longest <= 3 or (symbols or longest) <= 3:
        return _named(triples, ["c0", "c1", "c2"], "rank")[0].select("s", "i", "rank")
    names, unique = _named(triples.filter(F.col("i") % 3 != 0), ["c0", "c1", "c2"], "r")
    held = durable(names.select("s", "i", "r"))
    if not unique:
        # the names of a class are a string: of s, class k, place i it is string 2s+k-1, place i//3
        mine = held.select((F.col("s") * 2 + F.col("i") % 3 - 1).alias("s"), F.struct(F.floor(F.col("i") / 3).cast("int").alias("i"), "r").alias("x"))
        inner = mine.groupBy("s").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("symbols"))
        ranks = ranked(inner, symbols and -(-symbols // 3))
        held = durable(ranks.select(F.floor(F.col("s") / 2).cast("bigint").alias("s"), (F.col("i") * 3 + F.pmod("s", F.lit(2)) + 1).cast("int").alias("i"), F.col("rank").alias("r")))
    return _merged(strings, triples, held)


def _merged(strings: DataFrame, triples: DataFrame, sample: DataFrame) -> DataFrame:
    """(s, i, rank) from the ranks (s, i, r) of the positions 1 and 2 modulo 3."""
    behind = sample.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("m"))
    rank = lambda j: F.coalesce(F.try_element_at("m", F.col("i") + j), F.lit(END).cast("bigint"))
    rows = durable(triples.join(behind, "s", "left").select("s", "i", (F.col("i") % 3).alias("k"), "c0", "c1", *[rank(j).alias(f"r{j}") for j in range(3)]))
    smaller: list[Column] = []
    for (a, b), key in ORDERS:
        mine, name = list(key), f"{a}{b}"
        some = rows.filter(F.col("k").isin(a, b))
        keys = some.groupBy(*mine).agg(*[F.sum((F.col("k") == k).cast("bigint")).alias(f"n{name}_{k}") for k in (a, b)])
        ahead = _before(keys, mine, [f"n{name}_{a}", f"n{name}_{b}"])
        # classes outside the order find no key of theirs
        rows = rows.withColumn("_k", F.when(F.col("k").isin(a, b), F.lit(1))).join(ahead.withColumn("_k", F.lit(1)), ["_k", *mine], "left").drop("_k")
    count = lambda k, other: F.col(f"n{min(k, other)}{max(k, other)}_{other}")
    for k in range(3):
        others = [x for x in range(3) if x != k]
        own = F.col(f"n{min(k, others[0])}{max(k, others[0])}_{k}")
        smaller.append(F.when(F.col("k") == k, own + count(k, others[0]) + count(k, others[1])))
    return durable(rows.select("s", "i", F.coalesce(*smaller).alias("rank")))


def repeated(suffixes: DataFrame) -> DataFrame:
    """(s, i) of the suffixes(s, i, rank, prefix), prefix being a number for the leading symbols that are compared, whose
    prefix an adjacent suffix in the order has."""
    held = _sorted(suffixes.select("s", "i", "rank", "prefix"), ["rank", "s", "i"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = part = None
        for pdf in batches:
            if len(pdf):
                part = int(pdf["_p"].iat[0])
                first = pdf["prefix"].iat[0] if first is None else first
                last = pdf["prefix"].iat[-1]
        if part is not None:
            yield pd.DataFrame({"p": [part], "first": [first], "last": [last]})

    edge = sorted(tuple(r) for r in held.mapInPandas(ends, "p int, first bigint, last bigint").collect())  # a row a partition
    before = {b[0]: a[2] for a, b in zip(edge, edge[1:])}
    after = {a[0]: b[1] for a, b in zip(edge, edge[1:])}

    def equal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows equal to the row before or behind; the last row of a batch waits for the next batch."""
        wait = prev = part = None
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["_p"].iat[0]) if part is None else part
            pdf = pdf[["s", "i", "prefix"]] if wait is None else pd.concat([wait, pdf[["s", "i", "prefix"]]], ignore_index=True)
            x = pdf["prefix"].to_numpy()
            up = x[1:] == x[:-1]
            head = x[0] == (prev if prev is not None else before.get(part))
            hit = [a or b for a, b in zip([head, *up[:-1]], up, strict=True)] if len(x) > 1 else []
            yield pdf.iloc[: len(x) - 1][["s", "i"]][hit]
            prev, wait = (x[-2], pdf.iloc[-1:].reset_index(drop=True)) if len(x) > 1 else (prev if prev is not None else before.get(part), pdf)
        if wait is not None:
            x = wait["prefix"].iat[0]
            if x == prev or prev is None and x == before.get(part) or x == after.get(part):
                yield wait[["s", "i"]]

    return held.mapInPandas(equal, "s bigint, i int")
