"""Connected components by large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import BROADCAST_ROWS, counted, joinable

#: Edges from which on a node's share of them may be too large for a task: what is joined is then written first, as adaptive
#: execution splits a hot key of written tables only.
SPLIT_ROWS = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges(a, b): root is the smallest node that is reachable.  Each step replaces edges by edges
    to a smaller neighbour, in a logarithmic number of rounds; a node's neighbours are never gathered in one row."""
    now, n = counted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
    old = print_of(now)
    while True:
        side = joinable if n > SPLIT_ROWS else F.broadcast if n <= BROADCAST_ROWS else lambda d: d
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = side(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # large star: every larger neighbour goes to the smallest neighbour
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if n > SPLIT_ROWS:
            large = counted(large)[0]
        # small star: every smaller neighbour, and the node, go to the smallest one
        least = side(large.groupBy("a").agg(F.min("b").alias("m")))
        up = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, n = counted(up.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        new = print_of(now)
        if new == old:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        old = new
