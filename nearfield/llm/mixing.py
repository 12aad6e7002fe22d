"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id.  A source's mix is all its documents ``floor(target / size)`` times,
and once more those below a hash threshold.  The threshold comes from histograms: sizes are summed by source and
hash bucket, the bucket in which the budget ends is found, and only that bucket is split further (12 bits a
round), until a bucket is one hash value.  Nothing is sorted, no row leaves its partition but in sums, and larger
budgets always hold the documents of smaller ones.

Documents at the final hash value give a leading part of their words, in proportion, so that the mix meets its
target to within a word a document there.  Targets and thresholds are tables of a row a source.

Edge cases: a NULL or empty text has size 0 and is never taken; a NULL source is a source of its own (last in order);
NULL ids are hashed as an empty string; rows that repeat share a hash and so are treated alike; a very long text counts
whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import documents, durable, joinable, small

HASH_BITS, STEP = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def id_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def weighted(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """sizes(source, n) with the weight w of each source: the weights in turn, over sources by code point, NULL last.  Places
    come from a range-partitioned sort: a row a partition gives the number of sources before it."""
    spark = sizes.sparkSession
    key = [F.col("source").isNull(), F.col("source")]
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes.count() // 100_000 + 1)
    held = durable(sizes.repartitionByRange(parts, *key).withColumn("_p", F.spark_partition_id()))
    before = held.groupBy("_p").agg(F.count("*").alias("m")).select("_p", F.coalesce(F.sum("m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*key)) - 1 + F.col("_before")
    every = F.array(*[F.lit(float(w)) for w in weights])
    return durable(held.join(F.broadcast(before), "_p").select("source", "n", F.get(every, (place % len(weights)).cast("int")).alias("w")))


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """(source, n, target) of sources(source, n, w): share of all sizes by the weights, none above cap times its size; the
    excess goes to the others by weight, until none is above.  A round is one row of sums: the words a unit of weight gets
    rise, and sources that are at their cap stay there, so that the rounds end."""
    full = F.lit(float(cap)) * F.col("n")
    total = share * (sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    unit, capped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(unit) > full if capped >= 0 else F.lit(False)
        now = sources.agg(F.coalesce(F.sum(F.when(over, 1)), F.lit(0)).alias("m"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.coalesce(F.sum(F.when(over, full)), F.lit(0.0)).alias("held")).first()
        if now["m"] == capped:
            break
        capped, unit = now["m"], (total - now["held"]) / now["w"] if now["w"] else float("inf")
        if not now["w"]:
            break
    own = F.col("w") * F.lit(unit)
    return sources.select("source", "n", F.when(own > full, full).otherwise(own).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), shares: Sequence[float] = (1.5,), cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, size, source, source_size, target, taken) for each document and, with several shares, target_i and taken_i
    of the nested mixes.  The text is read once, for its size and hash; what follows reads that narrow table.  With
    ``keep`` (columns of docs) the rows come from a second pass over docs, so that texts are never joined by id.  Sources may
    be any number: their table is sent to the tasks while it is small, and joined beyond that."""
    columns = [F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("_h")]
    narrow = durable(docs.select(F.col(id_col), *columns))
    sources = weighted(durable(narrow.groupBy("source").agg(F.sum("size").alias("n"))), weights)
    out = docs.select(F.col(id_col), *[F.col(c) for c in keep], *columns) if keep else narrow
    for i, share in enumerate(shares):
        tail = f"_{i}" if i else ""
        table = small(_thresholds(narrow, targets(sources, share, cap)))
        joined = out.join(table, F.col("source").eqNullSafe(F.col("_s")), "left")
        at = F.col("_h") == F.col("_lo")
        part = F.when(F.col("_h") < F.col("_lo"), F.col("size")).when(at & (F.col("_tie") > 0), F.floor(F.col("size") * F.col("_want") / F.col("_tie"))).otherwise(0)
        cols = [c for c in out.columns]
        out = joined.select(*cols, *([F.col("_n").alias("source_size")] if not i else []), F.col("_target").alias(f"target{tail}"), (F.col("size") * F.col("_times") + part).cast("bigint").alias(f"taken{tail}"))
    return out.drop("_h")


def _thresholds(narrow: DataFrame, target: DataFrame) -> DataFrame:
    """(_s, _n, _target, _times, _lo, _want, _tie) of each source: how often all its documents are taken, the hash _lo below
    which they are taken once more, the words _want that are still wanted from those at _lo, and the size _tie of these.  A
    round sums the sizes of the open bucket's parts (all buckets first) and finds, by running sums over at most 4,096
    rows a source, the part in which the budget ends."""
    times = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("bigint")
    state = target.select(F.col("source").alias("_s"), F.col("n").alias("_n"), F.col("target").alias("_target"), times.alias("_times"))
    state = durable(state.select("*", F.lit(0).cast("bigint").alias("_lo"), F.round(F.col("_target") - F.col("_times") * F.col("_n")).cast("bigint").alias("_want"), F.lit(0).cast("bigint").alias("_tie")))
    for used in range(0, HASH_BITS, STEP):
        shift = HASH_BITS - used - STEP  # the bits below this round's bucket number
        own = narrow
        if used:
            open_ = small(state.filter("_want > 0").select(F.col("_s").alias("_o"), F.shiftright("_lo", shift + STEP).alias("_b")))
            own = narrow.join(open_, F.col("source").eqNullSafe(F.col("_o")) & (F.shiftright("_h", shift + STEP) == F.col("_b")))
        sums = own.groupBy(F.col("source").alias("_o"), F.shiftright("_h", shift).alias("_part")).agg(F.sum("size").alias("_m")).filter("_m > 0")
        run = Window.partitionBy("_o").orderBy("_part")
        wanted = sums.withColumn("_c", F.sum("_m").over(run)).join(small(state.select(F.col("_s").alias("_q"), F.col("_want").alias("_w"))), F.col("_o").eqNullSafe(F.col("_q")))
        ends = wanted.filter("_w > 0 and _c >= _w and _c - _m < _w").select("_o", (F.shiftleft("_part", shift)).alias("_at"), (F.col("_w") - F.col("_c") + F.col("_m")).alias("_rest"), "_m")
        new = {"_lo": F.coalesce("_at", "_lo"), "_want": F.coalesce("_rest", "_want"), "_tie": F.coalesce("_m", "_tie")}
        state = durable(state.join(joinable(ends), F.col("_s").eqNullSafe(F.col("_o")), "left").withColumns(new).select(*state.columns))
    return state


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
s AS (SELECT source, n, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s0),
o AS (SELECT *, coalesce(sum(2.0::DOUBLE * n) OVER b, 0) AS capped, sum(w) OVER (ORDER BY n / w DESC, source DESC NULLS FIRST) AS left_w, 1.5::DOUBLE * sum(n) OVER () AS total
      FROM s WINDOW b AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, (total - capped) / left_w AS unit FROM o),
m AS (SELECT max(unit) AS unit FROM u WHERE unit * w <= 2.0::DOUBLE * n),
t AS (SELECT s.source, n, CASE WHEN w * m.unit > 2.0::DOUBLE * n THEN 2.0::DOUBLE * n ELSE w * m.unit END AS target FROM s, m),
p AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS times FROM t),
q AS (SELECT *, round(target - times * n)::BIGINT AS rest FROM p),
c AS (SELECT d.*, q.n, q.target, q.times, q.rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS tie FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, n AS source_size, target,
       (size * times + CASE WHEN before + tie < rest THEN size WHEN before >= rest OR tie = 0 THEN 0 ELSE floor(size * (rest - before) / tie) END)::BIGINT AS taken FROM c
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
