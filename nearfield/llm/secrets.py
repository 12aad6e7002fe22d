"""Secret scans by an incremental blob ledger.

Texts are blobs, addressed by their SHA-256; documents are paths to them.  The ledger lists the (blob, rule
version) pairs that were scanned and what was found.  A run scans each unseen pair once, whatever the number of
paths, and joins findings back to all paths; with a ledger of earlier runs only new blobs or new rule versions
are read.  JVM expressions only.

A rule is a pattern, and a condition on each leftmost non-overlapping match (matches that fail it still use up
their text).  Spans are code points, end exclusive.

Edge cases: a NULL or empty text is the empty blob; rows that repeat are paths to one blob; NULL and repeated ids are
paths of their own, found by their text; a very long text is scanned whole, its matches being rows; an empty table gives
an empty result; other columns are ignored, whatever their names (redacted() keeps them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import documents, durable

_cased = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = "(" + "|".join(map(_cased, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: (kind, version, pattern, group that is measured, least length).  The first three are the base; the method adds
#: key blocks and signed web tokens.
RULES = (
    ("assign", 1, ASSIGN, 2, 12),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    ("hex", 1, "[0-9a-f]+", 0, 16),
    ("pem", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
#: A rule that needs no group has the same matches with its least length in the pattern: runs are maximal.
TIGHT = {"access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
BASE = ("assign", "access", "hex")


#: What follows the header of a key block without its END line: headers, base64 runs (line feeds may be written as \\n
#: in quoted keys), a shorter last one that stands alone on its line, and an END line of another label.
KEY_LINES = (
    r"^(?:\s|\\[nr])*+(?:[A-Z][A-Za-z0-9-]{0,30}:[^\n]*+\s*+)*+(?:[A-Za-z0-9+/=]{16,}+(?:[\s\"',]|\\[nr])*+)++"
    r"(?:[A-Za-z0-9+/]++=*+(?=[ \t\r\"',]*+(?:\n|\\[nr]|$|-----)))?+(?:(?:[\s\"',]|\\[nr])*+-----END [A-Z ]{0,32}PRIVATE KEY-----)?+"
)


def match_parts(text: Column, kind: str, pattern: str, group: int) -> Column:
    """ARRAY<STRUCT<g, m, k>>: lengths of the text before each match, of the match and of what the rule measures;
    NULL without a match.  The last entry is the text after the last match."""
    pattern = TIGHT.get(kind, pattern)
    size = lambda a: F.transform(a, lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(size(F.split(text, pattern, -1)).alias("g"), size(whole).alias("m"), size(measured).alias("k"))
    return F.when(text.rlike(pattern), zipped)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): paths has (id, blob, findings) for each row, findings being an array of (start, rank, kind,
    end) in order; ledger has (blob, pairs, findings), a row a blob and run, with this run's rows added.

    Hot blobs do no harm: a blob is scanned at the one path (its smallest id) that a partial aggregate picks, and
    the join back to the paths is one that adaptive execution splits.  Matches become rows, and their places running
    sums over a blob's matches, so that a text with millions of matches takes linear time and spills.
    """
    out, fresh = _scanned(docs, ledger, rules, id_col, text_col)
    return out, fresh if ledger is None else ledger.select("blob", "pairs", "findings").unionByName(fresh)


def scan_stored(docs: DataFrame, path: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan()'s paths, with the ledger kept as Parquet at ``path`` (a folder that driver and executors share): its rows are
    read, where there are any, and this run's are added."""
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    out, fresh = _scanned(docs, spark.read.parquet(path) if there else None, rules, id_col, text_col)
    out = durable(out)  # the ledger that it reads grows next
    fresh.write.mode("append").parquet(path)
    return out


def _scanned(docs: DataFrame, ledger: DataFrame | None, rules, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The paths with their findings, and the rows that this run adds to the ledger."""
    pairs = [f"{k}:{v}" for k, v, *_ in rules]
    rank = F.create_map(*[x for i, (k, *_) in enumerate(rules) for x in (F.lit(k), F.lit(i))])
    every = F.array(*[F.lit(x) for x in pairs])
    paths = durable(docs.select(F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("blob")))
    pick = paths.groupBy("blob").agg(F.min(F.struct(F.col("_id"))).alias("_p")).select("blob", F.col("_p._id").alias("_id"))
    if ledger is None:
        pick = pick.withColumn("pairs", every)
    else:
        known = ledger.select("blob", F.explode("pairs").alias("x")).groupBy("blob").agg(F.collect_set("x").alias("_seen"))
        new = F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>")))
        pick = pick.join(known, "blob", "left").select("blob", "_id", new.alias("pairs")).filter(F.size("pairs") > 0)
    texts = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_b", F.sha2(F.col("_t").cast("binary"), 256))
    todo = texts.join(pick, (F.col("_b") == F.col("blob")) & F.col("_i").eqNullSafe(F.col("_id")))
    parts = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("least"), F.when(F.array_contains("pairs", f"{k}:{v}"), match_parts(F.col("_t"), k, p, g)).alias("parts")) for k, v, p, g, n in rules]
    rows = todo.select("blob", F.explode(F.array(*parts)).alias("r")).filter(F.col("r.parts").isNotNull()).select("blob", "r.kind", "r.least", F.posexplode("r.parts").alias("i", "x"))
    # repeated rows of one path give equal rows here
    sums = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.dropDuplicates(["blob", "kind", "i"]).select("blob", "kind", "least", "x", F.sum(F.col("x.g") + F.coalesce("x.m", F.lit(0))).over(sums).cast("int").alias("end")).filter(F.col("x.k") >= F.col("least"))
    found = ends.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("x.m")).alias("start"), rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("findings"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    fresh = durable(pick.select("blob", "pairs").join(found, "blob", "left").select("blob", "pairs", F.coalesce("findings", none).alias("findings")))
    whole = fresh if ledger is None else ledger.select("blob", "pairs", "findings").unionByName(fresh)
    hits = whole.filter(F.size("findings") > 0)
    if ledger is not None:
        # of a rule that has a newer version the older findings do not count
        hits = hits.select("blob", F.filter("findings", lambda f: F.exists(F.array_intersect("pairs", every), lambda x: F.split_part(x, F.lit(":"), F.lit(1)) == f["kind"])).alias("findings"))
        hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))
    out = paths.join(hits.select("blob", "findings"), "blob", "left").select(F.col("_id").alias(id_col), "blob", F.coalesce("findings", none).alias("findings"))
    return out, fresh


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", length_col: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs with every found span replaced by the mark (overlapping spans by one), and the code points counted again
    in length_col.  The finding of a key block is its header; the whole block is replaced.  Findings are joined by blob,
    so that ids may be NULL or repeat."""
    paths, _ = scan(docs, id_col=id_col, text_col=text_col)
    hits = paths.filter(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("_f")).withColumnRenamed("blob", "_blob")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_b", F.sha2(F.coalesce(F.col("_row")[text_col], F.lit("")).cast("binary"), 256))
    joined = whole.join(hits, F.col("_b") == F.col("_blob"), "left")
    text = F.col("_row")[text_col]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    spans = F.transform("_f", lambda x: F.struct(x["start"], F.when(x["kind"] == "pem", _key_end(text, x["start"], x["end"])).otherwise(x["end"]).alias("end")))
    made = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.lit(2147483647))))
    done = joined.withColumn("_t", F.when(F.col("_f").isNull(), text).otherwise(made))
    new = {text_col: F.col("_t")} | ({length_col: F.when(F.col("_f").isNull(), F.col("_row")[length_col]).otherwise(F.length("_t").cast(docs.schema[length_col].dataType))} if length_col else {})
    return done.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def _key_end(text: Column, start: Column, end: Column) -> Column:
    """Where the key block ends whose header is at start..end: after the matching END line, or, where that is missing or
    comes after another header, after the base64 lines that follow."""
    last = F.replace(F.substring(text, start + 1, end - start), F.lit("-----BEGIN"), F.lit("-----END"))
    at, other = F.position(last, text, end + 1), F.position(F.lit("-----BEGIN "), text, end + 1)
    lines = F.length(F.regexp_extract(F.substring(text, end + 1, F.lit(2147483647)), KEY_LINES, 0))
    return F.when((at > 0) & ((other == 0) | (at < other)), at - 1 + F.length(last)).otherwise(end + lines)


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    got, _ = scan(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return got.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


def _oracle() -> str:
    def places(kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT r, '{kind}' AS kind, {[k for k, *_ in RULES].index(kind)} AS rank, s, s + m[i] AS e FROM (
  SELECT r, m, k, i, (list_sum(g[1:i]) + coalesce(list_sum(m[1:i-1]), 0))::BIGINT AS s FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS g, list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS m,
             list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS k FROM d WHERE regexp_matches(t, '{p}')))) WHERE k[i] >= {least}"""

    union = " UNION ALL ".join(places(k, p, g, n) for k, _, p, g, n in RULES)
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({union}),
a AS (SELECT r, {count}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


ORACLE_SQL = _oracle()
