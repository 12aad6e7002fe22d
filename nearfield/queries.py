"""The registered queries of the vector engine over the fixture tables, each with its DuckDB equivalent."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.errors import VectorError
from nearfield.functions import scalar as S
from nearfield.operators import hybrid, rescore
from nearfield.operators.graph import GraphIndex
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.recall import missed, recall_at_k, vec_mean
from nearfield.plans.knn import Knn, range_join
from nearfield.sources.table import VecTable
from nearfield.streaming.ingest import session_counts, windowed_counts

K = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings with metadata columns of each kind."""
    return table(spark, sf, "embeddings").withColumns({"flag": F.col("vec_id") % 2 == 0, "txt": F.col("vec_id").cast("string"), "real": F.col("vec_id") * 0.5})


def vector(spark: SparkSession, sf: str, i: int = 0) -> list[float]:
    return table(spark, sf, "embeddings").filter(F.col("vec_id") == i).select("embedding").first()[0]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise VectorError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="nearfield-")
    return f"{base}/tables/{uuid.uuid4().hex}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("distance",)})


# Oracle parts: a vector column, its query vector and the distance between them.
_EMB = "(SELECT *, vec_id % 2 = 0 AS flag, vec_id::VARCHAR AS txt, vec_id * 0.5 AS real FROM embeddings) e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) z"
_BIN = "list_transform({v}::DOUBLE[], lambda x: CASE WHEN x {op} 0 THEN 1 ELSE 0 END)"
_I8 = "list_transform({v}::DOUBLE[], lambda x: trunc(greatest(-128, least(127, (x + 1) / " + repr(S.STEP) + "::DOUBLE - 128))))"


def _dist(metric: str, a: str = "embedding", b: str = "q") -> str:
    if metric == "l2":
        return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"
    if metric == "cosine":
        return f"list_cosine_distance({a}::DOUBLE[], {b}::DOUBLE[])"
    return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: abs(p[1] - p[2])))"


def _hamming(op: str = ">", a: str = "embedding", b: str = "q") -> str:
    return _dist("l1", _BIN.format(v=a, op=op), _BIN.format(v=b, op=op))


def _top(d: str, where: str = "TRUE", k: int = K, columns: str = "vec_id") -> str:
    return f"SELECT {columns}, round(d, 6) AS distance FROM (SELECT *, {d} AS d FROM {_EMB}) WHERE {where} ORDER BY d, vec_id LIMIT {k}"


# --- distances and scalar functions --------------------------------------------------------------------------

for _m in ("l2", "l1", "cosine"):

    def _distances(s, sf, m=_m):
        d = S.distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector(s, sf)]).cast("array<float>"), "float32", m)
        return emb(s, sf).select("vec_id", F.round(d, 6).alias("distance"))

    query(f"vec_distance_{_m}", f"SELECT vec_id, round({_dist(_m)}, 6) AS distance FROM {_EMB}")(_distances)


@query("vec_distance_hamming", f"SELECT vec_id, round({_hamming()}::DOUBLE, 6) AS distance FROM {_EMB}")
def _(s, sf):
    code = S.vec_quantize_binary(F.array(*[F.lit(float(x)) for x in vector(s, sf)]).cast("array<float>"))
    return rounded(emb(s, sf).select("vec_id", S.vec_distance_hamming(S.vec_quantize_binary(F.col("embedding")), code).alias("distance")))


def _exploded(df: DataFrame, v, kind: str = "double") -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast(kind), 6).alias("value") if kind == "double" else F.col("x").cast(kind).alias("value"))


def _each(v: str, kind: str = "DOUBLE", source: str = "embeddings") -> str:
    """One row for each element; positions from 0."""
    value = f"round(x::{kind}, 6)" if kind == "DOUBLE" else f"x::{kind}"
    return f"SELECT vec_id, (pos - 1)::INT AS pos, {value} AS value FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT vec_id, {v} AS v FROM {source}))"


_ZIP = "list_transform(list_zip(embedding, q), lambda p: (p[1] {op} p[2])::FLOAT)"
_ZIP8 = "list_transform(list_zip(" + _I8.format(v="embedding") + ", " + _I8.format(v="q") + "), lambda p: ((p[1] {op} p[2] + 128 + 512)::INT % 256) - 128)"


def _with_q(s, sf):
    q = F.array(*[F.lit(float(x)) for x in vector(s, sf)]).cast("array<float>")
    return table(s, sf, "embeddings").withColumn("q", q)


@query("vec_length", "SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
def _(s, sf):
    return table(s, sf, "embeddings").select("vec_id", S.vec_length(F.col("embedding")).alias("n"))


@query("vec_type", "SELECT vec_id, 'float32' AS kind FROM embeddings")
def _(s, sf):
    return table(s, sf, "embeddings").select("vec_id", S.vec_type(F.col("embedding")).alias("kind"))


for _name, _f, _op in (("vec_add", S.vec_add, "+"), ("vec_sub", S.vec_sub, "-")):
    query(_name, _each(_ZIP.format(op=_op), "DOUBLE", _EMB))(lambda s, sf, f=_f: _exploded(_with_q(s, sf), f(F.col("embedding"), F.col("q"))))
    query(f"{_name}_int8", _each(_ZIP8.format(op=_op), "INT", _EMB))(lambda s, sf, f=_f: _exploded(_with_q(s, sf), f(S.vec_quantize_int8(F.col("embedding")), S.vec_quantize_int8(F.col("q")), "int8"), "int"))


@query("vec_slice", _each("list_slice(embedding, 9, 24)"))
def _(s, sf):
    return _exploded(table(s, sf, "embeddings"), S.vec_slice(F.col("embedding"), 8, 24))


_NORM = "list_transform({v}, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y))))::FLOAT)"


@query("vec_normalize", _each(_NORM.format(v="embedding")))
def _(s, sf):
    return _exploded(table(s, sf, "embeddings"), S.vec_normalize(F.col("embedding")))


@query("matryoshka", _each(_NORM.format(v="list_slice(embedding, 1, 16)")))
def _(s, sf):
    return _exploded(table(s, sf, "embeddings"), S.vec_normalize(S.vec_slice(F.col("embedding"), 0, 16)))


@query("vec_to_json", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.6f}', x::DOUBLE)), ',') || ']' AS json FROM embeddings")
def _(s, sf):
    return table(s, sf, "embeddings").select("vec_id", S.vec_to_json(F.col("embedding")).alias("json"))


@query("vec_quantize_int8", _each(_I8.format(v="embedding"), "INT"))
def _(s, sf):
    return _exploded(table(s, sf, "embeddings"), S.vec_quantize_int8(F.col("embedding")), "int")


@query("vec_quantize_binary", _each(_BIN.format(v="embedding", op=">"), "INT"))
def _(s, sf):
    return _exploded(table(s, sf, "embeddings"), S.bits(S.vec_quantize_binary(F.col("embedding"))), "int")


@query("vec_f32_json", _each("list_transform(embedding, lambda x: round(x::DOUBLE, 6)::FLOAT)"))
def _(s, sf):
    # the SQL rounds halves away from zero, and the text to even: so the values are rounded before
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 6).cast("float"))
    return _exploded(table(s, sf, "embeddings"), S.vec_f32(S.vec_to_json(rounded)))


@query("vec_int8_json", _each(_I8.format(v="embedding"), "INT"))
def _(s, sf):
    return _exploded(table(s, sf, "embeddings"), S.vec_int8(S.vec_to_json(S.vec_quantize_int8(F.col("embedding")), "int8")), "int")


@query("vec_each", _each("embedding"))
def _(s, sf):
    d = table(s, sf, "embeddings").select("vec_id", S.vec_each(F.col("embedding")))
    return d.select("vec_id", F.col("rowid").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("vec_blob_roundtrip", _each("embedding"))
def _(s, sf):
    return _exploded(table(s, sf, "embeddings"), S.vec_f32_blob(S.vec_to_blob(F.col("embedding"))))


# --- exact search -------------------------------------------------------------------------------------------


def knn(s, sf, metric: str = "l2") -> Knn:
    return Knn(emb(s, sf), "embedding", metric=metric)


for _m in ("l2", "l1", "cosine"):
    query(f"knn_{_m}", _top(_dist(_m)))(lambda s, sf, m=_m: rounded(knn(s, sf, m).run(vector(s, sf), K)))

    def _manual(s, sf, m=_m):
        S.register_all(s)
        table(s, sf, "embeddings").createOrReplaceTempView("nearfield_embeddings")
        return s.sql(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT e.vec_id, vec_distance_{m}(e.embedding, z.embedding) AS d FROM nearfield_embeddings e, (SELECT embedding FROM nearfield_embeddings WHERE vec_id = 0) z) ORDER BY d, vec_id LIMIT {K}")

    query(f"manual_knn_{_m}", _top(_dist(_m)))(_manual)

    def _int8(s, sf, m=_m):
        rows = emb(s, sf).withColumn("code", S.vec_quantize_int8(F.col("embedding")))
        code = rows.filter("vec_id = 0").select("code").first()[0]
        return rounded(Knn(rows, "code", elem="int8", metric=m).run(code, K))

    query(f"knn_int8_{_m}", _top(_dist(_m, _I8.format(v="embedding"), _I8.format(v="q"))))(_int8)


@query("knn_hamming", _top(_hamming()))
def _(s, sf):
    rows = emb(s, sf).withColumn("code", S.vec_quantize_binary(F.col("embedding")))
    code = rows.filter("vec_id = 0").select("code").first()[0]
    return rounded(Knn(rows, "code", elem="bit", metric="hamming").run(code, K))


query("knn_k_gt_n", _top(_dist("l2"), "label = 3", 4096))(lambda s, sf: rounded(knn(s, sf).where(F.col("label") == 3).run(vector(s, sf), 4096)))
query("knn_k_zero", _top(_dist("l2"), k=0))(lambda s, sf: rounded(knn(s, sf).run(vector(s, sf), 0)))
query("knn_rowid_in", _top(_dist("l2"), "vec_id IN (1, 5, 9, 77, 123, 499)"))(lambda s, sf: rounded(knn(s, sf).ids([1, 5, 9, 77, 123, 499]).run(vector(s, sf), K)))
query("semi_knn", _top(_dist("l2"), "vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))(lambda s, sf: rounded(knn(s, sf).ids(table(s, sf, "labels").filter("quality = 1").select("doc_id")).run(vector(s, sf), K)))
query("anti_knn", _top(_dist("l2"), "vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"))(lambda s, sf: rounded(knn(s, sf).ids(table(s, sf, "labels").filter("quality = 1").select("doc_id"), False).run(vector(s, sf), K)))

_OPS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
for _kind, _col, _val in (("partition", "label", "4"), ("meta_int", "label", "6"), ("meta_float", "real", "100.5"), ("meta_text", "txt", "'250'"), ("meta_bool", "flag", "true")):
    for _o, _sym in _OPS.items():
        if _kind == "meta_bool" and _o not in ("eq", "ne"):
            continue
        query(f"knn_{_kind}_{_o}", _top(_dist("l2"), f"{_col} {_sym} {_val}"))(lambda s, sf, p=f"{_col} {_sym} {_val}": rounded(knn(s, sf).where(F.expr(p)).run(vector(s, sf), K)))
for _name, _p in {"knn_partition_range": "label >= 2 AND label < 6", "knn_partition_in": "label IN (1, 3, 8)", "knn_meta_int_in": "label IN (2, 5)", "knn_meta_text_in": "txt IN ('10', '20', '30', '333')", "knn_meta_between": "real BETWEEN 50 AND 120", "knn_meta_or": "label = 2 OR (flag AND real < 30.0)", "knn_multi_filter": "label >= 2 AND label <> 7 AND flag AND real < 200.0 AND txt > '1'"}.items():
    query(_name, _top(_dist("l2"), _p))(lambda s, sf, p=_p: rounded(knn(s, sf).where(F.expr(p)).run(vector(s, sf), K)))
for _o in ("gt", "ge", "lt", "le"):
    query(f"knn_distance_{_o}", _top(_dist("l2"), f"d {_OPS[_o]} 1.3"))(lambda s, sf, o=_o: rounded(knn(s, sf).within(**{o: 1.3}).run(vector(s, sf), K)))
query("knn_distance_between", _top(_dist("l2"), "d BETWEEN 1.25 AND 1.35"))(lambda s, sf: rounded(knn(s, sf).within(ge=1.25, le=1.35).run(vector(s, sf), K)))

# --- joins ---------------------------------------------------------------------------------------------------

_BATCH = "SELECT q.vec_id AS query_id, e.vec_id, {d} AS d FROM embeddings e, (SELECT * FROM embeddings WHERE {which}) q"
_RANKED = "SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM (" + _BATCH + ") QUALIFY rank <= {k}"


def _asked(s, sf, where: str) -> DataFrame:
    return table(s, sf, "embeddings").filter(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _batch_oracle(which: str, k: int) -> str:
    return _RANKED.format(d=_dist("l2", "e.embedding", "q.embedding"), which=which, k=k)


#: The stated query set of every batch search.
_EVERY = "vec_id % 50 = 0"
query("knn_batch", _batch_oracle(_EVERY, K))(lambda s, sf: rounded(knn(s, sf).batch(_asked(s, sf, _EVERY), K)))
query("knn_rank", _batch_oracle(_EVERY, K))(lambda s, sf: rounded(knn(s, sf).batch_sql(_asked(s, sf, _EVERY), K)))
query("knn_self_join", _batch_oracle(_EVERY, 5))(lambda s, sf: rounded(knn(s, sf).batch(_asked(s, sf, _EVERY), 5)))


@query("knn_topk_array", "SELECT query_id, to_json(list(vec_id ORDER BY rank))::VARCHAR AS ids FROM (" + _batch_oracle(_EVERY, K) + ") GROUP BY query_id")
def _(s, sf):
    top = knn(s, sf).batch(_asked(s, sf, _EVERY), K)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"])
    return top.groupBy("query_id").agg(F.to_json(ids).alias("ids"))


@query("knn_join_source", f"SELECT t.vec_id, distance, d.lang, d.source FROM ({_top(_dist('l2'))}) t LEFT JOIN documents d ON d.doc_id = t.vec_id")
def _(s, sf):
    top = rounded(knn(s, sf).run(vector(s, sf), K))
    return top.join(table(s, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id", "left")


@query("join_point", "SELECT l.doc_id, l.quality, e.label FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id")
def _(s, sf):
    return table(s, sf, "labels").select("doc_id", "quality").join(table(s, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


@query("range_join_l2", f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_dist('l2', 'a.embedding', 'b.embedding')}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_dist('l2', 'a.embedding', 'b.embedding')} < 1.1")
def _(s, sf):
    e = table(s, sf, "embeddings")
    return rounded(range_join(e, e, 1.1, "vec_id", "embedding"))


# --- lookups and aggregates -----------------------------------------------------------------------------------

query("fullscan", "SELECT vec_id, label, len(embedding)::INT AS n FROM embeddings")(lambda s, sf: table(s, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("n")))
query("point_lookup", "SELECT vec_id, label FROM embeddings WHERE vec_id = 42")(lambda s, sf: table(s, sf, "embeddings").filter("vec_id = 42").select("vec_id", "label"))
query("text_pk_lookup", "SELECT vec_id::VARCHAR AS id, label FROM embeddings WHERE vec_id::VARCHAR = '42'")(lambda s, sf: emb(s, sf).filter("txt = '42'").select(F.col("txt").alias("id"), "label"))
query("count_by_partition", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")(lambda s, sf: table(s, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")))
query("farthest_point", f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT *, {_dist('l2')} AS d FROM {_EMB}) ORDER BY d DESC, vec_id LIMIT 1")(lambda s, sf: rounded(knn(s, sf).scored(vector(s, sf)).select("vec_id", "distance").orderBy(F.desc("distance"), "vec_id").limit(1)))
query("centroid_by_label", "SELECT label, (pos - 1)::INT AS pos, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")(lambda s, sf: rounded(vec_mean(table(s, sf, "embeddings"), "label"), "value"))
query("distance_rollup", f"SELECT label, vec_id % 2 = 0 AS flag, count(*) AS n, round(max(d), 6) AS farthest FROM (SELECT *, {_dist('l2')} AS d FROM {_EMB}) GROUP BY ROLLUP (label, vec_id % 2 = 0)")(
    lambda s, sf: knn(s, sf).scored(vector(s, sf)).rollup("label", "flag").agg(F.count("*").alias("n"), F.round(F.max("distance"), 6).alias("farthest"))
)

# --- approximate search ----------------------------------------------------------------------------------------


def _rescore_oracle(coarse: str, metric: str = "l2", where: str = "TRUE") -> str:
    return f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT *, {_dist(metric)} AS d FROM (SELECT *, {coarse} AS c FROM {_EMB} WHERE {where} ORDER BY c, vec_id LIMIT {K * 8})) ORDER BY d, vec_id LIMIT {K}"


query("rescore_bit", _rescore_oracle(_hamming(">=")))(lambda s, sf: rounded(rescore.search(knn(s, sf), vector(s, sf), K)))
for _m in ("l2", "l1", "cosine"):
    query(f"rescore_int8_{_m}", _rescore_oracle(_dist(_m, _I8.format(v="embedding"), _I8.format(v="q")), _m))(lambda s, sf, m=_m: rounded(rescore.search(knn(s, sf, m), vector(s, sf), K, "int8")))


@query("manual_rescore_bit", _rescore_oracle(_hamming(">")))
def _(s, sf):
    rows = emb(s, sf).withColumn("code", S.vec_quantize_binary(F.col("embedding")))
    q = vector(s, sf)
    code = rows.filter("vec_id = 0").select("code").first()[0]
    coarse = Knn(rows, "code", elem="bit", metric="hamming").run(code, K * 8, ["embedding"]).drop("distance")
    return rounded(Knn(coarse, "embedding").run(q, K))


def _fixed_ivf(s, sf) -> IvfIndex:
    """The vectors of rows 0 to 7 as centroids."""
    rows = table(s, sf, "embeddings").filter("vec_id < 8").orderBy("vec_id").select("embedding").collect()
    return IvfIndex(np.array([r[0] for r in rows], "f8"), nprobe=3)


_CELLS = f"SELECT e.vec_id, e.embedding, arg_min(c.vec_id, struct_pack(d := {_dist('l2', 'e.embedding', 'c.embedding')}, i := c.vec_id))::INT AS cell FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 8) c GROUP BY ALL"
_PROBED = f"WITH cells AS ({_CELLS}), p AS (SELECT c.vec_id::INT AS cell FROM (SELECT * FROM embeddings WHERE vec_id < 8) c, (SELECT embedding AS q FROM embeddings WHERE vec_id = 9) z ORDER BY {_dist('l2', 'c.embedding', 'q')}, c.vec_id LIMIT {{n}}) SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_dist('l2')} AS d FROM cells, (SELECT embedding AS q FROM embeddings WHERE vec_id = 9) z WHERE cell IN (SELECT cell FROM p)) ORDER BY d, vec_id LIMIT {K}"
query("ivf_assign", f"SELECT vec_id, cell FROM ({_CELLS})")(lambda s, sf: _fixed_ivf(s, sf).assign(table(s, sf, "embeddings")).select("vec_id", "cell"))


def _stored_cells(s, sf) -> tuple[IvfIndex, DataFrame]:
    ivf, path = _fixed_ivf(s, sf), shared_folder(s)
    ivf.write(ivf.assign(table(s, sf, "embeddings")), path)
    return ivf, s.read.parquet(path)


def _ivf_search(n: int):
    def run(s, sf):
        ivf, cells = _stored_cells(s, sf)
        return rounded(ivf.search(cells, vector(s, sf, 9), K, n))

    return run


query("ivf_knn_full_probe", _PROBED.format(n=8))(_ivf_search(8))
query("ivf_knn_nprobe", _PROBED.format(n=3))(_ivf_search(3))


@query("ivf_trained_recall")
def _(s, sf):
    """Recall of a trained and calibrated index, query by query."""
    return _ivf_recall(s, sf)


def _ivf_recall(s, sf) -> DataFrame:
    e = table(s, sf, "embeddings")
    ivf, path = IvfIndex.train(e, 16).calibrated(e, K), shared_folder(s)
    ivf.store(ivf.assign(e), path)
    asked = _asked(s, sf, _EVERY)
    ivf, rows = IvfIndex.open_stored(s, path)
    return recall_at_k(ivf.batch(rows, asked, K), knn(s, sf).batch(asked, K))


#: Whether an approximate search of the stated query set reaches a mean recall of 0.9.
_REACHED = f"SELECT count(*) AS n_queries, TRUE AS reached FROM embeddings WHERE {_EVERY}"


def _reached(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("reached"))


query("ivf_recall_reached", _REACHED)(lambda s, sf: _reached(_ivf_recall(s, sf)))

_CENTRES = "(SELECT * FROM embeddings WHERE vec_id < 8)"
_PROBES = f"SELECT q.vec_id AS query_id, c.vec_id::INT AS cell FROM (SELECT * FROM embeddings WHERE {_EVERY}) q, {_CENTRES} c QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_dist('l2', 'c.embedding', 'q.embedding')}, c.vec_id) <= 3"


@query("ivf_knn_batch", f"WITH cells AS ({_CELLS}), p AS ({_PROBES}) SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM (SELECT p.query_id, e.vec_id, {_dist('l2', 'e.embedding', 'q.embedding')} AS d FROM p JOIN cells e USING (cell) JOIN embeddings q ON q.vec_id = p.query_id) QUALIFY rank <= {K}")
def _(s, sf):
    ivf, cells = _stored_cells(s, sf)
    return rounded(ivf.batch(cells, _asked(s, sf, _EVERY), K))


def _coarse_pairs(code: str) -> str:
    return f"SELECT q.vec_id AS query_id, e.vec_id, e.embedding, q.embedding AS q FROM embeddings e, (SELECT * FROM embeddings WHERE {_EVERY}) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {code}, e.vec_id) <= {K * 8}"


@query("rescore_bit_batch", f"SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM (SELECT *, {_dist('l2')} AS d FROM ({_coarse_pairs(_hamming('>=', 'e.embedding', 'q.embedding'))})) QUALIFY rank <= {K}")
def _(s, sf):
    return rounded(rescore.batch(knn(s, sf), _asked(s, sf, _EVERY), K))


_COARSE = f"(SELECT vec_id FROM ({_rescore_oracle(_hamming('>='))}))"


@query("recall_at_k", f"SELECT 0::BIGINT AS query_id, avg(CASE WHEN vec_id IN {_COARSE} THEN 1 ELSE 0 END)::DOUBLE AS recall FROM ({_top(_dist('l2'))})")
def _(s, sf):
    one = lambda d: d.withColumn("query_id", F.lit(0).cast("long"))
    return recall_at_k(one(rescore.search(knn(s, sf), vector(s, sf), K)), one(knn(s, sf).run(vector(s, sf), K)))


@query("approx_missed", f"SELECT vec_id FROM ({_top(_dist('l2'))}) EXCEPT ALL SELECT vec_id FROM {_COARSE}")
def _(s, sf):
    return missed(rescore.search(knn(s, sf), vector(s, sf), K), knn(s, sf).run(vector(s, sf), K))


def _graph(s, sf, quantizer: str | None = None) -> tuple[GraphIndex, DataFrame]:
    g, path = GraphIndex(degree=32, width=64, shard_rows=512, quantizer=quantizer), shared_folder(s)
    g.build(table(s, sf, "embeddings")).write.parquet(path)
    return g, s.read.parquet(path)


def _graph_recall(s, sf, quantizer: str | None = None, width: int = 64, gone: str = "false", repaired: bool = False) -> DataFrame:
    """Recall by the graph, rows with ``gone`` being passed over, or taken out with their links repaired."""
    (g, index), e, asked = _graph(s, sf, quantizer), table(s, sf, "embeddings"), _asked(s, sf, _EVERY)
    ids = e.filter(gone).select("vec_id")
    found = g.search(g.delete(index, ids), asked, K, width) if repaired else g.search(index, asked, K, width, deleted=ids)
    return recall_at_k(found, knn(s, sf).where(~F.expr(gone)).batch(asked, K))


query("graph_recall")(_graph_recall)
query("graph_recall_reached", _REACHED)(lambda s, sf: _reached(_graph_recall(s, sf)))
query("graph_int8_reached", _REACHED)(lambda s, sf: _reached(_graph_recall(s, sf, "int8")))
query("graph_binary_reached", _REACHED)(lambda s, sf: _reached(_graph_recall(s, sf, "binary", 256)))
query("graph_passed_over_reached", _REACHED)(lambda s, sf: _reached(_graph_recall(s, sf, gone="vec_id % 3 = 1")))
query("graph_repaired_reached", _REACHED)(lambda s, sf: _reached(_graph_recall(s, sf, gone="vec_id % 3 = 1", repaired=True)))


# --- hybrid search ---------------------------------------------------------------------------------------------

_WORDS = ["ing", "tion"]
_SCORE = " + ".join(f"((length(t) - length(replace(t, '{w}', ''))) / {len(w)})::INT" for w in _WORDS)
_KW = f"SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT doc_id, {_SCORE} AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)) WHERE score > 0 QUALIFY rank <= {K}"
_VEC = f"SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id)::INT AS rank FROM (SELECT vec_id, {_dist('l2')} AS d FROM {_EMB}) QUALIFY rank <= {K}"


def _keyword(s, sf) -> DataFrame:
    return hybrid.keyword_top(table(s, sf, "documents"), _WORDS, K).select(F.col("doc_id").alias("id"), "rank")


def _near(s, sf) -> DataFrame:
    top = knn(s, sf).run(vector(s, sf), K)
    return top.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))  # k rows


query("hybrid_rrf", f"WITH a AS ({_KW}), b AS ({_VEC}) SELECT coalesce(a.id, b.id) AS id, a.rank AS kw_rank, b.rank AS vec_rank, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 6)::DOUBLE AS rrf FROM a FULL JOIN b ON a.id = b.id")(lambda s, sf: rounded(hybrid.rrf(_keyword(s, sf), _near(s, sf)), "rrf"))
query("hybrid_keyword_first", f"SELECT id, rank, 'fts' AS match_type FROM ({_KW}) UNION ALL SELECT id, rank, 'vec' FROM ({_VEC})")(lambda s, sf: hybrid.keyword_first(_keyword(s, sf), _near(s, sf)))


@query("hybrid_semantic_rerank", f"SELECT k.id, round({_dist('l2')}, 6) AS distance FROM ({_KW}) k JOIN embeddings e ON e.vec_id = k.id, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) z")
def _(s, sf):
    return rounded(hybrid.semantic_rerank(_keyword(s, sf), knn(s, sf).scored(vector(s, sf)).withColumnRenamed("vec_id", "id")))


# --- changes ---------------------------------------------------------------------------------------------------


def _made(s, sf) -> VecTable:
    t = VecTable.create(s, shared_folder(s), "vec_id integer primary key, label integer partition key, embedding float[64]")
    t.insert(table(s, sf, "embeddings"))
    return t


def _state(t: VecTable) -> DataFrame:
    """A row an element of every vector."""
    return t.df().select("vec_id", F.col("label").cast("int").alias("label"), F.posexplode("embedding").alias("pos", "x")).select("vec_id", "label", "pos", F.round(F.col("x").cast("double"), 6).alias("value"))


def _changed(label: str = "label", element: str = "x", where: str = "TRUE", source: str = "embeddings") -> str:
    each = f"SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM {source} WHERE {where}"
    return f"SELECT vec_id, {label} AS label, (pos - 1)::INT AS pos, round(({element})::DOUBLE, 6) AS value FROM ({each})"


@query("dml_insert", _changed(source="(SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, 77, embedding FROM embeddings WHERE vec_id < 3)"))
def _(s, sf):
    t = _made(s, sf)
    t.insert(table(s, sf, "embeddings").filter("vec_id < 3").withColumns({"vec_id": F.col("vec_id") + 1000000, "label": F.lit(77)}))
    return _state(t)


@query("dml_replace", _changed("CASE WHEN vec_id < 5 THEN 3 ELSE label END", "CASE WHEN vec_id < 5 THEN -x ELSE x END"))
def _(s, sf):
    t = _made(s, sf)
    t.replace(table(s, sf, "embeddings").filter("vec_id < 5").withColumns({"label": F.lit(3), "embedding": F.transform("embedding", lambda x: -x)}))
    return _state(t)


@query("dml_delete", _changed(where="vec_id % 7 <> 0"))
def _(s, sf):
    t = _made(s, sf)
    t.delete(F.col("vec_id") % 7 == 0)
    return _state(t)


@query("dml_update", _changed(element="CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE x END"))
def _(s, sf):
    t = _made(s, sf)
    t.update({"embedding": F.transform("embedding", lambda x: x * 0)}, F.col("vec_id") % 5 == 0)
    return _state(t)


# --- tables that search by the index they declare


def _table(s, sf, index: str) -> VecTable:
    t = VecTable.create(s, shared_folder(s), f"vec_id integer primary key, label integer, embedding float[64] indexed by {index}")
    t.insert(table(s, sf, "embeddings"))
    t.build_index()
    return t


query("table_rescore_bit", _rescore_oracle(_hamming(">=")))(lambda s, sf: rounded(_table(s, sf, "rescore(quantizer=bit)").knn().run(vector(s, sf), K)))
query("table_ivf_all_cells", _top(_dist("l2"), "label < 7"))(lambda s, sf: rounded(_table(s, sf, "ivf(nlist=16, nprobe=16)").knn().where(F.col("label") < 7).run(vector(s, sf), K)))
query("table_ivf_batch", _batch_oracle(_EVERY, K))(lambda s, sf: rounded(_table(s, sf, "ivf(nlist=16, nprobe=16)").knn().batch(_asked(s, sf, _EVERY), K)))


def _without(t: VecTable) -> VecTable:
    t.delete(F.col("vec_id") % 4 == 1)
    return t


query("table_rescore_deleted", _rescore_oracle(_hamming(">="), where="vec_id % 4 <> 1"))(lambda s, sf: rounded(_without(_table(s, sf, "rescore(quantizer=bit)")).knn().run(vector(s, sf), K)))
query("table_ivf_deleted", _top(_dist("l2"), "vec_id % 4 <> 1"))(lambda s, sf: rounded(_without(_table(s, sf, "ivf(nlist=16, nprobe=16)")).knn().run(vector(s, sf), K)))


@query("table_diskann_reached", _REACHED)
def _(s, sf):
    """After a delete, an insert that waits in the buffer and a search with a predicate."""
    t = _table(s, sf, "diskann(neighbor_quantizer=int8, n_neighbors=32, search_list_size=64)")
    t.delete(F.col("vec_id") % 5 == 1)
    t.insert(table(s, sf, "embeddings").filter("vec_id % 10 = 1").select("vec_id", "label", "embedding"))
    asked = _asked(s, sf, _EVERY)
    exact = Knn(t.df(), "embedding").where(F.col("label") != 3).batch(asked, K)
    return _reached(recall_at_k(t.knn().where(F.col("label") != 3).batch(asked, K), exact))


# --- SQL functions


def _sql(text: str, columns: str = "embedding"):
    def run(s, sf):
        S.register_all(s)
        table(s, sf, "embeddings").createOrReplaceTempView("nearfield_embeddings")
        return s.sql(text.replace("{Z}", "(SELECT embedding AS q FROM nearfield_embeddings WHERE vec_id = 0) z").replace("{E}", "nearfield_embeddings"))

    return run


_BITS8 = "list_transform(list_slice(embedding, 1, 8), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END)"
query("sql_length_type", "SELECT vec_id, 64 AS n, 'float32' AS kind, 64 AS n8, 'int8' AS kind8, 64 AS n1, 'bit' AS kind1 FROM embeddings")(
    _sql("SELECT vec_id, vec_length(embedding) AS n, vec_type(embedding) AS kind, vec_length(vec_quantize_int8(embedding)) AS n8, vec_type(vec_quantize_int8(embedding)) AS kind8, vec_length(vec_quantize_binary(embedding)) AS n1, vec_type(vec_quantize_binary(embedding)) AS kind1 FROM {E}")
)
query("sql_to_json", f"SELECT vec_id, '[' || array_to_string(list_transform({_I8.format(v='embedding')}, lambda x: x::INT::VARCHAR), ',') || ']' AS int8, '[' || array_to_string({_BITS8}, ',') || ']' AS bit, '[' || array_to_string(list_transform(list_slice(embedding, 3, 5), lambda x: format('{{:.6f}}', x::DOUBLE)), ',') || ']' AS float32 FROM embeddings")(
    _sql("SELECT vec_id, vec_to_json(vec_quantize_int8(embedding)) AS int8, vec_to_json(vec_slice_bit(vec_quantize_binary(embedding), 0, 8)) AS bit, vec_to_json(vec_slice(embedding, 2, 5)) AS float32 FROM {E}")
)
query("sql_normalize", _each(_NORM.format(v="list_slice(embedding, 1, 16)")))(_sql("SELECT vec_id, pos, round(cast(x AS DOUBLE), 6) AS value FROM (SELECT vec_id, posexplode(v) AS (pos, x) FROM (SELECT vec_id, vec_normalize(vec_slice(embedding, 0, 16)) AS v FROM {E}))"))
query("sql_int8_arithmetic", _each(_ZIP8.format(op="+"), "INT", _EMB))(_sql("SELECT vec_id, pos, cast(x AS INT) AS value FROM (SELECT vec_id, posexplode(v) AS (pos, x) FROM (SELECT vec_id, vec_add_int8(vec_quantize_int8(embedding), vec_quantize_int8(q)) AS v FROM {E}, {Z}))"))
query("sql_distance_hamming", _top(_hamming()))(_sql(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, vec_distance_hamming(vec_quantize_binary(embedding), vec_quantize_binary(q)) AS d FROM {{E}}, {{Z}}) ORDER BY d, vec_id LIMIT {K}"))
query("sql_from_json", _each("list_transform(embedding, lambda x: round(x::DOUBLE, 6)::FLOAT)"))(_sql("SELECT vec_id, pos, round(cast(x AS DOUBLE), 6) AS value FROM (SELECT vec_id, posexplode(v) AS (pos, x) FROM (SELECT vec_id, vec_f32(vec_to_json(transform(embedding, x -> cast(round(cast(x AS DOUBLE), 6) AS FLOAT)))) AS v FROM {E}))"))
query("sql_each_bit", f"SELECT vec_id, (pos - 1)::INT AS rowid, x::INT AS value FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT vec_id, {_BITS8} AS v FROM embeddings))")(
    _sql("SELECT e.vec_id, b.rowid, b.value FROM (SELECT vec_id, vec_slice_bit(vec_quantize_binary(embedding), 0, 8) AS v FROM {E}) e, LATERAL vec_each_bit(e.v) b")
)
query("sql_each_bit_msb", f"SELECT vec_id, (8 - pos)::INT AS rowid, x::INT AS value FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT vec_id, {_BITS8} AS v FROM embeddings))")(
    _sql("SELECT e.vec_id, b.rowid, b.value FROM (SELECT vec_id, vec_slice_bit(vec_quantize_binary(embedding), 0, 8) AS v FROM {E}) e, LATERAL vec_each_bit(e.v, true) b")
)
query("vec_version", f"SELECT '{S.vec_version()}' AS version, TRUE AS debug")(_sql(f"SELECT vec_version() AS version, contains(vec_debug(), '{S.vec_version()}') AS debug"))

# --- streams' operators on tables


@query("events_windowed", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, sf):
    return windowed_counts(table(s, sf, "events")).withColumn("total", F.round("total", 4))




@query("events_sliding", "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL '-30' MINUTE END]) AS start, event_type, value FROM events) GROUP BY ALL")
def _(s, sf):
    return windowed_counts(table(s, sf, "events"), "1 hour", step="30 minutes").withColumn("total", F.round("total", 4))


@query("events_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def _(s, sf):
    return session_counts(table(s, sf, "events"), "2 hours").withColumn("total", F.round("total", 4))
