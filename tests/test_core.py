import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.errors import VectorError
from nearfield.functions import scalar as S
from nearfield.operators.graph import GraphIndex, prune
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.recall import recall_at_k
from nearfield.operators.rescore import search as rescore
from nearfield.plans.knn import Knn, range_join
from nearfield.plans.spec import VecTableSpec
from nearfield.sources.table import ChangedByOther, VecTable
from nearfield.streaming.ingest import search_stream, session_counts, upsert_stream, windowed_counts


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_constructors(spark):
    assert one(spark, S.vec_f32(F.lit("[1, 2,,3] tail"))) == [1.0, 2.0, 3.0]
    assert one(spark, S.vec_int8(F.lit("[-128,127]"))) == [-128, 127]
    for bad in (S.vec_f32(F.lit("[]")), S.vec_f32(F.lit("x")), S.vec_f32(F.lit("[1e400]")), S.vec_f32(F.lit("[NaN]")), S.vec_f32(F.lit(None).cast("string")), S.vec_int8(F.lit("[128]")), S.vec_bit(F.lit(b""))):
        with pytest.raises(Exception):
            one(spark, bad)
    assert one(spark, S.vec_f32(F.lit(None).cast("string"), strict=False)) is None
    assert one(spark, S.vec_f32_blob(F.lit(S.serialize_float32([0.5, -2.0])))) == [0.5, -2.0]
    assert one(spark, S.vec_int8_blob(F.lit(S.serialize_int8([5, -7])))) == [5, -7]


def test_bits_and_errors(spark):
    v = F.lit(bytes([0b00000101, 0b10000000]))
    assert one(spark, S.bits(v)) == [1, 0, 1, 0, 0, 0, 0, 0] + [0] * 7 + [1]
    assert one(spark, S.vec_to_json(v, "bit")) == "[1,0,1,0,0,0,0,0,0,0,0,0,0,0,0,1]"
    rows = spark.range(1).select(S.vec_each(v, "bit", msb=True)).orderBy("rowid").collect()
    assert [r["value"] for r in rows][:8] == [0, 0, 0, 0, 0, 1, 0, 1]
    a = F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")
    with pytest.raises(Exception, match="mismatch"):
        one(spark, S.vec_distance_l2(a, F.slice(a, 1, 1)))
    assert one(spark, S.vec_distance_cosine(a, F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>"))) is None
    for args in ((-1, 2), (2, 1), (1, 1)):
        with pytest.raises(VectorError):
            S.vec_slice(a, *args)
    with pytest.raises(Exception, match="greater"):
        one(spark, S.vec_slice(a, 0, 3))
    int8 = lambda *x: F.array(*map(F.lit, x)).cast("array<tinyint>")
    assert one(spark, S.vec_add(int8(127, -128), int8(1, -1), "int8")) == [-128, 127]


def test_metrics_golden(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "vec_id long, embedding array<float>")
    # Distances of these three rows.
    want = {"l2": [(1, 4.472136), (2, 7.211103), (3, 10.0)], "l1": [(1, 6.0), (2, 10.0), (3, 14.0)], "cosine": [(3, 1.973417), (2, 1.98387), (1, 2.0)]}
    for m, rows in want.items():
        got = [(r[0], round(r[1], 6)) for r in Knn(d, "embedding", metric=m).run([-1.0, -2.0], 3).collect()]
        assert sorted(got) == sorted(rows)
    with pytest.raises(VectorError):
        Knn(d, "embedding").run([0.0, 0.0], -1)
    with pytest.raises(VectorError):
        Knn(d, "embedding").run([0.0, 0.0], 5000)


def test_kernel_equals_sql(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for metric in ("l2", "l1", "cosine"):
        k = Knn(e, "embedding", metric=metric).where(F.col("label") > 2).within(gt=0.5)
        rows = [[(r["query_id"], r["vec_id"], round(r["distance"], 6), r["rank"]) for r in d.orderBy("query_id", "rank").collect()] for d in (k.batch(q, 9), k.batch_sql(q, 9))]
        assert rows[0] == rows[1]
    assert Knn(e, "embedding").batch(q.limit(0), 3).count() == 0


def test_plans(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = Knn(e, "embedding").where(F.col("label") == 3).run([0.1] * 64, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan


def test_spec():
    s = VecTableSpec.parse("id integer primary key, v float[8] distance_metric=cosine indexed by ivf(nlist=16, nprobe=4), p text partition key, n integer, +note text, chunk_size=16")
    assert (s.key, s.vector("v").metric, s.vector("v").options["nlist"], s.partitions, s.metadata, s.auxiliary, s.chunk_size) == ("id", "cosine", 16, {"p": "string"}, {"n": "bigint"}, {"note": "string"}, 16)
    assert VecTableSpec.from_json(s.to_json()) == s
    for bad in ("n integer", "v float[0]", "v float[9000]", "v bit[8] distance_metric=l2", "v float[8] indexed by rescore()", "v float[8] indexed by ivf(nlist=2,nprobe=3)", "v float[7] indexed by diskann(neighbor_quantizer=binary)", "v float[8], chunk_size=7", "v float[8], what is this", "v float[8], V integer", "v float[8] indexed by ivf(oversample=4)"):
        with pytest.raises(VectorError):
            VecTableSpec.parse(bad)
    with pytest.raises(VectorError):
        VecTableSpec.parse("v float[8] indexed by rescore(quantizer=bit), n integer", strict_compat=True)


def test_table(spark, tmp_path):
    t = VecTable.create(spark, f"{tmp_path}/t", "id text primary key, v float[2], p integer partition key, n integer, +a text")
    t.insert(spark.createDataFrame([("a", [1.0, 0.0], 1, 5, "x"), ("b", [0.0, 1.0], None, 6, None)], "id string, v array<float>, p long, n long, a string"))
    with pytest.raises(VectorError, match="UNIQUE"):
        t.insert(spark.createDataFrame([("a", [1.0, 0.0], 1)], "id string, v array<float>, p long"))
    with pytest.raises(Exception, match="Dimension"):
        t.insert(spark.createDataFrame([("c", [1.0], 1)], "id string, v array<float>, p long"))
    with pytest.raises(VectorError):
        t.update({"p": 2}, F.lit(True))
    t.replace(spark.createDataFrame([("a", [3.0, 0.0], 2, 7, "y")], "id string, v array<float>, p long, n long, a string"))
    t.update({"n": 9}, F.col("id") == "b")
    assert sorted((r["id"], r["v"][0], r["n"]) for r in t.df().collect()) == [("a", 3.0, 7), ("b", 0.0, 9)]
    assert [r["id"] for r in VecTable.open(spark, f"{tmp_path}/t").knn().run([3.0, 0.0], 1).collect()] == ["a"]
    t.delete(F.col("p").isNull())
    t.vacuum()
    assert t.point("a").count() == 1 and t.df().count() == 1 and t.info().count() == 6
    moved = t.rename(f"{tmp_path}/u")
    assert moved.df().count() == 1
    moved.drop()
    auto = VecTable.create(spark, f"{tmp_path}/auto", "v float[1]")
    auto.insert(spark.createDataFrame([([1.0],), ([2.0],)], "v array<float>"))
    auto.insert(spark.createDataFrame([([3.0],)], "v array<float>"))
    assert sorted(r["rowid"] for r in auto.df().collect()) == [1, 2, 3]


def gaussian(spark, n, dims, seed=42):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), x


def test_recall_thresholds(spark):
    d, x = gaussian(spark, 1000, 32)
    exact = {r[0] for r in Knn(d, "embedding").run(x[3].tolist(), 10).collect()}
    last = 0
    for o in (2, 16, 64):
        share = len(exact & {r[0] for r in rescore(Knn(d, "embedding"), x[3].tolist(), 10, "bit", o).collect()}) / 10
        assert share >= last
        last = share
    assert last >= 0.7
    g, y = gaussian(spark, 150, 16)
    asked = g.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = GraphIndex(degree=16, width=32, shard_rows=80)
    found = index.search(index.build(g), asked, 5, deleted=g.filter("vec_id = 149"))
    assert min(r["recall"] for r in recall_at_k(found, Knn(g, "embedding").batch(asked, 5)).collect()) >= 0.6
    assert len(prune(0, np.arange(1, 150), y, 8)) <= 8
    line = spark.createDataFrame([(i, [float(i), 0.0, 0.0, 0.0]) for i in range(100)], "vec_id long, embedding array<float>")
    ivf = IvfIndex.train(line, 8, nprobe=8)
    got = {r[0] for r in ivf.search(ivf.assign(line), [50.0, 0, 0, 0], 10).collect()}
    assert len(got) == 10 and all(45 <= i <= 55 for i in got)
    assert ivf.search(ivf.unassigned(line), [50.0, 0, 0, 0], 3).count() == 3
    assert np.allclose(IvfIndex.from_json(ivf.to_json()).centroids, ivf.centroids)


def brute(x, q, k, metric="l2", alive=None):
    d = np.sqrt(((x - q) ** 2).sum(1)) if metric == "l2" else np.abs(x - q).sum(1)
    keep = np.flatnonzero(alive) if alive is not None else np.arange(len(x))
    return set(keep[np.lexsort((keep, d[keep]))][:k].tolist())


def test_ids_beside_null_stay(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    d = spark.createDataFrame([(i, [float(n), 1.0], i) for n, i in enumerate(ids)], "vec_id long, embedding array<float>, n long").coalesce(1)
    q = d.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    key = lambda r: (str(r[0]), r[3])
    got, want = (sorted((tuple(r) for r in Knn(d, "embedding").__getattribute__(f)(q, 2).select("query_id", "vec_id", "distance", "rank").collect()), key=key) for f in ("batch", "batch_sql"))
    assert got == want and {r[0] for r in got} == set(ids)
    assert {r["n"] for r in IvfIndex(np.zeros((1, 2))).assign(d).collect()} == set(ids)
    texts = q.select(F.coalesce(F.col("query_id").cast("string"), F.lit("none")).alias("query_id"), "query")
    assert {r["query_id"] for r in Knn(d, "embedding").batch(texts, 1).collect()} == {"none", str(ids[0]), str(ids[2])}
    g = GraphIndex(degree=8, width=8)
    found = g.search(g.build(d), q, 3).collect()
    assert {(r["query_id"], r["vec_id"]) for r in found} == {(a, b) for a in ids for b in ids}


def test_batch_search_against_brute_force(spark, monkeypatch):
    from nearfield.plans import blocks, kernels, knn

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 1).astype("f4")
    x[50:60] = x[0]  # ties
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    q = d.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for size, sent in ((4096, 64 << 20), (7, 0)):  # the second: many blocks, in a Cartesian product
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        monkeypatch.setattr(knn, "QUERY_BYTES", sent)
        for metric in ("l2", "l1", "cosine"):
            for bounds in ({}, {"gt": 0.2, "le": 1.7}):
                k = Knn(d, "embedding", metric=metric).within(**bounds)
                rows = [sorted((r["query_id"], r["vec_id"], round(r["distance"], 9), r["rank"]) for r in f(q, 12).collect()) for f in (k.batch, k.batch_sql)]
                assert rows[0] == rows[1], (size, metric, bounds)
    assert Knn(d, "embedding").batch(q, 0).collect() == []
    big = np.full((4, 3), 1e4) + rng.normal(size=(4, 3)) * 1e-3  # matrix products lose all of these distances
    pos, at = kernels.nearest(big, big, "l2", 1)
    assert {(i, i) for i in range(4)} <= set(zip(pos.tolist(), at.tolist()))


def test_range_join_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(150, 3)) * 0.05 + 4]).astype("f4")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    for metric in ("l2", "l1"):
        for radius in (0.1, 0.7):
            got = {(r["a_id"], r["b_id"]) for r in range_join(d, d, radius, "id", "v", metric, cells=9).collect()}
            y = x.astype("f8")
            want = {(i, j) for i in range(300) for j in range(i + 1, 300) if (np.sqrt(((y[i] - y[j]) ** 2).sum()) if metric == "l2" else np.abs(y[i] - y[j]).sum()) < radius}
            assert got == want
    assert range_join(d.limit(0), d, 1.0, "id", "v").count() == 0 and range_join(d, d.limit(0), 1.0, "id", "v").count() == 0


def test_graph_changes(spark):
    g, y = gaussian(spark, 300, 16)
    index = GraphIndex(degree=16, width=32, shard_rows=150)
    built = index.build(g).cache()
    asked = g.filter("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = lambda table, ix=index, width=None, **more: {q: [r["vec_id"] for r in ix.search(table, asked, 10, width, **more).orderBy("rank").collect() if r["query_id"] == q] for q in range(6)}
    assert all(len(v) == 10 and v[0] == q for q, v in found(built).items())
    # the nearest are deleted: k others are found, and nothing that is gone
    near = set().union(*(brute(y, y[q], 40) for q in range(6)))
    gone = g.filter(F.col("vec_id").isin([int(i) for i in near]))
    alive = np.array([i not in near for i in range(300)])
    for rows, more in ((built, {"deleted": gone.select("vec_id")}), (index.delete(built, gone.select("vec_id")), {})):
        got = found(rows, width=64, **more)
        assert all(len(v) == 10 and not near & set(v) for v in got.values())
        assert np.mean([len(set(v) & brute(y, y[q], 10, alive=alive)) / 10 for q, v in got.items()]) >= 0.9
    repaired = index.delete(built, gone.select("vec_id")).cache()
    assert repaired.count() == 300 - len(near)
    for r in repaired.groupBy("shard").agg(F.count("*").alias("n"), F.max("place").alias("p"), F.max(F.array_max("links")).alias("l"), F.sum(F.col("medoid").cast("int")).alias("m")).collect():
        assert r["p"] == r["n"] - 1 and r["l"] < r["n"] and r["m"] == 1
    assert index.delete(built, g.select("vec_id")).count() == 0
    # inserted again, and by way of a buffer
    again = index.insert(repaired, gone)
    assert again.count() == 300 and np.mean([len(set(v) & brute(y, y[q], 10)) / 10 for q, v in found(again, width=64).items()]) >= 0.9
    waits = GraphIndex(degree=16, width=32, shard_rows=150, buffer_threshold=len(near) + 1)
    assert waits.flushed(repaired, gone)[1].count() == len(near)
    waits.buffer_threshold = len(near)
    table, buffer = waits.flushed(repaired, gone)
    assert buffer.count() == 0 and table.count() == 300
    buffered = index.search(repaired, asked, 10, 64, buffer=gone.select("vec_id", "embedding"))
    assert {r["vec_id"] for r in buffered.filter("rank = 1").collect()} == set(range(6))
    moved = index.set_medoid(built, 7)
    assert [r["vec_id"] for r in moved.filter("medoid").join(built.filter("vec_id = 7").select("shard"), "shard").collect()] == [7]
    for quantizer, width in (("int8", 48), ("binary", 200)):
        coded = GraphIndex(degree=16, width=32, shard_rows=150, quantizer=quantizer)
        assert np.mean([len(set(v) & brute(y, y[q], 10)) / 10 for q, v in found(built, coded, width).items()]) >= 0.9
    with pytest.raises(VectorError):
        GraphIndex(quantizer="bit")


def test_tables_touch_only_what_changes(spark, tmp_path):
    t = VecTable.create(spark, f"{tmp_path}/t", "id integer primary key, v float[4], p integer partition key")
    rows = spark.range(400).select("id", F.array(*[(F.col("id") + j).cast("float") for j in range(4)]).alias("v"), (F.col("id") % 4).alias("p"))
    t.insert(rows)
    first = set(t._state()[1])
    t.insert(rows.limit(1).withColumn("id", F.lit(1000)))
    assert first < set(t._state()[1]) and t.df().count() == 401
    before = set(t._state()[1])
    t.update({"v": F.array(*[F.lit(0.0)] * 4).cast("array<float>")}, F.col("id") == 6)
    gone, made = before - set(t._state()[1]), set(t._state()[1]) - before
    assert all("/p=2/" in f for f in gone | made) and gone and made
    state = t._state()
    t.delete(F.col("id") == -5)
    assert t._state() == state  # nothing to do
    t.delete(spark.createDataFrame([(3,), (7,)], "x long"))
    assert t.df().count() == 399 and t.df(1).count() == 0
    # a writer that comes second is told so; an insert tries again
    base, files, index = t._state()
    t.insert(rows.limit(1).withColumn("id", F.lit(2000)))
    with pytest.raises(ChangedByOther):
        t._commit(base, files, index)
    other, calls = VecTable.open(spark, f"{tmp_path}/t"), []
    real = other._state

    def late(version=None):
        got = real(version)
        if not calls:
            calls.append(1)
            t.insert(rows.limit(1).withColumn("id", F.lit(3000)))
        return got

    other._state = late
    other.insert(rows.limit(1).withColumn("id", F.lit(4000)))
    assert {2000, 3000, 4000} <= {r["id"] for r in t.df().collect()}
    t.vacuum()
    assert t.df().count() == 402 and VecTable.open(spark, f"{tmp_path}/t").df().count() == 402
    text = (tmp_path / "t" / "_spec.json").read_text()
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "_spec.json").write_text(text.replace('"format": 2', '"format": 1'))
    with pytest.raises(VectorError, match="format"):
        VecTable.open(spark, f"{tmp_path}/old")


def test_tables_use_their_index(spark, tmp_path):
    g, y = gaussian(spark, 200, 16)
    rows = g.withColumn("n", F.col("vec_id") % 3)
    q = y[5].tolist()
    want = brute(y, y[5], 8)
    make = lambda name, index: VecTable.create(spark, f"{tmp_path}/{name}", f"vec_id integer primary key, n integer, embedding float[16] indexed by {index}")
    t = make("ivf", "ivf(nlist=8, nprobe=8)")
    t.insert(rows)
    assert {r["vec_id"] for r in t.knn().run(q, 8).collect()} == want  # untrained: exact
    with pytest.raises(VectorError):
        t.assign_vectors()
    t.build_index()
    assert {r["vec_id"] for r in t.knn().run(q, 8).collect()} == want
    t.set_nprobe(2)
    plan = t.knn().run(q, 8)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_cell" in plan and len({f.split("_cell=")[1].split("/")[0] for f in t._state()[1]}) == 8
    base, files, index = t._state()
    t._commit(base, files, {})  # a row that comes while there are no centroids waits for its cell
    t.insert(rows.limit(1).withColumn("vec_id", F.lit(500)))
    base, files, _ = t._state()
    t._commit(base, files, index)
    assert any("/_cell=-1/" in f for f in t._state()[1])
    t.assign_vectors()
    assert not any("/_cell=-1/" in f for f in t._state()[1]) and t.df().count() == 201
    t.set_centroid(0, q)
    t.set_nprobe(1)
    assert 5 in {r["vec_id"] for r in t.knn().run(q, 1).collect()}
    t.clear_centroids()
    assert want <= {r["vec_id"] for r in t.knn().run(q, 10).collect()}
    r = make("rescore", "rescore(quantizer=int8, oversample=8)")
    r.insert(rows)
    assert {x["vec_id"] for x in r.knn().run(q, 8, ["n"]).collect()} == want
    asked = g.filter("vec_id = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert {x["vec_id"] for x in r.knn().batch(asked, 8).collect()} == want
    d = make("diskann", "diskann(neighbor_quantizer=int8, n_neighbors=16, search_list_size=64, buffer_threshold=30)")
    d.insert(rows.filter("vec_id < 160"))
    d.build_index()
    d.insert(rows.filter("vec_id >= 160 and vec_id < 180"))
    assert len(d._state()[2]["embedding"]["files"]) < len(d._state()[1])
    alive = np.arange(200) < 180
    assert len({x["vec_id"] for x in d.knn().run(q, 8).collect()} & brute(y, y[5], 8, alive=alive)) >= 7
    odd = d.knn().where(F.col("n") == 1)
    assert len({x["vec_id"] for x in odd.run(q, 8).collect()} & brute(y, y[5], 8, alive=alive & (np.arange(200) % 3 == 1))) >= 7
    d.insert(rows.filter("vec_id >= 180"))  # the buffer is full: it goes into the graph
    assert set(d._state()[2]["embedding"]["files"]) == set(d._state()[1])
    assert len({x["vec_id"] for x in d.knn().run(q, 8).collect()} & want) >= 7
    d.delete(F.col("vec_id") == 5)
    assert 5 not in {x["vec_id"] for x in d.knn().run(q, 8).collect()}


def test_strict_searches(spark, tmp_path):
    t = VecTable.create(spark, f"{tmp_path}/t", "id integer primary key, v float[2], n integer, f float, b boolean, s text, +a text", strict_compat=True)
    t.insert(spark.createDataFrame([(1, [1.0, 0.0], 5, 0.5, True, "x", "y"), (2, [0.0, 1.0], 6, 1.5, False, "z", None)], "id long, v array<float>, n long, f double, b boolean, s string, a string"))
    ok = t.knn().where(F.col("n") >= 5).where(F.col("b") == True).where(F.col("s").isin("x", "z")).where((F.col("f") < 1) | (F.col("n") == 9))  # noqa: E712
    assert [r["id"] for r in ok.run([1.0, 0.0], 2).collect()] == [1]
    for bad in (F.col("a") == "y", F.col("s").like("x%"), F.col("n").isNull(), F.col("f").isin(0.5, 1.5), F.col("b") > False, F.length("s") == 1):
        with pytest.raises(VectorError):
            t.knn().where(bad)
    with pytest.raises(VectorError):
        t.knn().run([1.0, 0.0], 2, order_by="id")
    loose = Knn(t.df(), "v", "id").where(F.col("a") == "y")
    assert [r["id"] for r in loose.run([0.0, 1.0], 2, order_by="id").collect()] == [1]


def test_sql_functions(spark):
    S.register_all(spark)
    value = lambda text: spark.sql(f"SELECT {text}").first()[0]
    good = {
        "vec_f32('[1, 2,,3] tail')": [1.0, 2.0, 3.0], "vec_int8('[-128,127]')": [-128, 127], "vec_bit(X'0F')": b"\x0f", "vec_length(X'0F')": 8, "vec_length(vec_int8('[1,2]'))": 2, "vec_type(X'0F')": "bit",
        "vec_type(vec_int8('[1,2]'))": "int8", "vec_type(vec_f32('[1]'))": "float32", "vec_to_json(X'0580')": "[1,0,1,0,0,0,0,0,0,0,0,0,0,0,0,1]", "vec_to_json(vec_int8('[1,-2]'))": "[1,-2]",
        "vec_to_json(vec_f32('[1,2.5]'))": "[1.000000,2.500000]", "vec_add_int8(vec_int8('[127,-128]'), vec_int8('[1,-1]'))": [-128, 127], "vec_slice_bit(X'0102', 8, 16)": b"\x02",
        "vec_quantize_int8(vec_f32('[-1,0,1]'))": [-128, 0, 126], "vec_quantize_int8(vec_f32('[-1,0,2]'), 'sym127')": [-127, 0, 127], "vec_quantize_binary(vec_f32('[1,-1,1,-1,-1,-1,-1,-1]'))": b"\x05",
        "vec_distance_hamming(X'0F', X'FF')": 4.0, "vec_distance_l2(vec_int8('[1,2]'), vec_int8('[1,5]'))": 3.0, "vec_distance_cosine(vec_f32('[1,0]'), vec_f32('[0,0]'))": None, "vec_type(CAST(NULL AS BINARY))": None,
    }
    for text, want in good.items():
        assert value(text) == want, text
    for text in (
        "vec_f32('[]')", "vec_f32(NULL)", "vec_f32('x')", "vec_f32('[1e400]')", "vec_f32('[NaN]')", "vec_int8('[128]')", "vec_int8('[1.5]')", "vec_bit(X'')", "vec_bit(NULL)", "vec_add(vec_f32('[1,2]'), vec_f32('[1]'))",
        "vec_add_int8(array(1Y), array(1Y, 2Y))", "vec_sub_int8(array(1Y), array(1Y, 2Y))", "vec_distance_hamming(X'0F', X'FFFF')", "vec_distance_l1(array(1f), array(1f, 2f))", "vec_slice(array(1f), 0, 2)",
        "vec_slice(array(1f), 1, 0)", "vec_slice(array(1f), 0, 0)", "vec_slice(array(1f), -1, 1)", "vec_slice_bit(X'0102', 1, 16)", "vec_quantize_binary(array(1f))", "vec_quantize_int8(array(1f), 'x')",
    ):
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
            value(text)
    assert [tuple(r) for r in spark.sql("SELECT * FROM vec_each_bit(X'05', true)").collect()] == [(i, int(i in (5, 7))) for i in range(8)]


def test_windows_of_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:50:00", 2.0), (1, "2024-01-01 02:00:00", 4.0), (2, "2024-01-01 00:20:00", 8.0), (9, "2024-01-03 00:00:00", 0.0)]
    e = spark.createDataFrame(rows, "user_id long, ts string, value double").select("user_id", F.to_timestamp("ts").alias("ts"), F.lit("a").alias("event_type"), "value")
    assert sorted((r["user_id"], r["n"], r["total"]) for r in session_counts(e, "1 hour").collect()) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0), (9, 1, 0.0)]
    sliding = sorted((r["start"].hour * 60 + r["start"].minute, r["n"]) for r in windowed_counts(e, "1 hour", step="30 minutes").filter("start < '2024-01-02' and start >= '2024-01-01'").collect())
    assert sliding == [(0, 3), (30, 1), (90, 1), (120, 1)]
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    session_counts(stream, "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("sessions").count() in (3, 4)  # the last session ends after the watermark


def test_streams(spark, tmp_path):
    t = VecTable.create(spark, f"{tmp_path}/t", "id integer primary key, v float[2]")
    schema = "id long, v array<float>"
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema).write.parquet(f"{tmp_path}/in")
    upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), t, f"{tmp_path}/c1").awaitTermination()
    assert t.df().count() == 2
    spark.createDataFrame([(7, [0.9, 0.0])], "query_id long, query array<float>").write.parquet(f"{tmp_path}/q")
    search_stream(spark.readStream.schema("query_id long, query array<float>").parquet(f"{tmp_path}/q"), t.knn(), 1, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
