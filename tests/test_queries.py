import duckdb
import pytest

from nearfield.operators.ivf import IvfIndex
from nearfield.queries import ORACLE, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, ORACLE[name])


def test_recall_queries(spark, sf):
    for name, least in (("ivf_trained_recall", 0.9), ("graph_recall", 0.9)):
        rows = QUERIES[name](spark, sf).collect()
        assert sum(r["recall"] for r in rows) / len(rows) >= least, name


@pytest.mark.parametrize("name", ["ivf_trained_recall", "graph_recall"])
def test_recall_queries_ask_every_fiftieth_row(name, spark, sf):
    asked = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in QUERIES[name](spark, sf).collect()} == asked


def test_ivf_batch_finds_what_single_searches_find(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    ivf = IvfIndex.train(e, 16, nprobe=6)
    cells = ivf.assign(e).cache()
    asked = e.filter("vec_id in (0, 50, 333)").selectExpr("vec_id as query_id", "embedding as query")
    got = {(r["query_id"], r["vec_id"]) for r in ivf.batch(cells, asked, 10).collect()}
    assert got == {(q["query_id"], r["vec_id"]) for q in asked.collect() for r in ivf.search(cells, q["query"], 10).collect()}


def test_ivf_takes_the_name_binary(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    ivf = IvfIndex.train(e, 4, nprobe=4)
    q = e.filter("vec_id = 0").first()["embedding"]
    one = lambda kind: [tuple(r) for r in ivf.search(ivf.assign(e), q, 10, quantizer=kind, oversample=8).collect()]
    assert one("binary") == one("bit") and len(one("bit")) == 10
    assert one("none") == one(None)


#: Odd multiples of 1/128 lie halfway between six decimals; beyond 2**53 a double's shortest digits are not all of them.
_HALVES = [s * (2 * i + 1) / 128.0 for i in (0, 1, 2, 3, 64, 4095, 1 << 20) for s in (1, -1)]
_LARGE = [2.0**53, -(2.0**60), 2.0**63, 1e20, -(2.0**66), 3.4028234663852886e38, -3e38, 1e38]
_SMALL = [0.0, -0.0, -1e-9, 1e-45, 5e-7, 0.1]


@pytest.mark.parametrize("name", ["vec_to_json", "sql_to_json", "vec_f32_json", "sql_from_json"])
def test_json_rounds_as_the_sql(name, spark, tmp_path):
    values = _HALVES + _LARGE + _SMALL
    vectors = [(i, [values[(i + j) % len(values)] for j in range(64)]) for i in range(len(values))]
    if name == "vec_to_json":  # what has no digits cannot be read again
        vectors += [(100, [float("nan"), float("inf"), float("-inf"), 1.5]), (101, [0.25, None, 1.0]), (102, [None, None]), (103, []), (104, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert_same(QUERIES[name](spark, str(tmp_path)), duck, ORACLE[name])
