"""Inverted-file index: rows are stored by their nearest centroid; a search reads the nearest few cells."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import VectorError
from nearfield.functions import scalar
from nearfield.operators import rescore
from nearfield.plans import kernels
from nearfield.plans.blocks import matrix
from nearfield.plans.kernels import kmeans
from nearfield.plans.knn import _BOUNDS, Knn, check_k

UNASSIGNED = -1
NLIST_MAX = 65536


def _order(centroids: np.ndarray, x: np.ndarray, metric: str, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first (ties: the smaller number)."""
    d = kernels.pairwise(centroids, x, metric)
    return np.argsort(np.where(np.isnan(d), np.inf, d), axis=1, kind="stable")[:, :n].astype("i4")


@dataclass
class IvfIndex:
    """centroids (nlist x dims), and rows with a ``cell`` column; -1 marks rows that no centroid has yet."""

    centroids: np.ndarray
    column: str = "embedding"
    id_col: str = "vec_id"
    metric: str = "l2"
    nprobe: int = 10

    @classmethod
    def train(cls, df: DataFrame, nlist: int = 128, column: str = "embedding", id_col: str = "vec_id", metric: str = "l2", nprobe: int = 10, sample: int = 65536, iterations: int = 25, seed: int = 42) -> IvfIndex:
        """Centroids from the ``sample`` rows with the smallest hashes of their ids: a bounded sample that does
        not depend on partitioning, so that reruns agree."""
        if not 0 < nlist <= NLIST_MAX:
            raise VectorError(f"ivf nlist must be between 1 and {NLIST_MAX}")
        if nprobe > nlist:
            raise VectorError("ivf nprobe must not be above nlist")
        rows = df.filter(F.col(column).isNotNull()).select(id_col, column).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(sample).collect()
        if not rows:
            raise VectorError("no vectors to train on")
        return cls(kmeans(np.array([r[column] for r in rows], "f8"), nlist, iterations, seed), column, id_col, metric, nprobe)

    def assign(self, df: DataFrame) -> DataFrame:
        """df with its ``cell``: the centroid nearest by the metric (ties: the smaller number); NULL vectors get -1.  Other
        columns pass through in Arrow."""
        held, metric = self.centroids, self.metric
        rows = df.drop("cell")
        names, at = [*rows.columns, "cell"], rows.columns.index(self.column)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.full(b.num_rows, UNASSIGNED, "i4")
                some = np.flatnonzero(b.column(at).is_valid().to_numpy(zero_copy_only=False))
                if len(some):
                    x = matrix(b.column(at).take(pa.array(some)))
                    step = max(1, kernels.STEP_BYTES // (8 * len(held)))
                    for i in range(0, len(some), step):
                        cell[some[i : i + step]] = _order(held, x[i : i + step], metric, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names)

        return rows.mapInArrow(cells, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))

    def assign_pending(self, rows: DataFrame) -> DataFrame:
        """Stored rows, of which those that wait (cell -1) get their cell; the others are not measured again."""
        waiting = F.col("cell") == UNASSIGNED
        return rows.filter(~waiting).unionByName(self.assign(rows.filter(waiting)))

    def unassigned(self, df: DataFrame) -> DataFrame:
        """New rows that wait for assign(): searches always read them."""
        return df.withColumn("cell", F.lit(UNASSIGNED))

    def write(self, df: DataFrame, path: str, mode: str = "overwrite") -> None:
        """The rows by cell (a probe then prunes partitions).  One shuffle by ranges of cell and a hash of the id, so that a
        cell of any size, that of untrained rows too, is written by many tasks."""
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, "cell", F.xxhash64(self.id_col)).write.mode(mode).partitionBy("cell").parquet(path)

    def store(self, df: DataFrame, path: str) -> None:
        """write(), with the centroids beside it; open_stored() reads both."""
        self.write(df, f"{path}/rows")
        df.sparkSession.createDataFrame([(self.to_json(),)], "index string").coalesce(1).write.mode("overwrite").text(f"{path}/index")

    @classmethod
    def open_stored(cls, spark: SparkSession, path: str) -> tuple[IvfIndex, DataFrame]:
        return cls.from_json("".join(r[0] for r in spark.read.text(f"{path}/index").collect())), spark.read.parquet(f"{path}/rows")

    def calibrated(self, df: DataFrame, k: int = 10, recall: float = 0.95, queries: int = 256, seed: int = 7) -> IvfIndex:
        """The index with the least nprobe by which a bounded sample of df's own rows (the ``queries`` smallest hashes)
        finds the share ``recall`` of its exact k nearest."""
        rows = df.filter(F.col(self.column).isNotNull()).select(self.id_col, self.column)
        asked = rows.orderBy(F.xxhash64(self.id_col, F.lit(seed)), self.id_col).limit(queries).select(F.col(self.id_col).alias("query_id"), F.col(self.column).alias("query"))
        true = Knn(rows, self.column, self.id_col, "float32", self.metric).batch(asked, k).select("query_id", self.id_col)
        near = true.join(self.assign(rows).select(self.id_col, "cell"), self.id_col).groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
        got = near.join(asked, "query_id").select("query", "cells").collect()  # at most ``queries`` rows
        if not got:
            return self
        order = _order(self.centroids, np.array([r["query"] for r in got], "f8"), self.metric, len(self.centroids))
        rank = np.argsort(order, axis=1)
        need = np.concatenate([rank[i][np.maximum(r["cells"], 0)] * (np.array(r["cells"]) >= 0) for i, r in enumerate(got)]) + 1
        return replace(self, nprobe=int(np.quantile(need, recall, method="inverted_cdf")))

    def probes(self, query: list[float], nprobe: int | None = None) -> list[int]:
        return [*_order(self.centroids, np.array([query], "f8"), self.metric, nprobe or self.nprobe)[0].tolist(), UNASSIGNED]

    def search(self, rows: DataFrame, query: list[float], k: int, nprobe: int | None = None, quantizer: str | None = None, oversample: int = 1, exact_distance: bool = True, predicates: tuple = (), bounds: tuple = ()) -> DataFrame:
        """(id, distance) of the k nearest in the probed cells.  Predicates come first.  With a quantizer the cells
        are scanned by code and k * oversample candidates get exact distances."""
        knn = Knn(rows.filter(F.col("cell").isin(self.probes(query, nprobe))), self.column, self.id_col, "float32", self.metric, predicates, bounds)
        if quantizer and quantizer != "none" and (oversample > 1 or exact_distance):
            return rescore.search(knn, query, k, {"binary": "bit"}.get(quantizer, quantizer), oversample)  # as the table option says
        return knn.run(query, k)

    def batch(self, rows: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None, query_id: str = "query_id", query_col: str = "query", bounds: tuple = ()) -> DataFrame:
        """(query_id, id, distance, rank) of the k nearest in each query's probed cells.  The queries' cells are joined with
        the rows' cells, so that any number of queries is one plan; query ids of any type stay as they are."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_col).alias("query")).filter("query is not null")
        held, metric, n = self.centroids, self.metric, nprobe or self.nprobe

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    order = _order(held, matrix(b.column(1)), metric, n)
                    probed = np.concatenate([order, np.full((len(order), 1), UNASSIGNED, order.dtype)], 1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(probed), pa.list_(pa.int32()))], ["query_id", "query", "cells"])

        asked = asked.mapInArrow(cells, T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])).select("query_id", "query", F.explode("cells").alias("cell"))
        d = scalar.distance(F.col(self.column), F.col("query"), "float32", self.metric)
        near = rows.join(asked, "cell").select("query_id", self.id_col, d.alias("distance")).filter("distance is not null")
        for op, x in bounds:
            near = near.filter(_BOUNDS[op](F.col("distance"), F.lit(float(x))))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", self.id_col))
        return near.withColumn("rank", rank).filter(F.col("rank") <= check_k(k))

    def set_centroid(self, i: int, vector: list[float]) -> None:
        """Rows of the cells concerned must be assigned again, as a trained index's are."""
        self.centroids[i] = vector

    def clear(self, df: DataFrame) -> DataFrame:
        """Untrained again: every row is unassigned and every search exact."""
        return self.unassigned(df)

    def to_json(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "column": self.column, "id_col": self.id_col, "metric": self.metric, "nprobe": self.nprobe})

    @classmethod
    def from_json(cls, text: str) -> IvfIndex:
        held = json.loads(text)
        return cls(**held | {"centroids": np.array(held["centroids"])})
