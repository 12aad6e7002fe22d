"""Coarse search over quantized vectors, then exact distances of the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import VectorError
from nearfield.functions import scalar as S
from nearfield.plans.knn import _BOUNDS, K_MAX, Knn, check_k, literal

OVERSAMPLE_MAX = 128


def build(df: DataFrame, column: str, quantizer: str = "bit", out: str | None = None) -> DataFrame:
    """df with the quantized column; store it, so that the coarse pass reads 1/32 (bit) or 1/4 (int8) of the bytes."""
    if quantizer not in ("bit", "int8"):
        raise VectorError(f"unknown rescore quantizer {quantizer}")
    q = S.vec_quantize_binary(F.col(column), zero_is_one=True) if quantizer == "bit" else S.vec_quantize_int8(F.col(column))
    return df.withColumn(out or f"{column}_{quantizer}", q)


def search(knn: Knn, query: list[float], k: int, quantizer: str = "bit", oversample: int = 8, quantized: str | None = None) -> DataFrame:
    """(id, distance): the min(k * oversample, 4096) nearest by code, then the k nearest of them by the exact
    distance.  Every filter of knn is applied before the coarse pass; distance bounds after the exact one."""
    if not 1 <= oversample <= OVERSAMPLE_MAX:
        raise VectorError(f"rescore oversample must be between 1 and {OVERSAMPLE_MAX}")
    rows, name = knn.filtered(), quantized or f"_{quantizer}"
    if quantized is None:
        rows = build(rows, knn.column, quantizer, name)
    asked = literal(list(query), "float32")
    code = S.vec_quantize_binary(asked, zero_is_one=True) if quantizer == "bit" else S.vec_quantize_int8(asked)
    d = S.distance(F.col(name), code, quantizer, "hamming" if quantizer == "bit" else knn.metric)
    coarse = rows.select(knn.id_col, knn.column, d.alias("_coarse")).filter(F.col("_coarse").isNotNull()).orderBy("_coarse", knn.id_col).limit(min(check_k(k) * oversample, K_MAX))
    return Knn(coarse, knn.column, knn.id_col, knn.elem, knn.metric, bounds=knn.bounds).run(query, k)


def batch(knn: Knn, queries: DataFrame, k: int, quantizer: str = "bit", oversample: int = 8, query_id: str = "query_id", query_col: str = "query", quantized: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank) for a table of queries: the k * oversample nearest by code of each, as a batch search
    over the codes, then the k nearest of them by the exact distance."""
    if not 1 <= oversample <= OVERSAMPLE_MAX:
        raise VectorError(f"rescore oversample must be between 1 and {OVERSAMPLE_MAX}")
    rows, asked = knn.filtered(), queries.select(F.col(query_id).alias("query_id"), F.col(query_col).alias("query")).filter("query is not null")
    elem, metric = ("bit", "hamming") if quantizer == "bit" else ("int8", knn.metric)
    rows, name = rows.filter(F.col(knn.column).isNotNull()), quantized or "_code"
    coarse = Knn(rows if quantized else build(rows, knn.column, quantizer, name), name, knn.id_col, elem, metric).batch(build(asked, "query", quantizer, "_code"), min(check_k(k) * oversample, K_MAX), "query_id", "_code")
    d = S.distance(F.col(knn.column), F.col("query"), knn.elem, knn.metric)
    near = coarse.select("query_id", knn.id_col).join(asked, "query_id").join(rows.select(knn.id_col, knn.column), knn.id_col)
    pairs = near.select("query_id", knn.id_col, d.alias("distance")).filter("distance is not null")
    for op, x in knn.bounds:
        pairs = pairs.filter(_BOUNDS[op](F.col("distance"), F.lit(float(x))))
    return knn._ranked(pairs, k)
