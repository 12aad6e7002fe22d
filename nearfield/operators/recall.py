"""Recall of an approximate result against the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, id_col: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, recall): the share of the true neighbours that were found."""
    hit = found.select(query_id, id_col).distinct().withColumn("_hit", F.lit(1))
    return truth.select(query_id, id_col).join(hit, [query_id, id_col], "left").groupBy(query_id).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def missed(found: DataFrame, truth: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return truth.select(id_col).exceptAll(found.select(id_col))


def vec_mean(df: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """(by, pos, value): mean vector of each group, element by element; partial sums before the shuffle."""
    return df.select(by, F.posexplode(column).alias("pos", "_x")).groupBy(by, "pos").agg(F.avg(F.col("_x").cast("double")).alias("value"))
