"""Keyword and vector results combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyword_score(text: Column, words: list[str]) -> Column:
    """How often the words occur in the lower-cased text, as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0)
    for w in words:
        score = score + ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return score


def keyword_top(docs: DataFrame, words: list[str], k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, rank) of the k documents with the highest score above 0."""
    hits = docs.select(id_col, keyword_score(F.col(text_col), words).alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col).limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # k rows


def rrf(keyword: DataFrame, vector: DataFrame, id_col: str = "id", constant: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank)."""
    a = keyword.select(id_col, F.col("rank").alias("kw_rank"))
    b = vector.select(id_col, F.col("rank").alias("vec_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return a.join(b, id_col, "full").withColumn("rrf", part("kw_rank", weights[0]) + part("vec_rank", weights[1]))


def keyword_first(keyword: DataFrame, vector: DataFrame, id_col: str = "id") -> DataFrame:
    """Keyword matches, then vector matches, without removing doubles."""
    a = keyword.select(id_col, "rank", F.lit("fts").alias("match_type"))
    return a.unionByName(vector.select(id_col, "rank", F.lit("vec").alias("match_type")))


def semantic_rerank(keyword: DataFrame, scored: DataFrame, id_col: str = "id") -> DataFrame:
    """Keyword matches in the order of their distance."""
    return scored.join(F.broadcast(keyword.select(id_col)), id_col).select(id_col, "distance").orderBy("distance", id_col)
