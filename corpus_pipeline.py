"""A corpus pipeline of five stages over ``documents``.

Each stage takes what the one before kept.  Quality rules drop texts; of near duplicates the smallest id stays; texts
with a benchmark passage go; secrets are replaced by a mark (n_chars is counted again); the last stage says how many
words of each document the mix takes, and leaves out documents that it does not take.

Edge cases, in every stage: NULL and empty texts are rejected by the first (under 50 words) and pass the others as they
are, but for the mix, which takes nothing of them; texts are read whole, whatever their length; rows that repeat or share
an id are rows of their own, and of copies one row stays, by row and not by id; NULL languages and sources are groups of
their own; an empty table gives an empty table of the same columns; further columns travel along, whatever their names,
but for the mix, which returns its own columns beside the id, text, lang and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, jaccard, mixing, quality, secrets
from nearfield.llm.common import made, release, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, length_col="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=["text", "lang", "n_chars"]).filter("taken > 0")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", benchmark_decontamination), ("secrets", secret_scan), ("mix", source_mix)]
#: SQL can express neither the concentration steps nor the components; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Every stage's result is written to the shared folder and read again; what a stage has read
    and written besides is deleted then, so that two copies of the corpus are the most on disk."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(made(spark))
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
        release(spark, [x for x in made(spark)[:-1] if x not in before])  # all of this run but the stage's result
    return docs
