"""Streams of vectors and of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.plans.knn import Knn
from nearfield.sources.table import VecTable


def upsert_stream(stream: DataFrame, table: VecTable, checkpoint: str) -> StreamingQuery:
    """Every micro-batch replaces by key; of several rows with a key in one batch the last by all columns stays.
    A batch that runs twice gives the same table, so the sink is exactly-once."""

    def put(batch: DataFrame, _: int) -> None:
        key = table.spec.key
        rest = [c for c in batch.columns if c != key]
        table.replace(batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest]))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(queries: DataFrame, knn: Knn, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """The k nearest stored rows of every query that arrives; each batch's results go to their own folder."""

    def answer(batch: DataFrame, n: int) -> None:
        knn.batch(batch, k).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", step: str | None = None) -> DataFrame:
    """Counts and sums of events by type and window, tumbling or (with a step) sliding, with a watermark; batch or stream."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", every, step) if step else F.window("ts", every)
    return kept.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Counts and sums of each key's sessions, which end where no event follows within the gap; batch or stream."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap)
    return kept.groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(by, F.col("session_window.start").alias("start"), "n", "total")
