"""A stream of library changes, kept as the latest state of each path. An extra: nothing of the kind is asked for by batch users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, *, window: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Events by window and key; those later than ``delay`` are dropped. Works on streams and on tables; null times drop out."""
    source = events.where(F.col(time).isNotNull())
    late = source.withWatermark(time, delay) if events.isStreaming else source
    return late.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def feed_into(changes: DataFrame, apply, checkpoint: str):
    """Run ``apply(batch, batch_id)`` on each micro-batch of ``path, sha256`` rows, of each path the last; started with what has come so far."""

    def each(batch: DataFrame, number: int) -> None:
        apply(batch.groupBy("path").agg(F.max_by("sha256", "at").alias("sha256")), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
