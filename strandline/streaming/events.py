"""Structured Streaming forms: sessions, tumbling counts, deduplication and upserts. Each works on a batch DataFrame as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import upsert


def _late(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A key's events with gaps below ``gap`` are one session."""
    w = F.session_window(time, gap)
    agg = _late(events, time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return agg.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "total")


def tumbling(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window; overlapping ones with ``slide``."""
    agg = _late(events, time, late).groupBy(F.window(time, width, slide or width).alias("w"), by).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("started"), by, "n_events", "total")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One event per key; in a stream within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def upsert_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps one row a key, newer batches in place of older. Each batch writes a new version next to the last, so a repeated batch gives the same table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            last = spark.read.parquet(f"{path}/v{batch_id - 1}") if batch_id else None
        except Exception as e:  # the first batch of a sink that starts later
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        (upsert(last, batch, key) if last is not None else batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write
