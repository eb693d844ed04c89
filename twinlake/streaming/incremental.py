"""Incremental forms over streams: new files once, sessions of events, running duplicate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_files(stream: DataFrame, time: str = "delivered_at", delay: str = "7 days", keys: tuple[str, ...] = ("path", "full_hash")) -> DataFrame:
    """Each file state once, however often it is delivered within ``delay``; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def event_sessions(stream: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """``(key, session_start, session_end, n)``: sessions split where no event comes for ``gap``; late events up to ``delay`` count."""
    out = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def hourly_changes(stream: DataFrame, time: str = "delivered_at", delay: str = "1 day") -> DataFrame:
    """Deliveries and bytes per source and hour, final once the watermark has passed."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), "source_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return out.select(F.col("w.start").alias("hour"), "source_id", "n", "bytes")
