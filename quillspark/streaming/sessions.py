"""Event-time operators on streams; each works on a static frame as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which needs timestamps with a zone; a static frame as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def session_windows(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour", grace: str = "60 seconds") -> DataFrame:
    """M1: sessions of each user; a session ends a minute after its last event."""
    g = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n_events"))
    return g.select("user_id", "start", (F.col("last") + F.expr(f"INTERVAL {grace}")).alias("end"), "n_events")


def daily_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """M10."""
    return _timed(events, late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("value"), F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "value", "n")


def ingested_once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """M2: each event once, however often it arrives."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
