"""Reading statistics: totals, timelines, streaks, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIX_HOURS, FIVE_SECONDS, MINUTE = 21_600_000, 5_000, 60_000


def recorded(sessions: DataFrame) -> DataFrame:
    """Sessions last six hours at most; those under five seconds don't count."""
    return sessions.filter(F.col("raw") >= FIVE_SECONDS).select("id", "item_id", "started_at", F.least("raw", F.lit(SIX_HOURS)).alias("duration"))


def depth() -> Column:
    """How far an item was read, from 0 to 1."""
    return F.least(F.coalesce("max_scroll", "scroll", F.lit(0.0)), F.lit(1.0))


def finished() -> Column:
    """B4."""
    return F.coalesce(F.col("scroll") >= 1, F.lit(False)) | F.coalesce(F.col("status") == "finished", F.lit(False))


def shown_status() -> Column:
    """B2: the status set by the reader, else by position."""
    pos = F.coalesce("scroll", F.lit(0.0))
    return F.coalesce("status", F.when(pos <= 0, "unread").when(pos >= 1, "finished").otherwise("reading"))


def taste_status() -> Column:
    """As shown_status, by the deepest position."""
    pos = F.least(F.lit(1.0), F.greatest(F.coalesce("max_scroll", F.lit(0.0)), F.coalesce("scroll", F.lit(0.0))))
    return F.coalesce("status", F.when(pos <= 0, "unread").when(pos >= 1, "finished").otherwise("reading"))


def per_item(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("item_id").agg(F.sum("duration").alias("total_ms"), F.count("*").alias("n_sessions"))


def by_item(items: DataFrame, progress: DataFrame, sessions: DataFrame) -> DataFrame:
    """Time, sessions and words per minute of each item that was read."""
    p = progress.withColumnRenamed("item_id", "id")
    s = per_item(sessions).withColumnRenamed("item_id", "id")
    joined = items.select("id", "title", "word_count").join(s, "id").join(p, "id", "left")
    minutes = F.col("total_ms") / MINUTE
    wpm = F.when((F.col("word_count") > 0) & (F.col("total_ms") >= MINUTE) & (depth() > 0), F.round(F.col("word_count") * depth() / minutes, 1))
    return joined.select("id", "title", "total_ms", "n_sessions", wpm.alias("wpm"))


def words_read(items: DataFrame, progress: DataFrame) -> DataFrame:
    """D4."""
    p = progress.withColumnRenamed("item_id", "id")
    return items.select("id", "word_count").join(p, "id").agg(F.coalesce(F.sum((F.col("word_count") * depth()).cast("long")), F.lit(0).cast("long")).alias("words_read"))


def day_of(ms: str, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), tz))


def timeline(sessions: DataFrame, tz: str = "UTC") -> DataFrame:
    """D5."""
    return sessions.groupBy(day_of("started_at", tz).alias("day")).agg(F.sum("duration").alias("total_ms"))


def filled(days: DataFrame, as_of: str, n: int) -> DataFrame:
    """The n days up to as_of, with 0 where nothing was read, and a heat level."""
    end = F.lit(as_of).cast("date")
    every = days.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("day"))
    m = F.col("total_ms") / MINUTE
    level = F.when(m <= 0, 0).when(m < 15, 1).when(m < 30, 2).when(m < 60, 3).otherwise(4)
    return every.join(days, "day", "left").select("day", F.coalesce("total_ms", F.lit(0)).alias("total_ms")).withColumn("level", level)


def streaks(sessions: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """E1, E2 for each item: the longest run of days, and the one that ends at as_of or the day before."""
    days = sessions.select("item_id", day_of("started_at", tz).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("item_id").orderBy("day")))
    runs = days.withColumn("g", island).groupBy("item_id", "g").agg(F.count("*").alias("n"), F.max("day").alias("end"))
    current = F.max(F.when(F.col("end").between(F.date_sub(F.lit(as_of).cast("date"), 1), F.lit(as_of).cast("date")), F.col("n")))
    return runs.groupBy("item_id").agg(F.max("n").alias("longest"), F.coalesce(current, F.lit(0).cast("long")).alias("current"))


def segments(moments: DataFrame, gap_ms: int = 600_000, grace_ms: int = 60_000) -> DataFrame:
    """Activity of a user is cut where it rests longer than gap_ms; a segment ends grace_ms after its last event."""
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    cut = F.when(F.col("ms") - F.lag("ms").over(w) > gap_ms, 1).otherwise(0)
    g = moments.select("user_id", "ms", "event_id").withColumn("cut", cut).withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = g.groupBy("user_id", "segment").agg(F.min("ms").alias("start"), (F.max("ms") + grace_ms).alias("end"), F.count("*").alias("n_events"))
    return out.filter(F.col("end") - F.col("start") >= FIVE_SECONDS)


def totals(sessions: DataFrame, progress: DataFrame) -> DataFrame:
    """D1 to D3 in one row."""
    a = sessions.agg(F.coalesce(F.sum("duration"), F.lit(0).cast("long")).alias("total_ms"), F.count_distinct("item_id").alias("items_started"))
    return a.crossJoin(progress.agg(F.count_if(finished()).alias("items_finished")))


def dashboard(items: DataFrame, progress: DataFrame, sessions: DataFrame) -> DataFrame:
    """Totals, words read, days with reading, and the most read item, in one row."""
    days = timeline(sessions).agg(F.count("*").alias("days_read"), F.max("total_ms").alias("best_day_ms"))
    top = per_item(sessions).agg(F.max(F.struct("total_ms", -F.col("item_id"))).alias("t")).select((-F.col("t")["col2"]).alias("top_item"))
    return totals(sessions, progress).crossJoin(words_read(items, progress)).crossJoin(days).crossJoin(top)


def period_start(ms: str, period: str) -> Column:
    """H26; weeks begin on Monday."""
    return F.to_date(F.date_trunc({"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}[period], F.timestamp_millis(ms)))
