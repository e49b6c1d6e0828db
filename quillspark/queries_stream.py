"""Queries that run streams over files of the given tables, and give what their batch SQL gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import binding as B
from .registry import query
from .streaming import feed, keyed
from .tables import shared_dir

#: Key and moment of the row that moves the watermark of a stream past its last event.
LAST_KEY, LAST_MS = -1, 4_102_444_800_000


#: Files of a micro-batch, which as many tasks write and read.
FILES = 16


def _files(frame: DataFrame, batches: int, end: DataFrame | None = None) -> DataFrame:
    """A stream of frame's rows in so many micro-batches, from files of the shared folder; the row of end comes last."""
    s, at = frame.sparkSession, f"{shared_dir(frame.sparkSession)}/stream-{uuid.uuid4().hex}"
    frame.repartition(batches * FILES, F.xxhash64(*frame.columns)).write.parquet(at)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(at)
    return s.readStream.schema(frame.schema).option("maxFilesPerTrigger", FILES).parquet(at)


def _collected(stream: DataFrame) -> DataFrame:
    """The rows that a stream has put out when it has read all that is there."""
    s, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/streamed-{uuid.uuid4().hex}"
    before = s.conf.get(keyed.STORE[0], None)
    s.conf.set(*keyed.STORE)
    try:
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            s.conf.unset(keyed.STORE[0])
        else:
            s.conf.set(keyed.STORE[0], before)
    return s.read.schema(stream.schema).parquet(f"{at}/rows")


@query("""SELECT user_id AS id, max(reach) AS reach, arg_max(struct_pack(v := event_type, c := coalesce(clock, 0)), (coalesce(clock, 0), '["' || event_type || '","' || reach || '"]')).v AS v, max(coalesce(clock, 0)) AS clock
FROM (SELECT *, CASE WHEN event_id % 9 > 0 THEN event_id % 50 END AS clock, cast(floor(value * 100) AS BIGINT) AS reach FROM events) GROUP BY 1""", views=False)
def m3_m4_bucketed_feed(s, d):
    """A feed with late, unclocked and repeated changes over micro-batches, kept as a table of buckets."""
    e = F.col("event_id")
    rows = B.table(s, d, "events").select(F.col("user_id").alias("id"), F.when(e % 9 > 0, e % 50).alias("clock"), F.col("event_type").alias("v"), F.floor(F.col("value") * 100).cast("long").alias("reach"))
    at = f"{shared_dir(s)}/feed-{uuid.uuid4().hex}"
    table = feed.Table(s, f"{at}/table", "id", "clock", ("reach",), buckets=16)
    table.writer(_files(rows, 4)).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("id", "reach", "v", F.coalesce("clock", F.lit(0)).alias("clock"))


@query("""WITH e AS (SELECT user_id AS item_id, 1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // 60 AS ms, event_type = 'error' AS hidden FROM events),
o AS (SELECT *, lag(hidden) OVER w AS ph, max(CASE WHEN NOT hidden THEN ms END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
  min(CASE WHEN hidden THEN ms END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM e WINDOW w AS (PARTITION BY item_id ORDER BY ms, hidden)),
n AS (SELECT *, sum(CASE WHEN coalesce(ph, true) OR ms - last > 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ms) AS k FROM o WHERE NOT hidden)
SELECT * FROM (SELECT item_id, min(ms) AS started_at, least(max(ms) + 60000, list(until ORDER BY ms)[-1]) AS ended_at FROM n GROUP BY item_id, k) WHERE ended_at - started_at >= 5000""", views=False)
def m1_reading_sessions(s, d):
    """Reading sessions from a stream with keyed state and timers."""
    rows = B.moments(s, d).select(F.col("user_id").alias("item_id"), F.timestamp_millis(F.lit(B.SAVED) + F.floor((F.col("ms") - B.SAVED) / 60)).alias("ts"), (F.col("event_type") == "error").alias("hidden"))
    end = s.range(1).select(F.lit(LAST_KEY).cast("long").alias("item_id"), F.timestamp_millis(F.lit(LAST_MS)).alias("ts"), F.lit(False).alias("hidden"))
    return _collected(keyed.reading_sessions(_files(rows, 4, end))).filter(F.col("item_id") != LAST_KEY)


@query("""WITH r AS (SELECT user_id % 40 AS key, 1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) * 40 AS ms, max(CASE WHEN event_id % 3 = 0 THEN event_type END) AS value FROM events GROUP BY 1, 2),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN struct_pack(ms := ms, value := value) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM r)
SELECT key, ms, CASE WHEN stored.ms >= ms - 2592000000 THEN stored.value END AS value FROM b WHERE value IS NULL""", views=False)
def m9_cached_entries(s, d):
    """Lookups in a cache whose entries leave the state of a stream after 30 days."""
    rows = B.moments(s, d).groupBy((F.col("user_id") % 40).alias("key"), (F.lit(B.SAVED) + (F.col("ms") - B.SAVED) * 40).alias("ms")).agg(F.max(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("value"))
    end = s.range(1).select(F.lit(LAST_KEY).cast("long").alias("key"), F.timestamp_millis(F.lit(LAST_MS)).alias("ts"), F.lit(None).cast("string").alias("value"))
    stream = _files(rows.select("key", F.timestamp_millis("ms").alias("ts"), "value"), 4, end)
    return _collected(keyed.cached(stream, late="2000 days")).filter(F.col("key") != LAST_KEY)
