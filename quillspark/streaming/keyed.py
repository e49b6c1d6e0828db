"""Operators with state for each key and event-time timers, on streams; each has a batch form with the same rows.

Events of a key may arrive in any order within the watermark's delay: they wait in the state until the watermark has passed
them and are then taken in order, so that a stream gives what the batch form gives on all its events. A timer wakes a key
whose state comes to its end without a further event.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed values, in ms: an idle time that ends a session, how long a session goes on after its last event, the shortest one that counts.
IDLE, GRACE, SHORTEST = 600_000, 60_000, 5_000
#: Fixed value, in ms: how long a cached entry counts.
RETENTION = 30 * 86_400_000
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Takes the events of a key in order. Subclasses say what an event (a tuple that starts with its time in ms) and the passing of
    time do to the state (a tuple, or None)."""

    columns: tuple[str, ...]
    out: tuple[str, ...]
    waiting_schema: str
    state_schema: str

    def step(self, key: tuple, state: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def passed(self, key: tuple, state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """New events join those that wait, which aren't read here; a timer of the earliest one wakes the key when the watermark has passed it."""
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendList(new)
        due, timers = max(min(e[0] for e in new), timerValues.getCurrentWatermarkInMs() + 1), list(self.handle.listTimers())
        if not timers or due < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advanced(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _rows(self, found: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(self.out, r, strict=True))) for r in found)

    def _advanced(self, key: tuple, watermark: int) -> Iterator[Row]:
        held = sorted(map(tuple, self.waiting.get()), key=lambda e: tuple((x is not None, x) for x in e))
        state = tuple(self.state.get()) if self.state.exists() else None
        ready = [e for e in held if e[0] <= watermark]
        for event in ready:
            state, out = self.step(key, state, event)
            yield from self._rows(out)
        if state is not None and self.deadline(state) < watermark:
            state, out = self.passed(key, state, watermark)
            yield from self._rows(out)
        held = held[len(ready) :]
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [*(e[0] for e in held[:1]), *([self.deadline(state)] if state is not None else [])]
        if due:
            self.handle.registerTimer(max(min(due), watermark + 1))


class Sessions(InOrder):
    """The state is (first, last) of the open session."""

    out = ("item_id", "started_at", "ended_at")
    columns, waiting_schema, state_schema = ("ms", "hidden"), "ms long, hidden boolean", "first long, last long"

    @staticmethod
    def _closed(key: tuple, state: tuple | None, now: int) -> list[tuple]:
        if state is None:
            return []
        first, last = state
        end = min(last + GRACE, now)
        return [(key[0], first, end)] if end - first >= SHORTEST else []

    def step(self, key, state, event):
        now, hidden = event
        if hidden:
            return None, self._closed(key, state, now)
        if state is not None and now - state[1] > IDLE:
            return (now, now), self._closed(key, state, now)
        return ((state or (now,))[0], now), []

    def passed(self, key, state, now):
        return None, self._closed(key, state, now)

    def deadline(self, state):
        return state[1] + IDLE


def reading_sessions(events: DataFrame, item: str = "item_id", hidden: str = "hidden", late: str = "1 day") -> DataFrame:
    """M1: item, started_at, ended_at (ms) of each session. An event with hidden ends the session of its item there; otherwise a session ends
    a minute after its last event, when ten minutes have passed without one. Sessions under five seconds don't count.

    events: item, ts, hidden. A stream needs the state store STORE; a session shows once the watermark has passed its end.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = events.select(F.col(item).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), ms.alias("ms"), F.coalesce(hidden, F.lit(False)).alias("hidden"))
    if events.isStreaming:
        keyed = rows.withWatermark("ts", late).groupBy("item_id")
        return keyed.transformWithState(Sessions(), f"item_id {dict(rows.dtypes)['item_id']}, started_at long, ended_at long", "append", "eventTime")
    own = Window.partitionBy("item_id").orderBy("ms", "hidden")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    last = F.max(F.when(~F.col("hidden"), F.col("ms"))).over(before)
    cut = F.coalesce(F.lag("hidden").over(own), F.lit(True)) | (F.col("ms") - last > IDLE)
    marked = rows.withColumns({"cut": cut & ~F.col("hidden"), "until": F.min(F.when(F.col("hidden"), F.col("ms"))).over(after)}).filter("NOT hidden")
    numbered = marked.withColumn("n", F.sum(F.col("cut").cast("long")).over(Window.partitionBy("item_id").orderBy("ms").rangeBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("item_id", "n").agg(F.min("ms").alias("started_at"), F.least(F.max("ms") + GRACE, F.max_by("until", "ms")).alias("ended_at"))
    return found.filter(F.col("ended_at") - F.col("started_at") >= SHORTEST).select("item_id", "started_at", "ended_at")


class Cache(InOrder):
    """The state is (stored_at, value) of the entry."""

    out = ("key", "ms", "value")
    columns, waiting_schema, state_schema = ("ms", "value"), "ms long, value string", "stored_at long, value string"

    def __init__(self, retention: int):
        self.retention = retention

    def step(self, key, state, event):
        now, value = event
        if value is not None:
            return (now, value), []
        alive = state is not None and state[0] >= now - self.retention
        return state, [(key[0], now, state[1] if alive else None)]

    def passed(self, key, state, now):
        return None, []

    def deadline(self, state):
        return state[0] + self.retention


def cached(requests: DataFrame, key: str = "key", late: str = "1 hour", retention: int = RETENTION) -> DataFrame:
    """M9: key, ms, value of each lookup: the value stored last for its key, null if there is none or it was stored longer ago than retention.

    requests: key, ts, value (a string to store, or null to look up; of one moment, lookups come first). On a stream (with the state store
    STORE), entries leave the state when their time is up, whether or not anyone asks.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = requests.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), ms.alias("ms"), F.col("value").cast("string").alias("value"))
    if requests.isStreaming:
        keyed = rows.withWatermark("ts", late).groupBy("key")
        return keyed.transformWithState(Cache(retention), f"key {dict(rows.dtypes)['key']}, ms long, value string", "append", "eventTime")
    before = Window.partitionBy("key").orderBy("ms", F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, -1)
    stored = F.last(F.when(F.col("value").isNotNull(), F.struct("ms", "value")), ignorenulls=True).over(before)
    alive: Column = F.col("stored")["ms"] >= F.col("ms") - retention
    return rows.withColumn("stored", stored).filter("value IS NULL").select("key", "ms", F.when(alive, F.col("stored")["value"]).alias("value"))
