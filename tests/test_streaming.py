"""Streams against their batch results."""

import datetime
import random

import pytest

from quillspark.streaming import feed, keyed

SCHEMA = "id long, updated_at long, v string, reach double"


def values(table):
    return {x["id"]: (x["updated_at"] or 0, x["v"], x["reach"]) for x in table.collect()}


def test_change_feed_keeps_the_latest_rows_and_largest_registers(spark, tmp_path):
    """Late, repeated and unclocked changes over ten micro-batches; a batch that is run again changes nothing."""
    r = random.Random(4)
    rows = [(r.randrange(20), r.choice([None, *range(9)]), f"v{r.randrange(5)}", r.random()) for _ in range(400)]
    for i in range(10):
        spark.createDataFrame(rows[i * 40 : i * 40 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = feed.Table(spark, str(tmp_path / "out"), "id", "updated_at", ("reach",), buckets=8)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = table.writer(stream).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, before = values(table.read()), table.manifest()
    assert before["applied"] == {"feed": q.lastProgress["batchId"]} and q.lastProgress["batchId"] >= 9
    for i in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == i]
        clock = max(x[1] or 0 for x in own)
        assert got[i][0] == clock and got[i][2] == max(x[3] for x in own) and got[i][1] in {x[2] for x in own if (x[1] or 0) == clock}
    assert values(feed.merged(None, spark.createDataFrame(rows, SCHEMA), "id", "updated_at", ("reach",))) == got
    table.apply(spark.createDataFrame([(1, 99, "again", 2.0)], SCHEMA), batch=before["applied"]["feed"])
    assert table.manifest() == before


def test_a_commit_rewrites_its_buckets_only(spark, tmp_path):
    table = feed.Table(spark, str(tmp_path / "t"), "id", "updated_at", ("reach",), buckets=8)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.apply(spark.createDataFrame([(i, 1, "a", 0.5) for i in range(50)], SCHEMA))
    first = table.manifest()["files"]
    table.apply(spark.createDataFrame([(7, 2, "b", 0.1)], SCHEMA))
    second = table.manifest()["files"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert values(table.read())[7] == (2, "b", 0.5) and table.read().count() == 50
    # the files of the version before last go, those of the last two and what they share stay
    for n in range(3, 8):
        table.apply(spark.createDataFrame([(7, n, "c", 0.2)], SCHEMA))
    names = sorted(p.name.split("-")[0] + "-" + p.name.split("-")[1] for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert names == ["change-0", "change-5", "change-6", "manifest-5.json", "manifest-6.json"]
    assert len([p for p in (tmp_path / "t").glob("change-0-*/bucket=*")]) == 7
    table.apply(spark.createDataFrame([], SCHEMA))
    assert values(table.read())[7] == (7, "c", 0.5) and table.read().count() == 50


def test_dirty_rows_stay_until_they_are_sent(spark, tmp_path):
    schema = SCHEMA + ", dirty boolean"
    table = feed.Table(spark, str(tmp_path / "t"), "id", "updated_at", ("reach",), buckets=4)
    table.apply(spark.createDataFrame([(1, 5, "a", 0.5, False), (2, 5, "a", 0.5, False)], schema))
    table.edit(spark.createDataFrame([(1, 6, "mine", 0.4), (3, 6, "new", 0.4)], SCHEMA))
    table.apply(spark.createDataFrame([(1, 9, "theirs", 0.9, False), (2, 9, "theirs", 0.1, False), (3, 9, "theirs", 0.1, False)], schema))
    assert values(table.read()) == {1: (6, "mine", 0.4), 2: (9, "theirs", 0.5), 3: (6, "new", 0.4)}
    table.edit(spark.createDataFrame([(1, 20, "mine", 0.9)], SCHEMA), dirty=False)
    table.apply(spark.createDataFrame([(1, 21, "later", 0.1, False)], schema))
    assert values(table.read())[1] == (21, "later", 0.9)


def drained(spark, op, frame, tmp_path, name, files=5):
    """All rows of op on a stream of frame's rows in files, closed by a marker that moves the watermark on."""
    spark.conf.set(*keyed.STORE)
    parts = frame.randomSplit([1.0] * files, 3)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
    key, *rest = frame.columns
    end = spark.createDataFrame([(-1, *(None if c != "ts" else datetime.datetime(2100, 1, 1) for c in rest))], frame.schema)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in"))
    q = op(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_sessions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    r = random.Random(1)
    start = datetime.datetime(2024, 1, 5)
    rows = [(r.randrange(4), start + datetime.timedelta(seconds=r.choice([r.randrange(20_000), 600 * r.randrange(30)])), r.random() < 0.2) for _ in range(300)]
    rows += [(9, start, False), (8, start, True), (7, start, False), (7, start + datetime.timedelta(seconds=3), True), (6, start, False), (6, start, True), (5, start, None)]
    events = spark.createDataFrame(rows, "item_id long, ts timestamp, hidden boolean")
    want = set()
    for item in {x[0] for x in rows}:
        first = last = None
        own = sorted((int(x[1].replace(tzinfo=datetime.UTC).timestamp() * 1000), bool(x[2])) for x in rows if x[0] == item)
        for now, hidden in [*own, (10**14, True)]:
            if last is not None and (hidden or now - last > keyed.IDLE):
                end = min(last + keyed.GRACE, now)
                want |= {(item, first, end)} if end - first >= keyed.SHORTEST else set()
                first = last = None
            if not hidden:
                first, last = first if first is not None else now, now
    assert set(map(tuple, keyed.reading_sessions(events).collect())) == want and len(want) > 60
    assert sorted(map(tuple, drained(spark, keyed.reading_sessions, events, tmp_path, "s").collect())) == sorted(want)


def test_cached_entries_vanish(spark, tmp_path):
    r = random.Random(2)
    start = datetime.datetime(2024, 1, 5)
    rows = [(r.randrange(5), start + datetime.timedelta(days=r.randrange(200)), r.choice([None, None, f"v{r.randrange(9)}"])) for _ in range(200)]
    requests = spark.createDataFrame(list({(k, t): (k, t, v) for k, t, v in rows}.values()), "key long, ts timestamp, value string")
    want = set()
    for k, t, v in requests.collect():
        if v is None:
            puts = [(t2, v2) for k2, t2, v2 in requests.collect() if k2 == k and v2 is not None and t2 < t]
            best = max(puts, default=None)
            ms = int(t.replace(tzinfo=datetime.UTC).timestamp() * 1000)
            want.add((k, ms, best[1] if best and t - best[0] <= datetime.timedelta(days=30) else None))
    assert set(map(tuple, keyed.cached(requests).collect())) == want and any(x[2] for x in want) and any(x[2] is None for x in want)
    got = drained(spark, lambda s: keyed.cached(s, late="300 days"), requests, tmp_path, "k").filter("key >= 0").collect()
    assert set(map(tuple, got)) == want


def test_waiting_events_are_read_once_their_time_has_come(spark):
    """New events are put behind those that wait, which aren't read or written again, and a key has one timer."""
    from pyspark.sql import Row

    class Kept:
        def __init__(self):
            self.rows, self.reads = [], 0

        def get(self):
            self.reads += 1
            return iter(list(self.rows))

        def appendList(self, new):
            self.rows += new

        def put(self, new):
            raise AssertionError("written again")

    class Timers(set):
        listTimers, registerTimer, deleteTimer = (lambda self: iter(set(self))), set.add, set.remove

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    p = keyed.Sessions()
    p.waiting, p.handle = Kept(), Timers()
    for batch in ((50, 30), (40,), (20, 60)):
        assert list(p.handleInputRows((1,), iter([Row(ms=t, hidden=False) for t in batch]), Now)) == []
    assert sorted(p.waiting.rows) == [(t, False) for t in (20, 30, 40, 50, 60)] and p.waiting.reads == 0 and set(p.handle) == {20}
