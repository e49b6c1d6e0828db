"""Every registered query of the library against its DuckDB SQL at the smallest scale."""

import math
import random

import duckdb
import pytest

from quillspark.operators import vectors
from quillspark.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.5f}"
    if isinstance(x, list):
        return str([plain(y) for y in x])
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    result = duck.sql(ORACLES[name])
    assert names == sorted(result.columns)
    want = sorted(tuple(plain(r[result.columns.index(c)]) for c in names) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want


def test_diversified_places_are_whole(spark):
    rows = QUERIES["j11_diversified"](spark, DATA).collect()
    assert {(r["label"], r["place"]) for r in rows} == {(g, p) for g in {r["label"] for r in rows} for p in range(1, sum(r["label"] == g for r in rows) + 1)}


def test_diversified_sees_all_rows(spark):
    """A group led by 250 near copies, and a small one, against picks over all rows."""
    r = random.Random(3)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    rows = [(0, i, 0.9 + i % 50 / 1000, unit([1.0, r.random() / 100, 0.0, 0.0])) for i in range(250)]
    rows += [(0, 300 + i, 0.7 + i / 1000, unit([r.gauss(0, 1) for _ in range(4)])) for i in range(30)]
    rows += [(None, 400 + i, 0.5, unit([r.gauss(0, 1) for _ in range(4)])) for i in range(3)] + [(2, 500, 0.1, [1.0, 0.0, 0.0, 0.0])]
    want = set()
    for g in (0, None, 2):
        left, near, place = [x for x in rows if x[0] == g], {}, 0
        while left and place < 5:
            best = max(left, key=lambda x: (0.7 * x[2] - 0.3 * near.get(x[1], 0.0), x[2], -x[1]))
            left.remove(best)
            near = {x[1]: max(near.get(x[1], 0.0), sum(a * b for a, b in zip(x[3], best[3], strict=True))) for x in left}
            place += 1
            want.add((g, best[1], place))
    df = spark.createDataFrame(rows, "label int, id long, score double, v array<double>").repartition(3)
    assert set(map(tuple, vectors.diversified(df, "label", 5).collect())) == want
    assert sum(g == 0 and i >= 300 for g, i, _ in want) > 1


def test_streamed_sessions_match_batch(spark, tmp_path):
    from quillspark.streaming import sessions

    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = sessions.ingested_once(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == sessions.ingested_once(events).count()


def _replaced_table(tmp_path, name, select):
    """A folder of the tables in which select, over v, replaces one; and DuckDB on it."""
    con, where = duckdb.connect(), tmp_path / "data"
    where.mkdir()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS {select.format(v=f"'{DATA}/{t}.parquet'") if t == name else f"SELECT * FROM '{DATA}/{t}.parquet'"}")
        con.sql(f"COPY {t} TO '{where}/{t}.parquet' (FORMAT parquet)")
    return con, str(where)


def test_days_to_purge_of_times_to_come(spark, tmp_path):
    """Items deleted after the moment asked for: SQL's // cuts towards 0."""
    con, where = _replaced_table(tmp_path, "documents", "SELECT * REPLACE (doc_id * 251 AS doc_id) FROM {v}")
    want = sorted(con.sql(ORACLES["b25_days_to_purge"]).fetchall())
    assert any(r[2] > 29 for r in want)
    assert sorted(map(tuple, QUERIES["b25_days_to_purge"](spark, where).collect())) == want


def test_codec_keeps_the_sign_of_zero(spark, tmp_path):
    """Components that round to zero from below are -0.0, as in SQL; halves are taken away from 0."""
    v = "[-0.0000003, 0.0000003, '-0'::FLOAT, 0.0000005, -0.0000015, 1.0000005, -7.5]::FLOAT[]"
    con, where = _replaced_table(tmp_path, "embeddings", f"SELECT * REPLACE ({v} AS embedding) FROM {{v}}")
    want = sorted(str(r) for r in con.sql(f"SELECT id, v FROM ({ORACLES['a27_codec']})").fetchall())
    assert "-0.0, 0.0, -0.0" in want[0]
    assert sorted(str((r["id"], r["v"])) for r in QUERIES["a27_codec"](spark, where).collect()) == want
