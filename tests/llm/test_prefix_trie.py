"""The trie against a plain one, and the cases the docstring defines."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quillspark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, at int, n string, depth int, p1 string"


def plain(rows):
    own = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    value = {k: (len(v) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k, v in nodes.items()}
    for k, v in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(y != x and y[: len(x)] == x for y in below)]
        ended = ",".join(str(c) for c in sorted(v) if len(whole[c]) == len(k))
        out.append((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), len(kids), len(leaves), sum(value[x] for x in below), hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=1):
    r = random.Random(seed)
    say = lambda: r.choice(["yes", "no", "go  on\nthen", "", "a b c", "ünï x"])
    rows = []
    for c in [*range(45), 60, 61, 119, 120, -7, -40, -41]:
        if c == 20:
            continue  # a family without its first conversation
        rows += [(c, t, r.choice(["user", "assistant"]), say()) for t in range(r.choice([1, 1, 2, 3, 5, 8]))]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 240) for t in range(4)]  # copies, of their first and of each other
    rows += [(300, t, "user", "long") for t in range(70)] + [(301, t, "user", "long") for t in range(70)]
    rows += [(400, None, "b", "null turn"), (400, None, None, None), (400, 1, None, "x"), (400, 1, "user", None)] + [(400, 2, "user", "same")] * 3
    rows += [(None, 1, "user", "no id"), (None, None, None, None)]
    return [(*x, 1, "n", 2, "p") for x in rows]


@pytest.mark.parametrize(("cells", "seed"), [(1 << 14, 1), (1 << 14, 2), (8, 3), (64, 4)])
def test_nodes_match_a_plain_trie(spark, monkeypatch, cells, seed):
    """Also with a sketch so small that prefixes of one conversation pass for shared ones, at any depth."""
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "SLICE", min(cells, 1 << 14))
    rows = conversations(seed)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_a_conversation_over_several_parts(spark, monkeypatch):
    """With a row a task or so, conversations span many parts of the order."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    rows = [(c, t, "user", f"{t % 3} w") for c in (1, 300, 301, 302) for t in range(30 if c == 301 else 9)] + [(5, 1, "user", "equal")] * 20
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(*x, 1, "n", 2, "p") for x in rows], SCHEMA).repartition(3)
        parts = prefix_trie.turns(docs).selectExpr("conv_id", "shiftright(at, 33) AS part").groupBy("conv_id").agg({"part": "max", "*": "count"}).collect()
        got = prefix_trie.trie(docs).collect()
        spans = prefix_trie.turns(docs).selectExpr("conv_id", "shiftright(at, 33) AS part").distinct().groupBy("conv_id").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) == 5 and max(r["count"] for r in spans if r["conv_id"] == 301) > 2 and max(r["count"] for r in spans if r["conv_id"] == 5) > 1
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_sketch_never_counts_too_few(spark):
    r = np.random.default_rng(1)
    keys = r.integers(-(2**63), 2**63 - 1, (500, 2))
    rows = [tuple(map(int, keys[i])) for i in [*range(500), *range(0, 500, 5)]]
    bits, width = prefix_trie.sketched(spark.createDataFrame(rows, "p1 long, p2 long").repartition(4), len(rows))
    found = [all(row[c >> 3] >> (7 - (c & 7)) & 1 for row, c in zip(bits, (int(x[0]) for x in prefix_trie.cells(keys[i : i + 1, 0], keys[i : i + 1, 1], width)), strict=True)) for i in range(500)]
    assert all(found[::5]) and sum(found) < 110


def test_empty(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "n", 2, "p")], SCHEMA)).collect() == []


def test_query_matches_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op12_prefix_trie"])
    got = queries.op12_prefix_trie(spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    rows = [(*r, 0) for r in con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
