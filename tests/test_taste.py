"""Iterative and stateful operators against plain versions."""

import math
import random

import numpy as np
import pytest

from quillspark.operators import candidates, lists, taste, vectors


def unit(v):
    v = np.array(v, float)
    return v / np.linalg.norm(v)


def mean(rows):
    return unit(sum(w * v for _, v, w in rows))


def plain_facets(rows):
    rows = sorted(rows, key=lambda x: (-x[2], x[0]))
    k = min(max(math.floor(len(rows) / 8 + 0.5), 1), 3, len(rows))
    if k <= 1:
        return [mean(rows)]
    seeds = [0]
    while len(seeds) < k:
        rest = [i for i in range(len(rows)) if i not in seeds]
        seeds.append(min(rest, key=lambda i: (max(rows[i][1] @ rows[j][1] for j in seeds), i)))
    c, before = [rows[i][1] for i in seeds], None
    for _ in range(10):
        of = [int(np.argmax([x[1] @ y for y in c])) for x in rows]
        if of == before:
            break
        before = of
        c = [mean([x for x, j in zip(rows, of, strict=True) if j == i]) for i in range(len(c)) if i in of]
    out = []
    for x in c:
        if not any(x @ y > 0.98 for y in out):
            out.append(x)
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 5), (3, 16), (4, 60)])
def test_facets_match_plain_clustering(spark, seed, n):
    r = np.random.RandomState(seed)
    rows = [(i, unit(r.randn(5) + 3 * np.eye(5)[i % 3]), float(r.randint(1, 4))) for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist(), w) for i, v, w in rows], "id long, v array<double>, weight double").repartition(3)
    got = [x["centroid"] for x in taste.facets(df).orderBy("facet").collect()]
    assert np.allclose(got, plain_facets(rows))
    assert taste.facets(df.limit(0)).collect() == []


def test_facets_that_are_one_merge(spark):
    rows = [(i, [1.0, i / 1000, 0.0], 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>, weight double")
    assert taste.facets(df).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_union_walks_all_pools(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"s{r.randrange(60)}", f"k{r.randrange(60)}") for i in range(150)]
    ids, keys, want = set(), set(), set()
    for i, s, k in rows:
        if s not in ids and k not in keys:
            ids.add(s)
            keys.add(k)
            want.add(i)
    df = spark.createDataFrame(rows, "seq long, source_id string, key string").repartition(3)
    assert {x["seq"] for x in candidates.united(df).collect()} == want


def mmr(rows, k):
    left, near, out = sorted(rows, key=lambda x: x[0]), {}, []
    while left and len(out) < k:
        best = max(left, key=lambda x: (0.7 * x[2] - 0.3 * near.get(x[0], 0.0), x[2], -x[0]))
        left.remove(best)
        out.append(best)
        near = {x[0]: max(near.get(x[0], 0.0), float(x[3] @ best[3])) for x in left}
    return out


@pytest.mark.parametrize("quota", [3, 10, 26])
def test_quota_prefers_new_authors(spark, quota):
    r = np.random.RandomState(5)
    rows = [(i, f"A. {i % 25}" if i % 7 else None, float(r.rand()), unit(r.randn(4))) for i in range(80)]
    owned = {f"a {i}" for i in range(0, 25, 2)}
    best = {}
    for x in sorted(rows, key=lambda x: (-x[2], x[0])):
        best.setdefault((x[1] or "").lower().replace(".", ""), x)
    mine = [x for k, x in best.items() if " ".join(k.split()) in owned]
    fresh = [x for k, x in best.items() if " ".join(k.split()) not in owned]
    most = min(len(mine), math.floor(quota * 0.2 + 0.5))
    want = mmr(fresh, quota - most) + mmr(mine, most)
    taken = {x[0] for x in want}
    want += mmr([x for x in best.values() if x[0] not in taken], quota - len(want))
    df = spark.createDataFrame([(i, a, s, v.tolist()) for i, a, s, v in rows], "id long, author string, score double, v array<double>").repartition(3)
    names = spark.createDataFrame([(x,) for x in owned], "author_key string")
    assert {x["id"] for x in taste.picks(df, names, quota).collect()} == {x[0] for x in want}


def test_ranks_of_the_known_case(spark):
    """Two liked items and five distractors: ranks 7 and 6; and a tie favours the held-out item."""
    at = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(0, [1.0, 0.0], 1.0), (1, at(0.9), 1.0)] + [(2 + i, at(0.91 + i / 100), 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, v array<double>, weight double")
    ranks = {r["id"]: r["rank"] for r in taste.leave_one_out(df).collect()}
    c = {0: unit(rows[1][1]), 1: unit(rows[0][1])}
    for h in (0, 1):
        own = float(np.array(rows[h][1]) @ c[h])
        assert ranks[h] == 1 + sum(float(np.array(v) @ c[h]) > own + 1e-9 for i, v, _ in rows if i != h)
    assert taste.report(taste.leave_one_out(df.filter("id = 0")), 1).first()["n_folds"] == 0


def test_scores_take_all_centroids(spark, monkeypatch):
    v = spark.createDataFrame([(i, np.eye(20)[i].tolist()) for i in range(20)], "id long, v array<double>")
    c = v.select("v").withColumnRenamed("v", "centroid")
    for most in (1024, 6):
        monkeypatch.setattr(vectors, "FACETS", most)
        assert [r["score"] for r in vectors.score(v, c).collect()] == [1.0] * 20


def test_places_are_whole_and_nulls_last(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 5), i) for i in range(101)]
    df = spark.createDataFrame(rows, "id long, rating double, date_saved long").repartition(7)
    for sort, sign in (("rating_high", -1), ("rating_low", 1)):
        got = [r["id"] for r in sorted(lists.placed(df, *lists.library_order(sort)).collect(), key=lambda r: r["place"])]
        assert got == [x[0] for x in sorted(rows, key=lambda x: (x[1] is None, sign * (x[1] or 0), -x[2]))]
    assert lists.placed(df.limit(0), "id").collect() == []


def test_ranks_hold_few_cosines_at_once():
    """A batch of Spark's usual size against a pack of folds, counted as over all of its cosines."""
    import tracemalloc

    r = np.random.default_rng(2)
    x, c, ids = r.standard_normal((10_000, 16)).astype(np.float32), r.standard_normal((taste.FOLDS, 16)), np.arange(taste.FOLDS)
    mine = (x[: taste.FOLDS] * c).sum(axis=1)
    tracemalloc.start()
    got = taste.outranking(np.arange(10_000), x, ids, c, mine)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 10,000 x 2,048 cosines take 164 MB
    for f in (0, 7, 2047):
        assert got[f] == sum(np.delete(x.astype(float) @ c[f], f) > mine[f] + 1e-9)
