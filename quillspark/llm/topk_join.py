"""Exact top-k search: a Voronoi kNN join on integer inner products.

1. Rows are grouped by their nearest pivot (pivots are rows, at most PIVOTS), queries likewise.
2. Each query is solved against the rows of its own group; the k-th best score there, or among the pivots, is its floor.
3. A summary of each group (its rows' largest and smallest distance to the pivot and largest norm) bounds what a query
   can score with any row of it. A query is replicated to those groups that may reach its floor, and to no other.
4. Groups and the queries sent to them are cut into blocks, solved locally, and the k best of all blocks remain.

So a large group, a common vector or a hot pivot never lands in one task. reach() gives the share of pairs of a query and
a group that are compared; what can be pruned depends on the data (nothing among random directions in many dimensions).

Defined results: vectors that are null, empty, of another length than most (ties: the longer), or hold a null or
non-finite component take no part, nor do rows without an id; equal scores go to the smaller id, and repeated rows
of one id all count, except as partners of that id; queries with no other row have no result; extra columns are
ignored. Integers are compared exactly (sums below 2 ** 53).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, small_batches, written

PIVOTS = 256
#: Rows of a block of data, and of queries.
BLOCK, QUERY_BLOCK = 4096, 2048
LOCAL = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v array<double> with the whole numbers floor(scale * x), of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad)
    sizes = usable.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    return usable.filter(F.size("embedding") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0))


@dataclass(frozen=True)
class Groups:
    """pivots: [group, dimension] and the ids of those rows; of each group's rows: how many, largest and smallest distance to the pivot, largest norm."""

    pivots: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    far: np.ndarray
    near: np.ndarray
    norm: np.ndarray


def grouped(data: DataFrame, pivots: np.ndarray) -> DataFrame:
    """data with g, the nearest pivot, d, the distance to it, and norm."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(column(batch, "v"))
            d = _distances(x, pivots)
            g = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "v"), pa.array(g, pa.int32()), pa.array(d[np.arange(len(x)), g]), pa.array(np.sqrt((x**2).sum(1)))], ["vec_id", "v", "g", "d", "norm"])

    return data.mapInArrow(assign, "vec_id bigint, v array<double>, g int, d double, norm double")


def solved(queries: DataFrame, rows: DataFrame, asked: dict[int, int], sizes: dict[int, int], k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block of rows (vec_id, v, g) for the queries (vec_id, v, g) of the same g."""

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("vec_id")
            ids, m, of = x["vec_id"].to_numpy(), np.stack(x["v"].to_numpy()), q["vec_id"].to_numpy()
            for i in range(0, len(q), 256):
                s = np.stack(q["v"].to_numpy()[i : i + 256]) @ m.T
                s[of[i : i + 256, None] == ids] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(of[i : i + 256], best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return found[found["score"] > -np.inf].astype("int64")

    spark = queries.sparkSession
    cuts = [(g, max(1, math.ceil(sizes[g] / BLOCK)), max(1, math.ceil(n / QUERY_BLOCK))) for g, n in asked.items()]
    few = F.broadcast(spark.createDataFrame(cuts, "g int, blocks int, halves int"))  # a row of each group
    q = queries.join(few, "g").withColumn("half", F.pmod(F.xxhash64("vec_id"), "halves").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = rows.join(few, "g").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int")).withColumn("half", F.explode(F.sequence(F.lit(0), F.col("halves") - 1)))
    keys = ["g", "half", "block"]
    return q.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(x.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(solve, LOCAL)


def replicated(queries: DataFrame, groups: Groups, k: int) -> DataFrame:
    """vec_id, v, g of each query (vec_id, v, g, floor) for each group, other than its own, that may reach its floor."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, ids = _matrix(column(batch, "v")), column(batch, "g").to_numpy(), column(batch, "vec_id").to_numpy()
            floor = column(batch, "floor").to_numpy()
            length = np.sqrt((x**2).sum(1))[:, None]
            to, score = _distances(x, groups.pivots), x @ groups.pivots.T
            gap = np.maximum(np.maximum(to - groups.far, groups.near - to), 0)
            upper = np.minimum(score + length * groups.far, (length**2 + groups.norm**2 - gap**2) / 2)
            # pivots are rows: the k-th best of those with another id than the query's is a floor as well
            others = np.sort(np.where(ids[:, None] == groups.ids, -np.inf, score), axis=1)
            if others.shape[1] >= k:
                floor = np.maximum(floor, others[:, -k])
            i, g = np.nonzero((upper + 1e-6 * (1 + np.abs(upper)) >= floor[:, None]) & (np.arange(len(groups.rows)) != own[:, None]) & (groups.rows > 0))
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id").take(pa.array(i)), column(batch, "v").take(pa.array(i)), pa.array(g, pa.int32())], ["vec_id", "v", "g"])

    return queries.mapInArrow(send, "vec_id bigint, v array<double>, g int")


def search(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with the other rows."""
    local, _ = parts(vectors, is_query, k)
    if local is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def reach(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5) -> float:
    """The share of the pairs of a query and a group of rows that are compared, of all such pairs."""
    return parts(vectors, is_query, k)[1]


def parts(vectors: DataFrame, is_query: str, k: int) -> tuple[DataFrame | None, float]:
    """query_id, vec_id, score of the best of each block (None without rows), and the share of pairs sent."""
    spark = vectors.sparkSession
    small_batches(spark)
    data = written(quantised(vectors))
    rows = data.count()
    if rows == 0:
        return None, 0.0
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(4 * PIVOTS).collect()
    distinct: dict[tuple, int] = {}
    for r in sample:
        distinct.setdefault(tuple(r["v"]), r["vec_id"])
    n = max(1, min(PIVOTS, math.isqrt(rows), len(distinct)))
    pivots, ids = np.array(list(distinct)[:n]), np.array(list(distinct.values())[:n])
    own = written(grouped(data, pivots))
    queries = written(own.filter(is_query).select("vec_id", "v", "g").dropDuplicates())

    # a row of each group
    of = {r["g"]: r for r in own.groupBy("g").agg(F.count("*").alias("rows"), F.max("d").alias("far"), F.min("d").alias("near"), F.max("norm").alias("norm")).collect()}
    groups = Groups(pivots, ids, *(np.array([of[g][c] if g in of else 0.0 for g in range(n)]) for c in ("rows", "far", "near", "norm")))
    sizes = {g: r["rows"] for g, r in of.items()}
    asked = lambda q: {r["g"]: r["count"] for r in q.groupBy("g").count().collect()}
    data = own.select("vec_id", "v", "g")
    first = written(solved(queries, data, asked(queries), sizes, k))

    # of an id that asks with several vectors, the best of them may not bound the others
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    kth = first.withColumn("place", place).filter(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    single = queries.groupBy("vec_id").count().filter("count = 1").select("vec_id")
    floored = queries.join(kth.join(single, "vec_id"), "vec_id", "left").select("vec_id", "v", "g", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    sent = written(replicated(floored, groups, k))
    further = asked(sent)
    share = (sum(further.values()) + queries.count()) / max(1, queries.count() * len(of))
    return first.unionByName(solved(sent, data.filter(F.col("g").isin(list(further))), further, sizes, k)) if further else first, share


#: Brute force in SQL.
ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT * FROM usable WHERE len(v) = (SELECT len(v) AS n FROM usable GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1)),
s AS (SELECT q.vec_id AS query_id, x.vec_id, cast(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
