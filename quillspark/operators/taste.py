"""A reader's taste: facets of what is liked, scores against them, diverse picks, and how well they foretell a liked item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import candidates
from .vectors import diversified, dot, weighted_mean

#: How liked and disliked means weigh, items of a facet, most facets, rounds, and when two facets are one.
ALPHA, BETA = 1.0, 0.3
TARGET_SIZE, MOST_FACETS, ROUNDS, SAME = 8, 3, 10, 0.98
THIN, NORMAL = 4, 20


def normalised(v: Column) -> Column:
    """V scaled to length 1; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def scaled(v: Column, by: float) -> Column:
    """J2."""
    return F.transform(v, lambda x: x.cast("double") * by)


def less(a: Column, b: Column) -> Column:
    """A minus b, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") - y.cast("double"))


def tier(n: Column) -> Column:
    """How much is known of a reader, by items with a vector."""
    return F.when(n == 0, "empty").when(n <= THIN, "thin").when(n <= NORMAL, "normal").otherwise("power")


def facet_count(n: Column) -> Column:
    """J6."""
    return F.when(n <= 0, 0).otherwise(F.least(F.greatest(F.floor(n / TARGET_SIZE + 0.5), F.lit(1)), F.lit(MOST_FACETS), n)).cast("long")


def _frame(spark, centroids: list[list[float]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(centroids)), "facet int, centroid array<double>")


def facets(liked: DataFrame) -> DataFrame:
    """Facet, centroid: weighted spherical k-means of liked (id, v of length 1, weight), deterministic.

    Seeds: the heaviest item (of equals the smallest id), then the one least like all seeds. Each round assigns all items to
    the most similar centroid and takes weighted means by aggregation; MOST_FACETS centroids at most are on the driver.
    """
    spark = liked.sparkSession
    rows = written(liked.select("id", "v", "weight"))
    n = rows.count()
    if n == 0:
        return _frame(spark, [])
    k = min(max(int(n / TARGET_SIZE + 0.5), 1), MOST_FACETS, n)
    canonical = F.struct((-F.col("weight")).alias("w"), F.col("id"))
    seeds = [rows.agg(F.min_by("v", canonical)).first()[0]]
    like = lambda c: dot(F.col("v"), F.array(*(F.lit(float(x)) for x in c)))
    chosen = [rows.agg(F.min_by("id", canonical)).first()[0]]
    while len(seeds) < k:
        near = F.greatest(F.lit(-2.0), *(like(s) for s in seeds))
        far = rows.filter(~F.col("id").isin(chosen)).agg(F.min_by(F.struct("id", "v"), F.struct(near.alias("near"), canonical.alias("c")))).first()[0]
        seeds.append(far["v"])
        chosen.append(far["id"])
    centroids, before = [list(map(float, s)) for s in seeds], None
    if k == 1:
        centroids = [r["centroid"] for r in weighted_mean(rows.withColumn("facet", F.lit(0)), "v", "weight", "facet").collect()]
    else:
        for _ in range(ROUNDS):
            nearest = F.array_max(F.array(*(F.struct(like(c).alias("cos"), F.lit(-i).alias("i")) for i, c in enumerate(centroids))))["i"]
            assigned = written(rows.withColumn("facet", -nearest))
            sums = sorted((r["facet"], r["n"], r["h"]) for r in assigned.groupBy("facet").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("h")).collect())
            if sums == before:
                break
            before = sums
            centroids = [r["centroid"] for r in sorted(weighted_mean(assigned, "v", "weight", "facet").collect(), key=lambda r: r["facet"])]
            if len(centroids) <= 1:
                break
    out: list[list[float]] = []
    for c in centroids:
        if not any(np.dot(c, o) > SAME for o in out):
            out.append(c)
    return _frame(spark, out)


def rocchio(positive: DataFrame, disliked: DataFrame) -> DataFrame:
    """The facets of positive (facet, centroid), each pushed away from the mean of disliked (v, weight)."""
    negative = weighted_mean(disliked.withColumn("_all", F.lit(1)), "v", "weight", "_all").select(F.col("centroid").alias("_negative"))
    away = normalised(less(scaled(F.col("centroid"), ALPHA), scaled(F.col("_negative"), BETA)))
    joined = positive.join(F.broadcast(negative), F.lit(True), "left")  # one row at most
    return joined.withColumn("centroid", F.when(F.col("_negative").isNull(), F.col("centroid")).otherwise(away)).drop("_negative")


def liked_order() -> list[Column]:
    """F9."""
    return [F.desc("weight"), F.col("id")]


def picks(scored: DataFrame, owned_authors: DataFrame, quota: int, weight: float = 0.7) -> DataFrame:
    """Id, part of quota diverse rows (id, author, score, v): one for each author, and few of authors that are owned already;
    where either side is short, the best of what is left."""
    best = candidates.best_per_author(scored)
    have = owned_authors.select(F.col("author_key"), F.lit(True).alias("has")).distinct()
    best = written(best.join(have, "author_key", "left").withColumn("part", F.when(F.col("has"), "owned").otherwise("fresh")).drop("has"))
    owned = min(best.filter("part = 'owned'").count(), int(quota * candidates.OWNED_SHARE + 0.5))
    chosen = written(diversified(best.select("part", "id", "score", "v"), "part", quota - owned, weight).filter((F.col("part") == "fresh") | (F.col("place") <= owned)).select("id", "part"))
    missing = quota - chosen.count()
    if missing <= 0:
        return chosen
    rest = best.join(chosen.select("id"), "id", "left_anti").withColumn("part", F.lit("rest"))
    return chosen.unionByName(diversified(rest.select("part", "id", "score", "v"), "part", missing, weight).select("id", "part"))


#: Folds of one pass over all items.
FOLDS = 2048


#: Cosines that a task holds at once.
CELLS = 1 << 20


def outranking(others: np.ndarray, x: np.ndarray, ids: np.ndarray, c: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """How many of the others (rows of x) are nearer to each centroid of c than its own item (ids; mine: their cosines)."""
    better, rows = np.zeros(len(ids), np.int64), max(1, CELLS // max(1, len(ids)))
    for at in range(0, len(x), rows):
        better += ((x[at : at + rows].astype(float) @ c.T > mine + 1e-9) & (others[at : at + rows, None] != ids)).sum(axis=0)
    return better


def leave_one_out(items: DataFrame) -> DataFrame:
    """E10, J14 with one centroid: id, rank of each liked item (id, v, weight > 0) among all items, where the taste is that of the others.

    The fold's centroid is the weighted sum less the item's own part, pushed away from the disliked mean; an item outranks it
    by a strictly greater cosine. Folds pass over all items in packs of about FOLDS, which count in numpy and add up on Spark.
    """
    spark = items.sparkSession
    rows = written(items.select("id", "v", "weight"))
    liked = rows.filter("weight > 0")
    total = liked.select(F.posexplode("v").alias("i", "x"), "weight").groupBy("i").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("s")).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"))
    n = liked.count()
    empty = spark.createDataFrame([], "id long, rank long")
    if n < 2:
        return empty
    rest = F.zip_with(F.transform("s", lambda e: e["s"]), F.transform("v", lambda x: x.cast("double") * F.col("weight")), lambda a, b: a - b)
    folds = liked.crossJoin(F.broadcast(total)).select("id", "v", normalised(rest).alias("centroid"))  # one row
    folds = written(rocchio(folds, rows.filter("weight < 0").withColumn("weight", -F.col("weight"))))
    passes = -(-n // FOLDS)
    out = empty
    for p in range(passes):
        pack = folds.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).toArrow()
        ids = pack["id"].to_numpy()
        own, c = (np.stack([np.array(x, float) for x in pack[k].to_pylist()]) if len(ids) else np.zeros((0, 1)) for k in ("v", "centroid"))
        mine = (own * c).sum(axis=1)

        def count(batches: Iterator[pa.RecordBatch], ids=ids, c=c, mine=mine) -> Iterator[pa.RecordBatch]:
            better = np.zeros(len(ids), np.int64)
            for batch in batches:
                if batch.num_rows and len(ids):
                    x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                    better += outranking(batch.column(0).to_numpy(), x, ids, c, mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(better)], ["id", "better"])

        counted = rows.select("id", "v").mapInArrow(count, "id long, better long").groupBy("id").agg((F.sum("better") + 1).alias("rank"))
        out = out.unionByName(counted)
    return out


def report(ranks: DataFrame, field: int) -> DataFrame:
    """Mean reciprocal rank, hits among the first 5 and 10, mean percentile, and the number of folds."""
    r = F.col("rank")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return ranks.agg(mean(1 / r).alias("mrr"), mean((r <= 5).cast("int")).alias("hit5"), mean((r <= 10).cast("int")).alias("hit10"), mean(1 - (r - 1) / max(field - 1, 1)).alias("percentile"), F.count("*").alias("n_folds"))


def chunks(text: Column, size: int = 400) -> Column:
    """The words of a text in chunks of size words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.ceil(F.size(words) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def sampled(chunks: Column, k: int = 20) -> Column:
    """K chunks, from the middle of as many equal parts; all, if they are no more."""
    n = F.size(chunks)
    return F.when(n <= k, chunks).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get(chunks, F.floor((j + 0.5) * n / k).cast("int"))))


def two_tier(meta: Column, content: Column) -> Column:
    """The mean of an item's two vectors, or the one it has."""
    both = F.zip_with(meta, content, lambda x, y: 0.5 * x.cast("double") + 0.5 * y.cast("double"))
    return F.when(content.isNull(), normalised(meta)).when(meta.isNull(), normalised(content)).otherwise(normalised(both))


def stale(items: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Items (id, hash) without a vector of this hash and model."""
    e = embedded.select("id", F.col("hash").alias("_hash"), F.col("model").alias("_model"))
    fresh = F.col("hash").eqNullSafe(F.col("_hash")) & F.col("_model").eqNullSafe(F.lit(model))
    return items.join(e, "id", "left").filter(~fresh).drop("_hash", "_model")


def pairings(characters: DataFrame, known: DataFrame, partners: int = 4) -> DataFrame:
    """The names of each work's first character with the next ones (work, place, name), as far as a pairing of both is known (pair:
    the two names in order)."""
    ranked = characters.filter(F.col("place") <= partners + 1)
    a, b = ranked.filter("place = 1").select("work", F.col("name").alias("a")), ranked.filter("place > 1").select("work", "place", F.col("name").alias("b"))
    return a.join(b, "work").withColumn("pair", F.array_sort(F.array("a", "b"))).join(known.select("pair").distinct(), "pair", "left_semi").select("work", "place", "pair")


def resolved(terms: DataFrame, aliases: DataFrame, as_of: int, ttl: int, negative_ttl: int) -> DataFrame:
    """Terms with the cached name of their alias; state: hit, miss (known to have none), or ask (not cached or expired)."""
    a = aliases.select("term", F.col("name").alias("_name"), F.col("at").alias("_at"))
    age = F.lit(as_of) - F.col("_at")
    state = F.when(F.col("_at").isNull(), "ask").when(F.col("_name").isNotNull() & (age <= ttl), "hit").when(F.col("_name").isNull() & (age <= negative_ttl), "miss").otherwise("ask")
    joined = terms.join(a, "term", "left").withColumn("state", state)
    return joined.withColumn("name", F.when(F.col("state") == "hit", F.col("_name"))).drop("_name", "_at")
