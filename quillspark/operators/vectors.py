"""Vectors and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 for different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """x (double) to digits after the point, halves away from 0 and a zero with the sign of x, as C's round() does."""
    return F.signum(x) * F.round(F.abs(x) * 10.0**digits) / 10.0**digits


def affinity() -> Column:
    """From rating, else status; longer reading and a review strengthen it; within -1 and 1."""
    by_status = F.when(F.col("status") == "finished", 0.6).when(F.col("status") == "reading", 0.3).when(F.col("status") == "dropped", -0.5).otherwise(0.0)
    base = F.when(F.col("rating").isNotNull(), (F.col("rating") - 3.5) / 1.5).otherwise(by_status)
    longer = F.when(base > 0, base * (1 + 0.3 * F.least(F.lit(1.0), F.coalesce("minutes", F.lit(0.0)) / 60))).otherwise(base)
    review = F.when(F.col("has_review"), 0.1 * F.signum(longer)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), longer + review))


def weighted_mean(rows: DataFrame, vector: str, weight: str, group: str) -> DataFrame:
    """The weighted mean vector of each group, scaled to length 1; sums are combined before the shuffle."""
    each = rows.select(group, F.col(weight).alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(group, "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"))
    whole = sums.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("v"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return whole.select(group, F.transform("v", lambda e: F.when(F.col("norm") > 0, e["s"] / F.col("norm")).otherwise(0.0)).alias("centroid"))


#: About so many centroids are one array of a pass of score(); a taste has three.
FACETS = 1024


def score(candidates: DataFrame, centroids: DataFrame) -> DataFrame:
    """The largest cosine to a centroid, over all centroids."""
    passes = max(1, -(-centroids.count() // FACETS))
    best = F.aggregate("centroids", F.lit(-2.0), lambda n, c: F.greatest(n, dot(F.col("v"), c)))
    out = None
    for i in range(passes):
        pack = [r["centroid"] for r in centroids.select("centroid").filter(F.pmod(F.xxhash64("centroid"), F.lit(passes)) == i).collect()]
        few = candidates.sparkSession.createDataFrame([(pack,)], "centroids array<array<double>>")
        one = candidates.crossJoin(F.broadcast(few)).select("id", best.alias("score"))  # one row
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.max("score").alias("score"))


def diversified(scored: DataFrame, group: str, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over all rows of each group (id, score, v): group, id, place.

    Each of the k rounds takes the best row of each group by partial aggregation; of equals, the better scored and then the smaller id.
    """
    rows = written(scored.select(group, "id", "score", "v"))
    out = None
    for place in range(1, k + 1):
        near, left = F.lit(0.0), rows
        if out is not None:
            picked = out.groupBy(group).agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("picks"))
            left = rows.join(picked.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left").filter("ids IS NULL OR NOT array_contains(ids, id)")
            near = F.aggregate("picks", F.lit(0.0), lambda n, p: F.greatest(n, dot(F.col("v"), p)))
        best = F.struct((weight * F.col("score") - (1 - weight) * near).alias("mmr"), "score", (-F.col("id")).alias("first"))
        one = written(left.groupBy(group).agg(F.max_by(F.struct("id", "v"), best).alias("best")).select(group, "best.*", F.lit(place).alias("place")))
        out = one if out is None else out.unionByName(one)
    return out.select(group, "id", "place")
