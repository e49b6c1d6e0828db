"""Views of the library: scans, filters, joins, nesting, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .stats import shown_status

DAY = 86_400_000


def live(items: DataFrame) -> DataFrame:
    return items.filter(F.col("deleted_at").isNull())


def trash(items: DataFrame) -> DataFrame:
    return items.filter(F.col("deleted_at").isNotNull() & F.col("purged_at").isNull())


def expired(items: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    return trash(items).filter(F.col("deleted_at") < as_of - days * DAY)


def with_progress(items: DataFrame, progress: DataFrame) -> DataFrame:
    """C1."""
    return items.join(progress.withColumnRenamed("item_id", "id"), "id", "left")


def nested_tags(items: DataFrame, tags: DataFrame) -> DataFrame:
    """Each item with the sorted array of its tags."""
    own = tags.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return items.join(own, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def filtered(items: DataFrame, progress: DataFrame, tags: DataFrame, status: str | None = None, any_tags: list[str] | None = None, types: list[str] | None = None, query: str = "") -> DataFrame:
    """Live items without those that an item is derived from, then by status, tags, types and text."""
    out = live(items)
    hidden = out.filter(F.col("derived_from").isNotNull()).select(F.col("derived_from").alias("id")).distinct()
    out = nested_tags(with_progress(out.join(hidden, "id", "left_anti"), progress), tags)
    out = out.withColumn("shown", shown_status())
    if status:
        out = out.filter(F.col("shown") == status)
    if any_tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, any_tags))))
    if types:
        out = out.filter(F.col("content_type").isin(types))
    if query:
        q = F.lit(query.lower())
        out = out.filter(F.lower("title").contains(q) | F.lower("author").contains(q) | F.exists("tags", lambda t: F.lower(t).contains(q)))
    return out


def families(items: DataFrame, progress: DataFrame) -> DataFrame:
    """The furthest position within a source item and what is derived from it."""
    family = F.coalesce("derived_from", "id")
    return with_progress(items, progress).groupBy(family.alias("family")).agg(F.max(F.coalesce("scroll", F.lit(0.0))).alias("scroll"), F.count("*").alias("members"), F.bool_or(F.coalesce(F.col("status") == "finished", F.lit(False))).alias("finished"))


def universal_tags(tags: DataFrame, items: list[int]) -> DataFrame:
    """Tags that all of the items have."""
    return tags.filter(F.col("item_id").isin(items)).groupBy("tag").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") == len(set(items))).select("tag")


def top_per(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def first_per(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    return top_per(df, key, order, 1).drop("rank")


#: Words of titles that don't tell books apart.
TITLE_NOISE = "the a an of and or to in on for with by at from oceanofpdf com www http https pdf epub mobi azw3 ebook".split()


def title_tokens(title: str = "title") -> Column:
    """Distinct words of a normalised title without noise."""
    return F.array_distinct(F.filter(F.split(T.norm(F.col(title)), " "), lambda t: (t != "") & ~t.isin(*TITLE_NOISE)))


def not_contained(candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """C14: candidates without an owned title that has all their tokens.

    A candidate meets only the owned titles that have its rarest token (by how many owned titles have it), so a common
    word pairs nothing; the rest of its tokens is then looked for in the owned title.
    """
    enough = (F.size("tokens") >= 2) | ((F.size("tokens") == 1) & (F.length(F.element_at("tokens", 1)) >= 5))  # B13
    wanted = candidates.select("id", title_tokens().alias("tokens")).filter(F.size("tokens") > 0).filter(enough)
    have = owned.select(title_tokens().alias("own")).distinct()
    each = have.select("own", F.explode("own").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"))
    # tokens that no owned title has rule the candidate out
    rarest = wanted.select("id", "tokens", F.explode("tokens").alias("token")).join(common, "token").groupBy("id").agg(F.count("*").alias("met"), F.first("tokens").alias("tokens"), F.min_by("token", F.struct("n", "token")).alias("token"))
    met = rarest.filter(F.col("met") == F.size("tokens")).join(each, "token")
    hit = met.filter(F.size(F.array_except("tokens", "own")) == 0).select("id").distinct()
    return candidates.join(hit, "id", "left_anti")
