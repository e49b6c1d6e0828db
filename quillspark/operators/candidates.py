"""Candidates for recommendation: normalising, unions, exclusions, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import dropped, matched, written

#: Fixed value: subjects of comics, which a reader of texts can't show.
GRAPHIC = r"(?i)graphic novel|comic book|comics\s*&\s*graphic|comics,\s*strips|\bmanga\b|cartoons and comics"
#: The site that keys of books belong to, and the share of slots for authors that the reader owns.
ORIGIN = "https://openlibrary.org"
OWNED_SHARE = 0.2
DOC = "title string, author_name array<string>, subject array<string>, key string, cover_i long, isbn array<string>"


def key(title: Column, author: Column) -> Column:
    """H2: what two editions of one book share."""
    return F.concat(T.norm(title), F.lit("|"), T.norm(F.coalesce(author, F.lit(""))))


def normalised(docs: DataFrame, subjects: int = 12) -> DataFrame:
    """Candidates from JSON documents (column doc): those with a title and without a subject of comics."""
    d = docs.withColumn("d", F.from_json("doc", DOC))
    first = lambda c: F.when(F.trim(F.get(F.col(f"d.{c}"), F.lit(0))) != "", F.trim(F.get(F.col(f"d.{c}"), F.lit(0))))
    d = d.withColumn("title", F.trim("d.title")).withColumn("author", first("author_name")).withColumn("all", F.coalesce("d.subject", F.array().cast("array<string>")))
    d = d.filter((F.length("title") > 0) & ~F.exists("all", lambda x: F.coalesce(x, F.lit("")).rlike(GRAPHIC)))
    listed = F.slice(F.filter(F.transform("all", lambda x: F.trim(x)), lambda x: x != ""), 1, subjects)
    made = F.concat(F.lit("synthetic:"), F.lower("title"), F.lit("|"), F.lower(F.coalesce("author", F.lit(""))))
    cover = F.concat(F.lit("https://covers.openlibrary.org/b/id/"), F.col("d.cover_i").cast("string"), F.lit("-M.jpg"))
    return d.select("id", "title", "author", listed.alias("subjects"), F.when(F.col("d.cover_i").isNotNull(), cover).alias("cover"), F.coalesce(F.when(F.trim("d.key") != "", F.trim("d.key")), made).alias("source_id"), first("isbn").alias("isbn"))


def url(source: Column, source_id: Column) -> Column:
    """Where a candidate can be opened."""
    slash = F.when(source_id.startswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.when(source_id.rlike("(?i)^https?://"), source_id).when(source == "book", F.concat(F.lit(ORIGIN), slash, source_id)).otherwise(source_id)


def description(raw: Column) -> Column:
    """Without what follows a line of dashes and without link definitions; in one line, null if nothing is left."""
    head = F.element_at(F.split(raw, r"\n\s*-{3,}"), 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: ~x.rlike(r"(?i)^\s*\[[^\]]+\]:\s*http"))
    text = T.collapse(F.array_join(lines, " "))
    return F.when(text != "", text)


def why(subjects: Column, terms: Column, cap: int = 6) -> Column:
    """The subjects that are among the terms (in lower case), in their order."""
    return F.slice(F.filter(subjects, lambda x: F.array_contains(terms, F.lower(x))), 1, cap)


def chips(matched: Column, subjects: Column) -> Column:
    """What matched, else the first three subjects."""
    return F.when(F.size(matched) > 0, matched).otherwise(F.slice(subjects, 1, 3))


def excluded(candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """Candidates that share neither title and author, nor source id, nor ISBN with an owned row."""
    out = candidates.withColumn("key", key(F.col("title"), F.col("author")))
    out = out.join(owned.select(key(F.col("title"), F.col("author")).alias("key")).distinct(), "key", "left_anti")
    ids = owned.select(F.explode(F.array_compact(F.array("source_id", "isbn"))).alias("x")).distinct()
    out = out.join(ids.withColumnRenamed("x", "source_id"), "source_id", "left_anti")
    return out.join(ids.withColumnRenamed("x", "isbn"), "isbn", "left_anti").drop("key")


def united(pools: DataFrame, id: str = "source_id", key: str = "key", order: str = "seq") -> DataFrame:
    """G1: of rows in order, each whose id and key no earlier kept row has (one that was dropped counts for nothing).

    In each round, rows that come first among the undecided ones of both their id and their key are kept, and those that
    share either with a kept row go; a row is decided as in a walk through all rows. There are as many rounds as the longest
    chain of rows that hinge on one another has rows, at most. order is different in each row.
    """
    left, kept = written(pools), None
    while not left.isEmpty():
        first = left.groupBy(id).agg(F.min(order).alias("_a")), left.groupBy(key).agg(F.min(order).alias("_b"))
        now = written(left.join(first[0], id).join(first[1], key).filter((F.col(order) == F.col("_a")) & (F.col(order) == F.col("_b"))).select(*pools.columns))
        kept = now if kept is None else kept.unionByName(now)
        rest = written(left.join(now.select(id), id, "left_anti").join(now.select(key), key, "left_anti").select(*pools.columns))
        dropped(left)
        left = rest
    dropped(left)
    return kept if kept is not None else pools


def appended(base: DataFrame, extra: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Base, then the rows of extra whose key base lacks."""
    return base.withColumn("part", F.lit(0)).unionByName(extra.join(base.select(key), key, "left_anti").withColumn("part", F.lit(1)))


def best_per_author(scored: DataFrame, id: str = "id") -> DataFrame:
    """The best scored row of each author (the normalised name; none is an author of its own); of equals the smaller id."""
    order = F.struct(F.col("score"), (-F.col(id)).alias("first"))
    rows = scored.withColumn("author_key", T.norm(F.coalesce("author", F.lit(""))))
    return rows.groupBy("author_key").agg(F.max_by(F.struct(*scored.columns), order).alias("row")).select("row.*", "author_key")


def allocated(k: Column, book: Column, fic: Column) -> Column:
    """The slots for books of k, in proportion to a library's mix."""
    return F.when(book + fic == 0, k).otherwise(F.floor(book / F.greatest(book + fic, F.lit(1)) * k + 0.5)).cast("long")


def floored(book: Column, fic: Column, floor: int, has_book: Column, has_fic: Column) -> Column:
    """struct(book, fic) with each side at floor, as far as it has candidates and the other can spare slots."""
    least_b, least_f = F.least(F.lit(floor), has_book), F.least(F.lit(floor), has_fic)
    take = F.when(book < least_b, F.least(least_b - book, F.greatest(F.lit(0), fic - least_f))).otherwise(0)
    b, f = book + take, fic - take
    back = F.when(f < least_f, F.least(least_f - f, F.greatest(F.lit(0), b - least_b))).otherwise(0)
    return F.struct((b - back).cast("long").alias("book"), (f + back).cast("long").alias("fic"))


def blended(scored: DataFrame, fits: DataFrame, weight: float, group: str = "bucket") -> DataFrame:
    """Scores of the rows that have a fit: a part of it, stretched over the scores of their group (or as it is, where
    these are all equal)."""
    ends = written(scored.groupBy(group).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("met")))
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span > 0, F.col("lo") + F.col("fit") * span).otherwise(F.col("fit"))
    new = F.when(F.col("fit").isNull(), F.col("score")).otherwise((1 - weight) * F.col("score") + weight * scaled)
    return matched(scored, ends, [group]).join(fits, "id", "left").withColumn("score", new).drop("lo", "hi", "fit")


def rankings(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(id, fit) of replies (seq, reply: a JSON array of id and fit): known ids with a finite fit, within 0 and 1, the first of each."""
    each = replies.select("seq", F.posexplode(F.from_json("reply", "array<struct<id: long, fit: double>>")).alias("at", "r")).select("seq", "at", "r.id", "r.fit")
    good = each.filter(F.col("fit").isNotNull() & ~F.isnan("fit") & (F.abs("fit") != float("inf"))).join(known.select("id").distinct(), "id", "left_semi")
    return good.groupBy("id").agg(F.min_by("fit", F.struct("seq", "at")).alias("fit")).withColumn("fit", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fit"))))


def merged_terms(lists: DataFrame) -> DataFrame:
    """(term, weight) summed over lists."""
    return lists.groupBy("term").agg(F.sum("weight").alias("weight"))


def seed_queries(sources: DataFrame, subjects: int, authors: int) -> DataFrame:
    """The heaviest subjects and authors of liked sources (weight, tags, author, seq) as fielded queries; terms are one in
    any case, written as first seen, without quotes."""
    liked = sources.filter("weight > 0")
    tags = liked.select(F.lit("subject").alias("kind"), "weight", "seq", F.posexplode("tags").alias("at", "term"))
    names = liked.filter(F.col("author").isNotNull()).select(F.lit("author").alias("kind"), "weight", "seq", F.lit(0).alias("at"), F.col("author").alias("term"))
    terms = tags.unionByName(names).withColumn("term", T.collapse(F.regexp_replace("term", '"', " "))).filter("term <> ''")
    sums = terms.groupBy("kind", F.lower("term").alias("k")).agg(F.sum("weight").alias("weight"), F.min_by("term", F.struct("seq", "at")).alias("term"))
    order = F.desc(F.round("weight", 9)), F.asc("term")
    # each kind is cut by its own limit, task by task; only what is left is ranked
    best = [sums.filter(F.col("kind") == kind).orderBy(*order).limit(most) for kind, most in (("subject", subjects), ("author", authors))]
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    return best[0].unionByName(best[1]).withColumn("place", place).select("kind", "term", F.concat("kind", F.lit(':"'), "term", F.lit('"')).alias("q"), "weight", "place")


def length_profile(meta: DataFrame, least: int = 3, long: int = 40_000, short: int = 20_000, skew: float = 0.7) -> DataFrame:
    """A floor or ceiling of words, and whether only complete works are wanted, where a clear share of the liked ones agree."""
    w, s = F.col("words"), F.col("status")
    n, m = F.count_if(w > 0), F.count_if(F.coalesce(s != "", F.lit(False)))
    share = lambda c, of: F.count_if(c) / F.greatest(of, F.lit(1))
    floor = (n >= least) & (share((w > 0) & (w >= long), n) >= skew)
    ceil = (n >= least) & ~(share((w > 0) & (w >= long), n) >= skew) & (share((w > 0) & (w < short), n) >= skew)
    return meta.agg(F.when(floor, long).alias("word_floor"), F.when(ceil, short).alias("word_ceil"), ((m >= least) & (share(s == "complete", m) >= skew)).alias("complete_only"))
