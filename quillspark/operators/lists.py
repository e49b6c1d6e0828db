"""Collections, annotations, goals: filters, joins, counts, and their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .library import live, nested_tags, with_progress
from .stats import finished, period_start, shown_status

DAY = 86_400_000
#: The swatches of highlights in their order (name, dot), and what each color means unless a user says otherwise.
SWATCHES = {"yellow": ("Yellow", "#facc15"), "green": ("Green", "#4ade80"), "blue": ("Blue", "#60a5fa"), "pink": ("Pink", "#f472b6")}
LABELS = {"yellow": "Key quote", "green": "Theme / motif", "blue": "Vocabulary / craft", "pink": "Question"}
#: The color of highlights without one.
DEFAULT_COLOR = "yellow"


def contains(text: Column, part: str) -> Column:
    """Whether text has part, in any case; a null text has only the empty part."""
    return F.lower(F.coalesce(text, F.lit(""))).contains(part.strip().lower())


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """F1 to F8: df with place, its rank (from 1) in the given order over all rows.

    Spark sorts by ranges; a row's place is the number of rows of earlier ranges and its place in its own, so no task
    gets all rows.
    """
    inner = "_m"
    ordered = written(df.orderBy(*order).withColumn(inner, F.monotonically_increasing_id()))
    part = F.shiftright(inner, 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row of each range
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    joined = ordered.join(start, part == F.col("_part"))
    return joined.withColumn("place", F.col("_start") + F.col(inner).bitwiseAND((1 << 33) - 1) + 1).drop(inner, "_part", "_start")


def library_order(sort: str) -> list[Column]:
    """by the given sort; of equals, those saved last come first. Rows without a rating come last either way."""
    keys = {
        "date_saved": [],
        "last_read": [F.desc(F.coalesce("last_read_at", F.lit(0)))],
        "title": [F.asc("title")],
        "word_count": [F.desc(F.coalesce("word_count", F.lit(0)))],
        "progress": [F.desc(F.coalesce("scroll", F.lit(0.0)))],
        "rating_high": [F.desc_nulls_last("rating")],
        "rating_low": [F.asc_nulls_last("rating")],
    }
    return [*keys[sort], F.desc("date_saved")]


def cards(
    items: DataFrame, progress: DataFrame, tags: DataFrame, links: DataFrame, status: str | None = None, collection: int | None = None, any_tags: list[str] | None = None, authors: list[str] | None = None,
    types: list[str] | None = None, query: str = "",
) -> DataFrame:
    """The cards of the library: id, shown_id, title, author, content_type, status, tags. A live item is a card unless it is derived from a live one, whose card
    then shows the last such item (by date, then id). What is shown is filtered by status, collection, tags (any of them), types and text (title,
    author, description or a tag, in any case); authors are those of the cards' own items.
    """
    here = live(items)
    sources = here.select(F.col("id").alias("derived_from"))
    grouped = here.join(sources, "derived_from", "left_semi")
    last = grouped.groupBy(F.col("derived_from").alias("id")).agg(F.max_by("id", F.struct("date_saved", "id")).alias("last"))
    own = here.join(grouped.select("id"), "id", "left_anti").join(last, "id", "left")
    own = own.select("id", F.col("author").alias("own_author"), F.coalesce("last", "id").alias("shown_id"))
    shown = nested_tags(with_progress(here, progress), tags).select(F.col("id").alias("shown_id"), "title", "author", "content_type", "description", shown_status().alias("status"), "tags")
    out = own.join(shown, "shown_id")
    if status:
        out = out.filter(F.col("status") == status)
    if collection is not None:
        out = out.join(links.filter(F.col("deleted_at").isNull() & (F.col("collection_id") == collection)).select(F.col("item_id").alias("shown_id")), "shown_id", "left_semi")
    if any_tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, any_tags))))
    if authors:
        out = out.filter(F.col("own_author").isin(authors))
    if types:
        out = out.filter(F.col("content_type").isin(types))
    if query.strip():
        has = [contains(F.col(c), query) for c in ("title", "author", "description")]
        out = out.filter(has[0] | has[1] | has[2] | F.exists("tags", lambda t: contains(t, query)))
    return out.select("id", "shown_id", "title", "author", "content_type", "status", "tags")


def in_collections(items: DataFrame, links: DataFrame, progress: DataFrame) -> DataFrame:
    """C4: live items of each collection, with progress."""
    own = links.filter("deleted_at IS NULL").select("collection_id", F.col("item_id").alias("id"), "sort_order")
    return with_progress(live(items), progress).join(own, "id")


def collection_order(sort: str = "custom") -> list[Column]:
    """the custom order puts rows without a place last."""
    return [F.asc_nulls_last("sort_order"), F.desc("date_saved")] if sort == "custom" else library_order(sort)


def collection_filter(members: DataFrame, status: str | None = None, types: list[str] | None = None, query: str = "") -> DataFrame:
    """By shown status, types and text of title or author (not of descriptions)."""
    out = members
    if status:
        out = out.filter(F.col("shown") == status)
    if types:
        out = out.filter(F.col("content_type").isin(types))
    return out.filter(contains(F.col("title"), query) | contains(F.col("author"), query)) if query else out


def addable(items: DataFrame, links: DataFrame, collection: int, query: str = "", just_added: tuple[int, ...] = ()) -> DataFrame:
    """Live items that aren't in a collection yet."""
    inside = links.filter((F.col("collection_id") == collection) & F.col("deleted_at").isNull()).select(F.col("item_id").alias("id"))
    out = live(items).join(inside, "id", "left_anti").filter(~F.col("id").isin(list(just_added)))
    return out.filter(contains(F.col("title"), query) | contains(F.col("author"), query)) if query else out


def pickable(items: DataFrame, members: DataFrame) -> DataFrame:
    """Live items that may join a list: neither a member, nor derived from one, nor one's source, nor a sibling."""
    family = F.coalesce("derived_from", "id")
    taken = items.join(members.select(F.col("item_id").alias("id")), "id", "left_semi").select(family.alias("family")).distinct()
    return live(items).withColumn("family", family).join(taken, "family", "left_anti").drop("family")


def next_order(links: DataFrame, base: int, live_only: bool) -> DataFrame:
    """The place that a further item of each collection gets."""
    rows = links.filter("deleted_at IS NULL") if live_only else links
    return rows.groupBy("collection_id").agg((F.coalesce(F.max("sort_order"), F.lit(base - 1)) + 1).alias("next_order"))


def reordered(links: DataFrame, order: DataFrame) -> DataFrame:
    """links (collection_id, item_id, sort_order) with the places of order (collection_id, items: array); others keep theirs."""
    new = order.select("collection_id", F.posexplode("items").alias("at", "item_id"))
    return links.join(new, ["collection_id", "item_id"], "left").withColumn("sort_order", F.coalesce("at", "sort_order")).drop("at")


def companions(items: DataFrame) -> DataFrame:
    """The item derived from each item (the last saved of several)."""
    return live(items).filter(F.col("derived_from").isNotNull()).groupBy(F.col("derived_from").alias("id")).agg(F.max_by("id", F.struct("date_saved", "id")).alias("companion"))


# annotations


def annotation_filter(rows: DataFrame, as_of: int, color: str | None = None, themes: list[str] | None = None, item: int | None = None, days: int | None = None, query: str = "") -> DataFrame:
    """By effective color, any of the themes, book, a window of days, and text of quote or note."""
    out = rows
    if color:
        out = out.filter(F.coalesce("color", F.lit(DEFAULT_COLOR)) == color)
    if themes:
        out = out.filter(F.arrays_overlap("themes", F.array(*map(F.lit, themes))))
    if item is not None:
        out = out.filter(F.col("item_id") == item)
    if days:
        out = out.filter(F.col("created_at") >= as_of - days * DAY)
    both = F.concat(F.coalesce("selected_text", F.lit("")), F.lit(" "), F.coalesce("note_text", F.lit("")))
    return out.filter(contains(both, query)) if query.strip() else out


def reading_order() -> list[Column]:
    """Within a book."""
    return [F.coalesce("chapter", F.lit(-1)), F.col("position"), F.col("created_at"), F.col("id")]


def sections(rows: DataFrame) -> DataFrame:
    """Rows with their place in the book, and the book's newest and oldest stamp."""
    book = Window.partitionBy("item_id")
    return rows.withColumn("place", F.row_number().over(book.orderBy(*reading_order()))).withColumn("newest", F.max("created_at").over(book)).withColumn("oldest", F.min("created_at").over(book))


def section_order(rows: DataFrame, sort: str) -> DataFrame:
    """the books of rows (item_id, title, created_at), with section, their place by title, newest or oldest."""
    books = rows.groupBy("item_id").agg(F.min_by("title", "id").alias("title"), F.max("created_at").alias("newest"), F.min("created_at").alias("oldest"))
    order = {"title": [F.asc("title")], "newest": [F.desc("newest")], "oldest": [F.asc("oldest")]}[sort]
    return placed(books, *order, F.col("item_id")).withColumnRenamed("place", "section")


def theme_choice(themes: DataFrame, query: str) -> DataFrame:
    """The names that have query, and whether to offer a new one (none is equal in any case)."""
    q = query.strip().lower()
    return themes.agg(F.sort_array(F.collect_set(F.when(F.lower("name").contains(q), F.col("name")))).alias("shown"), (~F.coalesce(F.bool_or(F.lower("name") == q), F.lit(False)) & F.lit(bool(q))).alias("offers"))


def _by_color(values: dict[str, str], color: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.coalesce(color, F.lit(DEFAULT_COLOR))]


def swatch(color: Column) -> Column:
    """The dot of a highlight's color; that of the first swatch for an unknown one."""
    return F.coalesce(_by_color({k: dot for k, (_, dot) in SWATCHES.items()}, color), F.lit(next(iter(SWATCHES.values()))[1]))


def category(color: Column, overrides: dict[str, str] | None = None) -> Column:
    """The label of a highlight's color: the user's, else what the color means; the swatch's own name where a user's label is blank, and
    the first swatch's for an unknown color."""
    label = _by_color(LABELS | (overrides or {}), color)
    name = F.coalesce(_by_color({k: n for k, (n, _) in SWATCHES.items()}, color), F.lit(next(iter(SWATCHES.values()))[0]))
    return F.when(label != "", label).otherwise(name)


def location(fraction: Column, page: Column, chapter: Column) -> Column:
    """NN% and the page or chapter; either alone, or nothing."""
    native = F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string"))).when(chapter.isNotNull(), F.concat(F.lit("Ch. "), (chapter + 1).cast("string")))
    share = F.concat(F.floor(fraction * 100 + 0.5).cast("string"), F.lit("%"))
    return F.concat_ws(" · ", share, native)


def exported(rows: DataFrame) -> DataFrame:
    """A Markdown document of each book's quotes and notes, in reading order."""
    quote = F.when(F.col("selected_text").isNotNull(), F.concat(F.lit("> "), F.regexp_replace("selected_text", "\\n", "\n> ")))
    entry = F.concat_ws("\n\n", quote, "note_text")
    listed = F.array_sort(F.collect_list(F.struct(*reading_order()[:3], F.col("id"), entry.alias("entry"))))
    return rows.groupBy("item_id", "title").agg(listed.alias("entries")).select("item_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.array_join(F.transform("entries", lambda e: e["entry"]), "\n\n")).alias("markdown"))


# goals


def goal_values(goals: DataFrame, sessions: DataFrame, progress: DataFrame, as_of: int) -> DataFrame:
    """Of goals by time and by count, the minutes or finished items since the period began, and the percentage."""
    spark = goals.sparkSession
    periods = spark.createDataFrame([(p,) for p in ("daily", "weekly", "monthly", "yearly")], "period string")
    now = periods.withColumn("as_of", F.lit(as_of))
    starts = [now.filter(F.col("period") == p).select("period", F.unix_millis(period_start("as_of", p).cast("timestamp")).alias("since")) for p in ("daily", "weekly", "monthly", "yearly")]
    since = starts[0].unionByName(starts[1]).unionByName(starts[2]).unionByName(starts[3]).collect()  # four rows
    ms = sessions.agg(*(F.sum(F.when(F.col("started_at") >= r["since"], F.col("duration"))).alias(r["period"]) for r in since)).first()
    n = progress.filter(finished()).agg(*(F.count_distinct(F.when(F.col("last_read_at") >= r["since"], F.col("item_id"))).alias(r["period"]) for r in since)).first()
    values = F.broadcast(spark.createDataFrame([(k, p, v) for p in ms.asDict() for k, v in (("time", (ms[p] or 0) // 60_000), ("count", n[p]))], "type string, period string, value long"))
    return goals.join(values, ["type", "period"]).withColumn("percent", percent(F.col("value"), F.col("target")))


def percent(value: Column, whole: Column) -> Column:
    """D33."""
    return F.when(whole > 0, F.least(F.lit(100), F.floor(value / F.when(whole > 0, whole) * 100 + 0.5))).otherwise(0).cast("long")


def list_goals(links: DataFrame, items: DataFrame, progress: DataFrame) -> DataFrame:
    """Of each list, its books (an item and what is derived from it count once): title of the source if that is
    listed, furthest position and whether one of them is finished; and how many of them are."""
    rows = with_progress(live(items), progress).join(links.withColumnRenamed("item_id", "id"), "id")
    source = F.struct(F.when(F.col("derived_from").isNull(), 0).otherwise(1).alias("o"), F.col("title"), F.col("id"))
    done = F.max(F.coalesce("scroll", F.lit(0.0))) >= 1
    books = rows.groupBy("goal_id", F.coalesce("derived_from", "id").alias("family")).agg(
        F.min_by(F.struct("id", "title"), source).alias("book"), F.least(F.lit(1.0), F.max(F.coalesce("scroll", F.lit(0.0)))).alias("scroll"), (done | F.bool_or(F.coalesce(F.col("status") == "finished", F.lit(False)))).alias("finished")
    )
    return books.select("goal_id", "family", F.col("book.id").alias("item_id"), F.col("book.title").alias("title"), "scroll", "finished")
