"""Queries over collections, annotations and goals, and the orders of lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import library, lists, stats
from .plans import binding as B
from .registry import AS_OF, query

SHOWN = "coalesce(status, CASE WHEN coalesce(scroll, 0) <= 0 THEN 'unread' WHEN scroll >= 1 THEN 'finished' ELSE 'reading' END)"
DAY = 86_400_000


@query("SELECT i.id, title, hit FROM (SELECT id, 'id' AS hit FROM items WHERE id = 3 UNION ALL SELECT id, 'hash' FROM items WHERE sha256(text) = (SELECT sha256(text) FROM items WHERE id = 5) UNION ALL SELECT id, 'title' FROM items WHERE title = (SELECT title FROM items WHERE id = 7)) h JOIN items i ON i.id = h.id")
def a5_point_lookups(s, d):
    i = B.items(s, d).withColumn("hash", F.sha2("text", 256))
    by = lambda hit, cond: i.filter(cond).select("id", "title", F.lit(hit).alias("hit"))
    like = lambda c, k: i.join(i.filter(F.col("id") == k).select(c).distinct(), c, "left_semi").select("id", "title", F.lit(c).alias("hit"))
    return by("id", F.col("id") == 3).union(like("hash", 5)).union(like("title", 7))


@query("SELECT page_id, url FROM pages WHERE url = (SELECT url FROM pages ORDER BY page_id LIMIT 1)", views=False)
def a5_lookup_by_url(s, d):
    pages = B.table(s, d, "pages").select("page_id", "url")
    return pages.join(pages.orderBy("page_id").limit(1).select("url"), "url", "left_semi").select("page_id", "url")


@query(f"""SELECT i.id, i.title, p.scroll, CASE WHEN i.id % 5 = 0 THEN 'error' WHEN i.id % 3 = 0 THEN 'pending' END AS backup FROM items i LEFT JOIN progress p ON p.item_id = i.id WHERE deleted_at IS NULL""")
def b1_c26_backup_state(s, d):
    i = B.items(s, d)
    blobs = i.filter("id % 5 = 0 OR id % 3 = 0").select(F.sha2(F.concat(F.col("id").cast("string"), F.lit("|"), "text"), 256).alias("blob"), F.when(F.col("id") % 5 == 0, "error").otherwise("pending").alias("backup"))
    hashed = library.with_progress(library.live(i), B.progress(s, d)).withColumn("blob", F.sha2(F.concat(F.col("id").cast("string"), F.lit("|"), "text"), 256))
    return hashed.join(blobs, "blob", "left").select("id", "title", "scroll", "backup")


@query(f"""SELECT collection_id, i.id, title FROM items i JOIN (SELECT * FROM collection_items WHERE deleted_at IS NULL) c ON c.item_id = i.id LEFT JOIN progress p ON p.item_id = i.id
WHERE i.deleted_at IS NULL AND {SHOWN} = 'reading' AND content_type IN ('epub', 'pdf') AND (contains(lower(title), 'the') OR contains(lower(coalesce(author, '')), 'the'))""")
def b6_collection_filter(s, d):
    members = lists.in_collections(B.items(s, d), B.collection_items(s, d), B.progress(s, d)).withColumn("shown", stats.shown_status())
    return lists.collection_filter(members, "reading", ["epub", "pdf"], " THE ").select("collection_id", "id", "title")


@query(f"SELECT id FROM annotations WHERE coalesce(color, 'yellow') = 'yellow' AND list_has_any(themes, ['t0', 'u1']) AND created_at >= {AS_OF - 365 * DAY} AND contains(lower(coalesce(selected_text, '') || ' ' || coalesce(note_text, '')), 'the')")
def b7_annotation_filter(s, d):
    return lists.annotation_filter(B.annotations(s, d), AS_OF, "yellow", ["t0", "u1"], None, 365, "The").select("id")


@query("SELECT author, count(*) AS n FROM items WHERE deleted_at IS NULL AND contains(lower(author), '1') GROUP BY 1")
def b8_author_filter(s, d):
    return library.live(B.items(s, d)).filter(lists.contains(F.col("author"), "1")).groupBy("author").agg(F.count("*").alias("n"))


@query("SELECT id, source, source = 'book' AS books, source <> 'book' AS fanfiction FROM candidates")
def b9_modes(s, d):
    return B.candidates(s, d).select("id", "source", (F.col("source") == "book").alias("books"), (F.col("source") != "book").alias("fanfiction"))


@query("SELECT id FROM items WHERE deleted_at IS NULL AND coalesce(derived_from, id) NOT IN (SELECT coalesce(derived_from, id) FROM items WHERE id IN (SELECT item_id FROM goal_items WHERE goal_id % 3 = 2))")
def b10_pickable(s, d):
    return lists.pickable(B.items(s, d), B.goal_items(s, d).filter("goal_id % 3 = 2")).select("id")


@query("SELECT id FROM items WHERE length(text) >= 200")
def b22_usable(s, d):
    return B.items(s, d).filter(F.length("text") >= 200).select("id")


@query("SELECT id, title FROM items WHERE deleted_at IS NULL AND id NOT IN (SELECT item_id FROM collection_items WHERE collection_id = 4 AND deleted_at IS NULL) AND id NOT IN (1, 2) AND (contains(lower(title), 'an') OR contains(lower(author), 'an'))")
def b23_addable(s, d):
    return lists.addable(B.items(s, d), B.collection_items(s, d), 4, "an", (1, 2)).select("id", "title")


@query("SELECT list_sort(list(DISTINCT name) FILTER (contains(lower(name), 'brand#1'))) AS shown, NOT bool_or(lower(name) = 'brand#1') AS offers FROM (SELECT DISTINCT p_brand AS name FROM part)", views=False)
def b24_theme_choice(s, d):
    return lists.theme_choice(B.table(s, d, "part").select(F.col("p_brand").alias("name")).distinct(), " Brand#1 ")


@query(f"SELECT id, ({AS_OF} - deleted_at) // {DAY} AS days_ago, greatest(0, 30 - ({AS_OF} - deleted_at) // {DAY}) AS days_left FROM items WHERE deleted_at IS NOT NULL AND purged_at IS NULL")
def b25_days_to_purge(s, d):
    age = ((F.lit(AS_OF) - F.col("deleted_at")) / DAY).cast("long")  # whole days towards 0, as SQL's //
    return library.trash(B.items(s, d)).select("id", age.alias("days_ago"), F.greatest(F.lit(0), 30 - age).alias("days_left"))


@query("SELECT t.tag, min(t.color) AS color, count(*) AS n, min(i.title) AS first_title FROM (SELECT item_id, p_brand AS tag, '#' || length(p_brand) AS color FROM (SELECT DISTINCT l_orderkey % 1000 AS item_id, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)) t JOIN items i ON i.id = t.item_id WHERE deleted_at IS NULL GROUP BY 1")
def c3_tags_of_items(s, d):
    tags = B.table(s, d, "part").select(F.col("p_brand").alias("tag")).distinct().withColumn("color", F.concat(F.lit("#"), F.length("tag").cast("string")))
    joined = B.item_tags(s, d).join(F.broadcast(tags), "tag").join(library.live(B.items(s, d)).select("id", "title"), F.col("item_id") == F.col("id"))  # a row of each brand
    return joined.groupBy("tag").agg(F.min("color").alias("color"), F.count("*").alias("n"), F.min("title").alias("first_title"))


@query("SELECT collection_id, i.id, title, scroll, status, sort_order FROM items i JOIN (SELECT * FROM collection_items WHERE deleted_at IS NULL) c ON c.item_id = i.id LEFT JOIN progress p ON p.item_id = i.id WHERE i.deleted_at IS NULL")
def c4_collection_items(s, d):
    return lists.in_collections(B.items(s, d), B.collection_items(s, d), B.progress(s, d)).select("collection_id", "id", "title", "scroll", "status", "sort_order")


@query("SELECT a.id, i.title, i.author, a.chapter FROM annotations a JOIN items i ON i.id = a.item_id WHERE i.deleted_at IS NULL")
def c5_annotations_items(s, d):
    items = library.live(B.items(s, d)).select(F.col("id").alias("item_id"), "title", "author")
    return B.annotations(s, d).join(items, "item_id").select("id", "title", "author", "chapter")


@query("SELECT goal_id, i.id AS item_id, title, scroll, status FROM goal_items g JOIN items i ON i.id = g.item_id LEFT JOIN progress p ON p.item_id = i.id WHERE i.deleted_at IS NULL")
def c7_goal_items(s, d):
    rows = library.with_progress(library.live(B.items(s, d)), B.progress(s, d)).withColumnRenamed("id", "item_id")
    return B.goal_items(s, d).join(rows, "item_id").select("goal_id", "item_id", "title", "scroll", "status")


@query(""", here AS (SELECT *, substr(text, 60, 80) AS description FROM items WHERE deleted_at IS NULL),
grouped AS (SELECT l.* FROM here l JOIN here s ON s.id = l.derived_from),
last AS (SELECT derived_from AS id, arg_max(id, (date_saved, id)) AS last FROM grouped GROUP BY 1),
t AS (SELECT item_id, list_sort(list(DISTINCT tag)) AS tags FROM item_tags GROUP BY 1),
cards AS (SELECT i.id, d.id AS shown_id, i.author AS own_author, d.title, d.author, d.content_type, d.description, coalesce(t.tags, []) AS tags,
  coalesce(p.status, CASE WHEN coalesce(p.scroll, 0) <= 0 THEN 'unread' WHEN p.scroll >= 1 THEN 'finished' ELSE 'reading' END) AS status
  FROM here i LEFT JOIN last ON last.id = i.id JOIN here d ON d.id = coalesce(last.last, i.id) LEFT JOIN t ON t.item_id = d.id LEFT JOIN progress p ON p.item_id = d.id WHERE i.id NOT IN (SELECT id FROM grouped))
SELECT 'a' AS view, id, shown_id, title, status, tags FROM cards WHERE status = 'unread' AND list_has_any(tags, ['Brand#12', 'Brand#23', 'Brand#34'])
UNION ALL SELECT 'b', id, shown_id, title, status, tags FROM cards WHERE shown_id IN (SELECT item_id FROM collection_items WHERE collection_id = 3 AND deleted_at IS NULL) AND content_type IN ('epub', 'pdf')
UNION ALL SELECT 'c', id, shown_id, title, status, tags FROM cards WHERE own_author IN ('src1', 'src2', 'src3', 'src4', 'src5') AND (contains(lower(title), 'and') OR contains(lower(author), 'and') OR contains(lower(description), 'and') OR len(list_filter(tags, lambda x: contains(lower(x), 'and'))) > 0)
UNION ALL SELECT 'd', id, shown_id, title, status, tags FROM cards WHERE contains(lower(title), 'her') OR contains(lower(author), 'her') OR contains(lower(coalesce(description, '')), 'her') OR len(list_filter(tags, lambda x: contains(lower(x), 'her'))) > 0""")
def b5_cards(s, d):
    """Four views of the library: by status and tags, by collection and type, by author and text, by text alone."""
    tables = B.items(s, d).withColumn("description", F.substring("text", 60, 80)), B.progress(s, d), B.item_tags(s, d), B.collection_items(s, d)
    views = {
        "a": {"status": "unread", "any_tags": ["Brand#12", "Brand#23", "Brand#34"]}, "b": {"collection": 3, "types": ["epub", "pdf"]},
        "c": {"authors": ["src1", "src2", "src3", "src4", "src5"], "query": " AND "}, "d": {"query": "Her"},
    }
    rows = [lists.cards(*tables, **v).select(F.lit(n).alias("view"), "id", "shown_id", "title", "status", "tags") for n, v in views.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT derived_from AS id, arg_max(id, (date_saved, id)) AS companion FROM items WHERE derived_from IS NOT NULL AND deleted_at IS NULL GROUP BY 1")
def c22_companions(s, d):
    return lists.companions(B.items(s, d))


@query("SELECT sum(n) AS dirty FROM (SELECT count(*) AS n FROM items WHERE id % 4 = 0 UNION ALL SELECT count(*) FROM annotations WHERE id % 3 = 0 UNION ALL SELECT count(*) FROM collection_items WHERE item_id % 5 = 0)")
def d10_dirty_rows(s, d):
    counts = [t.agg(F.count_if(c).alias("n")) for t, c in ((B.items(s, d), F.col("id") % 4 == 0), (B.annotations(s, d), F.col("id") % 3 == 0), (B.collection_items(s, d), F.col("item_id") % 5 == 0))]
    return counts[0].union(counts[1]).union(counts[2]).agg(F.sum("n").cast("decimal(38,0)").alias("dirty"))


@query("SELECT collection_id, count(*) AS n FROM collection_items c JOIN items i ON i.id = c.item_id WHERE c.deleted_at IS NULL AND i.deleted_at IS NULL GROUP BY 1")
def d12_collection_counts(s, d):
    own = library.live(B.items(s, d)).select(F.col("id").alias("item_id"))
    return B.collection_items(s, d).filter("deleted_at IS NULL").join(own, "item_id").groupBy("collection_id").agg(F.count("*").alias("n"))


@query("SELECT author, row_number() OVER (ORDER BY author) AS place FROM (SELECT DISTINCT author FROM items WHERE deleted_at IS NULL AND author IS NOT NULL)")
def d13_distinct_authors(s, d):
    return lists.placed(library.live(B.items(s, d)).filter("author IS NOT NULL").select("author").distinct(), F.col("author"))


_SINCE = f"(SELECT epoch_ms(date_trunc(CASE period WHEN 'daily' THEN 'day' WHEN 'weekly' THEN 'week' WHEN 'monthly' THEN 'month' ELSE 'year' END, make_timestamp({AS_OF} * 1000)))) "


@query(f"""SELECT goal_id, type, period, target, value, CASE WHEN target > 0 THEN least(100, cast(floor(value / target * 100 + 0.5) AS BIGINT)) ELSE 0 END AS percent FROM (SELECT g.*, CASE WHEN type = 'time'
THEN (SELECT cast(coalesce(sum(duration), 0) AS BIGINT) // 60000 FROM kept WHERE started_at >= since) ELSE (SELECT count(DISTINCT item_id) FROM progress WHERE (scroll >= 1 OR status = 'finished') AND last_read_at >= since) END AS value
FROM (SELECT *, {_SINCE} AS since FROM goals) g WHERE type <> 'list')""")
def d15_d16_d33_goals(s, d):
    return lists.goal_values(B.goals(s, d), stats.recorded(B.sessions(s, d)), B.progress(s, d), AS_OF).select("goal_id", "type", "period", "target", "value", "percent")


@query("""SELECT goal_id, family, arg_min(id, (derived_from IS NOT NULL, title, id)) AS item_id, arg_min(title, (derived_from IS NOT NULL, title, id)) AS title, least(1.0, max(coalesce(scroll, 0))) AS scroll, max(coalesce(scroll, 0)) >= 1 OR bool_or(coalesce(status = 'finished', false)) AS finished
FROM (SELECT goal_id, i.id, i.title, derived_from, coalesce(derived_from, i.id) AS family, scroll, status FROM goal_items g JOIN items i ON i.id = g.item_id LEFT JOIN progress p ON p.item_id = i.id WHERE i.deleted_at IS NULL) GROUP BY 1, 2""")
def d17_list_goals(s, d):
    return lists.list_goals(B.goal_items(s, d), B.items(s, d), B.progress(s, d))


@query("SELECT i.id, coalesce(list_sort(list(DISTINCT collection_id) FILTER (collection_id IS NOT NULL)), []) AS collections FROM items i LEFT JOIN (SELECT * FROM collection_items WHERE deleted_at IS NULL) c ON c.item_id = i.id GROUP BY 1")
def d18_nested_collections(s, d):
    own = B.collection_items(s, d).filter("deleted_at IS NULL").groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_set("collection_id")).alias("collections"))
    return B.items(s, d).select("id").join(own, "id", "left").withColumn("collections", F.coalesce("collections", F.array().cast("array<bigint>")))


@query("SELECT collection_id, coalesce(max(sort_order), 0) + 1 AS next_all, coalesce(max(sort_order) FILTER (deleted_at IS NULL), -1) + 1 AS next_live FROM collection_items GROUP BY 1")
def d29_next_order(s, d):
    links = B.collection_items(s, d)
    live = lists.next_order(links, 0, True).withColumnRenamed("next_order", "next_live")
    both = lists.next_order(links, 1, False).withColumnRenamed("next_order", "next_all").join(live, "collection_id", "left")
    return both.select("collection_id", "next_all", F.coalesce("next_live", F.lit(0)).alias("next_live"))


@query("""SELECT id, item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY coalesce(chapter, -1), position, created_at, id) AS INTEGER) AS place, max(created_at) OVER (PARTITION BY item_id) AS newest, min(created_at) OVER (PARTITION BY item_id) AS oldest FROM annotations""")
def d31_e11_sections(s, d):
    return lists.sections(B.annotations(s, d)).select("id", "item_id", "place", "newest", "oldest")


@query("SELECT a.item_id, min(i.title) AS title FROM annotations a JOIN items i ON i.id = a.item_id GROUP BY 1")
def d32_annotated_books(s, d):
    titles = B.items(s, d).select(F.col("id").alias("item_id"), "title")
    return B.annotations(s, d).select("item_id").distinct().join(titles, "item_id")


def _sorted(name: str, sort: str, order: str) -> None:
    @query(f"SELECT i.id, row_number() OVER (ORDER BY {order}) AS place FROM items i LEFT JOIN progress p ON p.item_id = i.id WHERE deleted_at IS NULL", name=name)
    def run(s, d):
        items = library.with_progress(library.live(B.items(s, d)), B.progress(s, d)).drop("text")
        return lists.placed(items, *lists.library_order(sort), F.col("id")).select("id", "place")


for _name, _sort, _order in (
    ("f1_by_date_saved", "date_saved", "date_saved DESC, id"),
    ("f2_by_last_read", "last_read", "coalesce(last_read_at, 0) DESC, date_saved DESC, id"),
    ("f2_by_title", "title", "title, date_saved DESC, id"),
    ("f2_by_word_count", "word_count", "coalesce(word_count, 0) DESC, date_saved DESC, id"),
    ("f2_by_progress", "progress", "coalesce(scroll, 0) DESC, date_saved DESC, id"),
    ("f2_by_rating_high", "rating_high", "rating DESC NULLS LAST, date_saved DESC, id"),
    ("f2_by_rating_low", "rating_low", "rating ASC NULLS LAST, date_saved DESC, id"),
):
    _sorted(_name, _sort, _order)


@query("SELECT collection_id, i.id, row_number() OVER (PARTITION BY collection_id ORDER BY sort_order NULLS LAST, date_saved DESC, i.id) AS place FROM items i JOIN (SELECT * FROM collection_items WHERE deleted_at IS NULL) c ON c.item_id = i.id WHERE i.deleted_at IS NULL")
def f3_collection_order(s, d):
    rows = lists.in_collections(B.items(s, d), B.collection_items(s, d), B.progress(s, d))
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy(*lists.collection_order(), "id"))
    return rows.select("collection_id", "id", place.cast("long").alias("place"))


@query("SELECT id, row_number() OVER (ORDER BY coalesce(chapter, -1), position, created_at, id) AS place FROM annotations")
def f4_annotation_order(s, d):
    return lists.placed(B.annotations(s, d).select("id", "chapter", "position", "created_at"), *lists.reading_order()).select("id", "place")


_BOOKS = "(SELECT a.item_id, min(title) AS title, max(created_at) AS newest, min(created_at) AS oldest FROM annotations a JOIN items i ON i.id = a.item_id GROUP BY 1)"


@query(f"SELECT item_id, row_number() OVER (ORDER BY title, item_id) AS by_title, row_number() OVER (ORDER BY newest DESC, item_id) AS by_newest, row_number() OVER (ORDER BY oldest, item_id) AS by_oldest FROM {_BOOKS}")
def f5_section_orders(s, d):
    rows = B.annotations(s, d).select("id", "item_id", "created_at").join(B.items(s, d).select(F.col("id").alias("item_id"), "title"), "item_id")
    out = None
    for sort in ("title", "newest", "oldest"):
        one = lists.section_order(rows, sort).select("item_id", F.col("section").alias(f"by_{sort}"))
        out = one if out is None else out.join(one, "item_id")
    return out


@query("SELECT author, n, row_number() OVER (ORDER BY n DESC, author) AS by_count, row_number() OVER (ORDER BY author) AS by_name FROM (SELECT author, count(*) AS n FROM items WHERE deleted_at IS NULL GROUP BY 1)")
def f6_author_orders(s, d):
    counts = library.live(B.items(s, d)).groupBy("author").agg(F.count("*").alias("n"))
    return lists.placed(counts, F.desc("n"), F.col("author")).withColumnRenamed("place", "by_count").join(lists.placed(counts, F.col("author")).select("author", F.col("place").alias("by_name")), "author")


@query("SELECT term, weight, row_number() OVER (ORDER BY weight DESC, term) AS place FROM (SELECT lower(tag) AS term, round(sum(rating), 6) AS weight FROM item_tags JOIN items ON id = item_id WHERE rating > 3.5 GROUP BY 1)")
def f8_seed_order(s, d):
    liked = B.items(s, d).filter("rating > 3.5").select("id", "rating")
    terms = B.item_tags(s, d).join(liked, F.col("id") == F.col("item_id")).groupBy(F.lower("tag").alias("term")).agg(F.round(F.sum("rating"), 6).alias("weight"))
    return lists.placed(terms, F.desc("weight"), F.col("term"))


@query("SELECT id FROM (SELECT id, page FROM (SELECT page_id AS id, page_id % 7 + 1 AS page FROM pages) WHERE page BETWEEN (3 - 1) * 2 + 1 AND 2 * 3)", views=False)
def f12_page_window(s, d):
    n, per = 3, 2
    pages = B.table(s, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 7 + 1).alias("page"))
    return pages.filter(F.col("page").between((n - 1) * per + 1, per * n)).select("id")


@query("SELECT c.collection_id, c.item_id, coalesce(o.at, sort_order) AS sort_order FROM collection_items c LEFT JOIN (SELECT collection_id, item_id, cast(row_number() OVER (PARTITION BY collection_id ORDER BY item_id DESC) - 1 AS BIGINT) AS at FROM collection_items WHERE item_id % 2 = 0) o ON o.collection_id = c.collection_id AND o.item_id = c.item_id")
def f13_reordered(s, d):
    links = B.collection_items(s, d).drop("deleted_at")
    order = links.filter("item_id % 2 = 0").groupBy("collection_id").agg(F.sort_array(F.collect_list("item_id"), asc=False).alias("items"))
    return lists.reordered(links, order).select("collection_id", "item_id", F.col("sort_order").cast("long").alias("sort_order"))


@query("SELECT id, CASE coalesce(color, 'yellow') WHEN 'yellow' THEN 'Quote' WHEN 'green' THEN 'Theme / motif' WHEN 'blue' THEN 'Blue' ELSE 'Yellow' END AS category, CASE color WHEN 'green' THEN '#4ade80' WHEN 'blue' THEN '#60a5fa' ELSE '#facc15' END AS swatch, concat_ws(' · ', floor(position * 100 + 0.5)::BIGINT || '%', CASE WHEN page IS NOT NULL THEN 'p. ' || page WHEN chapter IS NOT NULL THEN 'Ch. ' || (chapter + 1) END) AS location FROM (SELECT *, CASE WHEN id % 2 = 0 THEN id % 90 END AS page FROM (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'mauve' ELSE color END AS color) FROM annotations))")
def h35_h45_labels(s, d):
    page = F.when(F.col("id") % 2 == 0, F.col("id") % 90)
    color = F.when(F.col("id") % 7 == 0, "mauve").otherwise(F.col("color"))
    return B.annotations(s, d).select("id", lists.category(color, {"yellow": "Quote", "blue": ""}).alias("category"), lists.swatch(color).alias("swatch"), lists.location(F.col("position"), page, F.col("chapter")).alias("location"))


@query("""SELECT a.item_id, concat_ws(chr(10) || chr(10), '# ' || min(title), string_agg(CASE WHEN selected_text IS NOT NULL THEN '> ' || replace(selected_text, chr(10), chr(10) || '> ') ELSE note_text END, chr(10) || chr(10) ORDER BY coalesce(chapter, -1), position, created_at, a.id)) AS markdown
FROM annotations a JOIN items i ON i.id = a.item_id GROUP BY 1""")
def a20_h49_markdown(s, d):
    return lists.exported(B.annotations(s, d).join(B.items(s, d).select(F.col("id").alias("item_id"), "title"), "item_id"))
