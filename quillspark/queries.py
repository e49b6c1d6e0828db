"""Registered queries of the library's operators, by the IDs of the survey, and the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import library, merge, search, stats, vectors
from .plans import binding as B
from .registry import AS_OF, AS_OF_DAY, ORACLES, QUERIES, query
from .streaming import sessions as streams

def _dated(df: DataFrame, day: str = "day") -> DataFrame:
    """Dates as text, which both engines write alike."""
    return df.withColumn(day, F.col(day).cast("string"))


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return stats.recorded(B.sessions(s, d))


DEPTH = "least(coalesce(max_scroll, scroll, 0), 1)"
BARE = "id, title, author, content_type, word_count, date_saved"


@query(f"SELECT {BARE} FROM items WHERE deleted_at IS NULL")
def a2_live_items(s, d):
    return library.live(B.items(s, d)).select(*BARE.split(", "))


@query("SELECT id, deleted_at FROM items WHERE deleted_at IS NOT NULL AND purged_at IS NULL")
def a3_trash(s, d):
    return library.trash(B.items(s, d)).select("id", "deleted_at")


@query(f"SELECT id, deleted_at FROM items WHERE purged_at IS NULL AND deleted_at < {AS_OF + 2 * B.DAY - 30 * B.DAY}")
def a4_expired_trash(s, d):
    return library.expired(B.items(s, d), AS_OF + 2 * B.DAY).select("id", "deleted_at")


@query("SELECT id, sha256(text) AS hash FROM items WHERE sha256(text) = (SELECT sha256(text) FROM documents ORDER BY doc_id LIMIT 1)")
def a5_lookup_by_hash(s, d):
    first = B.table(s, d, "documents").orderBy("doc_id").limit(1).select(F.sha2("text", 256).alias("hash"))
    return B.items(s, d).select("id", F.sha2("text", 256).alias("hash")).join(first, "hash", "left_semi").select("id", "hash")


@query("SELECT id, label FROM vectors WHERE id IN (SELECT id FROM items WHERE deleted_at IS NOT NULL)")
def a6_batched_keys(s, d):
    return B.vectors(s, d).select("id", "label").join(B.items(s, d).filter("deleted_at IS NOT NULL").select("id"), "id", "left_semi")


@query("SELECT item_id, coalesce(status, CASE WHEN coalesce(scroll, 0) <= 0 THEN 'unread' WHEN scroll >= 1 THEN 'finished' ELSE 'reading' END) AS shown, coalesce(status, CASE WHEN greatest(coalesce(max_scroll, 0), coalesce(scroll, 0)) <= 0 THEN 'unread' WHEN greatest(coalesce(max_scroll, 0), coalesce(scroll, 0)) >= 1 THEN 'finished' ELSE 'reading' END) AS taste FROM progress")
def b2_b3_statuses(s, d):
    return B.progress(s, d).select("item_id", stats.shown_status().alias("shown"), stats.taste_status().alias("taste"))


@query("""SELECT i.id, i.title, coalesce(t.tags, []) AS tags FROM items i LEFT JOIN progress p ON p.item_id = i.id
LEFT JOIN (SELECT item_id, list_sort(list(tag)) AS tags FROM item_tags GROUP BY 1) t ON t.item_id = i.id
WHERE deleted_at IS NULL AND id NOT IN (SELECT derived_from FROM items WHERE derived_from IS NOT NULL AND deleted_at IS NULL)
AND coalesce(status, CASE WHEN coalesce(scroll, 0) <= 0 THEN 'unread' WHEN scroll >= 1 THEN 'finished' ELSE 'reading' END) = 'reading'
AND content_type IN ('epub', 'pdf') AND list_has_any(coalesce(t.tags, []), ['Brand#12', 'Brand#23', 'Brand#34'])""")
def b5_library_filter(s, d):
    out = library.filtered(B.items(s, d), B.progress(s, d), B.item_tags(s, d), "reading", ["Brand#12", "Brand#23", "Brand#34"], ["epub", "pdf"])
    return out.select("id", "title", "tags")


@query("""SELECT id, CASE WHEN x IS NULL OR isnan(x) THEN NULL ELSE least(5.0, greatest(0.0, floor(x / 50 * 2 + 0.5) / 2)) END AS rating, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE least(1.0, greatest(0.0, x / 100)) END AS progress
FROM (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 5 = 0 THEN -value ELSE value END AS x FROM events)""", views=False)
def b14_clamps(s, d):
    e, v = F.col("event_id"), F.col("value")
    x = F.when(e % 7 == 0, F.lit(None)).when(e % 11 == 0, float("nan")).when(e % 5 == 0, -v).otherwise(v)
    return B.table(s, d, "events").select(e.alias("id"), x.alias("x")).select("id", T.clamp_rating(F.col("x") / 50).alias("rating"), T.clamp_progress(F.col("x") / 100).alias("progress"))


@query("SELECT id, item_id, started_at, duration FROM kept")
def b15_sessions(s, d):
    return _sessions(s, d)


@query("SELECT i.id, i.title, p.scroll, p.status, p.last_read_at FROM items i LEFT JOIN progress p ON p.item_id = i.id WHERE deleted_at IS NULL")
def c1_items_progress(s, d):
    return library.with_progress(library.live(B.items(s, d)), B.progress(s, d)).select("id", "title", "scroll", "status", "last_read_at")


@query("SELECT i.id, coalesce(list_sort(list(DISTINCT tag) FILTER (tag IS NOT NULL)), []) AS tags FROM items i LEFT JOIN item_tags t ON t.item_id = i.id GROUP BY 1")
def c6_nested_tags(s, d):
    return library.nested_tags(B.items(s, d).select("id"), B.item_tags(s, d))


@query("SELECT id FROM items WHERE deleted_at IS NULL AND id NOT IN (SELECT id FROM vectors WHERE owned) AND id NOT IN (SELECT item_id FROM item_tags WHERE tag = 'Brand#12')")
def c12_backfill_worklist(s, d):
    out = library.live(B.items(s, d)).select("id").join(B.vectors(s, d).filter("owned").select("id"), "id", "left_anti")
    return out.join(B.item_tags(s, d).filter("tag = 'Brand#12'").select(F.col("item_id").alias("id")), "id", "left_anti")


_TOKENS = "list_distinct(list_filter(string_split(lower(title), ' '), lambda t: t <> '' AND t NOT IN ('the', 'a', 'an', 'of', 'and', 'or', 'to', 'in', 'on', 'for', 'with', 'by', 'at', 'from', 'oceanofpdf', 'com', 'www', 'http', 'https', 'pdf', 'epub', 'mobi', 'azw3', 'ebook')))"


@query(f"""SELECT c.id FROM (SELECT id, {_TOKENS} AS tokens FROM candidates) c WHERE NOT (len(tokens) >= 2 OR (len(tokens) = 1 AND length(tokens[1]) >= 5)) OR NOT EXISTS (SELECT 1 FROM (SELECT {_TOKENS} AS own FROM candidates WHERE owned) o WHERE list_has_all(own, c.tokens))""")
def c14_fuzzy_containment(s, d):
    rows = B.candidates(s, d).select("id", "title", "owned")
    return library.not_contained(rows, rows.filter("owned")).select("id")


@query("SELECT coalesce(derived_from, id) AS family, max(coalesce(scroll, 0)) AS scroll, count(*) AS members, bool_or(coalesce(status = 'finished', false)) AS finished FROM items i LEFT JOIN progress p ON p.item_id = i.id GROUP BY 1")
def c21_d17_families(s, d):
    return library.families(B.items(s, d), B.progress(s, d))


@query("SELECT cast(coalesce(sum(duration), 0) AS BIGINT) AS total_ms, count(DISTINCT item_id) AS items_started, (SELECT count(*) FROM progress WHERE scroll >= 1 OR status = 'finished') AS items_finished FROM kept")
def d1_d3_totals(s, d):
    return stats.totals(_sessions(s, d), B.progress(s, d))


@query(f"SELECT cast(coalesce(sum(cast(trunc(word_count * {DEPTH}) AS BIGINT)), 0) AS BIGINT) AS words_read FROM items JOIN progress ON item_id = id")
def d4_words_read(s, d):
    return stats.words_read(B.items(s, d), B.progress(s, d))


@query("SELECT cast(cast(make_timestamp(started_at * 1000) AS DATE) AS VARCHAR) AS day, cast(sum(duration) AS BIGINT) AS total_ms FROM kept GROUP BY 1")
def d5_timeline(s, d):
    return _dated(stats.timeline(_sessions(s, d)))


@query(f"""SELECT id, title, total_ms, n_sessions, CASE WHEN word_count > 0 AND total_ms >= 60000 AND {DEPTH} > 0 THEN round(word_count * {DEPTH} / (total_ms / 60000), 1) END AS wpm
FROM items JOIN (SELECT item_id, cast(sum(duration) AS BIGINT) AS total_ms, count(*) AS n_sessions FROM kept GROUP BY 1) s ON s.item_id = id LEFT JOIN progress p ON p.item_id = id""")
def d6_stats_by_item(s, d):
    return stats.by_item(B.items(s, d), B.progress(s, d), _sessions(s, d))


@query(f"""SELECT * FROM (SELECT cast(coalesce(sum(duration), 0) AS BIGINT) AS total_ms, count(DISTINCT item_id) AS items_started FROM kept),
(SELECT count(*) AS items_finished FROM progress WHERE scroll >= 1 OR status = 'finished'),
(SELECT cast(coalesce(sum(cast(trunc(word_count * {DEPTH}) AS BIGINT)), 0) AS BIGINT) AS words_read FROM items JOIN progress ON item_id = id),
(SELECT count(*) AS days_read, max(t) AS best_day_ms FROM (SELECT cast(sum(duration) AS BIGINT) AS t FROM kept GROUP BY started_at // 86400000)),
(SELECT item_id AS top_item FROM kept GROUP BY 1 ORDER BY sum(duration) DESC, item_id LIMIT 1)""")
def d7_dashboard(s, d):
    return stats.dashboard(B.items(s, d), B.progress(s, d), _sessions(s, d))


@query("SELECT tag, count(*) AS n FROM item_tags GROUP BY 1")
def d8_tag_counts(s, d):
    return B.item_tags(s, d).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT content_type, count(*) FILTER (deleted_at IS NULL) AS live, count(*) FILTER (deleted_at IS NOT NULL AND purged_at IS NULL) AS trashed, count(*) FILTER (purged_at IS NOT NULL) AS purged FROM items GROUP BY 1")
def d9_state_pivot(s, d):
    state = F.when(F.col("purged_at").isNotNull(), "purged").when(F.col("deleted_at").isNotNull(), "trashed").otherwise("live")
    return B.items(s, d).withColumn("state", state).groupBy("content_type").pivot("state", ["live", "trashed", "purged"]).count().na.fill(0)


@query("SELECT author, count(*) AS n FROM items WHERE deleted_at IS NULL GROUP BY 1")
def d11_author_counts(s, d):
    return library.live(B.items(s, d)).groupBy("author").agg(F.count("*").alias("n"))


@query("SELECT tag FROM item_tags WHERE item_id IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT item_id) = 3")
def d14_universal_tags(s, d):
    return library.universal_tags(B.item_tags(s, d), [1, 2, 3])


@query("SELECT lower(tag) AS term, round(sum(rating), 6) AS weight, min(tag) AS casing FROM item_tags JOIN items ON id = item_id WHERE rating > 3.5 GROUP BY 1")
def d19_weighted_terms(s, d):
    liked = B.items(s, d).filter("rating > 3.5").select("id", "rating")
    joined = B.item_tags(s, d).join(liked, F.col("id") == F.col("item_id"))
    return joined.groupBy(F.lower("tag").alias("term")).agg(F.round(F.sum("rating"), 6).alias("weight"), F.min("tag").alias("casing"))


@query("SELECT label, list(round(s / n, 6) ORDER BY i) AS centroid FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY label)) AS n FROM (SELECT label, i, sum(cast(x AS DOUBLE) * (1 + id % 3)) AS s FROM (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY 1, 2)) GROUP BY 1")
def d23_weighted_mean(s, d):
    rows = B.vectors(s, d).withColumn("w", 1 + F.col("id") % 3)
    return vectors.weighted_mean(rows, "v", "w", "label").select("label", F.transform("centroid", lambda x: vectors.rounded(x, 6)).alias("centroid"))


@query(f"""SELECT item_id, max(n) AS longest, coalesce(max(n) FILTER (last BETWEEN DATE '{AS_OF_DAY}' - 1 AND DATE '{AS_OF_DAY}'), 0) AS current FROM
(SELECT item_id, count(*) AS n, max(day) AS last FROM (SELECT *, day - cast(row_number() OVER (PARTITION BY item_id ORDER BY day) AS INTEGER) AS g FROM
(SELECT DISTINCT item_id, cast(make_timestamp(started_at * 1000) AS DATE) AS day FROM kept)) GROUP BY item_id, g) GROUP BY 1""")
def e1_e2_streaks(s, d):
    return stats.streaks(_sessions(s, d), AS_OF_DAY)


@query("""SELECT user_id, cast(g AS BIGINT) AS segment, min(ms) AS "start", max(ms) + 60000 AS "end", count(*) AS n_events FROM
(SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS g FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > 600000 THEN 1 ELSE 0 END AS cut FROM moments)) GROUP BY user_id, g""")
def e3_segments(s, d):
    return stats.segments(B.moments(s, d))


@query(f"""SELECT cast(day AS VARCHAR) AS day, coalesce(total_ms, 0) AS total_ms, CASE WHEN coalesce(total_ms, 0) <= 0 THEN 0 WHEN total_ms < 900000 THEN 1 WHEN total_ms < 1800000 THEN 2 WHEN total_ms < 3600000 THEN 3 ELSE 4 END AS level FROM
(SELECT cast(unnest(generate_series(DATE '{AS_OF_DAY}' - 59, DATE '{AS_OF_DAY}', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN
(SELECT cast(make_timestamp(started_at * 1000) AS DATE) AS day, cast(sum(duration) AS BIGINT) AS total_ms FROM kept GROUP BY 1) USING (day)""")
def e4_e6_heatmap(s, d):
    return _dated(stats.filled(stats.timeline(_sessions(s, d)), AS_OF_DAY, 60))


@query("SELECT author, id, word_count, cast(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY word_count DESC, id) AS r FROM items WHERE deleted_at IS NULL) WHERE r <= 3")
def e9_top_per_author(s, d):
    live = library.live(B.items(s, d)).select("author", "id", "word_count")
    return library.top_per(live, "author", [F.desc("word_count"), F.col("id")], 3)


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER w - 1, 99) AS last_page, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", views=False)
def e13_e15_e19_chapters(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(so_far)
    return B.table(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.lead("turn").over(w) - 1, F.lit(99)).alias("last_page"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("start_char"), section.alias("section"))


@query("SELECT hash, min(id) AS id, count(*) AS copies FROM (SELECT id, sha256(text) AS hash FROM items WHERE deleted_at IS NULL) GROUP BY 1")
def g8_h5_import_dedup(s, d):
    return library.live(B.items(s, d)).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


@query("SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM part")
def h1_norm(s, d):
    return B.table(s, d, "part").select(F.col("p_partkey").alias("id"), T.norm(F.col("p_name")).alias("norm"))


@query("SELECT id, word_count FROM items")
def h3_word_count(s, d):
    return B.items(s, d).select("id", "word_count")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&#39;|&apos;', '''', 'gi'), '\\s+', ' ', 'g')) || ' <b>' AS text FROM pages""")
def h9_html_to_text(s, d):
    html = F.concat("html", F.lit(" &amp;lt;b&amp;GT;"))
    return B.table(s, d, "pages").select("page_id", T.html_to_text(html).alias("text"))


@query("SELECT url, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, lower(regexp_extract(b, '^([A-Za-z]+://[^/?]*)', 1)) || regexp_replace(substr(b, length(regexp_extract(b, '^([A-Za-z]+://[^/?]*)', 1)) + 1), '/+$', '') AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages)) GROUP BY 1")
def g9_h13_canonical_urls(s, d):
    return B.table(s, d, "pages").groupBy(T.canonical_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query("SELECT period, cast(d AS VARCHAR) AS start, count(*) AS n, cast(sum(duration) AS BIGINT) AS total_ms FROM (SELECT unnest(['daily', 'weekly', 'monthly', 'yearly']) AS period, unnest([date_trunc('day', t)::DATE, date_trunc('week', t)::DATE, date_trunc('month', t)::DATE, date_trunc('year', t)::DATE]) AS d, duration FROM (SELECT make_timestamp(started_at * 1000) AS t, duration FROM kept)) GROUP BY 1, 2")
def h26_d15_periods(s, d):
    names = ("daily", "weekly", "monthly", "yearly")
    starts = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), stats.period_start("started_at", p).alias("start")) for p in names)))
    return _dated(_sessions(s, d).select(starts.alias("p"), "duration").groupBy("p.period", "p.start").agg(F.count("*").alias("n"), F.sum("duration").alias("total_ms")), "start")


@query("SELECT event_type, count(*) AS n, cast(sum(cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def h22_json(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return B.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


_SYNC = """l AS (SELECT c_custkey, c_name, c_acctbal, c_custkey % 97 AS updated_at, c_custkey % 11 = 0 AS dirty FROM customer WHERE c_custkey % 5 <> 0),
r AS (SELECT c_custkey, c_name, c_acctbal + c_custkey % 4 AS c_acctbal, c_custkey % 89 AS updated_at FROM customer WHERE c_custkey % 3 <> 0)"""


@query(f"""SELECT c_custkey, action, CASE WHEN action IN ('apply', 'merge') THEN rn ELSE ln END AS c_name, greatest(la, ra) AS c_acctbal FROM (WITH {_SYNC}
SELECT r.c_custkey, r.c_name AS rn, l.c_name AS ln, r.c_acctbal AS ra, l.c_acctbal AS la, CASE WHEN l.c_custkey IS NULL THEN 'apply' WHEN l.dirty THEN 'skip_dirty'
WHEN r.updated_at > l.updated_at OR (r.updated_at = l.updated_at AND '["' || r.c_name || '","' || cast(r.c_acctbal AS VARCHAR) || '"]' > '["' || l.c_name || '","' || cast(l.c_acctbal AS VARCHAR) || '"]') THEN 'merge' ELSE 'keep' END AS action FROM r LEFT JOIN l ON l.c_custkey = r.c_custkey)""", views=False)
def i10_i12_pull(s, d):
    k = F.col("c_custkey")
    c = B.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    local = c.filter(k % 5 != 0).withColumn("updated_at", k % 97).withColumn("dirty", k % 11 == 0)
    remote = c.filter(k % 3 != 0).withColumn("c_acctbal", F.col("c_acctbal") + k % 4).withColumn("updated_at", k % 89)
    return merge.plan_pull(local, remote, "c_custkey", ["c_name", "c_acctbal"], ("c_acctbal",))


@query("SELECT p_partkey AS id, p_type AS name, min(p_partkey) OVER (PARTITION BY p_type) AS survivor, p_partkey = min(p_partkey) OVER (PARTITION BY p_type) AS survives FROM part", views=False)
def i14_natural_keys(s, d):
    return merge.natural_keys(B.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), "id", "name")


@query("""SELECT hash, CASE WHEN u AND o IS NOT NULL THEN 'unmark' WHEN u THEN 'keep' WHEN o IS NULL THEN 'mark' WHEN o < 500 THEN 'reap' ELSE 'wait' END AS action FROM
(SELECT hash, o, hash IN (SELECT sha256(text) FROM items WHERE purged_at IS NULL AND id % 4 <> 0) AS u FROM (SELECT sha256(text) AS hash, min(CASE WHEN id % 3 = 0 THEN id END) AS o FROM items GROUP BY 1))""")
def i19_sweep(s, d):
    i = B.items(s, d).withColumn("hash", F.sha2("text", 256))
    ledger = i.groupBy("hash").agg(F.min(F.when(F.col("id") % 3 == 0, F.col("id"))).alias("orphaned_at"))
    return merge.sweep(ledger, i.filter("purged_at IS NULL AND id % 4 <> 0"), 1000, 500)


@query("""SELECT id, round(least(1.0, greatest(-1.0, b2 + CASE WHEN has_review THEN 0.1 * sign(b2) ELSE 0 END)), 6) AS affinity FROM (SELECT *, CASE WHEN b > 0 THEN b * (1 + 0.3 * least(1.0, coalesce(minutes, 0) / 60)) ELSE b END AS b2 FROM
(SELECT i.id, has_review, minutes, CASE WHEN rating IS NOT NULL THEN (rating - 3.5) / 1.5 WHEN status = 'finished' THEN 0.6 WHEN status = 'reading' THEN 0.3 WHEN status = 'dropped' THEN -0.5 ELSE 0.0 END AS b FROM items i LEFT JOIN progress p ON p.item_id = i.id
LEFT JOIN (SELECT item_id, sum(duration) / 60000 AS minutes FROM kept GROUP BY 1) m ON m.item_id = i.id WHERE deleted_at IS NULL))""")
def j3_j4_affinity(s, d):
    minutes = stats.per_item(_sessions(s, d)).select(F.col("item_id").alias("id"), (F.col("total_ms") / 60_000).alias("minutes"))
    signals = library.with_progress(library.live(B.items(s, d)), B.progress(s, d)).join(minutes, "id", "left")
    return signals.select("id", F.round(vectors.affinity(), 6).alias("affinity"))


@query("SELECT doc_id AS id, cast((length(text) - length(replace(lower(text), 'with', ''))) // 4 AS BIGINT) AS n FROM documents WHERE contains(lower(text), 'with')", views=False)
def k5_occurrences(s, d):
    return search.occurrences(B.table(s, d, "documents"), "doc_id", "text", "with")


@query("""SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 60 SECOND AS "end", count(*) AS n_events FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS cut FROM events)) GROUP BY user_id, g""", views=False)
def m1_session_windows(s, d):
    return streams.session_windows(B.table(s, d, "events"))


@query("SELECT cast(cast(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1", views=False)
def m10_daily_totals(s, d):
    return _dated(streams.daily_totals(B.table(s, d, "events"))).withColumn("value", F.round("value", 4))


from . import queries_lists, queries_more, queries_pages, queries_stream, queries_sync, queries_taste, queries_text  # noqa: E402, F401  each registers its queries
