"""Queries over sites' pages, paging, caps and the whole recommendation."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from .functions import text as T
from .operators import candidates, library, taste, vectors
from .plans import binding as B
from .queries_taste import _scored, _weighted
from .queries_text import _STRIP
from .registry import query


@pandas_udf(BinaryType())
def encoded(v: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else struct.pack(f"<{len(x)}f", *x))


@pandas_udf(ArrayType(FloatType()))
def decoded(b: pd.Series) -> pd.Series:
    """A27."""
    return b.map(lambda x: None if x is None else list(struct.unpack(f"<{len(x) // 4}f", x)))


@query("SELECT id, 256 AS bytes, list_transform(v, lambda x: round(cast(x AS DOUBLE), 6)) AS v FROM vectors")
def a27_codec(s, d):
    rows = B.vectors(s, d).select("id", encoded("v").alias("b"))
    return rows.select("id", F.length("b").alias("bytes"), F.transform(decoded("b"), lambda x: vectors.rounded(x.cast("double"), 6)).alias("v"))


@query("SELECT source, id, score, cast(place AS INTEGER) AS place FROM (SELECT source, id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS place FROM candidates) WHERE place <= 40")
def f10_capped(s, d):
    return library.top_per(B.candidates(s, d).select("source", "id", "score"), "source", [F.desc("score"), F.col("id")], 40).withColumnRenamed("rank", "place")


@query("SELECT id, cast(place AS INTEGER) AS place FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS place FROM candidates WHERE id NOT IN (SELECT id FROM candidates WHERE id % 7 < 3)) WHERE place <= 12")
def f11_next_page(s, d):
    """Of each source, the next cards that haven't been shown."""
    c = B.candidates(s, d).select("source", "id", "score")
    left = c.join(c.filter("id % 7 < 3").select("id"), "id", "left_anti")
    return library.top_per(left, "source", [F.desc("score"), F.col("id")], 12).select("id", F.col("rank").alias("place"))


@query("""SELECT id, CASE WHEN k % 4 > 0 THEN 'T' END AS rating, CASE WHEN k % 3 > 0 THEN k * 1000 END AS words, CASE WHEN k % 5 = 0 THEN 'complete' ELSE 'in-progress' END AS status, CASE WHEN k % 2 = 0 THEN ['Romance', 'Hurt/Comfort'] ELSE ['Drama'] END AS genres, ['A' || k, 'B', 'C'] AS characters, ['A' || k || '/B'] AS pairings
FROM (SELECT event_id AS id, event_id % 60 AS k FROM events)""", views=False)
def h18_story_lines(s, d):
    k = F.col("event_id") % 60
    text = F.concat_ws(
        " - ", F.when(k % 4 > 0, F.lit("Rated:  T")).otherwise(F.lit("id: 5")), F.lit("English"), F.when(k % 2 == 0, "Romance/Hurt/Comfort").otherwise("Drama"), F.concat(F.lit("[A"), k.cast("string"), F.lit(", B] C")),
        F.lit("Chapters: 3"), F.when(k % 3 > 0, F.concat(F.lit("Words: "), F.format_number(k * 1000, 0))), F.when(k % 5 == 0, "Status: Complete"), F.lit("Updated: Jan 1"),
    )
    m = T.story_line(text)
    return B.table(s, d, "events").select(F.col("event_id").alias("id"), m.alias("m")).select("id", *(f"m.{c}" for c in ("rating", "words", "status", "genres", "characters", "pairings")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS top, CASE WHEN p_partkey % 2 = 0 THEN 'y / x' END AS pairing FROM part", views=False)
def h37_autocomplete(s, d):
    p = F.col("p_partkey")
    name = lambda c: F.struct(c.alias("name"))
    reply = F.to_json(F.when(p % 3 > 0, F.array(name(F.lit(" ")), name(F.concat(F.lit(" "), "p_name")))).otherwise(F.array(name(F.lit("")))))
    pairs = F.to_json(F.array(name(F.lit("x & y")), name(F.lit("x/y/z")), name(F.when(p % 2 == 0, "y / x").otherwise("x/x"))))
    return B.table(s, d, "part").select(p.alias("id"), T.top_name(reply).alias("top"), T.pairing_name(pairs, F.lit("x"), F.lit("y")).alias("pairing"))


@query("SELECT id, 'rest of ' || title AS a, CASE WHEN id % 2 = 0 THEN 'rest' ELSE 'other rest' END AS b, 'OEBPS/text/c' || id || '.html' AS path, 'images/i.png' AS up FROM candidates")
def h42_h43_titles_paths(s, d):
    c = B.candidates(s, d)
    i = F.col("id").cast("string")
    headers = F.array_join(F.array_repeat(F.concat(F.upper("title"), F.lit("  "), "title"), (F.col("id") % 6 + 1).cast("int")), " ")
    a = T.without_title(F.concat(headers, F.lit(" rest of "), "title"), F.col("title"))
    b = T.without_title(F.when(F.col("id") % 2 == 0, F.concat(F.upper("title"), F.lit(" "), "title", F.lit(" rest"))).otherwise(F.lit("other rest")), F.col("title"))
    path = T.resolved_path(F.lit("OEBPS/nav/toc.html"), F.concat(F.lit("../text/./c"), i, F.lit(".html#x")))
    return c.select("id", a.alias("a"), b.alias("b"), path.alias("path"), T.resolved_path(F.lit("a.html"), F.lit("../../images/i.png")).alias("up"))


_NAMES = ", ".join(f"'{t}'" for t in T.TAGS)
_HOSTILE = """<p onclick="x()" style="y">t</p><a href="javascript:z()" title="k">u</a><a href='mailto:a'>m</a><blink>v</blink><script>w</script><p/onclick=x()><img src=//h/i.png alt=q><td colspan=2 class=c>"""
_CLEAN = """<p>t</p><a title="k">u</a><a>m</a>v<p><img src="//h/i.png" alt="q" loading="lazy" /><td colspan="2">"""


@query(f"""SELECT page_id, list_reduce(list_prepend('', list_transform(range(1, len(texts) + 1), lambda i: replace(replace(texts[i], '<', '&lt;'), '>', '&gt;') || coalesce(CASE
WHEN NOT list_contains([{_NAMES}], names[i]) THEN '' WHEN starts_with(tags[i], '</') THEN CASE WHEN names[i] IN ('br', 'hr', 'img') THEN '' ELSE '</' || names[i] || '>' END
ELSE '<' || names[i] || CASE WHEN names[i] = 'a' AND regexp_matches(tags[i], ' href="') THEN ' href="' || regexp_extract(tags[i], ' href="([^"]*)"', 1) || '"' ELSE '' END || CASE WHEN names[i] IN ('br', 'hr') THEN ' />' ELSE '>' END END, ''))), lambda a, b: a || b) || '{_CLEAN}' AS clean,
regexp_matches(html, '(?i)<article') AS article FROM (SELECT *, list_transform(tags, lambda t: lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1))) AS names FROM (SELECT page_id, html, regexp_split_to_array(b, '<[^>]*>') AS texts, regexp_extract_all(b, '<[^>]*>') AS tags
FROM (SELECT *, regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS b FROM pages)))""", views=False)
def h11_l2_sanitised(s, d):
    rows = B.table(s, d, "pages").select("page_id", T.sanitised(F.concat("html", F.lit(_HOSTILE))).alias("clean"), "html")
    return rows.select("page_id", "clean", ((F.length(T.article(F.col("html"))) > 0) & F.col("html").rlike("(?i)<article")).alias("article"))


@query(f"SELECT page_id, regexp_extract(x, 'href=\"([^\"]*)\"', 1) AS link, {_STRIP.format('x')} AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>\\s*(<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)', 1)) AS x FROM pages)", views=False)
def l11_list_entries(s, d):
    return B.table(s, d, "pages").select("page_id", F.explode(T.list_entries(F.col("html"))).alias("e")).select("page_id", "e.link", "e.title")


@query("SELECT t.conv_id AS doc, t.turn AS entry, s.turn AS spine FROM (SELECT conv_id, turn, (turn * 3) % 7 AS target FROM conversations) t JOIN (SELECT conv_id, turn FROM conversations) s ON s.conv_id = t.conv_id AND s.turn = t.target", views=False)
def c25_contents(s, d):
    c = B.table(s, d, "conversations").select(F.col("conv_id").alias("doc"), "turn")
    toc = c.select("doc", F.col("turn").alias("entry"), (F.col("turn") * 3 % 7).alias("spine"))
    return toc.join(c.select("doc", F.col("turn").alias("spine")), ["doc", "spine"]).select("doc", "entry", "spine")


@query("SELECT i.id, coalesce(c.subjects[1:2], []) AS subjects, c.id IS NOT NULL AS cached FROM (SELECT p_partkey AS id FROM part WHERE p_partkey % 6 = 0) i LEFT JOIN (SELECT id, subjects FROM candidates WHERE id % 4 > 0) c USING (id)")
def j24_owned_subjects(s, d):
    c = B.candidates(s, d)
    cache = c.filter("id % 4 > 0").select("id", "subjects", F.lit(True).alias("hit"))
    return c.filter("owned").select("id").join(cache, "id", "left").select("id", F.coalesce(F.slice("subjects", 1, 2), F.array().cast("array<string>")).alias("subjects"), F.coalesce("hit", F.lit(False)).alias("cached"))


@query("SELECT tag AS term, count(*) FILTER (site) AS canonical, count(*) FILTER (NOT site) AS raw, bool_and(romance) AS romance_only FROM (SELECT tag, author LIKE '%1%' AS site, i.id % 5 = 0 AS romance FROM item_tags t JOIN items i ON i.id = t.item_id WHERE rating > 3) GROUP BY 1")
def j20_seed_split(s, d):
    liked = B.items(s, d).filter("rating > 3").select("id", F.col("author").contains("1").alias("site"), (F.col("id") % 5 == 0).alias("romance"))
    rows = B.item_tags(s, d).join(liked, F.col("item_id") == F.col("id"))
    return rows.groupBy(F.col("tag").alias("term")).agg(F.count_if("site").alias("canonical"), F.count_if(~F.col("site")).alias("raw"), F.bool_and("romance").alias("romance_only"))


@query()
def j25_recommended(s, d):
    """The whole way: facets of what is liked, less what is disliked; candidates that aren't owned by any key; scores; diverse picks, a slot
    for each author; score order. Greedy: each part has SQL or a plain version of its own."""
    c = B.candidates(s, d).withColumn("vid", F.col("id") % 400)
    fresh = candidates.excluded(c, c.filter("owned"))
    fresh = library.not_contained(fresh, c.filter("owned"))
    v = _scored(s, d).select(F.col("id").alias("vid"), "v", F.col("score").alias("fit"))
    scored = fresh.join(v, "vid").select("id", "author", F.col("fit").alias("score"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    own = c.filter("owned").select(T.norm(F.coalesce("author", F.lit(""))).alias("author_key"))
    picked = taste.picks(scored, own, 12)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # of 12 rows
    return picked.join(scored.select("id", "author", "score"), "id").withColumn("place", place).select("place", "id", "author", "part", F.round("score", 6).alias("score"))


@query("SELECT label, count(*) FILTER (weight > 0) AS liked, count(*) FILTER (weight < 0) AS disliked, round(sum(weight), 6) AS total FROM (SELECT label, CASE WHEN label < 4 THEN (1 + id % 3) / 3.0::DOUBLE WHEN label < 6 THEN -(1 + id % 3) / 3.0::DOUBLE ELSE 0.0 END AS weight FROM vectors) GROUP BY 1")
def c11_signals_vectors(s, d):
    return _weighted(s, d).groupBy("label").agg(F.count_if(F.col("weight") > 0).alias("liked"), F.count_if(F.col("weight") < 0).alias("disliked"), F.round(F.sum("weight"), 6).alias("total"))


@query("SELECT id, round(n, 6) AS n, list_transform(v, lambda x: round(cast(x AS DOUBLE) / n, 5) + 0.0::DOUBLE) AS unit FROM (SELECT id, v, sqrt(list_dot_product(cast(v AS DOUBLE[]), cast(v AS DOUBLE[]))) AS n FROM vectors)")
def j1_j2_unit_vectors(s, d):
    v = F.col("v")
    return B.vectors(s, d).select("id", F.round(F.sqrt(vectors.dot(v, v)), 6).alias("n"), F.transform(taste.normalised(v), lambda x: F.round(x, 5) + 0.0).alias("unit"))


@query("SELECT id, strftime(make_timestamp(date_saved * 1000), '%b %-d, %Y') AS saved FROM items")
def h27_dates(s, d):
    return B.items(s, d).select("id", T.date_label(F.col("date_saved")).alias("saved"))


@query("SELECT id, CASE WHEN author IS NOT NULL THEN title || ' author:\"' || author || '\"' ELSE title END AS q, '/search/?keywords=' || replace(title, ' ', '+') || '+' || lower(subjects[1]) || '&type=story&ppage=2' AS url FROM candidates")
def h25_query_strings(s, d):
    title = F.concat(F.lit(' "'), "title", F.lit('"  '))
    return B.candidates(s, d).select("id", T.owned_query(title, F.col("author")).alias("q"), T.keyword_query(F.col("title"), F.array(F.lower(F.element_at("subjects", 1))), 2).alias("url"))


@query("SELECT doc_id AS id, 49 AS place FROM documents WHERE length(text) >= 120 AND position(substr(text, 50, 12) IN substr(text, 38, 24)) = 13", views=False)
def h29_best_places(s, d):
    """A quote of each text, found again by its contexts."""
    t = F.col("text")
    alone = F.expr("locate(substring(text, 50, 12), substring(text, 38, 24))") == 13
    docs = B.table(s, d, "documents").filter((F.length(t) >= 120) & alone)
    return docs.select(F.col("doc_id").alias("id"), T.best_place(t, F.substring(t, 50, 12), F.substring(t, 10, 40), F.substring(t, 62, 40)).alias("place"))
