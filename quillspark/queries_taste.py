"""Queries over candidates and a reader's taste."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import candidates, lists, taste, vectors
from .plans import binding as B
from .registry import AS_OF, query

DAY = 86_400_000
#: Liked vectors have labels 0 to 3, disliked ones 4 and 5; weights from 1/3 to 1.
_WEIGHT = "CASE WHEN label < 4 THEN (1 + id % 3) / 3.0::DOUBLE WHEN label < 6 THEN -(1 + id % 3) / 3.0::DOUBLE ELSE 0.0 END"
_ITEMS = f"w AS (SELECT id, label, owned, cast(v AS DOUBLE[]) AS v, {_WEIGHT} AS weight FROM vectors), long AS (SELECT id, label, owned, weight, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM w)"
_UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
_FACETS = f"""{_ITEMS},
pos AS (SELECT label, list(s ORDER BY i) AS s FROM (SELECT label, i, sum(weight * x) AS s FROM long WHERE weight > 0 AND owned GROUP BY 1, 2) GROUP BY 1),
neg AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, sum(-weight * x) AS s FROM long WHERE weight < 0 AND owned GROUP BY 1)),
facets AS (SELECT label, list_transform(list_zip({_UNIT.format("pos.s")}, {_UNIT.format("neg.s")}), lambda z: z[1] - 0.3 * z[2]) AS f FROM pos, neg)"""


def _weighted(s, d):
    w = (1 + F.col("id") % 3) / 3.0
    weight = F.when(F.col("label") < 4, w).when(F.col("label") < 6, -w).otherwise(0.0)
    return B.vectors(s, d).withColumn("weight", weight)


def _facets(s, d):
    """A facet for each liked label, away from the disliked mean."""
    v = _weighted(s, d).filter("owned")
    positive = vectors.weighted_mean(v.filter("weight > 0"), "v", "weight", "label").withColumnRenamed("label", "facet")
    return taste.rocchio(positive, v.filter("weight < 0").withColumn("weight", -F.col("weight")))


def _scored(s, d):
    v = B.vectors(s, d)
    return vectors.score(v, _facets(s, d)).join(v, "id")


_SCORES = f"{_FACETS}, scores AS (SELECT id, max(list_dot_product(w.v, f) / sqrt(list_dot_product(f, f))) AS score FROM w, facets GROUP BY 1)"


@query(f", {_FACETS} SELECT label AS facet, list_transform({_UNIT.format('f')}, lambda x: round(x, 6)) AS centroid FROM facets")
def j8_rocchio(s, d):
    return _facets(s, d).select("facet", F.transform("centroid", lambda x: vectors.rounded(x, 6)).alias("centroid"))


@query(f", {_SCORES} SELECT id, round(score, 6) AS score FROM scores")
def j8_j10_scores(s, d):
    return _scored(s, d).select("id", vectors.rounded(F.col("score"), 6).alias("score"))


@query()
def j7_facets(s, d):
    """Weighted spherical k-means: iterative, compared with a plain version in the tests."""
    liked = _weighted(s, d).filter("weight > 0").select("id", taste.normalised(F.col("v")).alias("v"), "weight")
    return taste.facets(liked).select("facet", F.transform("centroid", lambda x: vectors.rounded(x, 5)).alias("centroid"))


def _rounds(k: int) -> str:
    """SQL of k greedy rounds: each takes the best row of a label by score, less the largest similarity to the rows taken so far."""
    out, taken = [], ""
    for place in range(1, k + 1):
        near = f"greatest(0, coalesce((SELECT max(list_dot_product(c.v, t.v)) FROM ({taken}) t WHERE t.label = c.label), 0))" if taken else "0"
        left = f"WHERE (c.label, c.id) NOT IN (SELECT (label, id) FROM ({taken}))" if taken else ""
        out.append(f"p{place} AS MATERIALIZED (SELECT label, arg_max(struct_pack(id := id, v := v), (round(mmr, 9), round(score, 9), -id)) AS best FROM (SELECT c.*, 0.7 * score - 0.3 * {near} AS mmr FROM pool c {left}) GROUP BY 1),\nq{place} AS (SELECT label, best.id AS id, best.v AS v, {place} AS place FROM p{place})")
        taken = " UNION ALL ".join(f"SELECT label, id, v FROM q{i}" for i in range(1, place + 1))
    return ",\n".join(out)


@query(f", {_SCORES}, pool AS (SELECT w.label, w.id, w.v, score FROM w JOIN scores USING (id) WHERE NOT owned),\n{_rounds(5)}\n" + " UNION ALL ".join(f"SELECT label, id, place FROM q{i}" for i in range(1, 6)))
def j11_diversified(s, d):
    pool = _scored(s, d).filter("NOT owned").select("label", "id", "score", F.transform("v", lambda x: x.cast("double")).alias("v"))
    return vectors.diversified(pool, "label", 5)


@query("SELECT author, n, book, fic, cast(CASE WHEN book + fic = 0 THEN 36 ELSE floor(book / (book + fic) * 36 + 0.5) END AS BIGINT) AS slots FROM (SELECT author, count(*) AS n, count(*) FILTER (source = 'book') AS book, count(*) FILTER (source <> 'book') AS fic FROM candidates GROUP BY 1)")
def j12_d21_slots(s, d):
    mix = B.candidates(s, d).groupBy("author").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "book").alias("book"), F.count_if(F.col("source") != "book").alias("fic"))
    return mix.withColumn("slots", candidates.allocated(F.lit(36), F.col("book"), F.col("fic")))


@query("""SELECT author, b2 - back AS book, f2 + back AS fic FROM (SELECT *, CASE WHEN f2 < least(12, hf) THEN least(least(12, hf) - f2, greatest(0, b2 - least(12, hb))) ELSE 0 END AS back FROM
(SELECT *, b + take AS b2, f - take AS f2 FROM (SELECT *, CASE WHEN b < least(12, hb) THEN least(least(12, hb) - b, greatest(0, f - least(12, hf))) ELSE 0 END AS take FROM
(SELECT author, hb, hf, cast(CASE WHEN hb + hf = 0 THEN 36 ELSE floor(hb / (hb + hf) * 36 + 0.5) END AS BIGINT) AS b, 36 - cast(CASE WHEN hb + hf = 0 THEN 36 ELSE floor(hb / (hb + hf) * 36 + 0.5) END AS BIGINT) AS f FROM
(SELECT author, count(*) FILTER (source = 'book') AS hb, count(*) FILTER (source <> 'book') AS hf FROM candidates GROUP BY 1)))))""")
def j12_floored_slots(s, d):
    mix = B.candidates(s, d).groupBy("author").agg(F.count_if(F.col("source") == "book").alias("hb"), F.count_if(F.col("source") != "book").alias("hf"))
    book = candidates.allocated(F.lit(36), F.col("hb"), F.col("hf"))
    return mix.select("author", candidates.floored(book, 36 - book, 12, F.col("hb"), F.col("hf")).alias("s")).select("author", "s.book", "s.fic")


@query()
def j13_quota(s, d):
    """Greedy and stateful: compared with a plain version in the tests."""
    named = F.concat(F.lit("Writer "), (F.col("id") % 60).cast("string"))
    scored = _scored(s, d).filter("NOT owned").withColumn("author", named)
    own = B.vectors(s, d).filter("owned").select(T.norm(F.concat(F.lit("Writer "), (F.col("id") % 30 + 1).cast("string"))).alias("author_key"))
    return taste.picks(scored.select("id", "author", "score", "v"), own, 36)


_FOLDS = f"""{_ITEMS}, total AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, sum(weight * x) AS s FROM long WHERE weight > 0 GROUP BY 1)),
neg AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, sum(-weight * x) AS s FROM long WHERE weight < 0 GROUP BY 1)),
rest AS (SELECT id, v, list_transform(list_zip(s, v), lambda z: z[1] - weight * z[2]) AS r FROM w, total WHERE weight > 0),
folds AS (SELECT id, v, list_transform(list_zip({_UNIT.format("r")}, {_UNIT.format("neg.s")}), lambda z: z[1] - 0.3 * z[2]) AS f FROM rest, neg),
ranks AS (SELECT h.id, 1 + count(*) FILTER (list_dot_product(o.v, {_UNIT.format("f")}) > list_dot_product(h.v, {_UNIT.format("f")}) + 1e-9 AND o.id <> h.id) AS rank FROM folds h, w o GROUP BY 1)"""


@query(f", {_FOLDS} SELECT id, rank FROM ranks")
def j14_e10_ranks(s, d):
    return taste.leave_one_out(_weighted(s, d))


@query(f", {_FOLDS} SELECT round(avg(1 / rank), 6) AS mrr, round(avg(cast(rank <= 5 AS INTEGER)), 6) AS hit5, round(avg(cast(rank <= 10 AS INTEGER)), 6) AS hit10, round(avg(1 - (rank - 1) / ((SELECT count(*) FROM w) - 1)), 6) AS percentile, count(*) AS n_folds FROM ranks")
def j14_leave_one_out(s, d):
    items = _weighted(s, d)
    out = taste.report(taste.leave_one_out(items), items.count())
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns[:-1]), "n_folds")


@query("""SELECT id, round(CASE WHEN fit IS NULL THEN score WHEN hi > lo THEN 0.5 * score + 0.5 * (lo + fit * (hi - lo)) ELSE 0.5 * score + 0.5 * fit END, 6) AS score FROM
(SELECT id, score, min(score) OVER (PARTITION BY source) AS lo, max(score) OVER (PARTITION BY source) AS hi, CASE WHEN id % 5 = 0 THEN id % 11 / 10.0::DOUBLE END AS fit FROM candidates)""")
def j15_blended(s, d):
    c = B.candidates(s, d)
    fits = c.filter("id % 5 = 0").select("id", (F.col("id") % 11 / 10.0).alias("fit"))
    return candidates.blended(c.select("id", "score", "source"), fits, 0.5, "source").select("id", F.round("score", 6).alias("score"))


@query("SELECT source, min(score) AS lo, max(score) AS hi FROM candidates GROUP BY 1")
def d25_ends(s, d):
    return B.candidates(s, d).groupBy("source").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query(f"SELECT id, n AS n_chunks, CASE WHEN n <= 3 THEN list_transform(range(n), lambda i: sha256(array_to_string(w[i * 40 + 1 : i * 40 + 40], ' '))) ELSE list_transform(range(3), lambda j: sha256(array_to_string(w[cast(floor((j + 0.5) * n / 3) AS BIGINT) * 40 + 1 : cast(floor((j + 0.5) * n / 3) AS BIGINT) * 40 + 40], ' '))) END AS sampled FROM (SELECT doc_id AS id, {_WORDS} AS w, cast(ceil(len({_WORDS}) / 40) AS INTEGER) AS n FROM documents)", views=False)
def j16_e16_chunks(s, d):
    c = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), taste.chunks(F.col("text"), 40).alias("c"))
    return c.select("id", F.size("c").alias("n_chunks"), F.transform(taste.sampled(F.col("c"), 3), lambda x: F.sha2(x, 256)).alias("sampled"))


@query("SELECT a.id, list_transform(list_zip(cast(a.v AS DOUBLE[]), cast(b.v AS DOUBLE[])), lambda z: round((z[1] + z[2]) / sqrt(list_sum(list_transform(list_zip(cast(a.v AS DOUBLE[]), cast(b.v AS DOUBLE[])), lambda y: (y[1] + y[2]) * (y[1] + y[2])))), 5) + 0.0::DOUBLE) AS v FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def j17_two_tier(s, d):
    a = B.vectors(s, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("v").alias("content"))
    return a.join(b, "id").select("id", F.transform(taste.two_tier(F.col("v"), F.col("content")), lambda x: F.round(x, 5) + 0.0).alias("v"))


@query("SELECT label, list(round(s / n, 6) ORDER BY i) AS pooled FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY label)) AS n FROM (SELECT label, i, avg(cast(x AS DOUBLE)) AS s FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY 1, 2)) GROUP BY 1")
def d24_pooled(s, d):
    mean = vectors.weighted_mean(B.vectors(s, d).withColumn("w", F.lit(1.0)), "v", "w", "label")
    return mean.select("label", F.transform("centroid", lambda x: vectors.rounded(x, 6)).alias("pooled"))


@query("SELECT id FROM items LEFT JOIN (SELECT doc_id AS eid, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE 'new' END AS m FROM documents WHERE doc_id % 4 <> 0) e ON eid = id WHERE deleted_at IS NULL AND (eid IS NULL OR h <> sha256(text) OR m <> 'new')")
def j18_c17_stale(s, d):
    items = B.items(s, d).filter("deleted_at IS NULL").select("id", F.sha2("text", 256).alias("hash"))
    i = F.col("doc_id")
    embedded = B.table(s, d, "documents").filter(i % 4 != 0).select(i.alias("id"), F.sha2(F.when(i % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"), F.when(i % 5 == 0, "old").otherwise("new").alias("model"))
    return taste.stale(items, embedded, "new").select("id")


@query(f", {_ITEMS} SELECT n, CASE WHEN n = 0 THEN 'empty' WHEN n <= 4 THEN 'thin' WHEN n <= 20 THEN 'normal' ELSE 'power' END AS tier, CASE WHEN p <= 0 THEN 0 ELSE least(greatest(cast(floor(p / 8 + 0.5) AS BIGINT), 1), 3, p) END AS k, source FROM (SELECT label AS source, count(*) FILTER (owned) AS n, count(*) FILTER (weight > 0 AND id % 9 = 0) AS p FROM w GROUP BY 1)")
def j5_j6_tiers(s, d):
    sizes = _weighted(s, d).groupBy(F.col("label").alias("source")).agg(F.count_if("owned").alias("n"), F.count_if((F.col("weight") > 0) & (F.col("id") % 9 == 0)).alias("p"))
    return sizes.select("source", "n", taste.tier(F.col("n")).alias("tier"), taste.facet_count(F.col("p")).alias("k"))


@query(f", {_ITEMS} SELECT id, round(weight, 6) AS weight, row_number() OVER (ORDER BY weight DESC, id) AS place FROM w WHERE weight > 0")
def j9_f9_c11_liked(s, d):
    liked = _weighted(s, d).filter("weight > 0").select("id", "weight")
    return lists.placed(liked, *taste.liked_order()).withColumn("weight", F.round("weight", 6))


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_KEY = f"{_NORM.format('title')} || '|' || {_NORM.format('coalesce(author, $$$$)')}".replace("$$$$", "''")


@query(f"SELECT id, {_KEY} AS key FROM candidates")
def h2_keys(s, d):
    return B.candidates(s, d).select("id", candidates.key(F.col("title"), F.col("author")).alias("key"))


@query(f", k AS (SELECT *, {_KEY} AS key FROM candidates) SELECT id FROM k WHERE key NOT IN (SELECT key FROM k WHERE owned) AND source_id NOT IN (SELECT source_id FROM k WHERE owned) AND coalesce(isbn, '') NOT IN (SELECT isbn FROM k WHERE owned AND isbn IS NOT NULL)")
def c13_g4_excluded(s, d):
    c = B.candidates(s, d)
    return candidates.excluded(c, c.filter("owned")).select("id")


@query(f", k AS (SELECT *, {_KEY} AS key FROM candidates) SELECT id FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.owned AND (b.key = a.key OR b.source_id = a.source_id)) AND id % 3 = 0")
def c15_cached_cards(s, d):
    c = B.candidates(s, d)
    cached = c.filter("id % 3 = 0").withColumn("isbn", F.lit(None).cast("string"))
    return candidates.excluded(cached, c.filter("owned").withColumn("isbn", F.lit(None).cast("string"))).select("id")


@query("SELECT id, round(weight, 6) AS weight, term FROM (SELECT i.id, rating - 3 AS weight, tag AS term FROM items i JOIN item_tags t ON t.item_id = i.id WHERE rating > 3 UNION ALL SELECT id, rating - 3, author FROM items WHERE rating > 3)")
def c10_liked_terms(s, d):
    liked = B.items(s, d).filter("rating > 3").select("id", (F.col("rating") - 3).alias("weight"), "author")
    tags = B.item_tags(s, d).join(liked, F.col("item_id") == F.col("id")).select("id", "weight", F.col("tag").alias("term"))
    return tags.unionByName(liked.select("id", "weight", F.col("author").alias("term"))).withColumn("weight", F.round("weight", 6))


@query("SELECT t.item_id, t.tag, i.author LIKE '%1%' AS is_site FROM item_tags t JOIN items i ON i.id = t.item_id WHERE deleted_at IS NULL")
def c9_source_tags(s, d):
    items = B.items(s, d).filter("deleted_at IS NULL").select("id", F.col("author").contains("1").alias("is_site"))
    return B.item_tags(s, d).join(items, F.col("item_id") == F.col("id")).select("item_id", "tag", "is_site")


@query("SELECT term, round(sum(w), 6) AS weight FROM (SELECT tag AS term, 1.0::DOUBLE AS w FROM item_tags UNION ALL SELECT p_brand, 0.5::DOUBLE FROM part) GROUP BY 1")
def d20_merged_terms(s, d):
    a = B.item_tags(s, d).select(F.col("tag").alias("term"), F.lit(1.0).alias("weight"))
    b = B.table(s, d, "part").select(F.col("p_brand").alias("term"), F.lit(0.5).alias("weight"))
    return candidates.merged_terms(a.unionByName(b)).withColumn("weight", F.round("weight", 6))


@query("SELECT count(*) FILTER (regexp_matches(url, 'example\\.org')) AS fic, count(*) FILTER (NOT regexp_matches(url, 'example\\.org')) AS book FROM pages", views=False)
def d21_mix(s, d):
    fic = F.col("url").rlike(r"example\.org")
    return B.table(s, d, "pages").agg(F.count_if(fic).alias("fic"), F.count_if(~fic).alias("book"))


@query("SELECT CASE WHEN n >= 3 AND lg / n >= 0.7 THEN 60 END AS word_floor, CASE WHEN n >= 3 AND lg / n < 0.7 AND sh / n >= 0.7 THEN 40 END AS word_ceil, m >= 3 AND c / m >= 0.7 AS complete_only FROM (SELECT count(*) FILTER (word_count > 0) AS n, count(*) FILTER (word_count >= 60) AS lg, count(*) FILTER (word_count > 0 AND word_count < 40) AS sh, count(*) AS m, count(*) FILTER (content_type <> 'pdf') AS c FROM items WHERE rating > 3)")
def d22_length_profile(s, d):
    meta = B.items(s, d).filter("rating > 3").select(F.col("word_count").alias("words"), F.when(F.col("content_type") != "pdf", "complete").otherwise("open").alias("status"))
    return candidates.length_profile(meta, 3, 60, 40)


@query(f", k AS (SELECT id, author, score, source_id, {_NORM.format('coalesce(author, $$)')} AS author_key FROM candidates) SELECT author_key, arg_max(id, (score, -id)) AS id, max(score) AS score FROM k GROUP BY 1".replace("$$", "''"))
def e8_best_per_author(s, d):
    return candidates.best_per_author(B.candidates(s, d).select("id", "author", "score")).select("author_key", "id", "score")


@query("SELECT source_id, min(id) AS id FROM candidates GROUP BY 1")
def e7_g2_first_per_source(s, d):
    from .operators import library

    return library.first_per(B.candidates(s, d).select("source_id", "id"), "source_id", [F.col("id")])


@query(f"""WITH RECURSIVE {B.DUCK.strip()}, k AS (SELECT id, source_id, {_KEY} AS key, row_number() OVER (ORDER BY id) AS n FROM candidates),
w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS id, '' AS source_id, '' AS key, []::VARCHAR[] AS ids, []::VARCHAR[] AS keys, false AS kept
UNION ALL SELECT n, id, source_id, key, CASE WHEN ok THEN list_append(ids, source_id) ELSE ids END, CASE WHEN ok THEN list_append(keys, key) ELSE keys END, ok
FROM (SELECT k.*, w.ids, w.keys, NOT list_contains(w.ids, k.source_id) AND NOT list_contains(w.keys, k.key) AS ok FROM w JOIN k ON k.n = w.n + 1))
SELECT id, source_id, key FROM w WHERE kept""", views=False)
def g1_united(s, d):
    """A walk through ordered pools, in which what was kept decides on what comes."""
    c = B.candidates(s, d).select("id", "source_id", candidates.key(F.col("title"), F.col("author")).alias("key"))
    return candidates.united(c.withColumn("seq", F.col("id"))).select("id", "source_id", "key")


@query("SELECT id, 0 AS part FROM candidates WHERE id % 2 = 0 UNION ALL SELECT id, 1 FROM candidates WHERE id % 3 = 0 AND id % 2 <> 0")
def g3_g7_appended(s, d):
    c = B.candidates(s, d).select("id")
    return candidates.appended(c.filter("id % 2 = 0"), c.filter("id % 3 = 0"), "id").select("id", "part")


@query("SELECT id, (list_filter(subjects, lambda x: lower(x) IN ('economy', 'brand#12', 'cold')))[1:2] AS matched, CASE WHEN len((list_filter(subjects, lambda x: lower(x) IN ('economy', 'brand#12', 'cold')))[1:2]) > 0 THEN (list_filter(subjects, lambda x: lower(x) IN ('economy', 'brand#12', 'cold')))[1:2] ELSE subjects[1:3] END AS chips FROM candidates")
def g5_h48_why(s, d):
    terms = F.array(*map(F.lit, ("economy", "brand#12", "cold")))
    c = B.candidates(s, d).withColumn("matched", candidates.why(F.col("subjects"), terms, 2))
    return c.select("id", "matched", candidates.chips(F.col("matched"), F.col("subjects")).alias("chips"))


@query(f", k AS (SELECT *, {_KEY} AS key FROM candidates) SELECT id FROM k WHERE id % 4 = 0 AND key IN (SELECT key FROM k WHERE id % 5 = 0)")
def g6_verified(s, d):
    c = B.candidates(s, d).select("id", candidates.key(F.col("title"), F.col("author")).alias("key"))
    return c.filter("id % 4 = 0").join(c.filter("id % 5 = 0").select("key"), "key", "left_semi").select("id")


@query("SELECT title, min(id) AS id FROM (SELECT lower(trim(title)) AS title, id FROM candidates) GROUP BY 1")
def g10_titles_once(s, d):
    return B.candidates(s, d).groupBy(F.lower(F.trim("title")).alias("title")).agg(F.min("id").alias("id"))


@query("SELECT sha256(text) AS hash FROM items WHERE purged_at IS NULL UNION SELECT sha256(title) FROM items WHERE purged_at IS NULL")
def g12_wanted(s, d):
    i = B.items(s, d).filter("purged_at IS NULL")
    return i.select(F.sha2("text", 256).alias("hash")).union(i.select(F.sha2("title", 256))).distinct()


_DOC = "json_object('title', ' ' || p_name || ' ', 'author_name', CASE WHEN p_partkey % 5 > 0 THEN [' Writer ' || p_size] END, 'subject', [p_type, '', CASE WHEN p_partkey % 8 = 0 THEN 'Graphic Novels' ELSE p_brand END], 'key', CASE WHEN p_partkey % 3 = 0 THEN '/works/' || p_partkey END, 'cover_i', CASE WHEN p_partkey % 2 = 0 THEN p_partkey END, 'isbn', ['978' || p_partkey])"


@query("""SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 5 > 0 THEN 'Writer ' || p_size END AS author, [p_type, p_brand] AS subjects, CASE WHEN p_partkey % 2 = 0 THEN 'https://covers.openlibrary.org/b/id/' || p_partkey || '-M.jpg' END AS cover,
CASE WHEN p_partkey % 3 = 0 THEN '/works/' || p_partkey ELSE 'synthetic:' || lower(p_name) || '|' || coalesce(CASE WHEN p_partkey % 5 > 0 THEN 'writer ' || p_size END, '') END AS source_id, '978' || p_partkey AS isbn,
CASE WHEN p_partkey % 3 = 0 THEN 'https://openlibrary.org/works/' || p_partkey ELSE 'https://openlibrary.org/' || 'synthetic:' || lower(p_name) || '|' || coalesce(CASE WHEN p_partkey % 5 > 0 THEN 'writer ' || p_size END, '') END AS url FROM part WHERE p_partkey % 8 <> 0""", views=False)
def h22_h23_b11_normalised(s, d):
    p = F.col("p_partkey")
    doc = F.to_json(F.struct(
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"),
        F.when(p % 5 > 0, F.array(F.concat(F.lit(" Writer "), F.col("p_size").cast("string")))).alias("author_name"),
        F.array("p_type", F.lit(""), F.when(p % 8 == 0, "Graphic Novels").otherwise(F.col("p_brand"))).alias("subject"),
        F.when(p % 3 == 0, F.concat(F.lit("/works/"), p.cast("string"))).alias("key"),
        F.when(p % 2 == 0, p).alias("cover_i"),
        F.array(F.concat(F.lit("978"), p.cast("string"))).alias("isbn"),
    ))
    docs = B.table(s, d, "part").select(p.alias("id"), doc.alias("doc"))
    return candidates.normalised(docs).withColumn("url", candidates.url(F.lit("book"), F.col("source_id")))


@query("SELECT doc_id AS id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS description FROM documents", views=False)
def h21_descriptions(s, d):
    raw = F.concat(F.lit("[1]: http://a.b/c\n"), "text", F.lit("\n  ----------\n[x](y) after"))
    plain = ~F.col("text").rlike(r"\n\s*-{3,}") & ~F.col("text").rlike(r"(?im)^\s*\[[^\]]+\]:\s*http")
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(plain, candidates.description(raw)).otherwise(candidates.description(raw)).alias("description"))


@query("SELECT id, least(1.0, greatest(0.0, arg_min(fit, (seq, n)))) AS fit FROM (SELECT p_size AS seq, p_partkey * 2 AS n, p_partkey % 300 AS id, p_partkey % 13 / 10.0::DOUBLE AS fit FROM part UNION ALL SELECT p_size, p_partkey * 2 + 1, p_partkey % 300 + 1, 0.5::DOUBLE FROM part WHERE p_partkey % 4 = 0) WHERE id IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY 1", views=False)
def h38_rankings(s, d):
    p = F.col("p_partkey")
    one = F.struct((p % 300).alias("id"), (p % 13 / 10.0).alias("fit"))
    two = F.struct((p % 300 + 1).alias("id"), F.lit(0.5).alias("fit"))
    parts = B.table(s, d, "part")
    replies = parts.select((F.col("p_size") * 1_000_000 + p).alias("seq"), F.to_json(F.when(p % 4 == 0, F.array(one, two)).otherwise(F.array(one))).alias("reply"))
    return candidates.rankings(replies, parts.filter(p % 2 == 0).select(p.alias("id")))


@query("""SELECT kind, term, kind || ':"' || term || '"' AS q, round(weight, 6) AS weight, cast(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(weight, 9) DESC, term) AS place FROM (
SELECT kind, arg_min(term, (seq, n)) AS term, sum(score) AS weight FROM (SELECT 'subject' AS kind, score, id AS seq, unnest(subjects) AS term, generate_subscripts(subjects, 1) AS n FROM candidates WHERE score > 0 UNION ALL SELECT 'author', score, id, author, 0 FROM candidates WHERE score > 0 AND author IS NOT NULL) GROUP BY kind, lower(term))) WHERE place <= CASE kind WHEN 'subject' THEN 8 ELSE 5 END""")
def j23_seed_queries(s, d):
    c = B.candidates(s, d).select("author", F.col("subjects").alias("tags"), F.col("score").alias("weight"), F.col("id").alias("seq"))
    return candidates.seed_queries(c, 8, 5).withColumn("weight", F.round("weight", 6))


@query("""SELECT category, term, round(weight, 6) AS weight, cast(row_number() OVER (PARTITION BY category ORDER BY weight DESC, term) AS INTEGER) AS place FROM (SELECT category, lower(term) AS term, round(sum(rating - 3), 6) AS weight FROM (SELECT 'c' || (ascii(right(tag, 1)) % 5) AS category, tag AS term, rating FROM item_tags JOIN items ON id = item_id WHERE rating > 3
UNION ALL SELECT 'author', author, rating FROM items WHERE rating > 3) GROUP BY 1, 2)""")
def j19_seeds_by_category(s, d):
    from pyspark.sql import Window

    liked = B.items(s, d).filter("rating > 3").select("id", "rating", "author")
    kind = F.concat(F.lit("c"), (F.ascii(F.right("tag", F.lit(1))) % 5).cast("string"))
    tags = B.item_tags(s, d).join(liked, F.col("item_id") == F.col("id")).select(kind.alias("category"), F.col("tag").alias("term"), "rating")
    terms = tags.unionByName(liked.select(F.lit("author").alias("category"), F.col("author").alias("term"), "rating"))
    sums = terms.groupBy("category", F.lower("term").alias("term")).agg(F.round(F.sum(F.col("rating") - 3), 6).alias("weight"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("weight"), "term")))


@query(f"""SELECT term, CASE WHEN since IS NULL THEN 'ask' WHEN name IS NOT NULL AND {AS_OF} - since <= {30 * DAY} THEN 'hit' WHEN name IS NULL AND {AS_OF} - since <= {7 * DAY} THEN 'miss' ELSE 'ask' END AS state, CASE WHEN name IS NOT NULL AND {AS_OF} - since <= {30 * DAY} THEN name END AS name FROM
(SELECT DISTINCT p_brand AS term FROM part) LEFT JOIN (SELECT p_brand AS term, CASE WHEN min(p_partkey) % 3 > 0 THEN upper(p_brand) END AS name, {AS_OF} - max(p_partkey) % 40 * {DAY} AS since FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) USING (term)""", views=False)
def j21_m9_aliases(s, d):
    parts = B.table(s, d, "part")
    g = parts.filter("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("term")).agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    aliases = g.select("term", F.when(F.col("a") % 3 > 0, F.upper("term")).alias("name"), (F.lit(AS_OF) - F.col("b") % 40 * DAY).alias("at"))
    return taste.resolved(parts.select(F.col("p_brand").alias("term")).distinct(), aliases, AS_OF, 30 * DAY, 7 * DAY)


@query("""SELECT a.work, b.place, list_sort([a.name, b.name]) AS pair FROM (SELECT l_orderkey AS work, l_linenumber AS place, 'n' || l_suppkey % 30 AS name FROM lineitem) a JOIN (SELECT l_orderkey AS work, l_linenumber AS place, 'n' || l_suppkey % 30 AS name FROM lineitem) b ON a.work = b.work
WHERE a.place = 1 AND b.place BETWEEN 2 AND 5 AND list_sort([a.name, b.name]) IN (SELECT list_sort(['n' || s_suppkey % 30, 'n' || (s_suppkey + 3) % 30]) FROM supplier)""", views=False)
def j22_pairings(s, d):
    name = lambda k: F.concat(F.lit("n"), (k % 30).cast("string"))
    people = B.table(s, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("place"), name(F.col("l_suppkey")).alias("name"))
    known = B.table(s, d, "supplier").select(F.array_sort(F.array(name(F.col("s_suppkey")), name(F.col("s_suppkey") + 3))).alias("pair"))
    return taste.pairings(people, known)
