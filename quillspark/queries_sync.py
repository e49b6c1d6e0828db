"""Queries over change sets, link sets, blobs and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import lists, merge
from .plans import binding as B
from .registry import AS_OF, query

DAY = 86_400_000
_LINKS = "l AS (SELECT l_suppkey % 20 AS owner, l_orderkey % 1000 AS item, CASE WHEN max(l_partkey) % 3 = 0 THEN 5 END AS deleted_at, min(l_partkey) AS updated_at, min(l_partkey) % 2 = 0 AS dirty FROM lineitem GROUP BY 1, 2)"


def _links(s, d):
    g = B.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("owner"), (F.col("l_orderkey") % 1000).alias("item")).agg(F.min("l_partkey").alias("p"), F.max("l_partkey").alias("q"))
    return g.select("owner", "item", F.when(F.col("q") % 3 == 0, F.lit(5).cast("long")).alias("deleted_at"), F.col("p").alias("updated_at"), (F.col("p") % 2 == 0).alias("dirty"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name FROM customer", views=False)
def i1_upsert(s, d):
    c = B.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge.upsert(c, c.filter("id % 3 = 0").withColumn("name", F.concat(F.upper("name"), F.lit("!"))), "id")


@query(f"WITH {_LINKS}, n AS (SELECT DISTINCT o_custkey % 20 AS owner, o_orderkey % 1500 AS item FROM orders) SELECT coalesce(l.owner, n.owner) AS owner, coalesce(l.item, n.item) AS item, CASE WHEN n.item IS NULL THEN deleted_at END AS deleted_at, CASE WHEN n.item IS NOT NULL AND (l.item IS NULL OR deleted_at IS NOT NULL) THEN 99 ELSE updated_at END AS updated_at FROM l FULL JOIN n ON l.owner = n.owner AND l.item = n.item", views=False)
def i2_revived(s, d):
    new = B.table(s, d, "orders").select((F.col("o_custkey") % 20).alias("owner"), (F.col("o_orderkey") % 1500).alias("item"))
    return merge.revived(_links(s, d).drop("dirty"), new, ["owner", "item"], 99)


@query(f"WITH {_LINKS}, n AS (SELECT DISTINCT o_custkey % 20 AS owner, o_orderkey % 1500 AS item FROM orders WHERE o_custkey % 2 = 0) SELECT coalesce(l.owner, n.owner) AS owner, coalesce(l.item, n.item) AS item, CASE WHEN n.item IS NOT NULL THEN NULL WHEN coalesce(l.owner, n.owner) IN (SELECT owner FROM n) THEN coalesce(deleted_at, 99) ELSE deleted_at END AS deleted_at FROM l FULL JOIN n ON l.owner = n.owner AND l.item = n.item", views=False)
def i3_replaced_set(s, d):
    new = B.table(s, d, "orders").filter("o_custkey % 2 = 0").select((F.col("o_custkey") % 20).alias("owner"), (F.col("o_orderkey") % 1500).alias("item"))
    return merge.replaced_set(_links(s, d), new, "owner", "item", 99)


@query(f"WITH {_LINKS} SELECT owner, name, p.deleted_at, live FROM (SELECT s_suppkey AS owner, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 6 <> 0 THEN s_name || chr(31) || s_suppkey ELSE s_name END AS name, CASE WHEN s_suppkey % 6 = 0 THEN 1 WHEN s_suppkey % 4 = 0 THEN 99 END AS deleted_at FROM supplier) p LEFT JOIN (SELECT owner, count(*) FILTER (deleted_at IS NULL AND owner % 4 <> 0) AS live FROM l GROUP BY 1) USING (owner)", views=False)
def i4_deleted(s, d):
    k = F.col("s_suppkey")
    parents = B.table(s, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 6 == 0, F.lit(1)).alias("deleted_at"))
    p, links = merge.deleted(parents, _links(s, d), parents.filter("id % 4 = 0"), "owner", 99)
    live = links.groupBy("owner").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"))
    return p.withColumnRenamed("id", "owner").join(live, "owner", "left").select("owner", "name", "deleted_at", "live")


@query("SELECT id, CASE WHEN id % 3 = 0 AND deleted_at IS NULL THEN 99 WHEN id % 3 = 1 AND deleted_at IS NOT NULL AND purged_at IS NULL THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN id % 3 = 2 AND deleted_at IS NOT NULL AND purged_at IS NULL THEN 99 ELSE purged_at END AS purged_at FROM items")
def i5_trashed(s, d):
    i = B.items(s, d).select("id", "deleted_at", "purged_at")
    action = F.element_at(F.array(*map(F.lit, ("trash", "restore", "purge"))), (F.col("id") % 3 + 1).cast("int"))
    return merge.trashed(i, i.select("id", action.alias("action")), 99)


@query("""SELECT coalesce(p.item_id, r.item_id) AS item_id, coalesce(n, scroll) AS scroll, CASE WHEN n IS NOT NULL THEN greatest(coalesce(max_scroll, 0), n) ELSE max_scroll END AS max_scroll FROM progress p FULL JOIN
(SELECT i.id AS item_id, n FROM items i JOIN (SELECT coalesce(derived_from, id) AS family, max(id % 7 / 7.0::DOUBLE) AS n FROM items WHERE id % 4 = 1 GROUP BY 1) f ON coalesce(i.derived_from, i.id) = f.family) r ON r.item_id = p.item_id""")
def i6_i7_moved(s, d):
    i = B.items(s, d)
    positions = i.filter("id % 4 = 1").select(F.col("id").alias("item_id"), (F.col("id") % 7 / 7.0).alias("scroll"))
    return merge.moved(B.progress(s, d).select("item_id", "scroll", "max_scroll"), positions, i.select("id", "derived_from"), AS_OF)


@query("SELECT type, period, target FROM (SELECT coalesce(g.type, w.type) AS type, coalesce(g.period, w.period) AS period, coalesce(w.target, g.target) AS target FROM (SELECT type, period, max(target) AS target FROM goals GROUP BY 1, 2) g FULL JOIN (SELECT 'count' AS type, period, CASE WHEN period = 'daily' THEN 0 ELSE min(target) + 1 END AS target FROM goals GROUP BY 2) w ON g.type = w.type AND g.period = w.period) WHERE target > 0")
def i8_period_goals(s, d):
    g = B.goals(s, d)
    wishes = g.groupBy("period").agg(F.min("target").alias("t")).select(F.lit("count").alias("type"), "period", F.when(F.col("period") == "daily", 0).otherwise(F.col("t") + 1).alias("target"))
    return merge.period_goals(g.groupBy("type", "period").agg(F.max("target").alias("target")), wishes)


@query("""SELECT name, coalesce(h.id, w.own) AS id, h.id IS NULL AS created FROM (SELECT upper(p_brand) || p_size % 3 AS name, p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(p_brand || p_size % 3)) AS own FROM part) w
LEFT JOIN (SELECT lower(p_brand || p_size % 3) AS k, min(-p_partkey - 1) AS id FROM part WHERE p_size % 3 = 1 AND p_partkey % 5 > 0 GROUP BY 1) h ON h.k = lower(w.name)""", views=False)
def i9_found_or_created(s, d):
    p = B.table(s, d, "part").select("p_partkey", "p_size", F.concat("p_brand", (F.col("p_size") % 3).cast("string")).alias("n"))
    names = p.filter("p_size % 3 = 1").select((-F.col("p_partkey") - 1).alias("id"), F.col("n").alias("name"), F.when(F.col("p_partkey") % 5 == 0, F.lit(1)).alias("deleted_at"))
    return merge.found_or_created(p.select(F.upper("n").alias("name"), F.col("p_partkey").alias("id")), names)


@query("SELECT c_custkey AS id, greatest(c_acctbal + c_custkey % 4 - 2, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END) AS bal, 99 AS updated_at FROM customer", views=False)
def i13_stamped(s, d):
    c = B.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    rows = c.withColumn("bal", F.col("bal") + F.col("id") % 4 - 2).withColumn("updated_at", F.col("id"))
    return merge.stamped(rows, c.filter("id % 5 > 0"), "id", ("bal",), 99)


@query("""WITH l AS (SELECT l_suppkey % 20 AS owner, l_orderkey % 1000 AS item, CASE WHEN max(l_partkey) % 3 = 0 THEN 5 END AS deleted_at, min(l_partkey) AS updated_at, min(l_partkey) % 2 = 0 AS dirty FROM lineitem GROUP BY 1, 2),
m AS (SELECT l.*, CASE WHEN owner % 4 > 0 AND owner % 4 < 3 THEN owner - owner % 4 END AS survivor FROM l), lost AS (SELECT *, survivor IS NOT NULL AND deleted_at IS NULL AS lost FROM m),
rows AS (SELECT item, owner, CASE WHEN lost THEN 99 ELSE deleted_at END AS deleted_at, CASE WHEN lost THEN 99 ELSE updated_at END AS updated_at, dirty OR lost AS dirty FROM lost WHERE (item, owner) NOT IN (SELECT (item, survivor) FROM lost WHERE lost))
SELECT * FROM rows UNION ALL SELECT DISTINCT item, survivor, NULL, 99, true FROM lost WHERE lost""", views=False)
def i15_repointed(s, d):
    links = _links(s, d)
    losers = links.select("owner").distinct().filter("owner % 4 IN (1, 2)").select(F.col("owner").alias("loser"), (F.col("owner") - F.col("owner") % 4).alias("survivor"))
    return merge.repointed(links, losers, "owner", ["item"], 99)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 5 > 0 THEN c_custkey * 10 ELSE c_custkey END AS updated_at, c_custkey % 2 = 0 AND NOT (c_custkey % 3 > 0 AND c_custkey % 5 > 0) AS dirty FROM customer", views=False)
def i16_read_back(s, d):
    k = F.col("c_custkey")
    local = B.table(s, d, "customer").select(k.alias("id"), k.alias("updated_at"), (k % 2 == 0).alias("dirty"))
    pushed = B.table(s, d, "customer").filter(k % 3 > 0).select(k.alias("id"), (k - F.when(k % 5 == 0, 1).otherwise(0)).alias("sent_at"), (k * 10).alias("server_at"))
    return merge.read_back(local, pushed, "id")


@query("""SELECT id, updated_at, page, max(updated_at) OVER w AS next_clock, last_value(id) OVER w AS next_id FROM (SELECT *, (row_number() OVER (ORDER BY updated_at, id) + 999) // 1000 AS page
FROM (SELECT l_linenumber + l_orderkey * 10 AS id, l_orderkey // 7 AS updated_at FROM lineitem WHERE l_orderkey // 7 > 3)) WINDOW w AS (PARTITION BY page ORDER BY updated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", views=False)
def i17_m3_feed(s, d):
    """Pages of 1,000 of a change feed with many equal clocks; every row behind the cursor arrives once."""
    feed = B.table(s, d, "lineitem").select((F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("id"), F.floor(F.col("l_orderkey") / 7).alias("updated_at"))
    return merge.pulled(feed, 3)


@query("SELECT c_custkey AS id, c_custkey // 7 AS updated_at FROM customer WHERE c_custkey // 7 > 3 ORDER BY 2, 1 LIMIT 40", views=False)
def a23_pull_page(s, d):
    feed = B.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 7).alias("updated_at"))
    return merge.page_of(feed, 3, 40)


@query("SELECT id, sha256(text) AS hash FROM items WHERE purged_at IS NOT NULL")
def i20_purged_files(s, d):
    return B.items(s, d).filter("purged_at IS NOT NULL").select("id", F.sha2("text", 256).alias("hash"))


_BUCKET = """o AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'tmp/' || doc_id ELSE 'users/u' || doc_id % 3 || '/content/' || sha256(text) END AS key, 'u' || doc_id % 3 AS u, sha256(text) AS h, doc_id * 1000 AS modified FROM documents),
w AS (SELECT DISTINCT 'u' || doc_id % 3 AS u, sha256(text) AS h FROM documents WHERE doc_id % 5 > 1),
a AS (SELECT key, CASE WHEN key LIKE 'tmp%' THEN 'foreign' WHEN (u, h) IN (SELECT (u, h) FROM w) THEN 'keep' WHEN modified > 900000 - 400000 THEN 'recent' ELSE 'orphan' END AS action FROM o)"""


def _actions(s, d):
    i, hash = F.col("doc_id"), F.sha2("text", 256)
    user = F.concat(F.lit("u"), (i % 3).cast("string"))
    key = F.when(i % 11 == 0, F.concat(F.lit("tmp/"), i.cast("string"))).otherwise(F.concat(F.lit("users/"), user, F.lit("/content/"), hash))
    docs = B.table(s, d, "documents")
    return merge.janitor(docs.select(key.alias("key"), (i * 1000).alias("modified")), docs.filter(i % 5 > 1).select(user.alias("user"), hash.alias("hash")), 900_000, 400_000)


@query(f"WITH {_BUCKET} SELECT key, action FROM a", views=False)
def i21_c20_janitor(s, d):
    return _actions(s, d)


@query(f"WITH {_BUCKET} SELECT count(*) AS scanned, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'recent') AS recent, count(*) FILTER (action = 'orphan') AS orphans, count(*) FILTER (action = 'foreign') AS \"foreign\" FROM a", views=False)
def d30_janitor_report(s, d):
    return merge.janitor_report(_actions(s, d))


_OUTBOX = "x AS (SELECT c_custkey AS hash, ['pending', 'error', 'done'][c_custkey % 3 + 1] AS state, c_custkey % 6 AS attempts, c_custkey * 100 AS stamp FROM customer WHERE c_custkey % 4 > 0)"


def _outbox(s, d):
    k = F.col("c_custkey")
    state = F.element_at(F.array(*map(F.lit, ("pending", "error", "done"))), (k % 3 + 1).cast("int"))
    return B.table(s, d, "customer").filter(k % 4 > 0).select(k.alias("hash"), state.alias("state"), (k % 6).alias("attempts"), (k * 100).alias("at"))


@query(f"WITH {_OUTBOX} SELECT coalesce(x.hash, w.hash) AS hash, CASE WHEN w.hash IS NOT NULL AND (state IS NULL OR state = 'error') THEN 'pending' ELSE state END AS state, coalesce(attempts, 0) AS attempts, CASE WHEN w.hash IS NOT NULL AND (state IS NULL OR state = 'error') THEN 99 ELSE stamp END AS at FROM x FULL JOIN (SELECT c_custkey AS hash FROM customer WHERE c_custkey % 5 < 3) w ON w.hash = x.hash", views=False)
def i22_enqueued(s, d):
    wanted = B.table(s, d, "customer").filter("c_custkey % 5 < 3").select(F.col("c_custkey").alias("hash"))
    return merge.enqueued(_outbox(s, d), wanted, 99)


@query(f"WITH {_OUTBOX} SELECT hash FROM x WHERE state = 'pending' OR (state = 'error' AND stamp + least(1000 * 2 ** attempts, 300000) <= 12000)", views=False)
def b20_due(s, d):
    return merge.due(_outbox(s, d), 12_000).select("hash")


@query(f"WITH {_OUTBOX} SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'error') AS error FROM x", views=False)
def d9_blob_states(s, d):
    return _outbox(s, d).groupBy().pivot("state", ["pending", "error"]).count().na.fill(0)


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 7 END, 99) AS updated_at, c_custkey % 5 = 0 OR c_custkey % 3 = 0 AS dirty FROM customer", views=False)
def i23_backfilled(s, d):
    k = F.col("c_custkey")
    rows = B.table(s, d, "customer").select(k.alias("id"), F.when(k % 3 > 0, k).alias("updated_at"), (k % 5 == 0).alias("dirty"), F.when(k % 2 == 0, F.lit(7)).alias("read_at"))
    return merge.backfilled(rows, ["read_at"], 99).drop("read_at")


@query("SELECT item_id, name, category, category IN ('fandom', 'relationship') AS promoted FROM (SELECT o_custkey AS item_id, 'new' || o_orderkey % 4 AS name, ['fandom', 'character', 'relationship'][o_orderkey % 3 + 1] AS category FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderpriority, 'rating' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0))", views=False)
def i25_source_tags(s, d):
    o = B.table(s, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("fandom", "character", "relationship"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    new = o.filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("item_id"), F.concat(F.lit("new"), (F.col("o_orderkey") % 4).cast("string")).alias("name"), kind.alias("category"))
    return merge.source_tags(o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("name"), F.lit("rating").alias("category")), new)


@query("SELECT id, sha256(CASE WHEN id % 4 = 1 THEN text || ' more' ELSE text END) AS hash, word_count + CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END AS words, id % 4 = 1 AS changed FROM items")
def i26_refreshed(s, d):
    i = B.items(s, d).select("id", "text", F.sha2("text", 256).alias("hash"), F.col("word_count").alias("words"))
    texts = i.filter("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text"))
    return merge.refreshed(i, texts).select("id", "hash", "words", "changed")


@query("SELECT c AS id, sha256(first || coalesce(more, '')) AS hash, greatest(1, coalesce(m, 1)) AS last FROM (SELECT conv_id AS c, string_agg(text, chr(10) ORDER BY turn) FILTER (turn <= 1) AS first, chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn > 1) AS more, max(turn) AS m FROM conversations GROUP BY 1)", views=False)
def i27_appended(s, d):
    c = B.table(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("number"), "text")
    first = c.filter("number <= 1").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n").alias("text")).withColumn("last", F.lit(1).cast("long"))
    return merge.appended_chapters(first, c).select("id", F.sha2("text", 256).alias("hash"), "last")


@query("""WITH l AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS v, o_orderkey % 13 AS updated_at FROM orders WHERE o_orderkey % 3 > 0), r AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice + 1 AS v, o_orderkey % 11 AS updated_at FROM orders WHERE o_orderkey % 5 > 0)
SELECT r.k, r.c, CASE WHEN l.k IS NULL THEN 'apply' ELSE 'skip_append' END AS action, coalesce(l.v, r.v) AS v FROM r LEFT JOIN l ON l.k = r.k AND l.c = r.c""", views=False)
def c18_i11_append(s, d):
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("v"))
    local = o.filter("k % 3 > 0").withColumn("updated_at", F.col("k") % 13).withColumn("dirty", F.lit(False))
    remote = o.filter("k % 5 > 0").withColumn("v", F.col("v") + 1).withColumn("updated_at", F.col("k") % 11)
    return merge.plan_pull(local, remote, ["k", "c"], ["v"], append=True)


@query(f"SELECT user_id AS id, max(ms) AS at FROM moments GROUP BY 1 HAVING max(ms) >= {AS_OF} - 3 * {DAY}")
def a22_m9_fresh(s, d):
    cache = B.moments(s, d).groupBy(F.col("user_id").alias("id")).agg(F.max("ms").alias("at"))
    return merge.evicted(cache, AS_OF, 3 * DAY)


@query("SELECT event_id FROM events", views=False)
def m2_ingested_once(s, d):
    from .streaming import sessions

    events = B.table(s, d, "events").select("event_id", "ts")
    return sessions.ingested_once(events.unionByName(events.filter("event_id % 3 = 0"))).select("event_id")


@query("SELECT id, seq, row_number() OVER (ORDER BY seq, id) AS place FROM (SELECT p_partkey AS id, p_partkey * 31 % 97 AS seq FROM part)", views=False)
def f14_dictionary_order(s, d):
    rows = B.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 31 % 97).alias("seq"))
    return lists.placed(rows, F.col("seq"), F.col("id"))
