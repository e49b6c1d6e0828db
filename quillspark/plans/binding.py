"""The domain's relations as views over the given tables. Each is a plain DataFrame; DUCK holds the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DAY = 86_400_000
SAVED = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    saved = i * 60_000 + SAVED
    return docs.select(
        i.alias("id"),
        F.substring("text", 1, 40).alias("title"),
        F.col("source").alias("author"),
        F.element_at(F.array(F.lit("article"), F.lit("epub"), F.lit("pdf")), (i % 3 + 1).cast("int")).alias("content_type"),
        T.word_count(F.col("text")).alias("word_count"),
        saved.alias("date_saved"),
        F.when(i % 17 == 0, saved + DAY).alias("deleted_at"),
        F.when(i % 34 == 0, saved + 2 * DAY).alias("purged_at"),
        F.when(i % 10 == 1, i - 1).alias("derived_from"),
        F.when(F.col("quality") == 1, 4.5).when(F.col("quality") == 0, 1.5).alias("rating"),
        (F.coalesce(F.col("quality"), F.lit(0)) * (1 - F.coalesce(F.col("toxic"), F.lit(1))) == 1).alias("has_review"),
        "text",
    )


def moments(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in ms."""
    return table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    length = F.floor(F.col("value") * 10_000).cast("long")
    return moments(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), F.col("ms").alias("started_at"), length.alias("raw"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    g = moments(spark, d).groupBy("user_id").agg(F.max("event_id").alias("e"), F.count("*").alias("n"), F.max("ms").alias("last_read_at"))
    pos = (F.col("e") % 101) / 100.0
    status = F.element_at(F.array(*(F.lit(x) for x in ("unread", "reading", "finished", "on-hold", "dropped"))), F.greatest((u % 6).cast("int"), F.lit(1)))
    return g.select(u.alias("item_id"), pos.alias("scroll"), F.when(u % 13 != 0, F.greatest(pos, (F.col("n") % 101) / 100.0)).alias("max_scroll"), "last_read_at", F.when(u % 6 != 0, status).alias("status"))


def item_tags(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("tag"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("item_id"), F.col("l_partkey").alias("p_partkey"))
    return lines.join(parts, "p_partkey").select("item_id", "tag").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", (F.col("vec_id") % 2 == 0).alias("owned"))


def collection_items(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("collection_id"), (F.col("l_orderkey") % 1000).alias("item_id")).agg(F.min("l_partkey").alias("p"), F.max("l_partkey").alias("q"), F.min("l_linenumber").alias("n"))
    return g.select("collection_id", "item_id", F.when(F.col("p") % 7 != 0, F.col("n")).alias("sort_order"), F.when(F.col("q") % 11 == 0, F.lit(SAVED)).alias("deleted_at"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    color = F.element_at(F.array(F.lit(None), F.lit("green"), F.lit("blue"), F.lit("yellow")), (c % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select(
        (c * 1000 + t).alias("id"),
        (c % 50).alias("item_id"),
        F.when(t % 3 > 0, t % 3).alias("chapter"),
        ((t * 7 % 10) / 10.0).alias("position"),
        (F.lit(1_706_745_600_000) - (c * 37 + t) % 500 * DAY).alias("created_at"),
        color.alias("color"),
        F.when(F.col("role") == "user", F.col("text")).alias("selected_text"),
        F.when(F.col("role") != "user", F.col("text")).alias("note_text"),
        F.array(F.concat(F.lit("t"), (c % 5).cast("string")), F.concat(F.lit("u"), (t % 3).cast("string"))).alias("themes"),
    )


def goals(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("time"), F.lit("count"), F.lit("list")), (c % 3 + 1).cast("int"))
    period = F.element_at(F.array(*map(F.lit, ("daily", "weekly", "monthly", "yearly"))), (c % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(c.alias("goal_id"), kind.alias("type"), period.alias("period"), (c % 50).alias("target"))


def goal_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("goal_id"), (F.col("o_orderkey") % 1000).alias("item_id")).distinct()


def candidates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        p.alias("id"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("title"),
        F.when(p % 9 > 0, F.concat(F.lit("Writer "), (p % 40).cast("string"))).alias("author"),
        F.array(F.initcap("p_type"), F.col("p_brand"), F.element_at(F.split("p_name", " "), 1)).alias("subjects"),
        F.element_at(F.array(F.lit("book"), F.lit("ao3"), F.lit("ffn")), (p % 3 + 1).cast("int")).alias("source"),
        F.concat(F.lit("s"), (p * 7 % 1700).cast("string")).alias("source_id"),
        F.when(p % 4 == 0, F.concat(F.lit("978"), (p % 900).cast("string"))).alias("isbn"),
        (p % 101 / 100.0).alias("score"),
        (p % 6 == 0).alias("owned"),
    )


DUCK = """
items AS (SELECT d.doc_id AS id, substr(text, 1, 40) AS title, source AS author, ['article', 'epub', 'pdf'][d.doc_id % 3 + 1] AS content_type,
  cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count,
  1704067200000 + d.doc_id * 60000 AS date_saved,
  CASE WHEN d.doc_id % 17 = 0 THEN 1704067200000 + d.doc_id * 60000 + 86400000 END AS deleted_at,
  CASE WHEN d.doc_id % 34 = 0 THEN 1704067200000 + d.doc_id * 60000 + 172800000 END AS purged_at,
  CASE WHEN d.doc_id % 10 = 1 THEN d.doc_id - 1 END AS derived_from,
  CASE quality WHEN 1 THEN 4.5::DOUBLE WHEN 0 THEN 1.5::DOUBLE END AS rating,
  coalesce(quality, 0) * (1 - coalesce(toxic, 1)) = 1 AS has_review, text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
moments AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
sessions AS (SELECT event_id AS id, user_id AS item_id, ms AS started_at, cast(floor(value * 10000) AS BIGINT) AS raw FROM moments),
kept AS (SELECT id, item_id, started_at, least(raw, 21600000) AS duration FROM sessions WHERE raw >= 5000),
progress AS (SELECT user_id AS item_id, (max(event_id) % 101) / 100.0::DOUBLE AS scroll,
  CASE WHEN user_id % 13 <> 0 THEN greatest((max(event_id) % 101) / 100.0::DOUBLE, (count(*) % 101) / 100.0::DOUBLE) END AS max_scroll, max(ms) AS last_read_at,
  CASE WHEN user_id % 6 <> 0 THEN ['unread', 'reading', 'finished', 'on-hold', 'dropped'][user_id % 6] END AS status FROM moments GROUP BY user_id),
item_tags AS (SELECT DISTINCT l_orderkey % 1000 AS item_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
vectors AS (SELECT vec_id AS id, embedding AS v, label, vec_id % 2 = 0 AS owned FROM embeddings),
collection_items AS (SELECT l_suppkey % 20 AS collection_id, l_orderkey % 1000 AS item_id, CASE WHEN min(l_partkey) % 7 <> 0 THEN min(l_linenumber) END AS sort_order,
  CASE WHEN max(l_partkey) % 11 = 0 THEN 1704067200000 END AS deleted_at FROM lineitem GROUP BY 1, 2),
annotations AS (SELECT conv_id * 1000 + turn AS id, conv_id % 50 AS item_id, CASE WHEN turn % 3 > 0 THEN turn % 3 END AS chapter, (turn * 7 % 10) / 10.0::DOUBLE AS position,
  1706745600000 - (conv_id * 37 + turn) % 500 * 86400000 AS created_at, [NULL, 'green', 'blue', 'yellow'][conv_id % 4 + 1] AS color,
  CASE WHEN role = 'user' THEN text END AS selected_text, CASE WHEN role <> 'user' THEN text END AS note_text, ['t' || (conv_id % 5), 'u' || (turn % 3)] AS themes FROM conversations),
goals AS (SELECT c_custkey AS goal_id, ['time', 'count', 'list'][c_custkey % 3 + 1] AS type, ['daily', 'weekly', 'monthly', 'yearly'][c_custkey % 4 + 1] AS period, c_custkey % 50 AS target FROM customer),
goal_items AS (SELECT DISTINCT o_custkey AS goal_id, o_orderkey % 1000 AS item_id FROM orders),
candidates AS (SELECT p_partkey AS id, p_name || ' ' || p_size AS title, CASE WHEN p_partkey % 9 > 0 THEN 'Writer ' || (p_partkey % 40) END AS author,
  [upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)), p_brand, string_split(p_name, ' ')[1]] AS subjects, ['book', 'ao3', 'ffn'][p_partkey % 3 + 1] AS source, 's' || (p_partkey * 7 % 1700) AS source_id,
  CASE WHEN p_partkey % 4 = 0 THEN '978' || (p_partkey % 900) END AS isbn, p_partkey % 101 / 100.0::DOUBLE AS score, p_partkey % 6 = 0 AS owned FROM part)
"""
