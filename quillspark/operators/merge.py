"""Merging change sets of several devices, link sets, tombstones, and collecting orphans.

Tables are immutable here: each operator returns the rows that a table has after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lists import placed


def _clock(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.updated_at"), F.lit(0))


def plan_pull(local: DataFrame, remote: DataFrame, key: str | list[str], columns: list[str], registers: tuple[str, ...] = (), append: bool = False) -> DataFrame:
    """What to do with each remote row, and the folded values.

    Missing rows are applied, dirty ones are kept; else the later clock wins (a missing one is 0), and with equal clocks
    the greater serialised values. Registers only grow. In append mode rows that are there are never changed. Actions:
    apply, skip_append, skip_dirty, keep, merge.
    """
    keys = [key] if isinstance(key, str) else key
    r, l = remote.alias("r"), local.withColumn("_here", F.lit(True)).alias("l")  # noqa: E741
    text = lambda side: T.composite(*(F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("")) for c in columns))
    wins = (_clock("r") > _clock("l")) | ((_clock("r") == _clock("l")) & (text("r") > text("l")))
    action = F.when(F.col("l._here").isNull(), "apply")
    action = action.when(F.lit(append), "skip_append").when(F.col("l.dirty"), "skip_dirty").when(wins, "merge").otherwise("keep")
    takes = F.col("action").isin("apply", "merge")

    def folded(c: str) -> Column:
        grown = F.col(f"l.{c}") if append else F.greatest(f"l.{c}", f"r.{c}")
        return F.when(F.col("action") == "apply", F.col(f"r.{c}")).otherwise(grown) if c in registers else F.when(takes, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))

    same = [F.col(f"r.{k}") == F.col(f"l.{k}") for k in keys]
    joined = r.join(l, same, "left").withColumn("action", action)
    return joined.select(*(F.col(f"r.{k}").alias(k) for k in keys), "action", *(folded(c).alias(c) for c in columns))


def natural_keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of one name share the smallest key as survivor; whether each survives. Names are aggregated before the join."""
    least = rows.groupBy(name).agg(F.min(key).alias("survivor"))
    return rows.select(key, name).join(least, name).withColumn("survives", F.col(key) == F.col("survivor"))


def repointed(links: DataFrame, losers: DataFrame, ref: str, others: list[str], now: int) -> DataFrame:
    """Links after the losers (loser, survivor) of a name collision went: each live link of a loser is a tombstone, and the
    survivor has a live, dirty link in its place (one that was a tombstone is live again)."""
    m = links.join(losers.withColumnRenamed("loser", ref), ref, "left").withColumn("_lost", F.col("survivor").isNotNull() & F.col("deleted_at").isNull())
    made = m.filter("_lost").select(*others, F.col("survivor").alias(ref), F.lit(None).cast("long").alias("deleted_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(True).alias("dirty"), F.lit(1).alias("_new"))
    stay = m.select(*others, ref, F.when(F.col("_lost"), F.lit(now)).otherwise(F.col("deleted_at")).cast("long").alias("deleted_at"), F.when(F.col("_lost"), F.lit(now)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"), (F.col("dirty") | F.col("_lost")).alias("dirty"), F.lit(0).alias("_new"))
    row = F.max_by(F.struct("deleted_at", "updated_at", "dirty"), "_new")
    return stay.unionByName(made.distinct()).groupBy(*others, ref).agg(row.alias("row")).select(*others, ref, "row.*")


def sweep(ledger: DataFrame, wanted: DataFrame, as_of: int, grace: int) -> DataFrame:
    """For each blob: keep what is wanted (unmark it if it was an orphan), mark new orphans, reap those older than grace."""
    have = wanted.select("hash").distinct().withColumn("used", F.lit(True))
    action = F.when(F.col("used") & F.col("orphaned_at").isNotNull(), "unmark").when(F.col("used"), "keep").when(F.col("orphaned_at").isNull(), "mark").when(F.col("orphaned_at") < as_of - grace, "reap").otherwise("wait")
    return ledger.join(have, "hash", "left").select("hash", action.alias("action"))


def janitor(objects: DataFrame, wanted: DataFrame, as_of: int, age: int) -> DataFrame:
    """Objects (key, modified) of a bucket with what to do: keep those wanted (user, hash), leave recent ones and keys of another
    shape, and name the orphans."""
    o = objects.withColumn("user", F.regexp_extract("key", "^users/([^/]+)/", 1)).withColumn("hash", F.regexp_extract("key", "/([0-9a-f]{64})$", 1))
    have = wanted.select("user", "hash").distinct().withColumn("used", F.lit(True))
    action = F.when(~T.is_blob_key(F.col("key")), "foreign").when(F.col("used"), "keep").when(F.col("modified") > as_of - age, "recent").otherwise("orphan")
    return o.join(have, ["user", "hash"], "left").select("key", action.alias("action"))


def janitor_report(actions: DataFrame) -> DataFrame:
    """D30."""
    return actions.agg(F.count("*").alias("scanned"), *(F.count_if(F.col("action") == a).alias(n) for a, n in (("keep", "kept"), ("recent", "recent"), ("orphan", "orphans"), ("foreign", "foreign"))))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows of new, and those of old whose key isn't among them."""
    keys = [key] if isinstance(key, str) else key
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def revived(links: DataFrame, new: DataFrame, keys: list[str], now: int) -> DataFrame:
    """Links with those of new, live; links that are there lose their tombstone and keep the rest."""
    added = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    out = links.withColumn("_old", F.lit(True)).join(added, keys, "full")
    gone = F.when(F.col("_new"), F.lit(None)).otherwise(F.col("deleted_at"))
    changed = F.col("_new") & (F.col("_old").isNull() | F.col("deleted_at").isNotNull())
    return out.select(*keys, *(F.col(c) for c in links.columns if c not in (*keys, "deleted_at", "updated_at")), gone.alias("deleted_at"), F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def replaced_set(links: DataFrame, chosen: DataFrame, owner: str, item: str, now: int) -> DataFrame:
    """For the owners that chosen (owner, item) names, exactly the chosen links are live; the others become tombstones. A null item only names its owner."""
    owners = chosen.select(owner).distinct().withColumn("_named", F.lit(True))
    wants = chosen.filter(F.col(item).isNotNull()).select(owner, item).distinct().withColumn("_want", F.lit(True))
    rows = links.select(owner, item, "deleted_at").withColumn("_old", F.lit(True)).join(wants, [owner, item], "full").join(owners, owner, "left")
    gone = F.when(F.col("_named").isNull(), F.col("deleted_at")).when(F.col("_want"), F.lit(None)).otherwise(F.coalesce("deleted_at", F.lit(now)))
    return rows.select(owner, item, gone.cast("long").alias("deleted_at"))


def deleted(parents: DataFrame, links: DataFrame, gone: DataFrame, ref: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Parents (id, name, deleted_at) and links with the rows of gone (id) as tombstones; a freed name can be used again."""
    mark = gone.select("id").distinct().withColumn("_gone", F.lit(True))
    p = parents.join(mark, "id", "left").withColumn("_now", F.coalesce("_gone", F.lit(False)) & F.col("deleted_at").isNull())
    p = p.withColumn("name", F.when(F.col("_now"), T.tombstone(F.col("name"), F.col("id"))).otherwise(F.col("name"))).withColumn("deleted_at", F.when(F.col("_now"), F.lit(now)).otherwise(F.col("deleted_at"))).drop("_gone", "_now")
    l = links.join(mark.withColumnRenamed("id", ref), ref, "left").withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), F.lit(now)).otherwise(F.col("deleted_at"))).drop("_gone")  # noqa: E741
    return p, l


def trashed(items: DataFrame, actions: DataFrame, now: int) -> DataFrame:
    """Items (id, deleted_at, purged_at) after actions (id, action): trash, restore, purge (of what is in the trash)."""
    a = items.join(actions.select("id", "action"), "id", "left")
    inside = F.col("deleted_at").isNotNull() & F.col("purged_at").isNull()
    gone = F.when((F.col("action") == "trash") & F.col("deleted_at").isNull(), F.lit(now)).when((F.col("action") == "restore") & inside, F.lit(None)).otherwise(F.col("deleted_at"))
    purged = F.when((F.col("action") == "purge") & inside, F.lit(now)).otherwise(F.col("purged_at"))
    return a.select("id", gone.cast("long").alias("deleted_at"), purged.cast("long").alias("purged_at"))


def moved(progress: DataFrame, positions: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """Progress (item_id, scroll, max_scroll) after new positions (item_id, scroll), which all items of a family take; the
    furthest position never falls."""
    family = F.coalesce("derived_from", "id")
    f = items.select("id", family.alias("family"))
    newest = positions.join(f, positions["item_id"] == f["id"]).groupBy("family").agg(F.max("scroll").alias("_new"))
    reach = f.join(newest, "family").select(F.col("id").alias("item_id"), "_new")
    out = progress.join(reach, "item_id", "full")
    furthest = F.when(F.col("_new").isNotNull(), F.greatest(F.coalesce("max_scroll", F.lit(0.0)), F.col("_new"))).otherwise(F.col("max_scroll"))
    return out.select("item_id", F.coalesce("_new", "scroll").alias("scroll"), furthest.alias("max_scroll"))


def period_goals(goals: DataFrame, wishes: DataFrame) -> DataFrame:
    """I8: goals (type, period, target) after wishes of the same columns: a target of 0 or less deletes, another one sets."""
    w = wishes.select("type", "period", F.col("target").alias("_wish"))
    return goals.join(w, ["type", "period"], "full").select("type", "period", F.coalesce("_wish", "target").alias("target")).filter("target > 0")


def found_or_created(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """Wanted (name, id for a new row) with the id of the live row of that name in any case, else the own id; of equal new names the smallest id."""
    have = names.filter("deleted_at IS NULL").groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("_have"))
    new = wanted.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("id").alias("_own"))
    joined = wanted.withColumn("k", F.lower(F.trim("name"))).join(have, "k", "left").join(new, "k")
    return joined.select("name", F.coalesce("_have", "_own").alias("id"), F.col("_have").isNull().alias("created"))


def stamped(rows: DataFrame, old: DataFrame, key: str, registers: tuple[str, ...], now: int) -> DataFrame:
    """Rows as a server keeps them: its own clock, and registers that never fall."""
    before = old.select(key, *(F.col(c).alias(f"_{c}") for c in registers))
    out = rows.join(before, key, "left")
    for c in registers:
        out = out.withColumn(c, F.greatest(c, f"_{c}")).drop(f"_{c}")
    return out.withColumn("updated_at", F.lit(now))


def read_back(local: DataFrame, pushed: DataFrame, key: str) -> DataFrame:
    """I16: local rows after the server's clocks (key, sent_at, server_at) came back: a row that hasn't changed since is clean."""
    p = pushed.select(key, "sent_at", "server_at")
    same = F.col("sent_at").isNotNull() & F.col("updated_at").eqNullSafe(F.col("sent_at"))
    return local.join(p, key, "left").withColumn("dirty", F.col("dirty") & ~same).withColumn("updated_at", F.when(same, F.col("server_at")).otherwise(F.col("updated_at"))).drop("sent_at", "server_at")


def page_of(feed: DataFrame, cursor: int, size: int) -> DataFrame:
    """The next rows of a change feed behind the cursor."""
    return feed.filter(F.col("updated_at") > cursor).orderBy("updated_at", "id").limit(size)


#: Rows of a page of a change feed.
PAGE = 1000


def pulled(feed: DataFrame, cursor: int, size: int = PAGE) -> DataFrame:
    """The rows of a feed (id, updated_at) behind a cursor with the page (from 1) that each arrives in, and the cursor (clock and
    id of its last row) to keep when that page is in. A cursor of clock and id loses and repeats nothing where a page ends among
    equal clocks. One job gives all pages, from the places of range-sorted rows."""
    rows = placed(feed.filter(F.col("updated_at") > cursor), F.asc("updated_at"), F.asc("id"))
    rows = rows.withColumn("page", F.ceil(F.col("place") / size)).drop("place")
    ends = rows.groupBy("page").agg(F.max(F.struct("updated_at", "id")).alias("end"))
    return rows.join(ends, "page").select(*feed.columns, "page", F.col("end.updated_at").alias("next_clock"), F.col("end.id").alias("next_id"))


def enqueued(outbox: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """Outbox (hash, state, attempts, at) with the wanted hashes: new ones are pending, those in error are pending again."""
    w = wanted.select("hash").distinct().withColumn("_want", F.lit(True))
    out = outbox.join(w, "hash", "full")
    again = F.col("_want") & (F.col("state").isNull() | (F.col("state") == "error"))
    return out.select("hash", F.when(again, "pending").otherwise(F.col("state")).alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(again, F.lit(now)).otherwise(F.col("at")).alias("at"))


def due(outbox: DataFrame, as_of: int, base: int = 1000, most: int = 300_000) -> DataFrame:
    """What may be sent: pending rows, and those in error whose back-off is over."""
    return outbox.filter((F.col("state") == "pending") | ((F.col("state") == "error") & (F.col("at") + T.backoff(base, F.col("attempts"), most) <= as_of)))


def backfilled(rows: DataFrame, clocks: list[str], now: int) -> DataFrame:
    """Rows without a clock get the best they have, and are dirty."""
    best = F.coalesce(*clocks, F.lit(now))
    return rows.withColumn("dirty", F.col("dirty") | F.col("updated_at").isNull()).withColumn("updated_at", F.coalesce("updated_at", best))


def source_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Source tags (item_id, name, category), where new ones replace all of their item; promoted are fandoms and relationships."""
    out = upsert_items(old, new)
    return out.withColumn("promoted", F.col("category").isin("fandom", "relationship"))


def upsert_items(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.unionByName(old.join(new.select("item_id").distinct(), "item_id", "left_anti").select(*new.columns))


def refreshed(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Items (id, text, hash, words) with new texts (id, text) where their hash differs; changed says where."""
    t = texts.select("id", F.col("text").alias("_text"), F.sha2("text", 256).alias("_hash"))
    out = items.join(t, "id", "left").withColumn("changed", F.coalesce(F.col("_hash") != F.col("hash"), F.lit(False)))
    new = lambda c, v: F.when(F.col("changed"), v).otherwise(F.col(c)).alias(c)
    return out.select("id", new("text", F.col("_text")), new("hash", F.col("_hash")), new("words", T.word_count(F.col("_text"))), "changed")


def appended_chapters(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """Items (id, text, last) with the chapters (id, number, text) behind the last one they have, in order; words are counted anew."""
    later = chapters.join(items.select("id", "last"), "id").filter(F.col("number") > F.col("last"))
    more = later.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("c"), F.max("number").alias("to"))
    whole = F.concat("text", F.coalesce(F.aggregate("c", F.lit(""), lambda s, x: F.concat(s, F.lit("\n\n"), x["text"])), F.lit("")))
    out = items.join(more, "id", "left").select("id", whole.alias("text"), F.coalesce("to", "last").alias("last"))
    return out.withColumn("words", T.word_count(F.col("text")))


def evicted(cache: DataFrame, as_of: int, ttl: int) -> DataFrame:
    """What of a cache (at) is fresh."""
    return cache.filter(F.col("at") >= as_of - ttl)
