"""The order of a serial's pages, by their links to the next and the previous one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..tables import dropped, written

#: Fixed value: most steps back from a page.
MAX_PREV_HOPS = 500


def nav_link(html: Column, url: Column, rel: str) -> Column:
    """The absolute URL of a page's link to the next (or prev) one: <link rel>, else <a rel>, else the first link or button whose text or label says
    so; null without one."""
    with_rel = lambda name: F.get(F.filter(P.tags(html, name), lambda t: F.lower(P.attribute(t, "rel")) == rel), F.lit(0))
    wanted = P.NEXT_TEXT if rel == "next" else P.PREV_TEXT

    def leads(e: Column) -> Column:
        href = F.coalesce(P.attribute(F.regexp_extract(e, "(?s)^<[^>]*>", 0), "href"), F.lit(""))
        return P.says(e, wanted) & (href != "") & ~href.startswith("#")

    by_text = P.attribute(F.get(F.filter(P.elements(html, "a|button"), leads), F.lit(0)), "href")
    in_page = T.with_value(P.attribute(with_rel("a"), "href"), lambda x: F.when(~x.startswith("#"), x))
    return T.resolved_url(url, F.coalesce(P.attribute(with_rel("link"), "href"), in_page, by_text))


def page_key(url: Column) -> Column:
    """What pages are told apart by: origin in lower case, path without an end slash, query."""
    return T.with_value(url, T.canonical_url)


def walked(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, node, place (from 0) of each node that one reaches from a start by following its link again and again, up to the first node
    that was there before, and most nodes.

    links: node, to (one row a node; a null or unknown to ends the walk); starts: start (a node). The links are doubled each round: with those
    over 2 ** k steps, the nodes of the first 2 ** k places give the next as many, so rounds are the logarithm of the longest walk.
    """
    nodes = links.select("node")
    jump = written(links.filter("to IS NOT NULL").join(nodes.withColumnRenamed("node", "to"), "to", "left_semi").select("node", "to"))
    path = written(starts.select("start").distinct().join(nodes.withColumnRenamed("node", "start"), "start", "left_semi").select("start", F.col("start").alias("node"), F.lit(0).alias("place")))
    step = 1
    while step < most:
        further = path.join(jump, "node").select("start", F.col("to").alias("node"), (F.col("place") + step).alias("place")).filter(F.col("place") < most)
        longer = written(path.unionByName(further).groupBy("start", "node").agg(F.min("place").alias("place")))
        grown = longer.count() > path.count()
        doubled = written(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("beyond")), "to").select("node", F.col("beyond").alias("to")))
        dropped(path, jump)
        path, jump, step = longer, doubled, 2 * step
        if not grown:
            break
    dropped(jump)
    return path


def crawl_order(pages: DataFrame, starts: DataFrame, most: int = P.MAX_CHAPTERS, back: int = MAX_PREV_HOPS) -> DataFrame:
    """L3: start, place (from 0), node of the pages of a serial, first to last: from the start page back over its previous pages, back at most, then on over
    the next ones; a page that was already there ends either way, and there are no more than most pages.

    pages: node, next, prev (nodes, perhaps null or unknown); starts: start.
    """
    behind = walked(pages.select("node", F.col("prev").alias("to")), starts, back + 1)
    ahead = walked(pages.select("node", F.col("next").alias("to")), starts, most)
    turn = behind.groupBy("start").agg(F.max("place").alias("n"))
    met = ahead.filter("place > 0").join(behind.select("start", "node"), ["start", "node"]).groupBy("start").agg(F.min("place").alias("stop"))
    on = ahead.join(turn, "start").join(met, "start", "left").filter((F.col("stop").isNull() | (F.col("place") < F.col("stop"))) & (F.col("place") > 0) & (F.col("place") + F.col("n") < most))
    first = behind.join(turn, "start").select("start", (F.col("n") - F.col("place")).alias("place"), "node")
    return first.unionByName(on.select("start", (F.col("place") + F.col("n")).alias("place"), "node"))
