"""Sequences of lines, pages, chapters and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, folded_name, with_value

#: Fixed values, in points: how far items of a line are apart at most, the spacing of a page that shows none, gaps that aren't spacing.
SAME_LINE, SPACING, NO_SPACING = 5, 12, 100
#: Fixed value: the share of a font's height above its baseline.
ASCENT = 0.8
#: Characters of a block by which matches and items of a page are joined.
BLOCK = 64


def running(lines: DataFrame, doc: str, line: str, least: int = 3) -> DataFrame:
    """Lines that occur least times or more in a document (headers and footers), in any case, and how often."""
    text = F.lower(F.trim(F.col(line)))
    return lines.filter(text != "").groupBy(doc, text.alias(line)).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


#: Pages looked at, fewest pages and first page of such a look, shares of the height that are header and footer, fewest hits,
#: and texts that number pages.
SAMPLE, LEAST_PAGES, FIRST_PAGE, HEADER, FOOTER, HITS = 8, 6, 4, 0.92, 0.08, 3
PAGE_NUMBER = r"(?i)^\d+$|^page\s+\d+|^\d+\s*of\s*\d+$"


def running_text(items: DataFrame, doc: str = "doc") -> DataFrame:
    """Doc, line of the headers and footers of documents: texts (in any case) that stand at the top or bottom of HITS or more of SAMPLE pages
    spread over the document, and page numbers there. Documents of a few pages have none.

    items: doc, page (from 1), y (from the bottom), height (of the page), str.
    """
    n = items.groupBy(doc).agg(F.max("page").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    start = F.least(F.lit(FIRST_PAGE), F.col("n"))
    page = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE - 1)), lambda i: F.least(F.floor(start + i / (SAMPLE - 1) * (F.col("n") - start) + 0.5), F.col("n")).cast("long"))
    looked = n.select(doc, F.explode(F.array_distinct(page)).alias("page"))
    edge = (F.col("y") > F.col("height") * HEADER) | (F.col("y") < F.col("height") * FOOTER)
    text = F.lower(F.trim("str"))
    found = items.filter(edge & (text != "")).withColumn("page", F.col("page").cast("long")).join(looked, [doc, "page"])
    return found.groupBy(doc, text.alias("line")).agg(F.count("*").alias("n")).filter((F.col("n") >= HITS) | F.col("line").rlike(PAGE_NUMBER)).select(doc, "line")


def spacing(rows: DataFrame, doc: str, gap: str) -> DataFrame:
    """Of each document, the median gap and the one at a tenth of the sorted gaps."""
    g = rows.groupBy(doc).agg(F.median(gap).alias("middle"), F.sort_array(F.collect_list(gap)).alias("gaps"))
    return g.select(doc, "middle", F.get("gaps", F.floor(F.size("gaps") * 0.1).cast("int")).alias("tenth"))


def _neighbours(rows: DataFrame, doc: str, page: str, order: str, side) -> DataFrame:
    other = side(page).over(Window.partitionBy(doc).orderBy(order))
    return rows.withColumn("_other", other).filter(F.col("_other").isNull() | (F.col("_other") != F.col(page))).drop("_other")


def first_of_runs(rows: DataFrame, doc: str, page: str, order: str) -> DataFrame:
    """Of neighbours with one page, the first."""
    return _neighbours(rows, doc, page, order, F.lag)


def last_of_runs(rows: DataFrame, doc: str, page: str, order: str) -> DataFrame:
    """Of neighbours with one page, the last."""
    return _neighbours(rows, doc, page, order, F.lead)


def skew(rows: DataFrame, doc: str, order: str, label: str, own: str) -> DataFrame:
    """How many labels of a table of contents fit their own target, how many the next one, and whether it is off by one."""
    nexts = rows.withColumn("_next", F.lead(own).over(Window.partitionBy(doc).orderBy(order)))
    g = nexts.groupBy(doc).agg(F.count_if(F.col(own) == F.col(label)).alias("own"), F.count_if(F.col("_next") == F.col(label)).alias("next"), F.count("*").alias("n"))
    return g.select(doc, "own", "next", (F.col("next") > 0.6 * F.col("n")).alias("skewed"))


def page_chunks(rows: DataFrame, doc: str, page: str, n: int = 10) -> DataFrame:
    """Pages in chunks of n."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    return rows.withColumn("chunk", F.floor((place - 1) / n).cast("long"))


def paragraphs(lines: DataFrame, doc: str, order: str, wide: float = 1.5, indent: float = 10) -> DataFrame:
    """Lines (gap before it, indent) with paragraph, which a wide gap (against the document's median) or an indent begins."""
    middle = lines.groupBy(doc).agg(F.median("gap").alias("_middle"))
    cut = (F.col("gap") > wide * F.col("_middle")) | (F.col("indent") > indent)
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.join(middle, doc).withColumn("paragraph", F.sum(cut.cast("int")).over(w)).drop("_middle")


def current_chapter(chapters: DataFrame, positions: DataFrame, ahead: int = 80) -> DataFrame:
    """Of each document, the last chapter that starts no later than a little behind the position; as-of by aggregation."""
    met = chapters.join(positions, "doc").filter(F.col("start") <= F.col("position") + ahead)
    return met.groupBy("doc").agg(F.max_by("chapter", F.struct("start", "chapter")).alias("chapter"))


def heatmap(days: DataFrame, as_of: str, weeks: int = 53) -> DataFrame:
    """E5: weeks from Monday up to the week of as_of: day, week, dow, whether it is to come, the month where it changes, and the time read."""
    end = F.lit(as_of).cast("date")
    monday = F.to_date(F.date_trunc("week", end))
    first = F.date_sub(monday, 7 * (weeks - 1))
    every = days.sparkSession.range(1).select(F.explode(F.sequence(first, F.date_add(monday, 6))).alias("day"))
    n = F.date_diff("day", first)
    out = every.join(days, "day", "left").select("day", F.floor(n / 7).cast("int").alias("week"), (n % 7).cast("int").alias("dow"), (F.col("day") > end).alias("future"), F.coalesce("total_ms", F.lit(0)).alias("total_ms"))
    changed = (F.col("dow") == 0) & ((F.col("week") == 0) | (F.month("day") != F.month(F.date_sub("day", 7))))
    return out.withColumn("label", F.when(changed, F.month("day")))


def digests(rows: DataFrame, key: str, term: str, most: int) -> DataFrame:
    """The commonest terms of each key as labelled lines."""
    counts = rows.groupBy(key, term).agg(F.count("*").alias("n"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(term).alias("t")))), 1, most)
    return counts.groupBy(key).agg(listed.alias("l")).select(key, F.array_join(F.transform("l", lambda e: F.concat(e["t"], F.lit(": "), (-e["o"]).cast("string"))), "\n").alias("digest"))


_LINE = "struct<text: string, y: double, min_x: double, width: double>"


def lines(items: DataFrame, page: str = "page") -> DataFrame:
    """Page, line (from 1, top to bottom), text, y, min_x, width of the lines of each page.

    items: page, x, y, str, width. From top to bottom, an item more than SAME_LINE below the first item of a line begins the next one. Then tokens of
    one or two characters (marks above the line) join the nearer line, if it is nearer than the page's median spacing. Folds over one
    page's items, sorted.
    """
    item = F.struct((-F.col("y")).alias("down"), "x", "str", "width")
    return lines_of_pages(items.groupBy(page).agg(F.collect_list(item).alias("items")), page)


def lines_of_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    """E17 for rows that hold all items (down: -y, x, str, width) of a page: lines() without a shuffle of the items."""
    pages = pages.withColumn("items", F.sort_array("items"))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"))

    def placed(acc: Column, e: Column) -> Column:
        new = acc["first"].isNull() | (e["down"] - acc["first"] > SAME_LINE)
        return F.struct(F.when(new, e["down"]).otherwise(acc["first"]).alias("first"), (acc["i"] + 1).alias("i"), F.when(new, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = F.aggregate("items", start, placed)["cuts"]

    def line(first: Column, i: Column, every: Column) -> Column:
        end = F.coalesce(F.get(every, i + 1), F.size("items"))
        own = F.sort_array(F.transform(F.slice("items", first + 1, end - first), lambda e: F.struct(e["x"].alias("x"), e["down"].alias("down"), e["str"].alias("str"), e["width"].alias("width"))))

        def joined(own: Column) -> Column:
            real = F.get(F.filter(own, lambda e: F.trim(e["str"]) != ""), F.lit(0))
            text = F.trim(F.array_join(F.transform(own, lambda e: e["str"]), ""))
            width = F.aggregate(own, F.lit(0.0), lambda s, e: s + e["width"])
            return F.struct(text.alias("text"), (-F.get(own, F.lit(0))["down"]).alias("y"), real["x"].alias("min_x"), width.alias("width")).cast(_LINE)

        return with_value(own, joined)

    raw = pages.withColumn("cuts", cuts).select(page, F.filter(F.transform("cuts", lambda c, i: line(c, i, F.col("cuts"))), lambda x: x["text"] != "").alias("raw"))
    gaps = F.filter(F.zip_with(F.slice("raw", 1, F.size("raw") - 1), F.slice("raw", 2, F.size("raw")), lambda a, b: F.abs(a["y"] - b["y"])), lambda g: (g > 0) & (g < NO_SPACING))
    by_size = raw.withColumn("gaps", F.when(F.size("raw") > 1, F.array_sort(gaps)).otherwise(F.array().cast("array<double>")))
    half = F.floor(F.size("gaps") / 2).cast("int")
    middle = F.when(F.size("gaps") % 2 == 1, F.get("gaps", half)).otherwise((F.get("gaps", half - 1) + F.get("gaps", half)) / 2)
    rows = by_size.withColumn("spacing", F.coalesce(middle, F.lit(float(SPACING))))

    # of each line: the number of the line it becomes part of, and how: 0 as itself, 1 behind it, -1 before it
    begin = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("n"), F.lit(False).alias("skip"), F.array().cast("array<struct<n: int, how: int>>").alias("out"))
    far = F.lit(float("inf"))

    def decided(acc: Column, e: Column) -> Column:
        both = F.struct(F.coalesce(F.abs(acc["y"] - e["y"]), far).alias("up"), F.coalesce(F.abs(e["y"] - e["after"]), far).alias("down"))
        how = with_value(both, lambda g: F.when(acc["skip"] | ~e["short"], 0).when((g["up"] <= g["down"]) & (g["up"] < F.col("spacing")), 1).when(g["down"] < F.col("spacing"), -1).otherwise(0))

        def taken(how: Column) -> Column:
            n = acc["n"] + F.when(acc["skip"] | (how == 1), 0).otherwise(1)
            y = F.when(how == 1, acc["y"]).when(how == -1, e["after"]).otherwise(e["y"])
            return F.struct(y.alias("y"), n.alias("n"), (how == -1).alias("skip"), F.concat(acc["out"], F.array(F.struct(n.alias("n"), how.alias("how")))).alias("out"))

        return with_value(how, taken)

    seen = F.transform("raw", lambda x, i: F.struct(x["y"].alias("y"), F.get("raw", i + 1)["y"].alias("after"), (F.length(x["text"]) <= 2).alias("short")))
    marked = rows.select(page, "raw", F.aggregate(seen, begin, decided)["out"].alias("out"))
    each = marked.select(page, F.posexplode(F.zip_with("raw", "out", lambda x, o: F.struct(x.alias("x"), o.alias("o")))).alias("i", "e")).select(page, "i", "e.x", "e.o")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x.text"))), lambda e: e["text"]), "")
    main = lambda c: F.max(F.when(F.col("o.how") == 0, F.col(f"x.{c}")))
    whole = each.groupBy(page, F.col("o.n").alias("line")).agg(text.alias("text"), main("y").alias("y"), F.min(F.when(F.col("o.how") < 1, F.col("x.min_x"))).alias("min_x"), F.sum("x.width").alias("width"))
    return whole.select(page, "line", "text", "y", "min_x", "width")


def item_rect(transform: Column, width: Column, viewport: Column) -> Column:
    """array(x, y, width, height) of a text item, from the top left: its affine transform (six numbers) seen through the viewport's."""
    m = lambda i: F.get(viewport, F.lit(i))
    t = lambda i: F.get(transform, F.lit(i))
    b, c, d = m(1) * t(0) + m(3) * t(1), m(0) * t(2) + m(2) * t(3), m(1) * t(2) + m(3) * t(3)
    a, e, f = m(0) * t(0) + m(2) * t(1), m(0) * t(4) + m(2) * t(5) + m(4), m(1) * t(4) + m(3) * t(5) + m(5)
    angle, height = F.atan2(b, a), F.hypot(c, d)
    ascent = height * ASCENT
    return F.array(e + ascent * F.sin(angle), f - ascent * F.cos(angle), width.cast("double"), height)


def sliced(rect: Column, start: Column, end: Column) -> Column:
    """The part of a rectangle between two shares of its width."""
    x, y, w, h = (F.get(rect, F.lit(i)) for i in range(4))
    return F.array(x + w * start, y, w * (end - start), h)


def contains_point(rect: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a rectangle, its edges included."""
    left, top, w, h = (F.get(rect, F.lit(i)) for i in range(4))
    return (x >= left) & (x <= left + w) & (y >= top) & (y <= top + h)


def found_rects(items: DataFrame, needle: str, page: str = "page") -> DataFrame:
    """Page, n (from 1, in reading order), slices (array of rectangles) of each occurrence of the needle on a page, without overlaps; case and
    diacritics don't matter.

    items: page, i (their order), str, rect (array of x, y, width, height), eol (a line ends behind the item). A match over several items has a slice of
    each. Matches and items are joined by blocks of characters and then by their overlap.
    """
    wanted = folded_name(needle)
    text = folded(F.coalesce("str", F.lit("")))
    broken = F.when(F.coalesce("eol", F.lit(False)) & ~text.rlike(r"\s$"), F.concat(text, F.lit(" "))).otherwise(text)
    rows = items.select(F.col(page).alias("page"), "i", broken.alias("t"), F.length(text).alias("size"), "rect")
    before = Window.partitionBy("page").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("a", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0)))
    whole = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda e: e["t"]), "").alias("t"))
    parts = whole.select("page", F.split("t", r"\Q" + wanted + r"\E", -1).alias("p")).filter((F.size("p") > 1) & F.lit(bool(wanted)))
    gaps = parts.select("page", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("n", "gap"))
    to = F.sum(F.length("gap") + len(wanted)).over(Window.partitionBy("page").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    matches = gaps.select("page", (F.col("n") + 1).alias("n"), to.alias("e"), (to - len(wanted)).alias("s"))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / BLOCK), F.floor((b - 1) / BLOCK)))
    cut_matches = matches.select("*", blocks(F.col("s"), F.col("e")).alias("block"))
    cut_items = held.filter("size > 0").select("page", "i", "a", "size", "rect", blocks(F.col("a"), F.col("a") + F.col("size")).alias("block"))
    met = cut_matches.join(cut_items, ["page", "block"]).filter((F.col("a") < F.col("e")) & (F.col("a") + F.col("size") > F.col("s")) & (F.floor(F.greatest("a", "s") / BLOCK) == F.col("block")))
    part = sliced(F.col("rect"), F.greatest(F.col("s") - F.col("a"), F.lit(0)) / F.col("size"), F.least(F.col("e") - F.col("a"), F.col("size")) / F.col("size"))
    return met.groupBy("page", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("r")))), lambda e: e["r"]).alias("slices")).withColumnRenamed("page", page)
