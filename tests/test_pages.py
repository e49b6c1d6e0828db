"""Crawl order, addresses, lines and rectangles of pages against plain versions."""

import ipaddress
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.functions import net
from quillspark.operators import crawl, layout


def plain_order(pages, start, most, back):
    behind, node = [start], start
    while len(behind) <= back and pages[node][1] in pages and pages[node][1] not in behind:
        node = pages[node][1]
        behind.append(node)
    out, node = behind[::-1], start
    while len(out) < most and pages[node][0] in pages and pages[node][0] not in out:
        node = pages[node][0]
        out.append(node)
    return out


@pytest.mark.parametrize(("most", "back"), [(1000, 500), (10, 4), (1, 0)])
def test_crawl_order_is_that_of_a_walk(spark, most, back):
    r = random.Random(5)
    chain = {i: (i + 1, i - 1) for i in range(100, 150)}
    loops = {i: (200 + (i - 200 + 1) % 7, 200 + (i - 200 - 1) % 7) for i in range(200, 207)}
    rho = {300: (301, None), 301: (302, 300), 302: (303, 301), 303: (301, 302), 310: (310, 310)}
    fork = {400: (402, None), 401: (402, None), 402: (None, 401), 403: (400, 402)}
    wild = {i: (r.choice([None, *range(500, 540)]), r.choice([None, 9999, *range(500, 540)])) for i in range(500, 540)}
    pages = chain | loops | rho | fork | wild
    rows = spark.createDataFrame([(n, a, b, 1) for n, (a, b) in pages.items()], "node long, next long, prev long, place int")
    starts = [100, 120, 149, 203, 300, 302, 310, 400, 403, 510, 520]
    got = {}
    for x in crawl.crawl_order(rows, spark.createDataFrame([(s,) for s in [*starts, starts[0], 7777]], "start long"), most, back).collect():
        got.setdefault(x["start"], []).append((x["place"], x["node"]))
    assert {s: [n for _, n in sorted(v)] for s, v in got.items()} == {s: plain_order(pages, s, most, back) for s in starts}
    assert all([p for p, _ in sorted(v)] == [*range(len(v))] for v in got.values())


def test_a_long_chain_takes_logarithmically_many_rounds(spark):
    n = 1000
    rows = spark.range(n).select(F.col("id").alias("node"), (F.col("id") + 1).alias("to"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = crawl.walked(rows, spark.createDataFrame([(0,)], "start long"), 5000).agg(F.count("*"), F.sum("place")).first()
    assert tuple(got) == (n, n * (n - 1) // 2) and len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 150


NAV = [
    ('<head><link rel="next" href="../c/2"></head><a rel="next" href="/x">n</a>', "http://h.org/b/c/2"),
    ("<a class=x rel='next' href='/x?y=1'>go</a>", "http://h.org/x?y=1"),
    ('<a rel="next" href="#top">n</a><a href="3.html"> Next  Chapter </a>', "http://h.org/b/p/3.html"),
    ('<a href="a">See what happens next in Book 2</a>', None),
    ('<button aria-label="next page" href="q">x</button>', "http://h.org/b/p/q"),
    ('<a href="#"><b>Next</b></a><a href="r">&gt;&gt;</a>', "http://h.org/b/p/r"),
    ("<a href=s><span>→</span></a>", "http://h.org/b/p/s"),
    ("<p>nothing</p>", None),
    ("", None),
    (None, None),
]


def test_next_links(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(NAV)], "i int, html string")
    got = rows.select("i", crawl.nav_link(F.col("html"), F.lit("http://h.org/b/p/1.html"), "next").alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [w for _, w in NAV]


def plain_private(ip):
    try:
        a = ipaddress.ip_address(ip if "%" not in ip else "no scope")
    except ValueError:
        return False
    if a.version == 6:
        if int(a) >> 48 == 0 or int(a) >> 32 == 0xFFFF:
            return False if int(a) >> 32 not in (0, 0xFFFF) else plain_private(str(ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)))
        return any(a in ipaddress.ip_network(n) for n in net.PRIVATE_V6)
    return any(a in ipaddress.ip_network(n) for n in net.PRIVATE_V4)


def test_private_addresses(spark):
    r = random.Random(1)
    edges = [x for n in net.PRIVATE_V4 + net.PRIVATE_V6 for x in (ipaddress.ip_network(n)[0], ipaddress.ip_network(n)[-1])]
    ips = [str(type(e)(min(max(int(e) + d, 0), 2**e.max_prefixlen - 1))) for e in edges for d in (-1, 0, 1)]
    ips += [str(ipaddress.IPv4Address(r.randrange(2**32))) for _ in range(100)] + [str(ipaddress.IPv6Address(r.randrange(2**128))) for _ in range(100)]
    ips += ["::", "::1", "::ffff:127.0.0.1", "::FFFF:7f00:1", "::ffff:8.8.8.8", "::10.0.0.1", "::8.8.8.8", "FE80::1", "2001:db8::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    ips += ["", "256.1.1.1", "1.2.3", "01.2.3.4", "10.0.0.1 ", "a.b.c.d", "1::2::3", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::g", ":::", ":", "fe80::1%eth0", "host.example", "1.2.3.4::", "::1.2.3.4:5"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*ips, None])], "i int, ip string")
    got = rows.select("i", net.is_private(F.col("ip")).alias("x")).orderBy("i").collect()
    assert [(ip, g["x"]) for ip, g in zip([*ips, None], got, strict=True)] == [(ip, plain_private(ip) if ip else False) for ip in [*ips, None]]


def plain_lines(items):
    groups = []
    for x, y, s, w in sorted(items, key=lambda e: (-e[1], e[0], e[2], e[3])):
        if not groups or groups[-1][0][1] - y > 5:
            groups.append([])
        groups[-1].append((x, y, s, w))
    raw = []
    for g in groups:
        g = sorted(g, key=lambda e: (e[0], -e[1], e[2], e[3]))
        text = "".join(e[2] for e in g).strip(" ")
        if text:
            raw.append([text, g[0][1], next(e[0] for e in g if e[2].strip(" ")), sum(e[3] for e in g)])
    if len(raw) < 2:
        return raw
    gaps = [d for a, b in zip(raw, raw[1:]) if 0 < (d := abs(a[1] - b[1])) < 100]  # noqa: B905
    spacing, out, i = statistics.median(gaps) if gaps else 12, [], 0
    while i < len(raw):
        line = raw[i]
        if len(line[0]) <= 2:
            up = abs(out[-1][1] - line[1]) if out else math.inf
            down = abs(line[1] - raw[i + 1][1]) if i + 1 < len(raw) else math.inf
            if up <= down and up < spacing:
                out[-1] = [out[-1][0] + line[0], out[-1][1], out[-1][2], out[-1][3] + line[3]]
                i += 1
                continue
            if down < spacing:
                after = raw[i + 1]
                out.append([line[0] + after[0], after[1], min(line[2], after[2]), line[3] + after[3]])
                i += 2
                continue
        out.append(line)
        i += 1
    return out


def test_lines_of_pages(spark):
    r = random.Random(6)
    pages = {}
    for p in range(60):
        y, items = 700.0, []
        for _ in range(r.randrange(12)):
            y -= r.choice([4.0, 7.0, 12.0, 12.0, 13.0, 30.0, 120.0])
            short = r.random() < 0.3
            items += [(50.0 + 40 * k + r.randrange(3), y + r.choice([0.0, 0.0, 3.0, -2.0]), r.choice(["§", "* ", " ", "1"]) if short else r.choice(["word ", " the", "  ", "line"]), r.choice([5.0, 20.5])) for k in range(1 if short else r.randrange(1, 5))]
        pages[p] = items
    rows = spark.createDataFrame([(p, *e, 1) for p, items in pages.items() for e in items], "page int, x double, y double, str string, width double, line int").repartition(3)
    got = {}
    for x in layout.lines(rows).orderBy("page", "line").collect():
        got.setdefault(x["page"], []).append([x["text"], x["y"], x["min_x"], x["width"]])
    want = {p: w for p, items in pages.items() if (w := plain_lines(items))}
    assert got == want and sum(map(len, want.values())) > 150


def test_rectangles_of_matches(spark):
    """A match within an item, over two items, over a line's end, with marks and composed letters; next to a plain search."""
    items = [
        (1, 0, "The Café is", [10.0, 20.0, 110.0, 8.0], False), (1, 1, " open cafe", [120.0, 20.0, 50.0, 8.0], True), (1, 2, "ś here ca", [10.0, 40.0, 80.0, 8.0], False),
        (1, 3, "", [0.0, 0.0, 0.0, 0.0], False), (1, 4, "fe", [90.0, 40.0, 20.0, 8.0], True), (2, 0, "caf", [0.0, 0.0, 30.0, 5.0], True), (2, 1, "e", [0.0, 9.0, 10.0, 5.0], True),
        (3, 0, "x" * 300 + "cafecafe" + "y" * 100, [0.0, 0.0, 408.0, 1.0], None), (4, 0, None, [0.0, 0.0, 1.0, 1.0], False),
    ]
    rows = spark.createDataFrame(items, "page int, i int, str string, rect array<double>, eol boolean")
    got = {(x["page"], x["n"]): x["slices"] for x in layout.found_rects(rows, "CAFÉ").collect()}
    want = {
        (1, 1): [[10 + 110 * 4 / 11, 20, 110 * 4 / 11, 8]],
        (1, 2): [[120 + 50 * 6 / 10, 20, 50 * 4 / 10, 8]],
        (1, 3): [[10 + 80 * 7 / 9, 40, 80 * 2 / 9, 8], [90, 40, 20, 8]],
        (3, 1): [[300, 0, 4, 1]],
        (3, 2): [[304, 0, 4, 1]],
    }
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) and all(a == pytest.approx(b) for a, b in zip(got[k], want[k], strict=True)) for k in want)
    assert layout.found_rects(rows, "").collect() == []
    over = {(x["page"], x["n"]): len(x["slices"]) for x in layout.found_rects(rows, "cafe s").collect()}
    assert over == {(1, 1): 2}


def test_rectangles_of_items(spark):
    one = spark.range(1)
    array = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    view = array(1, 0, 0, -1, 0, 800)
    plain, turned = one.select(layout.item_rect(array(10, 0, 0, 10, 50, 700), F.lit(30), view).alias("a"), layout.item_rect(array(0, 10, -10, 0, 50, 700), F.lit(30), view).alias("b")).first()
    assert plain == pytest.approx([50, 92, 30, 10]) and turned == pytest.approx([50 + 8 * math.sin(-math.pi / 2), 100 - 8 * math.cos(-math.pi / 2), 30, 10])
    r = one.select(layout.sliced(array(10, 20, 100, 8), F.lit(0.25), F.lit(0.5)).alias("s"), *(layout.contains_point(array(10, 20, 100, 8), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("i", 10, 28), ("o", 9, 22)))).first()
    assert tuple(r) == ([35, 20, 25, 8], True, False)


def test_words_of_documents_become_lines_where_they_are_read(spark):
    """e17_lines shuffles lines, not words; its pages hold the words of a document in order."""
    from quillspark.queries import QUERIES

    out = QUERIES["e17_lines"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    items = {}
    for r in docs:
        for w, word in enumerate(re.sub(r"[ \t\n\x0b\f\r]+", " ", r["text"]).split(" ") if r["text"] is not None else ()):
            row = w // 9
            items.setdefault(f"{r['doc_id']}/{row // 40}", []).append((50.0 + 40 * (w % 9), 700.0 - 14 * (row % 40) + (6.0 if len(word) <= 2 else 0.0), word + " ", 5.0 * len(word)))
    flat = [(p, *i) for p, own in items.items() for i in own]
    want = layout.lines(spark.createDataFrame(flat, "page string, x double, y double, str string, width double"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
