"""Scalar functions against plain versions."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


def many(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r["x"] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_folding(spark):
    texts = ["Ärger Éa", "ß", "café", "café", "Łódź ﬁ", "Ἀχιλλεύς", "İstanbul", "ệ", "", None, "".join(chr(c) for c in range(0xA0, 0x250))]
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not 0x300 <= ord(c) <= 0x36F)
    assert many(spark, T.folded, texts) == [plain(t) for t in texts]


def test_entities(spark):
    texts = ["&amp;lt;b&amp;gt;", "&NBSP;x&Quot;y&apos;&#39;", "a&#233;b&#x41;c&#8217;d", "&amp;#233;", "&#160;z&#xE9;", "&#55357;", "&#;&#x;", "no entity", "<p>&lt;p&gt;</p>", None]
    want = ["<b>", "x\"y''", "aébAc’d", "é", "zé", "\ufffd", "&#;&#x;", "no entity", "<p>", None]
    got = many(spark, T.body_text, texts)
    assert [g for g, w in zip(got, want, strict=True) if w is not None] == [w for w in want if w is not None]
    assert many(spark, T.html_to_text, ["&amp;lt;", "&LT;x&#39;", "a&#233;"]) == ["<", "<x'", "a&#233;"]


SANITISED = [
    ("<p>ok</p><script>alert(1)</script>", "<p>ok</p>"),
    *((f"<{t}>x</{t}><p>keep</p>", "<p>keep</p>" if t == "style" else "x<p>keep</p>") for t in ("style", "iframe", "form", "video", "svg")),
    ('<img src="https://e.com/a.png" onerror="alert(1)">', '<img src="https://e.com/a.png" loading="lazy" />'),
    ('<div class="epub-settings-overlay" id="x">t</div>', "<div>t</div>"),
    ('<a href="javascript:alert(1)">x</a>', "<a>x</a>"),
    ('<a href="data:text/html,x">x</a>', "<a>x</a>"),
    ('<img src="data:image/png;base64,AAAA">', '<img loading="lazy" />'),
    ('<a href="https://example.com/x" title="t">x</a>', '<a href="https://example.com/x" title="t">x</a>'),
    ('<img src="https://e.com/a.png" alt="a" loading=eager>', '<img src="https://e.com/a.png" alt="a" loading="lazy" />'),
    ('<table><tr><td colspan="2" rowspan="3">c</td></tr></table>', '<table><tr><td colspan="2" rowspan="3">c</td></tr></table>'),
    ("<h2>T</h2><p><strong>a</strong> <em>b</em></p><blockquote>q</blockquote>", "<h2>T</h2><p><strong>a</strong> <em>b</em></p><blockquote>q</blockquote>"),
    # beyond the published cases
    ("<a href=javascript:x()>u</a>", "<a>u</a>"),
    ("<p/onclick=x()>t</p>", "<p>t</p>"),
    ("<img/src='http://a/b.png'/onerror=alert(1)//>", '<img src="http://a/b.png" loading="lazy" />'),
    ("<a href='java&#115;cript:x()'>a</a><a href='java&#x09;script:x'>b</a><a href=' \x01javascript:x'>c</a><a href='javascript&colon;x'>d</a>", "<a>a</a><a>b</a><a>c</a><a>d</a>"),
    ("<a href=&#106avascript:x>e</a><a HREF=JavaScript:x>f</a><a href='mailto:x@y'>g</a>", "<a>e</a><a>f</a><a>g</a>"),
    ("<a href='/a?b=c:d'>r</a><a href=//h/p>s</a><a href='#f'>t</a><a href=x.html>u</a>", '<a href="/a?b=c:d">r</a><a href="//h/p">s</a><a href="#f">t</a><a href="x.html">u</a>'),
    ("<a href=https://ok href=javascript:x>t</a>", '<a href="https://ok">t</a>'),
    ("<scr<!-- -->ipt>alert(1)</script><p>z", "alert(1)<p>z"),
    ("<script>open", ""),
    ("<!DOCTYPE html><?x?><!-- <p>no</p> -->a < b > c <p", "a &lt; b &gt; c &lt;p"),
    ("<dl><dt>a</dt><dd>b</dd></dl><del>c</del><ins>d</ins><mark>e</mark><article><aside>f</aside></article>", "<dl><dt>a</dt><dd>b</dd></dl><del>c</del><ins>d</ins><mark>e</mark><article><aside>f</aside></article>"),
    ("<BR><hr/></br><P TITLE=x data-x=1>t</P>", "<br /><hr /><p>t</p>"),
    ("<a title='a>b\"c' href=x>t</a>", '<a title="a&gt;b&quot;c" href="x">t</a>'),
    ("", ""),
    (None, None),
]


def test_sanitiser(spark):
    assert many(spark, T.sanitised, [a for a, _ in SANITISED]) == [b for _, b in SANITISED]


def test_titles(spark):
    title = "The (Odd) Title."
    assert one(spark, T.without_title, f"{title} {title.upper()}  {title} {title} {title} rest of {title} x", title) == f"rest of {title} x"
    assert [one(spark, T.without_title, t, n) for t, n in (("x y", ""), ("The Titles", "The Title"), (r"a\Eb c", r"a\Eb"), ("", "t"), ("t t", "t"))] == ["x y", "The Titles", "c", "", "t"]


def test_links(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c.html?x=1#f", "https://h.org", "http://h.org/a/"]
    links = ["../d", "./e", "f", "/g/../h", "../../../../i", "#x", "?q=..", "//o.net/a/./b", "https://z.org/a/../b", "..", ".", "", "a/b/../c?d=../e"]
    for b in bases:
        for link in links:
            want = urljoin(b, link).replace("z.org/a/..", "z.org") if link else b.partition("#")[0]
            want = re.sub(r"/(\.\./)+", "/", want).replace("/./", "/")
            got = one(spark, T.resolved_url, b, link)
            assert got == want or got == want.replace("h.org", "h.org/", 1) or (link in ("#x", "?q=..", "") and got == urljoin(b, link)), (b, link, got, want)


@pytest.mark.parametrize("text", ["", "abc", "a😀b", "😀" * 2100, "x" * 3999 + "😀", "é😀z" * 1400, "y" * 5000, "😀" + "y" * 4500 + "😀z"])
def test_content_hash_counts_units(spark, text):
    units = [int.from_bytes(text.encode("utf-16-be")[i : i + 2], "big") for i in range(0, 2 * len(text.encode("utf-16-be")) // 2, 2)]
    sample, h = (units[:2000] + units[-2000:] if len(units) > 4000 else units), 0
    for u in sample:
        h = (h * 31 + u) & 0xFFFFFFFF
    assert one(spark, T.content_hash, text) == f"{len(units)}:{h}"


def test_colors(spark):
    from quillspark.functions import colors

    one_row = spark.range(1)
    c = lambda x: F.lit(x)
    got = one_row.select(
        colors.shifted(c("#0a14FA"), c(10)), colors.shifted(c("#0a1405"), c(-10)), colors.darkened(c("#804020"), 0.25), colors.blend(c("#ffffff"), c("#000000"), 0.5), colors.luminance(c("#ffffff")),
        colors.luminance(c("#000000")), colors.shifted(c("red"), c(1)), colors.luminance(c("#fff")), colors.is_hex(c("#12345")), colors.is_hex(c("#aBcDeF")), colors.is_hex(F.lit(None).cast("string")),
    ).first()
    assert tuple(got) == ("#141eff", "#000a00", "#603018", "#808080", pytest.approx(1.0), 0.0, None, None, False, True, False)
