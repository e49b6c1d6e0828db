"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that the HTML reader decodes, in any case and in this order (the ampersand before what it may set free).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"))
#: Marks that folding takes away.
MARKS = range(0x300, 0x370)


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: expressions that name large ones often would grow with each step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def folded_name(text: str) -> str:
    """H8 for one text on the driver."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if ord(c) not in MARKS)


@cache
def _folding() -> tuple[str, str]:
    """Lower-case characters of the basic plane that fold to one other, what they fold to, then the marks that vanish."""
    one = [(c, f) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if ord(c) not in MARKS and c == c.lower() and len(f := folded_name(c)) == 1 and f != c]
    return "".join(c for c, _ in one) + "".join(map(chr, MARKS)), "".join(f for _, f in one)


@cache
def fold_variants() -> dict[str, str]:
    """The other characters of the basic plane that fold to a character, by that character."""
    out: dict[str, str] = {}
    for c in map(chr, (*range(0x41, 0xD800), *range(0xE000, 0x10000))):
        if ord(c) not in MARKS and len(f := folded_name(c)) == 1 and f != c:
            out[f] = out.get(f, "") + c
    return out


def folded(text: str | Column) -> Column:
    """H8: lower case without diacritics, by a table that the Unicode decompositions give. Characters that decompose to several letters
    (Hangul syllables) stay composed."""
    return F.translate(F.lower(text), *_folding())


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm(text: Column) -> Column:
    """H1: lower case, only letters, digits and single blanks."""
    return collapse(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """H3."""
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def html_to_text(html: Column) -> Column:
    """H9: drop scripts, styles and tags, decode the common entities, collapse blanks."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return collapse(common_entities(F.regexp_replace(out, r"<[^>]*>", " ")))


def common_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.regexp_replace(text, f"(?i){entity}", char)
    return text


def _character(code: Column) -> Column:
    """The character of a UTF-16 unit; half of a pair is the replacement character."""
    unit = code.bitwiseAND(0xFFFF)
    return F.when(unit.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE"))


def decoded_numbers(text: Column, end: str = ";") -> Column:
    """text with all numeric entities (decimal, then hexadecimal) as characters."""
    number = {10: lambda n: _character(n.cast("long")), 16: lambda n: _character(F.conv(n, 16, 10).cast("long"))}
    for pattern, base in ((rf"&#(\d{{1,9}}){end}", 10), (rf"(?i)&#x([\da-f]{{1,7}}){end}", 16)):
        codes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), number[base])
        whole = F.zip_with(F.split(text, pattern, -1), codes, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        text = F.when(text.rlike(pattern), F.array_join(whole, "")).otherwise(text)
    return text


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+://[^/?]*)", 1))
    tail = F.substr(bare, F.length(head) + 1)
    return F.concat(head, F.regexp_replace(tail, r"/+$", ""))


def clamp(x: Column, low: float, high: float) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def clamp_rating(x: Column) -> Column:
    """To halves between 0 and 5; NaN and null are null."""
    return F.when(~F.isnan(x), clamp(F.floor(x * 2 + 0.5) / 2, 0.0, 5.0))


def clamp_progress(x: Column) -> Column:
    """Between 0 and 1; NaN and null are 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.coalesce(clamp(x, 0.0, 1.0), F.lit(0.0)))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


# hashes and keys


def _units(text: Column) -> Column:
    """The UTF-16 units of a text: two for each character beyond the basic plane."""
    code = lambda c: F.ascii(c).cast("long")
    pair = lambda c: F.array(F.shiftright(code(c) - 0x10000, 10) + 0xD800, (code(c) - 0x10000).bitwiseAND(0x3FF) + 0xDC00)
    each = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    wide = F.flatten(F.transform(each, lambda c: F.when(code(c) > 0xFFFF, pair(c)).otherwise(F.array(code(c)))))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(F.transform(each, code))


def _hashed(units: Column) -> Column:
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))


def content_hash(text: Column) -> Column:
    """H4: length and a 31-multiplier hash of the text's UTF-16 units (of its first and last 2,000, if it has more than 4,000)."""
    wide = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    n = F.length(text) + F.when(wide, F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).otherwise(0)
    # 2,000 characters have 2,000 units at least, so the ends of the sample are cut from these
    ends = F.concat(F.slice(_units(F.substring(text, 1, 2000)), 1, 2000), F.reverse(F.slice(F.reverse(_units(F.right(text, F.lit(2000)))), 1, 2000)))
    return F.concat(n.cast("string"), F.lit(":"), _hashed(F.when(n > 4000, ends).otherwise(_units(text))).cast("string"))


def hash31(id: Column) -> Column:
    """The same hash as an unsigned number."""
    step = lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(0xFFFFFFFF)
    return F.when(F.length(id) > 0, F.aggregate(F.split(id, ""), F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def color_of(id: Column, palette: int, signed: bool = False) -> Column:
    """The place of an id's color, by the unsigned hash, or by the absolute value of the signed one."""
    h = hash31(id)
    return (F.when(h >= 2**31, 2**32 - h).otherwise(h) if signed else h) % palette


def embedding_hash(meta: Column, content: Column) -> Column:
    """H6: changes with either; a null content is an empty one."""
    return F.sha2(F.concat(meta, F.lit("\x1f"), F.coalesce(content, F.lit(""))), 256)


def tombstone(name: Column, id: Column) -> Column:
    """A name that is free for others again."""
    return F.concat(name, F.lit("\x1f"), id.cast("string"))


def composite(*columns: Column) -> Column:
    """One key of several columns, told apart from any other."""
    return F.to_json(F.array(*(c.cast("string") for c in columns)))


# HTML and URLs


def body_text(html: Column) -> Column:
    """The text of the body, with numeric entities decoded as well."""
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)</body\s*>", 1)
    return collapse(F.translate(decoded_numbers(html_to_text(F.when(F.length(body) > 0, body).otherwise(html))), "\u00a0", " "))


def is_http(url: Column) -> Column:
    """B16."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def without_dots(url: Column) -> Column:
    """An absolute URL whose path has no . and .. segments; .. doesn't go beyond the top."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    def rebuilt(u: Column) -> Column:
        head, path, tail = (F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
        parts = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), step)
        whole = with_value(parts, lambda p: F.concat(F.array_join(p, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(p) > 0), "/").otherwise("")))
        return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(head, F.lit("/"), whole, tail)).otherwise(u)

    return with_value(url, rebuilt)


def resolved_url(base: Column, link: Column) -> Column:
    """A link of a page as an absolute URL."""

    def resolved(both: Column) -> Column:
        base, link = both["base"], both["link"]
        scheme, origin = F.regexp_extract(base, r"^([A-Za-z]+:)", 1), F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
        bare = F.regexp_replace(base, r"(?s)[?#].*$", "")
        folder = F.regexp_extract(bare, r"^([A-Za-z]+://.*/)", 1)
        own = F.when(F.length(F.regexp_extract(base, r"^[A-Za-z]+://[^/]*(/)", 1)) > 0, folder).otherwise(F.concat(origin, F.lit("/")))
        query = F.regexp_replace(base, r"(?s)#.*$", "")
        found = F.when(link == "", query).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link))
        found = found.when(link.startswith("#"), F.concat(query, link)).when(link.startswith("?"), F.concat(bare, link)).otherwise(F.concat(own, link))
        return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).otherwise(found)

    return without_dots(with_value(F.struct(base.alias("base"), link.alias("link")), resolved))


def numeric_chapter(url: Column) -> Column:
    """struct(head, number, tail) of a URL whose path ends with a number; null without one."""
    p = r"^(.*[/_-])(\d+)(/?(?:[?#].*)?)$"
    return F.when(url.rlike(p), F.struct(F.regexp_extract(url, p, 1).alias("head"), F.regexp_extract(url, p, 2).cast("long").alias("number"), F.regexp_extract(url, p, 3).alias("tail")))


def links(html: Column) -> Column:
    """The targets of a page's links."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)


def page_title(html: Column) -> Column:
    """The first heading, else the title, as text; null without either."""
    h1, title = (html_to_text(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)) for t in ("h1", "title"))
    return F.when(F.length(h1) > 0, h1).when(F.length(title) > 0, title)


def escaped_html(text: Column) -> Column:
    """H12."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def chapter_block(title: Column, html: Column) -> Column:
    """A chapter as a block; chapter_blocks() reads them back."""
    return F.concat(F.lit('<div class="chapter"><h2>'), escaped_html(title), F.lit("</h2>"), html, F.lit("</div><!--/chapter-->"))


def chapter_blocks(html: Column) -> Column:
    """The inner HTML of the chapters."""
    return F.regexp_extract_all(html, F.lit(r'(?s)<div class="chapter">(.*?)</div><!--/chapter-->'), 1)


def int_loose(text: Column) -> Column:
    """The digits of a text as a number; null without one."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) > 0, digits.cast("long"))


def work_status(chapters: Column) -> Column:
    """X/Y: complete when all are there; null for other texts."""
    p = r"^\s*([\d,]+)\s*/\s*([\d,]+|\?)\s*$"
    a, b = (F.regexp_replace(F.regexp_extract(chapters, p, i), ",", "") for i in (1, 2))
    return F.when(chapters.rlike(p), F.when(a == b, "complete").otherwise("in-progress"))


# words and labels


def metadata(title: Column, author: Column, tags: Column, description: Column, most: int = 400) -> Column:
    """Labelled parts, those that are there; long ones are cut."""
    cut = F.when(F.length(description) > most, F.rtrim(F.substring(description, 1, most))).otherwise(description)
    labelled = lambda k, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{k}: "), c))
    return F.concat_ws(" | ", F.concat(F.lit("title: "), title), labelled("author", author), labelled("tags", F.array_join(tags, ", ")), labelled("description", cut))


def duration(ms: Column) -> Column:
    """45s, 12m, 3h 5m."""
    h, m = F.floor(ms / 3_600_000), F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000 + 0.5)
    hours = F.when(m > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(h.cast("string"), F.lit("h")))
    return F.when(ms < 60_000, F.concat(js_round(ms / 1000).cast("string"), F.lit("s"))).when(ms < 3_600_000, F.concat(js_round(ms / 60_000).cast("string"), F.lit("m"))).otherwise(hours)


def word_label(n: Column) -> Column:
    """950, 12K, 1.2M."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(js_round(n / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def book_fraction(chapter: Column, within: Column, chapters: Column) -> Column:
    """How far into the book a place of a chapter is; null without a chapter or chapters."""
    return F.when(chapter.isNotNull() & (chapters > 0), clamp((chapter + clamp(within, 0.0, 1.0)) / chapters, 0.0, 1.0))


def fraction_chapter(fraction: Column, n: Column) -> Column:
    """The chapter (from 0) that a fraction of the book stands for."""
    return F.when(n <= 1, 0).otherwise(js_round(fraction * (n - 1))).cast("long")


def chapter_fraction(chapter: Column, n: Column) -> Column:
    """H47."""
    return F.when(n <= 1, 0.0).otherwise(chapter / F.greatest(n - 1, F.lit(1)))


def backoff(base: int, n: Column, most: int) -> Column:
    """H41."""
    return F.least(base * F.pow(F.lit(2.0), n), F.lit(float(most))).cast("long")


def progress(done: Column, total: Column) -> Column:
    """A percentage; null without a total."""
    return F.when(total > 0, js_round(done / F.when(total > 0, total) * 100).cast("long"))


def chapter_progress(message: Column) -> Column:
    """struct(done, total) of `chapter N of M` or `N/M`; null for other texts."""
    p = r"(?i)(\d+)\s*(?:/|of)\s*(\d+)"
    return F.when(message.rlike(p), F.struct(F.regexp_extract(message, p, 1).cast("long").alias("done"), F.regexp_extract(message, p, 2).cast("long").alias("total")))


def context_score(a: Column, b: Column) -> Column:
    """How many characters two contexts share at the same places."""
    n = F.least(F.length(a), F.length(b))
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))).otherwise(0)


def normal_word(raw: Column) -> Column:
    """Lower case, without what isn't a letter at either end."""
    return F.regexp_replace(F.trim(F.lower(raw)), r"^[^\p{L}]+|[^\p{L}]+$", "")


#: Suffixes of inflected words and what replaces them, in the order of trial.
SUFFIXES = (("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("zes", "z"), ("es", ""), ("s", ""), ("ied", "y"), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("er", ""), ("est", ""), ("er", "e"), ("est", "e"))


def base_forms(word: Column) -> Column:
    """The words that an inflected one may come from, in the order of trial."""
    by_rule = [F.when(word.endswith(suffix), F.concat(F.substr(word, F.lit(1), F.length(word) - len(suffix)), F.lit(new))) for suffix, new in SUFFIXES]
    p = r"^(.*[aeiou])([bcdfghjklmnpqrstvwxyz])\2(ing|ed)$"
    doubled = F.when(word.rlike(p), F.concat(F.regexp_extract(word, p, 1), F.regexp_extract(word, p, 2)))
    return F.array_distinct(F.filter(F.array_compact(F.array(*by_rule, doubled)), lambda x: (F.length(x) >= 2) & (x != word)))


#: How lines that begin a chapter start; titles of what isn't a chapter, by how they begin and as a whole.
HEADING = r"(?i)^(chapter|part|section|prologue|epilogue|afterword|interlude|book|volume|arc|coda|preface|introduction|conclusion|appendix)\b"
MATTER_PREFIX = (
    r"^(half[\s-]?title|title\s?page|frontispiece|copyright|colophon|imprint|dedication|epigraph|foreword|preface|prologue|prelude|introduction|epilogue|afterword|postscript|acknowledge?ments?"
    r"|appendix|appendices|glossary|bibliography|discography|filmography|maps? of|list of|about the author|about the publisher|also by|by the same author|other books(?: by)?|coming soon|praise for"
    r"|permissions|author.?s note|translator.?s note|publisher.?s note)\b"
)
MATTER_WHOLE = r"^(cover|contents|table of contents|notes|endnotes?|footnotes?|index|references?|credits|excerpt|newsletter|dramatis personae|maps?)[\s:.-]*$"


def is_heading(line: Column) -> Column:
    """A line that begins a chapter."""
    return F.coalesce(line.rlike(HEADING), F.lit(False))


def is_matter(title: Column) -> Column:
    """The title of front or back matter, which has no number: by how it begins, or a general word that stands alone."""
    plain = F.lower(collapse(F.translate(decoded_numbers(common_entities(title)), "\u00a0", " ")))
    return F.coalesce(with_value(plain, lambda t: t.rlike(MATTER_PREFIX) | t.rlike(MATTER_WHOLE)), F.lit(False))


def is_blob_key(key: Column) -> Column:
    """B19."""
    return F.coalesce(key.rlike(r"^users/[^/]+/(content|cover)/[0-9a-f]{64}$"), F.lit(False))


# sites


#: Genres of story lines, one of which has a slash.
GENRES = (
    "Adventure Angst Crime Drama Family Fantasy Friendship General Horror Humor Hurt/Comfort Mystery Parody Poetry Romance Sci-Fi Spiritual Supernatural Suspense Tragedy Western"
).split()


def story_line(line: Column) -> Column:
    """struct(rating, words, favs, follows, status, genres, characters, pairings) of a line `Rated: T - English - Drama/Humor - [A, B] C - Words: 1,234 - ...`.

    A segment of known genres only holds genres; names in brackets are a pairing; a line without a status is in progress.
    """
    parts = F.filter(F.transform(F.split(collapse(line), " - "), lambda x: F.trim(x)), lambda x: x != "")
    labelled = r"(?i)^(Rated|Words|Favs|Follows|Chapters|Reviews|Status|Updated|Published|id):"
    value = lambda k: F.get(F.transform(F.filter(parts, lambda x: x.rlike(f"(?i)^{k}:")), lambda x: F.trim(F.regexp_replace(x, r"(?i)^\w+:\s*", ""))), F.lit(0))
    free = F.filter(parts, lambda x, i: (i != 1) & ~x.rlike(labelled))
    known = "|".join(g.replace("/", "/") for g in GENRES)
    is_genre = lambda x: x.rlike(f"^({known})(/({known}))*$")
    names = F.filter(free, lambda x: ~is_genre(x))
    genres = F.flatten(F.transform(F.filter(free, is_genre), lambda x: F.regexp_extract_all(x, F.lit(f"({known})"), 1)))
    trimmed = lambda x: F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != "")
    brackets = F.flatten(F.transform(names, lambda x: F.regexp_extract_all(x, F.lit(r"\[([^\]]+)\]"), 1)))
    pairs = F.filter(F.transform(brackets, trimmed), lambda p: F.size(p) > 1)
    loose = F.flatten(F.transform(names, lambda x: trimmed(F.regexp_replace(x, r"\[[^\]]+\]", " "))))
    people = F.concat(F.flatten(F.transform(brackets, trimmed)), loose)
    status = F.when(value("Status").rlike("(?i)complete"), "complete").otherwise("in-progress")
    return F.struct(value("Rated").alias("rating"), *(int_loose(value(k)).alias(k.lower()) for k in ("Words", "Favs", "Follows")), status.alias("status"), genres.alias("genres"), people.alias("characters"), F.transform(pairs, lambda p: F.array_join(p, "/")).alias("pairings"))


def top_name(reply: Column) -> Column:
    """The first name of an autocomplete reply (a JSON array of objects with a name)."""
    names = F.transform(F.from_json(reply, "array<struct<name: string>>"), lambda x: F.trim(x["name"]))
    return F.get(F.filter(names, lambda x: x != ""), F.lit(0))


def pairing_name(reply: Column, a: Column, b: Column) -> Column:
    """The first name of a reply that is a pairing of just these two people, in either order."""
    names = F.transform(F.from_json(reply, "array<struct<name: string>>"), lambda x: F.trim(x["name"]))
    people = lambda x: F.array_sort(F.transform(F.split(x, "/"), lambda y: F.trim(y)))
    return F.get(F.filter(names, lambda x: ~F.contains(x, F.lit("&")) & (a != b) & (people(x) == F.array_sort(F.array(a, b)))), F.lit(0))


def without_title(text: Column, title: Column) -> Column:
    """A text without its title at the start (in any case), however often it stands there."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(title, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(F.length(title) > 0, F.regexp_replace(text, F.concat(F.lit("(?iu)^(?:"), quoted, F.lit(" +)+")), F.lit(""))).otherwise(text)


def resolved_path(base: Column, path: Column) -> Column:
    """A path of an archive, as seen from a file of it; parts .. go up, but not beyond the top."""
    whole = F.concat(F.regexp_replace(base, r"[^/]*$", ""), F.regexp_replace(path, r"[?#].*$", ""))
    step = lambda done, x: F.when((x == "") | (x == "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


#: Tags that sanitised HTML keeps, the attributes of each that stay, and the schemes of links.
TAGS = (
    "p br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd strong em b i u s del ins sup sub mark blockquote pre code a img figure figcaption "
    "table thead tbody tfoot tr th td div span section article aside"
).split()
ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title", "loading"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
SCHEMES = ("http", "https")
#: Tags without an end, tags that go with all that is in them, a tag or declaration, an attribute.
VOID, WHOLE = ("br", "hr", "img"), "script|style|textarea|option"
TAG = r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>"""
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?"""


def _safe_link(value: Column) -> Column:
    """Whether a link is relative or of a known scheme, once entities are decoded and blanks and control characters dropped, as readers do."""
    plain = F.regexp_replace(common_entities(decoded_numbers(common_entities(value), ";?")), "(?i)&colon;?", ":")
    plain = F.regexp_replace(plain, r"(?is)&(?:tab|newline);?|[\x00-\x20\x7f-\xa0\u200b-\u200f\u2028-\u202f\ufeff]+|<!--.*?-->", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([^/?#:]*):", 1))
    return ~plain.rlike("^[^/?#:]*:") | scheme.isin(*SCHEMES)


def _kept_tag(tag: Column) -> Column:
    name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))
    found = F.regexp_extract_all(F.regexp_replace(tag, r"^<[a-zA-Z][^\s/>]*", ""), F.lit(ATTRIBUTE), F.lit(0))

    def parsed(a: Column) -> Column:
        part = lambda i: F.regexp_extract(a, f"(?s)^{ATTRIBUTE}$", i)
        return F.struct(F.lower(part(1)).alias("name"), F.concat(part(2), part(3), part(4)).alias("value"))

    def allowed(a: Column, i: Column, every: Column) -> Column:
        known = [(name == t) & a["name"].isin(*names) for t, names in ATTRIBUTES.items()]
        first = F.array_position(F.transform(every, lambda x: x["name"]), a["name"]) == i + 1
        link = ~a["name"].isin("href", "src") | _safe_link(a["value"])
        return (known[0] | known[1] | known[2] | known[3]) & (a["name"] != "loading") & first & link

    every = F.transform(found, parsed)
    value = lambda v: F.replace(F.replace(F.replace(v, F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kept = F.transform(F.filter(every, lambda a, i: allowed(a, i, every)), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), value(a["value"]), F.lit('"')))
    lazy = F.when(name == "img", ' loading="lazy"').otherwise("")
    opened = F.concat(F.lit("<"), name, F.array_join(kept, ""), lazy, F.when(name.isin(*VOID), " />").otherwise(">"))
    closed = F.when(name.isin(*VOID), "").otherwise(F.concat(F.lit("</"), name, F.lit(">")))
    return F.when(~name.isin(*TAGS), "").when(tag.startswith("</"), closed).otherwise(opened)


def sanitised(html: Column) -> Column:
    """HTML rebuilt from its tokens: known tags with the attributes that they may have, links that are relative or http(s), images that load
    lazily, and text. Scripts, styles and forms' values go with what is in them, comments and declarations go, a < that begins no
    tag is text. Ends without a beginning aren't looked for."""
    bare = F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|<({WHOLE})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    texts = F.transform(F.split(bare, TAG, -1), lambda t: F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    tags = F.transform(F.regexp_extract_all(bare, F.lit(TAG), F.lit(0)), _kept_tag)
    return F.array_join(F.zip_with(texts, tags, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def article(html: Column) -> Column:
    """L2: the inner HTML of the article, else of the main part, else of the body, else all, without navigation."""
    bare = F.regexp_replace(html, r"(?is)<(nav|header|footer|aside)\b.*?</\1\s*>", " ")
    inner = [F.regexp_extract(bare, rf"(?is)<{t}\b[^>]*>(.*)</{t}\s*>", 1) for t in ("article", "main", "body")]
    return F.coalesce(*(F.when(F.length(x) > 0, x) for x in inner), bare)


def list_entries(html: Column) -> Column:
    """struct(link, title) of each list entry that is a link."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<li[^>]*>\s*(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r'href="([^"]*)"', 1).alias("link"), html_to_text(x).alias("title")))


def date_label(ms: Column) -> Column:
    """Jan 5, 2024 (of the session's time zone)."""
    return F.date_format(F.timestamp_millis(ms), "MMM d, yyyy")


def plain_term(text: Column) -> Column:
    """Without quotes, in single blanks."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), '"', " "))


def owned_query(title: Column, author: Column) -> Column:
    """What a catalogue is asked for a book."""
    a = plain_term(author)
    return F.when(a != "", F.concat(plain_term(title), F.lit(' author:"'), a, F.lit('"'))).otherwise(plain_term(title))


def keyword_query(fandom: Column, extras: Column, page: int = 1) -> Column:
    """The address of a site's story search for a fandom and further terms."""
    words = F.array_join(F.concat(F.array(fandom), extras), " ")
    return F.concat(F.lit("/search/?keywords="), F.url_encode(words), F.lit(f"&type=story&ppage={page}"))


def best_place(text: Column, quote: Column, before: Column, after: Column) -> Column:
    """Where (characters before it) a quote stands best: of its occurrences (without overlaps) the one whose neighbourhood shares most
    characters with the contexts, and of equals the first; null if it doesn't occur."""
    parts = F.split(text, F.concat(F.lit("\\Q"), quote, F.lit("\\E")), -1)
    n = F.length(quote)

    def scored(i: Column) -> Column:
        at = F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * n
        back = F.reverse(F.substr(text, F.greatest(at - F.length(before) + 1, F.lit(1)), F.least(at, F.length(before))))
        ahead = F.substr(text, at + n + 1, F.length(after))
        score = context_score(back, F.reverse(before)) + context_score(ahead, after)
        return F.struct(score.alias("score"), (-at).alias("at"))

    found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), scored)
    return F.when((n > 0) & (F.size(parts) > 1), -F.array_max(found)["at"])
