"""What kind of page a text is, what it says of its serial, and who parses it. Pages are read by patterns, not as trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .text import with_value

#: Most chapters of a serial; texts of links and shapes of paths.
MAX_CHAPTERS = 1000
NEXT_TEXT = r"(?i)^\s*(next(\s*(chapter|part|page|episode|chap))?|→|›|>>|continue\s+reading)\s*$"
PREV_TEXT = r"(?i)^\s*(prev(ious)?(\s*(chapter|part|page|episode|chap))?|←|‹|<<)\s*$"
CHAPTER_ANCHOR = r"(?i)\b(chapter|prologue|epilogue|interlude|afterword|arc|book|volume|part)\b"
CHAPTER_SEGMENT = r"(?i)/(chapter|ch|episode|ep|part|page|c)s?[-_/]*\d+"
WORK_PATH = r"(?i)/(fiction|story|stories|series|novel|novels|work|book)s?\b"
CHAPTER_SUFFIX = r"(?i)\s*[-–—|:]\s*(chapter|ch\.?|part|episode)\s*\d+.*"
AUTHOR_PATH = r"/(user|author|profile|u)s?/"
GENERIC_IMAGE = r"(?i)logo|icon|default|placeholder|avatar"
#: Which parser takes a page by a part of its host, in this order, and the sites that have a key of their own.
PARSERS = {
    "archiveofourown.org": "ao3", "fanfiction.net": "ffnet", "royalroad.com": "royalroad", "wattpad.com": "wattpad", "scribblehub.com": "scribblehub", "sufficientvelocity.com": "xenforo",
    "spacebattles.com": "xenforo",
}
SITE_KEYS = {"archiveofourown.org": "ao3", "fanfiction.net": "ffn"}
#: Links to one's own work that make a page its table of contents.
LEAST_LINKS = 3


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in quotes or not; null without one."""
    forms = ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")
    return with_value(tag, lambda t: F.coalesce(*(F.nullif(F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*{q}", 1), F.lit("")) for q in forms)))


def tags(html: Column, name: str) -> Column:
    """The opening tags of a name (or a pattern of names)."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{name})\s[^>]*>"), 0)


def elements(html: Column, name: str) -> Column:
    """The elements of a name, from tag to end tag; they don't nest."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{name})(?:\s[^>]*)?>.*?</(?:{name})\s*>"), 0)


def said(element: Column) -> Column:
    """The text of an element."""
    return T.common_entities(F.regexp_replace(element, "(?s)<[^>]*>", ""))


def _opening(element: Column) -> Column:
    return F.regexp_extract(element, "(?s)^<[^>]*>", 0)


def says(element: Column, pattern: str) -> Column:
    """Whether an element's text or label as a whole is as the pattern."""
    return said(element).rlike(pattern) | F.coalesce(attribute(_opening(element), "aria-label"), F.lit("")).rlike(pattern)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def kind(html: Column, url: Column) -> Column:
    """Chapter (links to neighbours by rel or by what they say, or a chapter's number in the path), toc (three links or more that name
    chapters, or to pages below a work's own path), else article."""
    rel = F.exists(tags(html, "link|a"), lambda t: F.lower(attribute(t, "rel")).isin("next", "prev"))
    nav = F.exists(elements(html, "a|button"), lambda e: says(e, NEXT_TEXT) | says(e, PREV_TEXT))
    named = F.size(F.filter(elements(html, "a"), lambda e: said(e).rlike(CHAPTER_ANCHOR))) >= LEAST_LINKS
    path = path_of(url)
    top = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^/?#]*){0,2})", 1)
    below = lambda link: link.startswith(top) & (path_of(link) != path)
    own = F.size(F.filter(F.transform(F.filter(tags(html, "a"), lambda t: attribute(t, "href").isNotNull()), lambda t: T.resolved_url(url, attribute(t, "href"))), below)) >= LEAST_LINKS
    chapter = F.coalesce(rel, F.lit(False)) | F.coalesce(nav, F.lit(False)) | path.rlike(CHAPTER_SEGMENT)
    return F.when(chapter, "chapter").when(named | (path.rlike(WORK_PATH) & own), "toc").otherwise("article")


def chapters(html: Column) -> Column:
    """The options of the first list with two or more, else N of `N chapters` in the text (2 to MAX_CHAPTERS), else null."""
    lists = F.filter(F.transform(elements(html, "select"), lambda e: F.regexp_count(e, F.lit(r"(?i)<option[\s>]"))), lambda n: n >= 2)
    number = with_value(F.regexp_extract(said(html), r"(?i)\b(\d{1,9})\s+chapters?\b", 1), lambda n: F.when(n != "", n.cast("int")))
    return F.coalesce(F.get(lists, F.lit(0)), with_value(number, lambda n: F.when(n.between(2, MAX_CHAPTERS), n)))


def meta(html: Column, key: str, name: str) -> Column:
    """The content of the first meta tag whose key is name; null without one."""
    return attribute(F.get(F.filter(tags(html, "meta"), lambda t: attribute(t, key) == name), F.lit(0)), "content")


def series_title(html: Column, fallback: Column) -> Column:
    """The serial's title, from what a chapter's page is shared or titled as, without `- Chapter N`; else the fallback."""
    titles = (meta(html, "property", "og:title"), said(F.get(elements(html, "title"), F.lit(0))))
    cleaned = [with_value(F.trim(F.regexp_replace(t, CHAPTER_SUFFIX, "")), lambda c: F.when((c != "") & (c != fallback), c)) for t in titles]
    return F.coalesce(*cleaned, fallback)


def author(html: Column) -> Column:
    """The author that the page names, else the text of the first link to a user's page that has one; null without."""
    named = with_value(F.trim(meta(html, "name", "author")), lambda a: F.when(a != "", a))
    linked = F.filter(F.transform(F.filter(elements(html, "a"), lambda e: attribute(_opening(e), "href").rlike(AUTHOR_PATH)), lambda e: F.trim(said(e))), lambda t: t != "")
    return F.coalesce(named, F.get(linked, F.lit(0)))


def cover(html: Column) -> Column:
    """The picture that the page is shared with, unless it is a site's own."""
    return with_value(meta(html, "property", "og:image"), lambda c: F.when(~c.rlike(GENERIC_IMAGE), c))


def _by_host(url: Column, names: dict[str, str]) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return with_value(host, lambda h: F.coalesce(*(F.when(h.contains(part), name) for part, name in names.items())))


def parser(url: Column) -> Column:
    """L1: which of the sites' parsers takes a page; null if none does, so that it is read as any serial or article."""
    return F.when(T.is_http(url), _by_host(url, PARSERS))


def site_key(url: Column) -> Column:
    """The key of the site that a page is of; null for others."""
    return _by_host(url, SITE_KEYS)
