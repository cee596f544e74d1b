"""Outgoing links of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.binding import let
from strandmill.functions.urls import is_http, normalise, page_parts
from strandmill.sources.warc import content_text, target_uri, warc_responses

# A tag on one line, and the link patterns in the order they are tried.
TAG = r"<([^>\n\r\u0085\u2028\u2029]*)>"
TAG_WITH_LINK = (
    r"<([^>\n\r\u0085\u2028\u2029]*?(?:[hH][rR][eE][fF]|[sS][rR][cC])=[^>\n\r\u0085\u2028\u2029]*)>"
)
LINK_PATTERNS = (
    r"""[aA].+?[hH][rR][eE][fF]=['"](.+?)['"].*?""",
    r"""[aA][rR][eE][aA].+?[hH][rR][eE][fF]=['"](.*?)['"].*?""",
    r"""[fF][rR][aA][mM][eE].+?[sS][rR][cC]=['"](.*?)['"].*?""",
    r"""[iI][fF][rR][aA][mM][eE].+?[sS][rR][cC]=['"](.*?)['"].*?""",
)
# Fixed value: everything up to and with the first blank line.
HTTP_HEADER = r"(?s)\A(?:.*?(?>\r\n|\n|\r))??[\x00-\x20&&[^\r\n]]*(?>\r\n|\n|\r)"


def html_tags(html: Column) -> Column:
    """The insides of the tags that open and close on one line."""
    return F.regexp_extract_all(html, F.lit(TAG), F.lit(1))


def tag_link(tag: Column, page: Column) -> Column:
    """The first acceptable link of a tag, made absolute; null if there is none.

    ``page`` is from :func:`strandmill.functions.urls.page_parts`.
    """
    found = F.array(
        *(F.when(tag.rlike(pattern), F.regexp_extract(tag, pattern, 1)) for pattern in LINK_PATTERNS)
    )
    absolute = F.transform(
        F.filter(found, lambda link: link.isNotNull()), lambda link: normalise(page, link)
    )
    return F.get(F.filter(absolute, lambda link: is_http(link) & (link != page["url"])), F.lit(0))


def page_links(page: Column, html: Column) -> Column:
    """The link of every tag that has one, in page order and with repeats."""
    tags = F.regexp_extract_all(html, F.lit(TAG_WITH_LINK), F.lit(1))
    links = let(page_parts(page), lambda parts: F.transform(tags, lambda tag: tag_link(tag, parts)))
    return F.when(page != "", F.filter(links, lambda link: link.isNotNull()))


def link_occurrences(df: DataFrame, *keep: str, page: str = "url", html: str = "html") -> DataFrame:
    """One row per tag with a link."""
    return df.select(*keep, F.explode(page_links(F.col(page), F.col(html))).alias("link"))


def outlinks(df: DataFrame, *keep: str, page: str = "url", html: str = "html") -> DataFrame:
    """One row per distinct link of each page.

    A page is one row, so its links are made distinct inside it, without a shuffle.
    """
    links = F.array_distinct(page_links(F.col(page), F.col(html)))
    return df.select(*keep, F.explode(links).alias("link"))


def outlink_sets(df: DataFrame, *keep: str, page: str = "url", html: str = "html") -> DataFrame:
    """The distinct links of each page as a sorted array, empty where there are none."""
    links = F.array_sort(F.array_distinct(page_links(F.col(page), F.col(html))))
    return df.select(*keep, F.coalesce(links, F.array().cast("array<string>")).alias("links"))


def http_body(text: Column) -> Column:
    """What follows the first blank line; null if there is no blank line."""
    return F.when(text.rlike(HTTP_HEADER), F.regexp_replace(text, HTTP_HEADER, ""))


def warc_outlinks(records: DataFrame, *keep: str) -> DataFrame:
    """The distinct links of every response record, next to its ``url``."""
    pages = warc_responses(records).select(
        *keep, target_uri().alias("url"), http_body(content_text()).alias("html")
    )
    return outlinks(pages, *keep, "url")
