"""Text columns: all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
DROPPED = r"(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>"


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and numbers, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def normalize_ws(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Text of a page without script, style, nav and footer bodies, comments and tags."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, " "), r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return normalize_ws(bare)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_links(html: Column) -> Column:
    """All href values, as an array."""
    return F.regexp_extract_all(html, F.lit(r'(?i)href\s*=\s*"([^"]*)"'), F.lit(1))


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))
