"""Text preparation (tokens, chunks, pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, page_links, page_title, strip_html, terms, url_host


def tokenize(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """One row a term occurrence: id, pos (from 0), term."""
    return df.select(id_col, F.posexplode(terms(F.col(col))).alias("pos", "term"))


def pages_text(pages: DataFrame) -> DataFrame:
    """Title, host and plain text of each page."""
    return pages.select("page_id", url_host(F.col("url")).alias("host"), page_title(F.col("html")).alias("title"), strip_html(F.col("html")).alias("text"))


def links(pages: DataFrame) -> DataFrame:
    """One row an href: page_id, link."""
    return pages.select("page_id", F.explode(page_links(F.col("html"))).alias("link"))


def chunk(df: DataFrame, size: int = 500, stride: int = 400, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Windows of ``size`` characters, ``stride`` apart; a window starts where characters are left that none before covers.

    Null and empty texts have no chunks."""
    n = F.length(col)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride))).cast("int"))
    rows = df.where(n > 0).select(id_col, F.col(col).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return rows.select(id_col, "chunk_no", F.substring("_t", F.col("chunk_no") * stride + 1, F.lit(size)).alias("text"))


def whitespace_normalized(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    return df.select(id_col, normalize_ws(F.col(col)).alias("text"))
