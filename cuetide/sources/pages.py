"""URLs in the markup of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuetide.functions import urls


def markup_urls(pages: DataFrame, most_chars: int | None = None) -> DataFrame:
    """pages: page_id, url, html. (page_id, target): the distinct URLs of each page's markup, whole, however often the page
    was scanned. Pages with equal markup each have theirs, since relative addresses depend on the page. With most_chars
    longer markup is left out; left_out() tells what that is."""
    read = pages if most_chars is None else pages.where(F.length("html") <= most_chars)
    return read.select("page_id", F.explode(urls.sniffed(F.col("html"), F.col("url"))["urls"]).alias("target")).distinct()


def left_out(pages: DataFrame, most_chars: int) -> DataFrame:
    """(page_id, chars) of pages that markup_urls leaves out at such a bound."""
    return pages.select("page_id", F.length("html").cast("long").alias("chars")).where(F.col("chars") > most_chars)
