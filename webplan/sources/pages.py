"""Scanning the page corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webplan.functions import urls as U
from webplan.functions.text import decode_entities, trimmed


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html, title, og_title.  html is pruned from the scan when nobody reads it."""
    return with_titles(spark.read.parquet(path))


def page_title(html: Column) -> Column:
    return trimmed(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def with_titles(pages: DataFrame) -> DataFrame:
    og = F.regexp_extract(
        "html", r"""(?is)<meta[^>]*property\s*=\s*["']og:title["'][^>]*content\s*=\s*["']([^"']*)["']""", 1
    )
    return pages.withColumn("title", page_title(F.col("html"))).withColumn("og_title", trimmed(decode_entities(og)))


def with_site(pages: DataFrame) -> DataFrame:
    """Adds the keys the planning jobs group by: site, viewport and page_key."""
    return pages.select(
        "*",
        U.site_of(F.col("url")).alias("site"),
        U.viewport_of(F.col("url")).alias("viewport"),
        U.normalize_page_url(F.col("url")).alias("page_key"),
    )
