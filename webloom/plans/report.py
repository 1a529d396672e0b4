"""Page reports and sitemap pages: projections over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.metadata import with_metadata
from webloom.functions.render import render_html
from webloom.functions.text import strip_html_to_text, utf16_length
from webloom.functions.urls import parsed_url, sitemap_slug, to_relative_path
from webloom.operators.links import link_counts, with_links
from webloom.operators.sitemaps import filter_priority
from webloom.session import ship

#: Fields of the metadata struct that a report carries as columns.
FLAT = ("meta_description", "canonical_url", "robots", "author", "language")


def page_rows(pages: DataFrame, render: bool = True, metadata: bool = True, strip: tuple[str, ...] = ("css",), key: str = "url") -> DataFrame:
    """pages (url, html, status_code) with markdown, metadata, links and images, each in its row. url: normalised; key is taken for older callers."""
    ship(pages.sparkSession)
    text = render_html(F.col("html"), F.col("url"), "markdown", strip) if render else strip_html_to_text(F.col("html"))
    rows = pages.withColumn("markdown", F.coalesce(text, F.lit("")))
    rows = with_links(rows)
    return (with_metadata(rows) if metadata else rows).drop("html")


def page_report(rows: DataFrame, processed_at: Column | None = None, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Flat report of page_rows(), after the columns to keep."""
    m = F.col("metadata")
    return rows.select(
        *keep,
        "url",
        F.coalesce(m["title"], F.lit("")).alias("title"),
        *(m[c].alias(c) for c in FLAT),
        *(m["og"][c].alias(f"og_{c}") for c in ("title", "description", "image", "url")),
        *(m["twitter"][c].alias(f"twitter_{c}") for c in ("title", "description", "image")),
        m["json_ld"].alias("page_schema"),
        F.coalesce("status_code", F.lit(200)).alias("status_code"),
        F.col("markdown").alias("content_snippet"),
        utf16_length(F.col("markdown")).alias("text_length"),
        "links",
        F.transform("images", lambda i: F.struct(i["url"].alias("url"), i["alt"].alias("alt_text"), F.lit("content").alias("location"))).alias("images"),
        link_counts(F.col("links")).alias("links_count"),
        (processed_at if processed_at is not None else F.current_timestamp()).alias("processed_at"),
    )


def sitemap_pages(urls: DataFrame, base_url: str, priority_threshold: float | None = None) -> DataFrame:
    """Rows (url relative to the base's origin, sitemap_slug, sitemap_url, priority, lastmod) of discovered URLs."""
    base = parsed_url(F.lit(base_url if "://" in base_url else f"https://{base_url}"))
    parsed = parsed_url(F.col("url"))
    relative = to_relative_path(parsed, base)
    return filter_priority(urls, priority_threshold).select(F.when((parsed != "") & (relative != parsed), relative).otherwise(F.col("url")).alias("url"), sitemap_slug(F.col("source")).alias("sitemap_slug"), F.col("source").alias("sitemap_url"), "priority", "lastmod")
