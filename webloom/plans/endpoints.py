"""The answers of the fetch and discover endpoints for tables of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.render import render_html
from webloom.functions.text import fresh
from webloom.functions.urls import normalize_url
from webloom.operators.sitemaps import discover_many
from webloom.sources.page_store import PageStore

#: Fixed values of the endpoints: formats, what is asked for where a parameter is missing, and messages.
FORMATS = ("html", "markdown", "semantic_tree", "semantic_tree_text")
DEFAULT_URL, DEFAULT_FORMAT = "https://example.com", "markdown"
NO_URL, BAD_FORMAT = "Missing required 'url' query parameter", "Invalid format. Use: " + ", ".join(FORMATS)


@dataclass
class DiscoverAnswers:
    answers: DataFrame  # url, status, host, n_sitemaps, total_urls, has_more, sitemaps, error: one row a distinct request
    urls: DataFrame  # request, ord, pos, url, lastmod, priority, source of the answers with status 200


def fetch_answers(store: PageStore, requests: DataFrame) -> DataFrame:
    """requests (url, format, ...) with status (200, 400 for a format that is none, 500 for a page that the store lacks), content_type, body and error.

    A null or empty url or format stands for the default. Pages are joined once, whatever the formats; each format's renderer sees its own requests only.
    Other columns are carried; columns named like the answer's are replaced.
    """
    asked, fmt = fresh(requests, "asked"), fresh(requests, "format")
    kept = requests.drop("status", "content_type", "body", "error", "status_code", "html")
    url, format_ = (F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(d)).otherwise(F.col(c)) for c, d in (("url", DEFAULT_URL), ("format", DEFAULT_FORMAT)))
    rows = kept.withColumns({fmt: format_, asked: F.struct("url")})
    valid = F.col(fmt).isin(*FORMATS)
    found = store.head(rows.withColumn("url", F.when(valid, normalize_url(url))))
    body = F.coalesce(*(F.when(F.col(fmt) == f, render_html(F.when(F.col(fmt) == f, F.col("html")), F.col("url"), f)) for f in FORMATS))
    found = found.withColumn("body", body)
    status = F.when(~valid, 400).when(F.col("body").isNull(), 500).otherwise(200)
    kind = F.when(status == 200, F.when(F.col(fmt) == "html", "text/html; charset=utf-8").otherwise("text/plain; charset=utf-8")).otherwise("application/json")
    error = F.when(status == 400, BAD_FORMAT).when(status == 500, "page not in store")
    own = [F.col(f"`{asked}`")["url"].alias("url") if c == "url" else F.col(f"`{c}`") for c in kept.columns]
    return found.select(*own, status.alias("status"), kind.alias("content_type"), "body", error.alias("error"))


def discover_answers(store: PageStore, requests: DataFrame, max_sitemaps: int = 50, max_depth: int = 3) -> DiscoverAnswers:
    """Sitemap discovery for every distinct requested url (a domain or URL): status 200 with the totals and at most max_sitemaps sitemaps in order; 400 for a null or empty
    url, 500 for one that is no URL. The URLs found are a table of their own, as a domain may have any number."""
    asked = requests.select("url").distinct()
    named = F.coalesce(F.col("url"), F.lit("")) != ""
    whole = F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url"))
    good = F.coalesce(normalize_url(whole), F.lit("")) != ""
    asked = asked.withColumn("status", F.when(~named, 400).when(~good, 500).otherwise(200))
    schema = "url string, content string"
    sitemaps = store.sitemaps if store.sitemaps is not None else asked.sparkSession.createDataFrame([], schema)
    found = discover_many(asked.filter("status = 200").select(F.col("url").alias("domain")), sitemaps, store.robots, max_sitemaps, max_depth)
    listed = found.sitemaps.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("ord", "url", "type", "url_count"))).alias("sitemaps"))
    totals = found.summary.join(listed, "domain", "left").withColumnRenamed("domain", "url")
    error = F.when(F.col("status") == 400, NO_URL).when(F.col("status") == 500, "Invalid URL")
    answers = asked.join(totals, "url", "left").select("url", "status", "host", "n_sitemaps", "total_urls", "has_more", "sitemaps", error.alias("error"))
    return DiscoverAnswers(answers, found.urls.withColumnRenamed("domain", "request"))
