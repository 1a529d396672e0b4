"""Crawls over a page store: the resumable bounded crawl, and the distributed breadth-first traversal."""

from __future__ import annotations

import functools
import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import matches_pattern, normalize_one, normalize_url, parse_url, passes_domain_filter
from webloom.operators.frontier import DRIVER_FRONTIER, CrawlConfig, Cursor, decode_cursor, encode_cursor
from webloom.operators.robots import is_url_allowed, parse_robots_one
from webloom.operators.sitemaps import discover_sitemaps
from webloom.plans.report import page_rows
from webloom.scratch import cut
from webloom.sources.page_store import PageStore

MARGIN = 2_000  # ms of the time budget that a page must leave
_LINK = "struct<url:string,anchor_text:string,type:string,location:string>"
_META = "struct<title:string,meta_description:string,canonical_url:string,language:string,author:string,robots:string,og:struct<title:string,description:string,image:string,url:string,type:string,site_name:string>,twitter:struct<card:string,title:string,description:string,image:string,site:string>,json_ld:array<string>>"
PAGE_SCHEMA = f"ord long, url string, status string, status_code int, markdown string, metadata {_META}, links array<{_LINK}>, images array<struct<url:string,alt:string>>, depth int, fetch_time long, error string"


@dataclass
class CrawlStats:
    pages_crawled: int
    total_pages_crawled: int
    pages_remaining: int
    elapsed: int
    stop_reason: str


@dataclass
class CrawlResult:
    pages: DataFrame
    cursor: str | None
    stats: CrawlStats


def host_of(url: str) -> str:
    """Host of a URL without port; ValueError where there is none."""
    if (p := parse_url(url)) is None:
        raise ValueError(f"invalid url: {url}")
    return p[2] if p[2].endswith("]") else p[2].partition(":")[0]


def gate(pages: DataFrame, config: CrawlConfig, rules: list[tuple[str, bool]]) -> DataFrame:
    """pages (url) with status: disallowed by robots rules, skipped by patterns, else completed."""
    url = F.col("url")
    status = F.lit("completed")
    skip = matches_pattern(url, list(config.exclude_patterns))
    if config.include_patterns:
        skip = skip | ~matches_pattern(url, list(config.include_patterns))
    status = F.when(skip, "skipped").otherwise(status)
    if config.obey_robots and rules:
        table = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in rules))
        status = F.when(~is_url_allowed(url, table), "disallowed").otherwise(status)
    return pages.withColumn("status", status)


def crawl_pages(store: PageStore, urls: DataFrame, config: CrawlConfig, rules: list[tuple[str, bool]]) -> DataFrame:
    """One row for each distinct url: status, status_code, markdown, metadata, links, images, error. One pipeline for all of them."""
    gated = gate(urls.select("url").distinct(), config, rules)
    rows = page_rows(store.head_once(gated), config.render, config.extract_metadata, config.strip)
    done = F.col("status") == "completed"
    lost = done & F.col("status_code").isNull() & F.lit(config.render)
    ok = done & ~lost
    code = F.col("status_code") if config.extract_metadata or not config.render else F.lit(None).cast("int")
    none_links, none_images = F.array().cast(f"array<{_LINK}>"), F.array().cast("array<struct<url:string,alt:string>>")
    meta = F.col("metadata") if config.extract_metadata else F.lit(None)
    return rows.select(
        "url",
        F.when(lost, "error").otherwise(F.col("status")).alias("status"),
        F.when(ok, code).alias("status_code"),
        F.when(ok, F.col("markdown")).otherwise("").alias("markdown"),
        F.when(ok, meta).cast(_META).alias("metadata"),
        F.when(ok, F.col("links")).otherwise(none_links).alias("links"),
        F.when(ok, F.col("images")).otherwise(none_images).alias("images"),
        F.when(lost, "page not in store").alias("error"),
    )


def start(spark: SparkSession, config: CrawlConfig, store: PageStore) -> Cursor:
    """Cursor of a new crawl: robots rules, sitemap URLs (unfiltered) and the seed."""
    seed = normalize_one(config.url) or config.url
    host = host_of(seed)
    cursor = Cursor(config, host)
    robots = store.robots_txt(host)
    if config.obey_robots and robots:
        cursor.robots[host] = parse_robots_one(robots)
    entries: list[tuple[str, int]] = []
    if config.source in ("all", "sitemaps") and store.sitemaps is not None:
        found = discover_sitemaps(spark, seed, store.sitemaps, robots)
        urls = found.urls.withColumn("u", normalize_url(F.col("url"))).filter("u <> ''").orderBy("ord", "pos").select("u")
        entries = [(r.u, 0) for r in urls.limit(DRIVER_FRONTIER + 1 if cursor.capacity is None else cursor.capacity).collect()]
    if config.source in ("all", "links") and (u := normalize_one(seed)) and all(u != e for e, _ in entries):
        entries.insert(0, (u, 0))
    cursor.add(entries)
    return cursor


def crawl_batch(spark: SparkSession, config: CrawlConfig, store: PageStore, cursor: str | None = None, compat: bool = True, use_cursor_config: bool = False, clock: Callable[[], int] = lambda: int(time.time() * 1000)) -> CrawlResult:
    """Crawl until a limit, the time budget or the crawl delay stops it; resumable by the cursor it returns.

    The traversal order is sequential by definition and bounded by max_pages and the
    frontier's capacity, so it runs on the driver, on URLs, status and links; pages are worked on in parallel, as
    many of the frontier's next ones as may still be crawled, and stay in saved tables. Many crawls at once: crawl_many. compat: queued duplicates are crawled again, as the
    visited test only knows crawled pages; otherwise each URL is crawled once.
    """
    began = clock()
    state = decode_cursor(cursor) if cursor else start(spark, config, store)
    config = state.config if cursor and use_cursor_config else config
    state.config = config
    rules = state.robots.get(state.seed_domain)
    done: dict[str, Row] = {}
    pages: list[tuple[int, str, int]] = []
    saved: list[DataFrame] = []
    queued = {u for u, _ in state.frontier}
    stop = "complete"
    while state.frontier:
        if state.total >= config.max_pages:
            stop = "limit"
            break
        if clock() - began + config.page_timeout + MARGIN > config.time_budget:
            stop = "time_budget"
            break
        if rules and rules.crawl_delay is not None and state.last_fetch is not None and clock() - state.last_fetch < rules.crawl_delay:
            stop = "crawl_delay"
            break
        left = config.max_pages - state.total
        ahead = state.frontier[:left] if config.strategy == "bfs" else state.frontier[-left:]
        batch = state.take(min(config.concurrency, left), config.strategy)
        if any(u not in done for u, _ in batch):
            urls = spark.createDataFrame([(u,) for u in dict.fromkeys(u for u, _ in ahead if u not in done)], "url string")
            saved.append(cut(crawl_pages(store, urls, config, rules.rules if rules else [])))
            done.update((r.url, r) for r in saved[-1].select("url", "status", F.transform("links", lambda x: F.struct(x["url"].alias("url"), x["type"].alias("type"))).alias("links")).collect())
        for url, depth in batch:
            if not compat and state.is_visited(url):
                continue
            r = done[url]
            pages.append((len(pages), url, depth))
            state.add_visited(url)
            state.total += 1
            if r.status == "completed" and config.source in ("all", "links") and depth + 1 <= config.max_depth:
                new = [u for u in _follow(r.links, config, state.seed_domain) if not state.is_visited(u)]
                if not compat:
                    new = [u for u in dict.fromkeys(new) if u not in queued]
                    queued.update(new)
                state.add([(u, depth + 1) for u in new])
        state.last_fetch = clock()
    if not state.frontier:
        stop = "complete"
    over = stop == "complete" or state.total >= config.max_pages
    stats = CrawlStats(len(pages), state.total, len(state.frontier), clock() - began, stop)
    return CrawlResult(_in_order(spark, pages, saved), None if over else encode_cursor(state), stats)


def _in_order(spark: SparkSession, pages: list[tuple[int, str, int]], saved: list[DataFrame]) -> DataFrame:
    """The saved pages by (ord, url, depth), in PAGE_SCHEMA."""
    if not saved:
        return spark.createDataFrame([], PAGE_SCHEMA)
    order = F.broadcast(spark.createDataFrame(pages, "ord long, url string, depth long"))
    rows = functools.reduce(DataFrame.unionByName, saved).join(order, "url")
    return rows.select("ord", "url", "status", "status_code", "markdown", "metadata", "links", "images", "depth", F.lit(0).cast("long").alias("fetch_time"), "error")


def _follow(links: list[Row], config: CrawlConfig, seed: str) -> list[str]:
    """Links to queue, in order: internal ones (or all), of the domain, past the patterns."""
    import re

    from webloom.functions.urls import glob_to_regex

    def fits(url: str, patterns: tuple[str, ...]) -> bool:
        return any(re.fullmatch(glob_to_regex(p).replace("\\x{2028}\\x{2029}", "  "), url) for p in patterns)

    out = []
    for link in links:
        if link.type == "external" and not config.include_external_links:
            continue
        if not (url := normalize_one(link.url)):
            continue
        host = host_of(url)
        if not (config.include_external_links or host == seed or config.include_subdomains and host.endswith("." + seed)):
            continue
        if fits(url, config.exclude_patterns) or config.include_patterns and not fits(url, config.include_patterns):
            continue
        out.append(url)
    return out


def bfs_levels(seeds: DataFrame, edges: DataFrame, max_depth: int | None = 10, max_pages: int | None = None) -> DataFrame:
    """(url, depth) of everything reachable from seeds (url) over edges (src, dst), each URL once at its least depth.

    Each level is a join of the last level with the edges, a distinct and an anti-join
    with what is visited, then a checkpoint, so that lineage stays short and lost
    executors cost no earlier level. Without max_depth it goes on until no new page appears. A page limit keeps whole levels while they
    fit, and of the level that doesn't the first URLs in order.
    """
    level = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0).cast("long")))
    visited, n = level, level.count()
    if max_pages is not None and n > max_pages:
        return level.orderBy("url").limit(max_pages)
    step = cut(edges.select("src", "dst").distinct().repartition("src"))  # the edge plan runs once, not once a level
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        new = level.join(step, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(visited, "url", "left_anti")
        level = cut(new.withColumn("depth", F.lit(depth).cast("long")))
        found = level.count()
        if max_pages is not None and n + found > max_pages:
            return visited.unionByName(level.orderBy("url").limit(max_pages - n))
        if not found:
            break
        visited, n = cut(visited.unionByName(level)) if depth % 4 == 0 else visited.unionByName(level), n + found
    return visited


def followable(links: DataFrame, config: CrawlConfig, seed: str) -> DataFrame:
    """Rows of a links table (page_url, url, type) that a crawl would queue, as one chain of filters on the normalised URL."""
    rows = links if config.include_external_links else links.filter("type = 'internal'")
    url = F.col("url")
    rows = rows.filter(passes_domain_filter(url, seed, config.include_subdomains, config.include_external_links))
    rows = rows.filter(~matches_pattern(url, list(config.exclude_patterns)))
    return rows.filter(matches_pattern(url, list(config.include_patterns))) if config.include_patterns else rows
