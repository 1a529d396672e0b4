"""Bounded crawls from many seeds at once, level by level on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.urls import matches_pattern, normalize_url, passes_domain_filter, safe_host
from webloom.operators.frontier import CrawlConfig
from webloom.operators.robots import RULES, is_url_allowed, parse_robots
from webloom.operators.sitemaps import discover_many
from webloom.plans.crawl import crawl_pages
from webloom.scratch import cut
from webloom.session import ship
from webloom.sources.page_store import PageStore

_TURN = "seed string, ord long, room long, start long, batch long, waiting long, taken long, crawled long, queued long"


@dataclass
class ManyCrawl:
    pages: DataFrame  # seed, ord, batch, not_before and the columns of a crawled page
    stats: DataFrame  # seed, pages_crawled, pages_remaining, stop_reason: one row a seed


def _turns(config: CrawlConfig):
    """For pages of each seed in the order they are crawled, with how many new links each has: how many of these the queue has room for, and
    which place the first of them gets. The state of a seed's queue goes along and comes out with each page.
    """
    cap, most, at_once = config.frontier_capacity, config.max_pages, config.concurrency

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed = None
        waiting = taken = crawled = queued = batch = 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.seed != seed:
                    seed, waiting, taken, crawled, queued, batch = r.seed, r.waiting, r.taken, r.crawled, r.queued, r.batch
                if not taken:  # the next batch leaves the queue
                    taken = min(at_once, waiting, most - crawled)
                    waiting, batch = waiting - taken, batch + 1
                room = r.fresh if cap is None else min(r.fresh, max(0, cap - waiting))
                taken, crawled, waiting = taken - 1, crawled + 1, waiting + room
                out.append((seed, r.ord, room, queued, batch, waiting, taken, crawled, queued + room))
                queued += room
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _TURN.split(", ")])

    return run


def _entries(store: PageStore, sites: DataFrame, config: CrawlConfig) -> DataFrame:
    """(seed, url, ord) of what each crawl starts with: the seed, unless a sitemap has it, then the sitemaps' URLs in order."""
    own = sites.select("seed", F.col("seed").alias("url"), F.struct(F.lit(-1).cast("long").alias("ord"), F.lit(0).cast("long").alias("pos")).alias("place"))
    if config.source != "links" and store.sitemaps is not None:
        found = discover_many(sites.select(F.col("seed").alias("domain")), store.sitemaps, store.robots).urls
        listed = found.select(F.col("domain").alias("seed"), normalize_url(F.col("url")).alias("url"), F.struct("ord", "pos").alias("place")).filter("url <> ''")
        listed = cut(listed.groupBy("seed", "url").agg(F.min("place").alias("place")))
        own = listed.unionByName(own.join(listed, ["seed", "url"], "left_anti")) if config.source == "all" else listed
    elif config.source == "sitemaps":
        own = own.limit(0)
    return own.select("seed", "url", (F.row_number().over(Window.partitionBy("seed").orderBy("place", "url")) - 1).cast("long").alias("ord"))


def crawl_many(store: PageStore, seeds: DataFrame, **options: Any) -> ManyCrawl:
    """A bounded breadth-first crawl from every seed of a table (url), options as in CrawlConfig: the pages of crawl_batch(compat=False) with no clock running.

    All crawls advance together, a level of depth at a time: one join with the store, one with what each seed has queued, and a scan
    over each seed's pages of the level, in order, that keeps the queue's length, so frontier_capacity, concurrency and max_pages drop the same URLs as one crawl after the other
    would. Pages stay on the executors and each level is cut by a checkpoint; what one seed has in a level is bounded by max_pages times a page's links.

    not_before: ms after the crawl's begin at which the page's batch may be fetched, by the crawl delay of the seed's robots.txt.
    Of URLs that a sitemap repeats the first counts. Seeds that are no URL are not crawled (stop_reason invalid); repeated and null seeds count once and not at all.
    """
    config = CrawlConfig.of("many", **options)
    config = replace(config, frontier_capacity=None) if options.get("frontier_capacity", 0) is None else config
    if config.strategy != "bfs":
        raise ValueError("many crawls are breadth-first")
    ship(seeds.sparkSession)
    given = seeds.filter("url IS NOT NULL").select(normalize_url(F.col("url")).alias("seed"), "url").distinct()
    invalid = given.filter("seed = ''").select(F.col("url").alias("seed"))
    sites = given.filter("seed <> ''").select("seed", safe_host(F.col("seed")).alias("host")).distinct()
    none = F.lit(None).cast(RULES)
    robots = F.broadcast(sites.sparkSession.createDataFrame([], "host string")).withColumn("robots", none)
    if config.obey_robots and store.robots is not None:
        files = store.robots.join(sites.select("host").distinct(), "host", "left_semi").dropDuplicates(["host"])
        robots = files.select("host", parse_robots(F.col("content")).alias("robots"))
    sites = cut(sites.join(robots, "host", "left").select("seed", "host", F.col("robots.rules").alias("rules"), F.col("robots.crawl_delay").alias("delay")))
    first = cut(_entries(store, sites, config))
    if config.frontier_capacity is not None:
        first = first.filter(F.col("ord") < config.frontier_capacity)
    seen = first.select("seed", "url")
    zero = F.lit(0).cast("long")
    counts = first.groupBy("seed").agg(F.count(F.lit(1)).alias("waiting"))
    state = sites.select("seed").join(counts, "seed", "left").select("seed", F.coalesce("waiting", zero).alias("waiting"), zero.alias("taken"), zero.alias("crawled"), F.coalesce("waiting", zero).alias("queued"), (zero - 1).alias("batch"))
    level, parts, depth = first.filter(F.col("ord") < config.max_pages), [], 0
    while depth == 0 or not level.isEmpty():
        judged = level.join(sites, "seed").withColumn("allowed", F.col("rules").isNull() | is_url_allowed(F.col("url"), F.col("rules")))
        pages = crawl_pages(store, judged.filter("allowed").select("url").distinct(), config, [])
        status = F.when(F.col("allowed"), F.col("status")).otherwise("disallowed")
        empty = lambda c: F.coalesce(c, F.array().cast(pages.schema[c].dataType)).alias(c)
        pages = judged.join(pages, "url", "left").select("seed", "host", "delay", "ord", "url", status.alias("status"), "status_code", F.coalesce("markdown", F.lit("")).alias("markdown"), "metadata", empty("links"), empty("images"), F.lit(depth).cast("long").alias("depth"), "error")
        pages = cut(pages)
        fresh = None
        if config.source != "sitemaps" and depth < config.max_depth:
            fresh = cut(_fresh_links(pages, seen, config))
        numbers = pages.select("seed", "ord")
        if fresh is not None:
            numbers = numbers.join(fresh.groupBy("seed", "parent").agg(F.count(F.lit(1)).alias("fresh")).withColumnRenamed("parent", "ord"), ["seed", "ord"], "left")
        else:
            numbers = numbers.withColumn("fresh", F.lit(None).cast("long"))
        queue = numbers.join(state, "seed").withColumn("fresh", F.coalesce("fresh", zero)).repartition("seed").sortWithinPartitions("seed", "ord")
        turns = cut(queue.mapInPandas(_turns(config), _TURN))
        parts.append(pages.join(turns.select("seed", "ord", "batch"), ["seed", "ord"]))
        names = ["waiting", "taken", "crawled", "queued", "batch"]
        latest = turns.groupBy("seed").agg(F.max_by(F.struct(*names), "ord").alias("now"))
        state = cut(state.join(latest, "seed", "left").select("seed", *(F.coalesce(F.col(f"now.{n}"), F.col(n)).alias(n) for n in names)))
        if fresh is None:
            break
        place = F.row_number().over(Window.partitionBy("seed", "parent").orderBy("pos")) - 1
        admitted = fresh.withColumn("place", place).join(turns.select("seed", F.col("ord").alias("parent"), "room", "start"), ["seed", "parent"]).filter("place < room")
        level = cut(admitted.select("seed", "url", (F.col("start") + F.col("place")).alias("ord")).filter(F.col("ord") < config.max_pages))
        seen = cut(seen.unionByName(fresh.select("seed", "url")))
        depth += 1
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    not_before = F.col("batch") * F.coalesce("delay", F.lit(0.0))
    columns = ["seed", "ord", "url", "status", "status_code", "markdown", "metadata", "links", "images", "depth", "error", "batch"]
    stop = F.when(F.col("waiting") > 0, "limit").otherwise("complete")
    stats = state.select("seed", F.col("crawled").alias("pages_crawled"), F.col("waiting").alias("pages_remaining"), stop.alias("stop_reason"))
    stats = stats.unionByName(invalid.select("seed", zero.alias("pages_crawled"), zero.alias("pages_remaining"), F.lit("invalid").alias("stop_reason")))
    return ManyCrawl(every.select(*columns, not_before.alias("not_before")), stats)


def _fresh_links(pages: DataFrame, seen: DataFrame, config: CrawlConfig) -> DataFrame:
    """(seed, url, parent, pos): links of completed pages that a crawl follows and its seed hasn't queued, each at its first place."""
    links = pages.filter("status = 'completed'").select("seed", "host", "ord", F.posexplode("links").alias("pos", "link")).select("seed", "host", "ord", "pos", "link.url", "link.type")
    if not config.include_external_links:
        links = links.filter("type = 'internal'")
    url = F.col("url")
    links = links.filter(passes_domain_filter(url, F.col("host"), config.include_subdomains, config.include_external_links)).filter(~matches_pattern(url, list(config.exclude_patterns)))
    if config.include_patterns:
        links = links.filter(matches_pattern(url, list(config.include_patterns)))
    first = links.groupBy("seed", "url").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.join(seen, ["seed", "url"], "left_anti").select("seed", "url", F.col("at.ord").alias("parent"), F.col("at.pos").alias("pos"))
