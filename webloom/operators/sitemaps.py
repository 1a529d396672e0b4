"""Sitemaps: parsing as native expressions, discovery as joins level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.text import match_or_null, trim_ws
from webloom.operators.robots import parse_robots, parse_robots_one
from webloom.scratch import cut
from webloom.session import ship

#: Where sitemaps are looked for, in this order, when robots.txt names none.
COMMON_LOCATIONS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap-0.xml", "/sitemap1.xml", "/sitemap.php", "/sitemap.txt")
FLOAT_PREFIX = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def tag_text(block: Column, tag: str) -> Column:
    """Trimmed content of the first such element; longer names that start with tag count too; null where there is none."""
    return trim_ws(match_or_null(block, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"))


def priority_of(text: Column) -> Column:
    """Number at the start of a text; null where there is none."""
    return F.regexp_extract(text, FLOAT_PREFIX, 0).try_cast("double")


def parse_sitemap(content: Column) -> Column:
    """Struct: type (index or urlset), child_sitemaps, entries array<struct<url, lastmod, priority>>."""
    xml = F.coalesce(content, F.lit(""))
    blocks = lambda tag: F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    filled = lambda x: x.isNotNull() & (x != "")
    children = F.filter(F.transform(blocks("sitemap"), lambda b: tag_text(b, "loc")), filled)
    entries = F.transform(blocks("url"), lambda b: F.struct(tag_text(b, "loc").alias("url"), tag_text(b, "lastmod").alias("lastmod"), priority_of(tag_text(b, "priority")).alias("priority")))
    entries = F.filter(entries, lambda e: filled(e["url"]))
    # A urlset most of whose entries are sitemap files is an index of these.
    files = F.transform(F.filter(entries, lambda e: e["url"].endswith(".xml") & F.lower(e["url"]).contains("sitemap")), lambda e: e["url"])
    as_index = (F.size(files) > 0) & (F.size(files) * 2 >= F.size(entries))
    none = F.array().cast("array<struct<url:string,lastmod:string,priority:double>>")
    index = (F.size(children) > 0) | as_index
    return F.struct(
        F.when(index, "index").otherwise("urlset").alias("type"),
        F.when(F.size(children) > 0, children).when(as_index, files).otherwise(F.array().cast("array<string>")).alias("child_sitemaps"),
        F.when(index, none).otherwise(entries).alias("entries"),
    )


def parse_sitemap_table(store: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """url, type, url_count, child_sitemaps, entries of each sitemap."""
    p = store.select(F.col(url).alias("url"), parse_sitemap(F.col(content)).alias("p"))
    return p.select("url", F.col("p.type").alias("type"), F.when(F.col("p.type") == "index", F.size("p.child_sitemaps")).otherwise(F.size("p.entries")).cast("long").alias("url_count"), F.col("p.child_sitemaps").alias("child_sitemaps"), F.col("p.entries").alias("entries"))


def urls_of(parsed: DataFrame, source: str = "url") -> DataFrame:
    """(url, lastmod, priority, source, pos) of all urlsets: a bag, duplicates stay."""
    return parsed.filter("type = 'urlset'").select(F.col(source).alias("source"), F.posexplode("entries").alias("pos", "e")).select(F.col("e.url").alias("url"), F.col("e.lastmod").alias("lastmod"), F.col("e.priority").alias("priority"), "source", F.col("pos").cast("long").alias("pos"))


def filter_priority(urls: DataFrame, least: float | None) -> DataFrame:
    """URLs of that priority or more; a missing priority counts as 0."""
    return urls if least is None else urls.filter(F.coalesce("priority", F.lit(0.0)) >= least)


@dataclass
class Discovery:
    domain: str
    sitemaps: DataFrame  # url, type, url_count, in the order of ord
    urls: DataFrame  # url, lastmod, priority, source, in the order of ord, pos
    total_urls: int
    has_more: bool


def origin_and_host(domain: str) -> tuple[str, str]:
    """https origin and host of a domain or URL. Only "://" makes a URL, so hosts that begin with http are hosts."""
    url = domain if "://" in domain else f"https://{domain}"
    scheme, _, rest = url.partition("://")
    authority = rest.split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()
    return f"{scheme}://{authority}", authority.rpartition("@")[2].partition(":")[0]


def common_sitemaps(hosts: DataFrame, store: DataFrame) -> DataFrame:
    """(host, url): for each host (host, origin) the first common location that the store (url, content) has with content."""
    places = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(p).alias("path")) for i, p in enumerate(COMMON_LOCATIONS)))
    tried = hosts.select("host", "origin", F.explode(places).alias("p")).select("host", F.col("p.pos").alias("pos"), F.concat("origin", "p.path").alias("url"))
    return tried.join(store.filter("content <> ''").select("url").distinct(), "url").groupBy("host").agg(F.min_by("url", "pos").alias("url"))


def discover_sitemaps(spark: SparkSession, domain: str, store: DataFrame, robots: str | None = None, max_sitemaps: int = 50, max_depth: int = 3) -> Discovery:
    """Sitemaps and their URLs, depth first. store: (url, content).

    Each level is one join of at most max_sitemaps URLs with the store; what is
    gathered is bounded by the caps, except the child lists of the sitemaps found,
    which stay whole, as missing children don't count, and the urls table, which stays lazy.
    Cycles are followed until a cap ends them.
    """
    origin, host = origin_and_host(domain)
    seeds = parse_robots_one(robots).sitemaps if robots else []
    if not seeds:
        seeds = [r.url for r in common_sitemaps(spark.createDataFrame([(host, origin)], "host string, origin string"), store).collect()]
    known: dict[str, tuple[str, int, list[str]] | None] = {}

    def look_up(urls: list[str]) -> None:
        wanted = [u for u in dict.fromkeys(urls) if u not in known]
        if wanted:
            known.update(dict.fromkeys(wanted))
            found = parse_sitemap_table(store.filter("content <> ''").filter(F.col("url").isin(wanted)))
            known.update({r.url: (r.type, r.url_count, r.child_sitemaps) for r in found.select("url", "type", "url_count", "child_sitemaps").collect()})

    out: list[tuple[int, str, str, int]] = []
    has_more = False
    stack = [(u, 0) for u in reversed(seeds)]
    while stack:
        url, depth = stack.pop()
        if len(out) >= max_sitemaps or depth > max_depth:
            has_more = True
            if len(out) >= max_sitemaps:
                break
            continue
        if url not in known:
            look_up([u for u, d in reversed(stack) if d == depth][: max_sitemaps - 1] + [url])
        if known[url] is None:
            continue
        kind, n, kids = known[url]
        out.append((len(out), url, kind, n))
        stack += [(k, depth + 1) for k in reversed(kids)] if kind == "index" else []
    sitemaps = spark.createDataFrame(out, "ord long, url string, type string, url_count long")
    urls = urls_of(parse_sitemap_table(store.filter(F.col("url").isin([u for _, u, t, _ in out if t == "urlset"] or [""]))))
    order = F.broadcast(sitemaps.filter("type = 'urlset'").select("ord", F.col("url").alias("source")))
    return Discovery(host, sitemaps, urls.join(order, "source"), sum(n for *_, t, n in out if t == "urlset"), has_more)


@dataclass
class ManyDiscovery:
    sitemaps: DataFrame  # domain, ord, url, type, url_count
    urls: DataFrame  # domain, ord, pos, url, lastmod, priority, source
    summary: DataFrame  # domain, host, n_sitemaps, total_urls, has_more: one row a domain


def with_origin(domains: DataFrame) -> DataFrame:
    """domains (domain) with host and origin, as origin_and_host gives them."""
    url = F.when(F.col("domain").contains("://"), F.col("domain")).otherwise(F.concat(F.lit("https://"), "domain"))
    authority = F.lower(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1))
    host = F.substring_index(F.substring_index(authority, "@", -1), ":", 1)
    return domains.select("domain", host.alias("host"), F.concat(F.substring_index(url, "://", 1), F.lit("://"), authority).alias("origin"))


def discover_many(domains: DataFrame, store: DataFrame, robots: DataFrame | None = None, max_sitemaps: int = 50, max_depth: int = 3) -> ManyDiscovery:
    """discover_sitemaps for a table of domains (domain), from sitemaps (url, content) and robots.txt files (host, content), without a driver loop over any.

    A sitemap's place in depth-first order is its path: its number among the seeds, then among the children of each parent. A level
    joins all domains' candidates with the parsed sitemaps, and of all that is known of a domain only the first max_sitemaps by path stay: what
    comes after so many that exist can't be among them, however deep. So a level holds at most max_sitemaps rows a domain, and
    paths end cycles at max_depth. has_more tells, as there, that the cap left some listed sitemap out (whether it exists or not) or max_depth some child.

    Repeated domains count once, null ones not at all; a sitemap that the store has twice counts once.
    """
    ship(store.sparkSession)
    asked = cut(with_origin(domains.filter("domain IS NOT NULL").distinct()))
    filled = store.filter("content <> ''")
    parsed = cut(parse_sitemap_table(filled).drop("entries").dropDuplicates(["url"]))
    seeds = None
    if robots is not None:
        named = robots.join(asked.select("host").distinct(), "host", "left_semi").dropDuplicates(["host"]).select("host", parse_robots(F.col("content"))["sitemaps"].alias("maps"))
        seeds = asked.join(named, "host").select("domain", F.posexplode("maps").alias("pos", "url"))
    rest = asked if seeds is None else asked.join(seeds, "domain", "left_anti")
    common = common_sitemaps(rest.select(F.col("origin").alias("host"), "origin").distinct(), store).select(F.col("host").alias("origin"), "url")
    first = rest.join(common, "origin").select("domain", F.lit(0).alias("pos"), "url")
    first = cut(first if seeds is None else seeds.unionByName(first))
    known, refs = None, first.select("domain", F.array("pos").alias("path"), "url")
    in_order = Window.partitionBy("domain").orderBy("path")
    for depth in range(max_depth + 1):
        here = refs.join(parsed, "url").select("domain", "path", "url", "type", "url_count", "child_sitemaps")
        every = here if known is None else known.unionByName(here)
        known = cut(every.withColumn("ord", (F.row_number().over(in_order) - 1).cast("long")).filter(F.col("ord") < max_sitemaps).drop("ord"))
        last = known.filter(F.size("path") == depth + 1)
        refs = last.select("domain", "path", F.posexplode("child_sitemaps").alias("pos", "url")).select("domain", F.concat("path", F.array("pos")).alias("path"), "url")
    known = cut(known.withColumn("ord", (F.row_number().over(in_order) - 1).cast("long")))
    kids = F.size("child_sitemaps")
    # The last place listed below each sitemap, and among the seeds.
    ends = known.filter((kids > 0) & (F.size("path") <= max_depth)).select("domain", F.concat("path", F.array(kids - 1)).alias("end"))
    ends = ends.unionByName(first.groupBy("domain").agg(F.array(F.max("pos")).alias("end"))).groupBy("domain").agg(F.max("end").alias("end"))
    total = known.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_sitemaps"),
        F.sum(F.when(F.col("type") == "urlset", F.col("url_count")).otherwise(0)).alias("total_urls"),
        F.max("path").alias("last"),
        F.max((kids > 0) & (F.size("path") > max_depth)).alias("deeper"),
    )
    summary = asked.join(total, "domain", "left").join(ends, "domain", "left").select(
        "domain",
        "host",
        F.coalesce("n_sitemaps", F.lit(0)).alias("n_sitemaps"),
        F.coalesce("total_urls", F.lit(0)).alias("total_urls"),
        F.coalesce(F.col("deeper") | (F.col("n_sitemaps") >= max_sitemaps) & (F.col("end") > F.col("last")), F.lit(max_sitemaps < 1) & F.col("end").isNotNull()).alias("has_more"),
    )
    places = known.filter("type = 'urlset'").select("domain", "ord", F.col("url").alias("source"))
    entries = urls_of(parse_sitemap_table(filled.join(places.select(F.col("source").alias("url")).distinct(), "url", "left_semi").dropDuplicates(["url"])))
    urls = places.join(entries, "source").select("domain", "ord", "pos", "url", "lastmod", "priority", "source")
    return ManyDiscovery(known.select("domain", "ord", "url", "type", "url_count"), urls, summary)


def sitemap_levels(seeds: DataFrame, store: DataFrame, max_depth: int = 3) -> DataFrame:
    """(host, url, depth, type, url_count) for any number of hosts: sitemaps are parsed once, each level is one join, cut by a checkpoint; each sitemap once per host at its least depth."""
    parsed = cut(parse_sitemap_table(store.filter("content <> ''")).drop("entries"))  # parsed once, not once a level
    level = seeds.select("host", "url").distinct().withColumn("depth", F.lit(0).cast("long"))
    found = None
    for depth in range(max_depth + 1):
        here = cut(level.join(parsed, "url"))
        found = here if found is None else found.unionByName(here)
        level = here.select("host", F.explode("child_sitemaps").alias("url")).distinct().withColumn("depth", F.lit(depth + 1).cast("long"))
    return found.groupBy("host", "url").agg(F.min("depth").alias("depth"), F.first("type").alias("type"), F.first("url_count").alias("url_count"))
