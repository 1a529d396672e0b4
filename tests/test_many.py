import random

import pytest
from pyspark.sql import functions as F

from webloom.operators.frontier import CrawlConfig
from webloom.operators.sitemaps import discover_many, discover_sitemaps
from webloom.plans.crawl import crawl_batch
from webloom.plans.many import crawl_many
from webloom.sources.page_store import PageStore


def sitemap_store(spark, r):
    """Sitemaps that list each other, cycles and missing files included."""
    names = [f"https://h{i % 4}.com/{n}" for i, n in enumerate(["sitemap.xml", "sitemap_index.xml", *(f"m{j}.xml" for j in range(26))])]
    rows = []
    for n in names:
        kids = [r.choice([*names, "https://none.com/x.xml"]) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.7:
            rows.append((n, "<sitemapindex>" + "".join(f"<sitemap><loc>{k}</loc></sitemap>" for k in kids) + "</sitemapindex>"))
        elif r.random() < 0.8:
            rows.append((n, "<urlset>" + "".join(f"<url><loc>{n}/{j}</loc></url>" for j in range(r.randrange(3))) + "</urlset>"))
        elif r.random() < 0.5:
            rows.append((n, ""))
    robots = {f"h{i}.com": "\n".join(f"Sitemap: {r.choice([*names, 'https://none.com/y.xml'])}" for _ in range(r.randrange(1, 4))) for i in range(3)}
    return spark.createDataFrame(rows, "url string, content string"), robots


@pytest.mark.parametrize(("seed", "cap", "depth"), [(2, 6, 3), (3, 3, 1), (4, 1, 0)])
def test_discovery_of_many_equals_discovery_of_each(spark, seed, cap, depth):
    r = random.Random(seed)
    store, robots = sitemap_store(spark, r)
    domains = ["h0.com", "https://h1.com/some/page", "h2.com", "h3.com", "http://H0.com", "nothing.org"]
    files = spark.createDataFrame(list(robots.items()), "host string, content string")
    many = discover_many(spark.createDataFrame([(d,) for d in [*domains, "h0.com", None]], "domain string"), store, files, cap, depth)
    sitemaps, urls = many.sitemaps.collect(), many.urls.collect()
    summary = {x.domain: x for x in many.summary.collect()}
    assert len(summary) == len(domains)
    for d in domains:
        host = d.split("://")[-1].split("/")[0].lower()
        one = discover_sitemaps(spark, d, store, robots.get(host), cap, depth)
        want = [tuple(x) for x in one.sitemaps.orderBy("ord").select("ord", "url", "type", "url_count").collect()]
        assert sorted((x.ord, x.url, x.type, x.url_count) for x in sitemaps if x.domain == d) == want, d
        listed = sorted(map(tuple, one.urls.select("ord", "pos", "url", "source").collect()))
        assert sorted((x.ord, x.pos, x.url, x.source) for x in urls if x.domain == d) == listed
        s = summary[d]
        assert (s.host, s.n_sitemaps, s.total_urls, s.has_more) == (one.domain, len(want), one.total_urls, one.has_more), d
    assert cap > 6 or any(s.has_more for s in summary.values())


def site(spark, r, sitemaps=True):
    """Four hosts of pages with random links, one host a subdomain of another; robots.txt and sitemaps for some."""
    names = [f"https://{h}/{n}" for h in ("a.com", "sub.a.com", "b.com", "c.com") for n in ["", *(f"p{i}" for i in range(14)), "de/x", "es/y"]]
    html = lambda: "<html><head><title>t</title></head><body>" + " ".join(f'<a href="{r.choice([*names, "https://none.org/q", "/p1#x", "/p2/"])}">l{i}</a>' for i in range(r.randrange(1, 7))) + "</body></html>"
    pages = spark.createDataFrame([(n, html(), r.choice([200, 404])) for n in names if r.random() < 0.9 or n.endswith("/")], "url string, html string, status_code int")
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /de/\nCrawl-delay: 2"), ("b.com", "User-agent: *\nDisallow: /p3\nAllow: /p3$\nSitemap: https://b.com/s.xml")], "host string, content string")
    maps = [("https://b.com/s.xml", "<urlset>" + "".join(f"<url><loc>https://b.com/{p}</loc></url>" for p in ("p5", "p6/", "", "p7", "de/x")) + "</urlset>"), ("https://c.com/sitemap.xml", "<urlset><url><loc>https://c.com/p9</loc></url><url><loc>bad</loc></url></urlset>")]
    return PageStore(pages, robots, spark.createDataFrame(maps, "url string, content string") if sitemaps else None)


CASES = [
    {"source": "links", "max_pages": 7, "concurrency": 2, "include_subdomains": True},
    {"source": "all", "include_external_links": True, "frontier_capacity": 5, "concurrency": 3, "max_depth": 3, "extract_metadata": True},
    {"source": "sitemaps", "max_pages": 3},
    {"source": "links", "exclude_patterns": ("**/es/**",), "include_patterns": ("https://*/**",), "max_depth": 2, "obey_robots": False, "render": False},
    {"source": "all", "include_external_links": True, "frontier_capacity": None, "max_pages": 60, "concurrency": 1},
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_many_crawls_equal_one_after_the_other(spark, case):
    options = CASES[case]
    store = site(spark, random.Random(case))
    seeds = ["https://a.com", "https://b.com/", "https://c.com/p0", "https://gone.net/"]
    many = crawl_many(store, spark.createDataFrame([(s,) for s in [*seeds, "https://a.com/", None, "no url"]], "url string"), **options)
    rows, stats = many.pages.collect(), {s.seed: s for s in many.stats.collect()}
    assert len(stats) == len(seeds) + 1 and stats["no url"].stop_reason == "invalid"
    for s in seeds:
        config = CrawlConfig.of(s, **options, time_budget=10**12)
        if options.get("frontier_capacity", 0) is None:
            from dataclasses import replace

            config = replace(config, frontier_capacity=None)
        clock = iter(range(0, 10**9, 10**5)).__next__
        one = crawl_batch(spark, config, store, compat=False, clock=clock)
        shape = lambda r: (r.ord, r.url, r.status, r.status_code, r.markdown, r.metadata, r.links, r.images, r.depth, r.error)
        name = s if s.count("/") > 2 else s + "/"
        mine = sorted((r for r in rows if r.seed == name), key=lambda r: r.ord)
        assert list(map(shape, mine)) == list(map(shape, one.pages.orderBy("ord").collect())), (s, options)
        t = stats[name]
        assert (t.pages_crawled, t.pages_remaining) == (one.stats.pages_crawled, one.stats.pages_remaining)
        assert t.stop_reason == one.stats.stop_reason
        delay = 2000 if s == "https://a.com" and options.get("obey_robots", True) else 0
        assert all(r.not_before == r.batch * delay and r.batch <= r.ord for r in mine)


def test_many_crawls_of_nothing(spark):
    store = site(spark, random.Random(0))
    none = crawl_many(store, spark.createDataFrame([], "url string"))
    assert none.pages.collect() == [] and none.stats.collect() == []
    with pytest.raises(ValueError):
        crawl_many(store, spark.createDataFrame([], "url string"), strategy="dfs")
    assert none.pages.select(F.col("links")).columns == ["links"]


def test_repeated_pages_and_clashing_columns(spark):
    """Two pages with one normalised URL give one row, the least html; a caller's columns keep their names."""
    pages = spark.createDataFrame([("http://a.com/x", "<p>b</p>"), ("http://a.com/x#t", "<p>a</p>"), ("http://a.com/y", "<p>y</p>")], "url string, html string")
    store = PageStore(pages)
    for _ in range(2):
        many = crawl_many(store, spark.createDataFrame([("http://a.com/x",), ("http://a.com/y/",)], "url string"), render=False)
        assert sorted((r.url, r.markdown) for r in many.pages.collect()) == [("http://a.com/x", "a"), ("http://a.com/y", "y")]
        assert [r.markdown for r in crawl_batch(spark, CrawlConfig("http://a.com/x", render=False), store).pages.collect()] == ["a"]
    urls = spark.createDataFrame([("http://a.com/y", 7, "mine", 1)], "url string, _url int, html string, at int")
    row = store.head(urls).first()
    assert (row["_url"], row["html"], row["at"], row["status_code"]) == (7, "<p>y</p>", 1, 200)


def test_a_frontier_without_capacity_has_a_bound(spark, monkeypatch):
    from webloom.operators import frontier

    monkeypatch.setattr(frontier, "DRIVER_FRONTIER", 3)
    state = frontier.Cursor(frontier.CrawlConfig("https://e.com", frontier_capacity=None), "e.com")
    state.add([("u", 0)] * 3)
    with pytest.raises(ValueError, match="crawl_many"):
        state.add([("v", 0)])
