import time

from pyspark.sql import functions as F

from webloom.operators.frontier import CrawlConfig, decode_cursor
from webloom.plans.crawl import bfs_levels, crawl_batch
from webloom.plans.report import page_report, page_rows, sitemap_pages
from webloom.sources.page_store import PageStore, register, sitemap_content
from webloom.streaming import ingest


def page(*links):
    return "<html><head><title>T</title></head><body>" + " ".join(f'<a href="{u}">l</a>' for u in links) + "</body></html>"


def site(spark):
    pages = [
        ("https://e.com/", page("/a", "/b", "https://x.org/"), 200),
        ("https://e.com/a", page("/c", "/b"), 200),
        ("https://e.com/b", page("/d"), 404),
        ("https://e.com/c", page("/"), 200),
        ("https://x.org/", page(), 200),
    ]
    robots = spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /c\nCrawl-delay: 1\nSitemap: https://e.com/s.xml")], "host string, content string")
    maps = spark.createDataFrame([("https://e.com/s.xml", "<urlset><url><loc>https://e.com/a/</loc></url><url><loc>https://x.org/</loc></url></urlset>")], "url string, content string")
    return PageStore(spark.createDataFrame(pages, "url string, html string, status_code int"), robots, maps)


def run(spark, cursor=None, clock=lambda: 0, compat=True, store=None, **options):
    return crawl_batch(spark, CrawlConfig("https://e.com", **options), store or site(spark), cursor, compat=compat, clock=clock)


def rows(result):
    return [(r.url.removeprefix("https://e.com"), r.status, r.depth) for r in result.pages.orderBy("ord").collect()]


def test_bfs_and_dfs_without_robots(spark):
    r = run(spark, source="links", obey_robots=False, extract_metadata=True, concurrency=1)
    assert rows(r) == [("/", "completed", 0), ("/a", "completed", 1), ("/b", "completed", 1), ("/c", "completed", 2), ("/b", "completed", 2), ("/d", "error", 2), ("/d", "error", 3)]
    assert r.cursor is None and r.stats.stop_reason == "complete" and r.stats.pages_remaining == 0
    got = {x.url: x for x in r.pages.collect()}
    assert got["https://e.com/b"].status_code == 404 and got["https://e.com/"].metadata.title == "T" and got["https://e.com/d"].error
    once = run(spark, source="links", obey_robots=False, compat=False, concurrency=1)
    assert [u for u, *_ in rows(once)] == ["/", "/a", "/b", "/c", "/d"]
    deep = run(spark, source="links", obey_robots=False, strategy="dfs", concurrency=1, compat=False)
    assert [u for u, *_ in rows(deep)] == ["/", "/b", "/d", "/a", "/c"]


def test_robots_sitemaps_patterns_and_limits(spark):
    r = run(spark, clock=iter(range(0, 10**7, 2000)).__next__, time_budget=10**9, max_pages=6)
    assert rows(r)[:3] == [("/", "completed", 0), ("/a", "completed", 0), ("https://x.org/", "completed", 0)]
    assert ("/c", "disallowed", 1) in rows(r)
    assert run(spark, max_pages=2).stats.stop_reason in ("limit", "crawl_delay")
    skipped = run(spark, source="links", obey_robots=False, include_patterns=("https://e.com/x*",))
    assert rows(skipped) == [("/", "skipped", 0)]
    external = run(spark, source="links", obey_robots=False, include_external_links=True, exclude_patterns=("**/b",), max_depth=1, concurrency=1)
    assert rows(external) == [("/", "completed", 0), ("/a", "completed", 1), ("https://x.org/", "completed", 1)]
    plain = run(spark, source="links", obey_robots=False, render=False)
    assert rows(plain) == [("/", "completed", 0)] and plain.pages.first().markdown == "T l l l"


def test_stops_and_resumes(spark):
    slow = run(spark, source="links", time_budget=16_000)
    assert slow.stats.stop_reason == "time_budget" and slow.stats.pages_crawled == 0 and slow.cursor
    held = run(spark, source="links")
    assert held.stats.stop_reason == "crawl_delay" and held.stats.pages_crawled == 1
    state = decode_cursor(held.cursor)
    assert state.robots["e.com"].crawl_delay == 1000.0 and [u for u, _ in state.frontier] == ["https://e.com/a", "https://e.com/b"]
    more = run(spark, held.cursor, clock=lambda: 5000, source="links")
    assert [u for u, *_ in rows(more)] == ["/a", "/b"] and more.stats.total_pages_crawled == 3


def test_bfs_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert sorted(map(tuple, bfs_levels(seeds, edges).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert sorted(map(tuple, bfs_levels(seeds, edges, max_depth=1).collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert sorted(map(tuple, bfs_levels(seeds, edges, max_pages=2).collect())) == [("a", 0), ("b", 1)]


def test_bfs_without_a_depth_bound(spark):
    from compare import SF

    from webloom.plans.queries import QUERIES, graph

    edges = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(12)] + [("03", "05")], "src string, dst string")
    got = bfs_levels(spark.createDataFrame([("00",)], "url string"), edges, max_depth=None)
    assert sorted(map(tuple, got.collect())) == [(f"{i:02d}", i if i < 5 else i - 1) for i in range(13)]
    seeds, edges = graph(spark, SF)
    links, want = [tuple(e) for e in edges.collect()], {r.url: 0 for r in seeds.collect()}
    depth, level = 0, set(want)
    while level:
        depth, level = depth + 1, {dst for src, dst in links if src in level and dst not in want}
        want |= dict.fromkeys(level, depth)
    assert {r.url: r.depth for r in QUERIES["crawl_bfs_whole"](spark, SF).collect()} == want


def test_report_and_sitemap_pages(spark):
    pages = spark.createDataFrame([("https://e.com/", page("/a"), 201), ("https://e.com/n", None, None)], "url string, html string, status_code int")
    got = {r.url: r for r in page_report(page_rows(pages)).collect()}
    r = got["https://e.com/"]
    assert (r.title, r.status_code, r.links_count.total, r.text_length) == ("T", 201, 1, len(r.content_snippet)) and len(r) == 22
    assert got["https://e.com/n"].title == "" and got["https://e.com/n"].status_code == 200
    urls = spark.createDataFrame([("https://e.com/p?q", None, 0.9, "https://e.com/s/m.xml"), ("https://f.com/p", "x", None, "https://e.com/m.xml")], "url string, lastmod string, priority double, source string")
    assert [tuple(x) for x in sitemap_pages(urls, "e.com").collect()] == [("/p?q", "m.xml", "https://e.com/s/m.xml", 0.9, None), ("https://f.com/p", "m.xml", "https://e.com/m.xml", None, "x")]
    assert sitemap_pages(urls, "https://e.com", 0.5).count() == 1


def test_store_and_sources(spark, tmp_path):
    import gzip

    store = site(spark)
    urls = spark.createDataFrame([("https://e.com/a",), ("https://e.com/none",)], "url string")
    got = {r.url: r for r in store.fetch(urls, "markdown").collect()}
    assert "[l](https://e.com/c)" in got["https://e.com/a"].content and got["https://e.com/none"].content is None
    assert '<base href="https://e.com/a">' in store.fetch(urls, base=True).filter("content is not null").first().content
    assert store.robots_txt("e.com").startswith("User-agent") and store.robots_txt("f.com") is None
    store.write_by_host(str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).filter("host = 'e.com'").count() == 4
    body = spark.createDataFrame([("https://e.com/s.xml.gz", gzip.compress(b"<x>")), ("https://e.com/bad.gz", b"no"), ("https://e.com/s.xml", b"<y>")], "url string, body binary")
    assert {r.u: r.c for r in body.select(F.col("url").alias("u"), sitemap_content(F.col("url"), F.col("body")).alias("c")).collect()} == {"https://e.com/s.xml.gz": "<x>", "https://e.com/bad.gz": None, "https://e.com/s.xml": "<y>"}
    register(spark)
    live = spark.read.format("webloom_http").option("urls", "http://127.0.0.1:9/x").option("timeoutMs", "500").load().collect()
    assert len(live) == 1 and live[0].html is None and live[0].error


def test_long_live_pages_are_errors(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "none" in self.path else 200)
            self.end_headers()
            self.wfile.write(b"x" * int(self.path.rpartition("/")[2]))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    register(spark)
    urls = " ".join(f"http://127.0.0.1:{server.server_port}/{p}" for p in ("100", "101", "none/101"))
    got = spark.read.format("webloom_http").option("urls", urls).option("maxBytes", "100").load().collect()
    server.shutdown()
    assert sorted((r.status_code, r.html, bool(r.error)) for r in got if r.html) == [(200, "x" * 100, False)]
    assert sorted((r.status_code, bool(r.error)) for r in got if not r.html) == [(200, True), (404, True)]


def test_stream_reports_each_url_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in ([(1, "https://e.com/1", page()), (2, "https://e.com/1#x", page()), (3, "junk", page())], [(4, "https://e.com/1/", page()), (5, "https://e.com/2", page())]):
        spark.createDataFrame(part, ingest.PAGES).coalesce(1).write.mode("append").parquet(src)
        q = ingest.crawl_stream(ingest.read_pages(spark, src), out, ck)
        assert q.awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["https://e.com/1", "https://e.com/2"]


def test_host_rates(spark, tmp_path):
    rows_ = [("https://e.com/1", "2024-01-01 00:00:10"), ("https://e.com/2", "2024-01-01 00:00:50"), ("https://f.com/", "2024-01-01 00:01:10")]
    spark.createDataFrame(rows_, "url string, ts string").selectExpr("url", "cast(ts as timestamp) as ts").write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "f"))
    q = ingest.host_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.host, r.fetches) for r in spark.table("rates").collect()) == [("e.com", 2), ("f.com", 1)]
    time.sleep(0)


def test_sql_names(spark):
    from webloom.sql import register_functions

    register_functions(spark)
    r = spark.sql("SELECT normalize_url('HTTP://E.com/a/') AS n, url_hash('a') AS h, parse_robots('User-agent: *\nDisallow: /x').rules[0].pattern AS p, render_markdown('<b>x</b>', '') AS m").first()
    assert (r.n, r.p, r.m) == ("http://e.com/a", "/x", "**x**") and r.h > 0
