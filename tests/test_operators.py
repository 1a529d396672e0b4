import random

import pytest
from pyspark.sql import functions as F

from webloom.functions.urls import normalize_url
from webloom.operators import frontier as fr
from webloom.operators import robots as R
from webloom.operators import sitemaps as S
from webloom.operators.links import extract_images, link_counts, links_table, with_links

MD = "[Home](https://e.com) [js](javascript:void(0)) [mail](mailto:a@b.c) [**Bold** `code`](https://e.com/a/#x) [again](https://e.com/a) ![pic](https://e.com/i.png) ![](https://e.com/j.png) ![dup](https://e.com/i.png) [ ](https://e.com/blank) [Sub](https://blog.e.com/) [Out](https://other.org/x) [rel](/r)"


def test_links_and_images(spark):
    df = spark.createDataFrame([(1, "https://e.com/p", MD), (2, "https://e.com/q", None), (3, "junk", "[a](https://e.com/z)")], "i int, url string, markdown string")
    rows = {r.i: r for r in with_links(df, key="i").withColumn("c", link_counts(F.col("links"))).collect()}
    links = [(x.url, x.anchor_text, x.type) for x in rows[1].links]
    assert links == [("https://e.com/", "Home", "internal"), ("https://e.com/a", "Bold code", "internal"), ("https://blog.e.com/", "Sub", "internal"), ("https://other.org/x", "Out", "external")]
    assert [(x.url, x.alt) for x in rows[1].images] == [("https://e.com/i.png", "pic"), ("https://e.com/j.png", "")]
    assert rows[1].links[0].location == "navigational" and rows[1].links[1].location == "content"
    assert tuple(rows[1].c) == (4, 3, 1, sum(x.location == "content" for x in rows[1].links), sum(x.location == "navigational" for x in rows[1].links))
    assert rows[2].links == [] and rows[2].images == [] and rows[3].links[0].type == "external"


def test_links_against_python_regex(spark):
    import random
    import re

    r = random.Random(4)
    parts = ["[a](https://e.com/1)", "!", "[", "](", "x", "\n", "![i](https://e.com/2)", "[**b**](https://e.com/3/)", "[n\nl](https://e.com/4 'title')", "é", " "]
    docs = [(i, "https://e.com/", "".join(r.choice(parts) for _ in range(12))) for i in range(300)]
    got = {}
    for x in links_table(spark.createDataFrame(docs, "i int, page string, md string"), "md", "page", ["i"]).collect():
        got.setdefault(x.i, set()).add((x.pos, x.url, x.location))
    for i, _, md in docs:
        want, seen = set(), set()
        for pos, m in enumerate(re.finditer(r"\[([^\]]*)\]\(([^)]+)\)", md)):
            from webloom.functions.urls import normalize_one

            anchor = re.sub(r"\*\*(.*?)\*\*", r"\1", m[1].strip()).strip()
            url = normalize_one(m[2].strip())
            if not (m.start() and md[m.start() - 1] == "!") and anchor and url and url not in seen:
                seen.add(url)
                ratio = m.start() / len(md)
                want.add((pos, url, "navigational" if ratio < 0.15 or ratio > 0.85 else "content"))
        assert got.get(i, set()) == want, md


ROBOTS = [
    ("User-agent: *\nDisallow: /private/\nDisallow: /admin/", "*", [("/private/", False), ("/admin/", False)], None, []),
    ("User-agent: *\nCrawl-delay: 2\nDisallow: /x", "*", [("/x", False)], 2000.0, []),
    ("Sitemap: https://e.com/1.xml\nUser-agent: *\nDisallow:\nsitemap: https://e.com/2.xml", "*", [], None, ["https://e.com/1.xml", "https://e.com/2.xml"]),
    ("User-agent: *\nDisallow: /\n\nUser-agent: MyBot\nDisallow: /only", "mybot", [("/only", False)], None, []),
    ("User-agent: *\nDisallow:\nUser-agent: badbot\nDisallow: /", "*", [("/", False)], None, []),
    ("User-agent: *\nDisallow: /a\nUser-agent: *\nDisallow: /b", "*", [("/b", False)], None, []),
    ("User-agent: *\nDisallow: /a\nUser-agent: x\nCrawl-delay: 9", "x", [("/a", False)], None, []),
    ("Disallow: /early\nUser-agent : *\nuser-agent:*\r\nALLOW: /p # note\nnonsense\n# Disallow: /c", "*", [("/p # note", True)], None, []),
    ("User-agent:\nDisallow: /e\nUser-agent: *\nDisallow: /w", "*", [("/e", False)], None, []),
    ("", "*", [], None, []),
    (None, "*", [], None, []),
]


@pytest.mark.parametrize(("content", "agent", "rules", "delay", "sitemaps"), ROBOTS)
def test_robots_parse(spark, content, agent, rules, delay, sitemaps):
    r = R.parse_robots_one(content, agent)
    assert (r.rules, r.crawl_delay, r.sitemaps) == (rules, delay, sitemaps)


def test_robots_table_equals_udf(spark):
    for agent in ("*", "mybot", "x"):
        df = spark.createDataFrame([(str(i), c) for i, (c, *_) in enumerate(ROBOTS)], "host string, content string")
        got = sorted((r.host, r.pos, r.pattern, r.allow, r.crawl_delay) for r in R.parse_robots_table(df, agent=agent).collect())
        rows = [(h, R.parse_robots_one(c, agent)) for h, c in ((str(i), c) for i, (c, *_) in enumerate(ROBOTS))]
        assert got == sorted((h, i, p, a, r.crawl_delay) for h, r in rows for i, (p, a) in enumerate(r.rules))
        udf = df.select("host", R.parse_robots(F.col("content"), agent).alias("r")).collect()
        assert {r.host: [tuple(x) for x in r.r.rules] for r in udf} == {h: r.rules for h, r in rows}


def allowed(spark, rules, url, compat=False):
    df = spark.createDataFrame([(url, [{"pattern": p, "allow": a} for p, a in rules])], "u string, r array<struct<pattern:string,allow:boolean>>")
    return df.withColumn("n", normalize_url(F.col("u"))).select(R.is_url_allowed(F.col("n"), F.col("r"), compat).alias("x")).first().x


def test_robots_permission(spark):
    longest = [("/", False), ("/public/", True)]
    assert allowed(spark, longest, "https://e.com/public/page") and not allowed(spark, longest, "https://e.com/admin/page")
    star = [("/*?session=", False)]
    assert not allowed(spark, star, "https://e.com/a?session=1") and allowed(spark, star, "https://e.com/a")
    dollar = [("/exact$", False)]
    assert not allowed(spark, dollar, "https://e.com/exact") and allowed(spark, dollar, "https://e.com/exact/more")
    assert allowed(spark, dollar, "https://e.com/exact", compat=True) and not allowed(spark, dollar, "https://e.com/exact$", compat=True)
    assert allowed(spark, [("/a", False), ("/a", True)], "https://e.com/a") and allowed(spark, [], "https://e.com/a")
    assert not allowed(spark, [("/a+(b)", False)], "https://e.com/a+(b)c") and allowed(spark, [("/A", False)], "https://e.com/a")


XML = "<urlset><url><loc> https://e.com/1 </loc><lastmod>2024-01-01</lastmod><priority>0.8</priority></url><url><loc>https://e.com/2</loc></url><url><priority>1</priority></url></urlset>"
INDEX = "<sitemapindex><sitemap><loc>https://e.com/a.xml</loc></sitemap><sitemap><loc>https://e.com/b.xml</loc></sitemap></sitemapindex>"
LIKE = "<urlset><url><loc>https://e.com/sitemap-1.xml</loc></url><url><loc>https://e.com/SITEMAP2.xml</loc></url><url><loc>https://e.com/x</loc></url></urlset>"


def test_sitemap_parse(spark):
    df = spark.createDataFrame([("set", XML), ("index", INDEX), ("like", LIKE), ("text", "https://e.com/1\n"), ("none", None)], "url string, content string")
    got = {r.url: r for r in S.parse_sitemap_table(df).collect()}
    assert [tuple(e) for e in got["set"].entries] == [("https://e.com/1", "2024-01-01", 0.8), ("https://e.com/2", None, None)] and got["set"].url_count == 2
    assert got["index"].type == "index" and got["index"].child_sitemaps == ["https://e.com/a.xml", "https://e.com/b.xml"]
    assert got["like"].type == "index" and got["like"].url_count == 2
    assert (got["text"].type, got["text"].url_count) == ("urlset", 0) == (got["none"].type, got["none"].url_count)
    prio = spark.createDataFrame([("0.8abc",), ("high",), (".5",), ("1e1x",), ("-2",)], "p string").select(S.priority_of(F.col("p")).alias("x"))
    assert [r.x for r in prio.collect()] == [0.8, None, 0.5, 10.0, -2.0]


def test_discover(spark):
    store = spark.createDataFrame(
        [("https://e.com/sitemap_index.xml", INDEX), ("https://e.com/a.xml", XML), ("https://e.com/b.xml", INDEX.replace("b.xml", "c.xml")), ("https://e.com/c.xml", XML.replace("e.com", "f.com")), ("https://e.com/sitemap.php", XML)], "url string, content string"
    )
    d = S.discover_sitemaps(spark, "e.com", store)
    order = [(r.url.rpartition("/")[2], r.type, r.url_count) for r in d.sitemaps.orderBy("ord").collect()]
    assert order == [("sitemap_index.xml", "index", 2), ("a.xml", "urlset", 2), ("b.xml", "index", 2), ("a.xml", "urlset", 2), ("c.xml", "urlset", 2)]
    assert d.domain == "e.com" and d.total_urls == 6 == d.urls.count() and not d.has_more
    few = S.discover_sitemaps(spark, "https://e.com/x", store, max_sitemaps=2)
    assert few.sitemaps.count() == 2 and few.has_more
    flat = S.discover_sitemaps(spark, "e.com", store, max_depth=1)
    assert flat.has_more and flat.total_urls == 2
    named = S.discover_sitemaps(spark, "e.com", store, robots="Sitemap: https://e.com/c.xml\nSitemap: https://e.com/none.xml")
    assert named.total_urls == 2 and not named.has_more
    assert S.discover_sitemaps(spark, "httpbin.org", store).total_urls == 0
    assert S.filter_priority(d.urls, 0.5).count() == 3


def test_discover_passes_missing_children(spark):
    children = [f"https://e.com/{i}.xml" for i in range(200)]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in children) + "</sitemapindex>"
    store = [("https://e.com/sitemap.xml", index), *((u, XML) for u in children[120:130])]
    d = S.discover_sitemaps(spark, "e.com", spark.createDataFrame(store, "url string, content string"))
    assert [r.url for r in d.sitemaps.orderBy("ord").collect()] == ["https://e.com/sitemap.xml", *children[120:130]]
    assert d.total_urls == 20 == d.urls.count() and not d.has_more


def test_cursor_round_trip():
    config = fr.CrawlConfig.of("https://e.com", max_pages=7, include_patterns=["https://e.com/*"], strategy=None)
    c = fr.Cursor(config, "e.com", [("https://e.com/1", 1), ("https://e.com/é", 2)], {5: None}, {"e.com": R.Robots([("/x", False)], 2000.0, ["s"])}, 5, 99)
    assert fr.decode_cursor(fr.encode_cursor(c)) == c
    big = fr.Cursor(config, "e.com", [(f"https://e.com/{'x' * 600}{i}", 0) for i in range(200)])
    text = fr.encode_cursor(big)
    assert text.startswith("z:") and fr.decode_cursor(text) == big
    for bad in ("", "%%%", "bm90IGpzb24=", "z:AAAA", "e30="):
        with pytest.raises(ValueError):
            fr.decode_cursor(bad)


def test_frontier_and_config():
    c = fr.Cursor(fr.CrawlConfig("https://e.com"), "e.com")
    c.add([(str(i), 0) for i in range(3)])
    assert c.take(2, "bfs") == [("0", 0), ("1", 0)] and c.take(5, "dfs") == [("2", 0)] and c.take(1, "bfs") == []
    c.add([(str(i), 0) for i in range(250)])
    assert len(c.frontier) == 200 and c.take(2, "dfs") == [("199", 0), ("198", 0)]
    assert not c.is_visited("u")
    c.add_visited("u")
    c.add_visited("u")
    assert c.is_visited("u") and len(c.visited) == 1
    for bad in ({"concurrency": 0}, {"source": "x"}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            fr.CrawlConfig("https://e.com", **bad)
    with pytest.raises(ValueError):
        fr.CrawlConfig("")
    p = fr.page_preset("https://e.com")
    assert (p.max_pages, p.source, p.extract_metadata, p.obey_robots, p.page_timeout) == (1, "links", True, False, 25_000)


def test_links_in_the_row_equal_the_links_table(spark):
    """The Arrow function and the native expressions give the same links and images, offsets in UTF-16 units included."""
    r = random.Random(5)
    bits = ["[a](https://x.org/", "[**b** _c_](http://e.com/p)", "![i](/pic.png)", "![](q)", "[](u)", "[m](mailto:a@b)", "1)", "2/)", "\U0001f600" * 9, " word ", "\n", "[x](ftp://f)", "[z](https://sub.e.com/#f)", "](", "[q](  )"]
    rows = [(i, "https://e.com/a", None if i == 0 else "".join(r.choice(bits) for _ in range(r.randrange(25)))) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, markdown string").selectExpr("*", "1 AS read", "2 AS _page", "3 AS total")
    out = with_links(df)
    assert out.columns == [*df.columns, "links", "images"]
    got = {x.page_id: x for x in out.collect()}
    table = {}
    for x in links_table(df, keys=["page_id"]).orderBy("page_id", "pos").collect():
        table.setdefault(x.page_id, []).append((x.url, x.anchor_text, x.type, x.location))
    assert {i: [tuple(k) for k in x.links] for i, x in got.items() if x.links} == table
    images = {x.page_id: x.im for x in df.select("page_id", extract_images(F.col("markdown")).alias("im")).collect()}
    assert {i: x.images for i, x in got.items()} == images
    assert sum(k[3] == "content" for v in table.values() for k in v) > 50


def test_frontier_capacity_is_an_option():
    from webloom.operators.frontier import CrawlConfig, Cursor, decode_cursor, encode_cursor

    new = [(f"https://e.com/{i}", 0) for i in range(500)]
    for capacity, want in ((200, 200), (300, 300), (None, 500)):
        state = Cursor(CrawlConfig("https://e.com", frontier_capacity=capacity), "e.com")
        state.add(new)
        back = decode_cursor(encode_cursor(state))
        back.add(new)
        assert len(state.frontier) == want and len(back.frontier) == (want if capacity else 1000)


def test_sitemap_pages_parses_urls(spark):
    from webloom.plans.report import sitemap_pages

    urls = [("HTTPS://E.com/p/?q#f", "https://e.com/a.xml"), ("https://e.com/x/", "https://e.com/a.xml"), ("https://e.com", "u"), ("https://other.com/y", "u"), ("not a url", "u")]
    df = spark.createDataFrame([(u, None, None, s) for u, s in urls], "url string, lastmod string, priority double, source string")
    got = {r.url for r in sitemap_pages(df, "e.com").collect()}
    assert got == {"/p/?q", "/x/", "/", "https://other.com/y", "not a url"}
