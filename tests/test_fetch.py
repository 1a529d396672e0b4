import gzip
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from webloom.operators.robots import is_url_allowed
from webloom.plans.endpoints import BAD_FORMAT, NO_URL, discover_answers, fetch_answers
from webloom.sources.http_pages import may_fetch, register
from webloom.sources.page_store import PageStore, gunzip_one


@pytest.fixture
def server():
    """A site that answers with the path and agent, and keeps what was asked."""
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            robots = self.path == "/robots.txt"
            self.wfile.write(b"User-agent: *\nDisallow: /no\nAllow: /no/but*yes$" if robots else f"{self.path} {self.headers['User-Agent']}".encode())

        def log_message(self, *args):
            pass

    site = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{site.server_port}", asked
    site.shutdown()


@pytest.fixture
def live(spark):
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("webloom_http")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_choose_the_requests(server, live):
    base, asked = server
    other = base.replace("127.0.0.1", "localhost")
    pages = live.option("pushdown", "true").option("urls", f"{base}/a {base}/b {other}/c {base}/da {base}/db").load()
    for condition, want in (("host = 'localhost'", ["/c"]), (f"url IN ('{base}/a', '{base}/b')", ["/a", "/b"]), (f"url LIKE '{base}/d%' AND html NOT LIKE '/db%'", ["/da"]), ("url = 'http://x.org/'", [])):
        asked.clear()
        assert sorted(r.html.split()[0] for r in pages.filter(condition).collect()) == want
        assert set(asked) == ({"/da", "/db"} if "LIKE" in condition else set(want))


def test_agent_suffix_and_robots(server, live):
    base, asked = server
    urls = " ".join(f"{base}/{p}" for p in ("ok", "no/1", "no/but/1yes", "no/but/1yes/2"))
    got = {r.url[len(base) :]: r for r in live.option("urls", urls).option("userAgentSuffix", "me/1").option("obeyRobots", "true").load().collect()}
    assert got["/ok"].html == "/ok webloom/0.1 me/1" and got["/no/but/1yes"].status_code == 200
    assert all(got[p].html is None and got[p].error.startswith("Disallowed") for p in ("/no/1", "/no/but/1yes/2"))
    assert "/no/1" not in asked and asked.count("/robots.txt") == 1


def test_stream_of_live_pages(server, spark, tmp_path):
    base, asked = server
    register(spark)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for n in (3, 5):  # more URLs after a restart: only these are asked for
        source = spark.readStream.format("webloom_http").option("urls", " ".join(f"{base}/{i}" for i in range(n))).option("maxUrlsPerBatch", "2").load()
        query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r.html.split()[0] for r in spark.read.parquet(out).collect()) == [f"/{i}" for i in range(5)]
    assert len(asked) == 5


def test_may_fetch_is_the_table_rule(spark):
    r = random.Random(2)
    rules = [("/" + "".join(r.choice("ab*/.$") for _ in range(r.randrange(5))), r.random() < 0.5) for _ in range(300)]
    cases = [(i, "/" + "".join(r.choice("ab/.$") for _ in range(r.randrange(5))), r.sample(rules, 3)) for i in range(600)]
    rows = spark.createDataFrame([(i, "https://e.com" + p, [{"pattern": a, "allow": b} for a, b in rs]) for i, p, rs in cases], "i int, url string, rules array<struct<pattern:string,allow:boolean>>")
    want = {x.i: x.ok for x in rows.select("i", is_url_allowed(F.col("url"), F.col("rules")).alias("ok")).collect()}
    assert all(may_fetch(p, rs) == want[i] for i, p, rs in cases)


def test_gunzip_by_pieces():
    body = gzip.compress(b"abc" * 100_000)
    assert gunzip_one(body, 300_000) == "abc" * 100_000 and gunzip_one(body, 299_999) is None
    assert gunzip_one(body + gzip.compress(b"more"), 1 << 20, 7) == "abc" * 100_000 + "more"
    assert gunzip_one(body[:-20], 1 << 20) is gunzip_one(b"no", 9) is gunzip_one(b"", 9) is gunzip_one(None, 9) is None
    assert gunzip_one(gzip.compress(b""), 9) == ""


def store(spark):
    frame = '<body>a<IFRAME class=x src="/f?x#y"></iframe> b <iframe src="https://o.org/none"></iframe><frame src=\'f?x\'>c</body>'
    pages = [("https://e.com/p", frame), ("https://e.com/f?x", r'<html><body id="b">\1 $0 <iframe src="/p"></iframe></body></html>'), ("https://e.com/no", "<p>n</p>"), ("https://o.org/no", None)]
    return PageStore(spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /no")], "host string, content string"), spark.createDataFrame([("https://e.com/sitemap.xml", "<urlset><url><loc>https://e.com/1</loc></url></urlset>")], "url string, content string"))


def test_fetch_with_frames_and_robots(spark):
    urls = spark.createDataFrame([("https://e.com/p", 1), ("https://e.com/no", 2), ("https://o.org/no", 3), ("https://e.com/q", 4), (None, 5)], "url string, _blocked int")
    body = r'<div>\1 $0 <iframe src="/p"></iframe></div>'
    got = {r._blocked: r for r in store(spark).fetch(urls, with_frames=True, obey_robots=True).collect()}
    assert len(got) == 5 and [got[i].status_code for i in range(1, 6)] == [200, None, 200, None, None]
    assert got[1].content == f'<body>a<IFRAME class=x src="/f?x#y"></iframe>{body} b <iframe src="https://o.org/none"></iframe><frame src=\'f?x\'>{body}c</body>'
    assert got[2].content is got[3].content is None
    assert {r.url: r.content for r in store(spark).fetch(urls).collect()}["https://e.com/no"] == "<p>n</p>"


def test_robots_for_many(spark):
    sites = spark.createDataFrame([("e.com",), ("http://E.com:8080/x",), ("o.org",), (None,), ("e.com",)], "site string")
    got = {r.site: r for r in store(spark).robots_for(sites).collect()}
    assert {s: (r.host, r.robots_url, bool(r.content)) for s, r in got.items()} == {
        "e.com": ("e.com", "https://e.com/robots.txt", True),
        "http://E.com:8080/x": ("e.com", "http://e.com:8080/robots.txt", True),
        "o.org": ("o.org", "https://o.org/robots.txt", False),
    }
    assert PageStore(store(spark).pages).robots_for(sites).filter("content IS NULL").count() == 3


def test_endpoints(spark):
    asked = [("https://e.com/no#x", "markdown", 1), ("https://e.com/no", None, 2), ("https://e.com/no", "html", 3), ("https://e.com/no", "pdf", 4), (None, "html", 5), ("junk", "", 6)]
    requests = spark.createDataFrame(asked, "url string, format string, status int").withColumn("n", F.col("status"))
    got = {r.n: r for r in fetch_answers(store(spark), requests).collect()}
    assert [got[i].status for i in range(1, 7)] == [200, 200, 200, 400, 500, 500]
    assert [got[i].body for i in range(1, 7)] == ["n", "n", "<p>n</p>", None, None, None]
    assert got[4].error == BAD_FORMAT and got[1].url == "https://e.com/no#x" and got[3].content_type.startswith("text/html")
    assert fetch_answers(store(spark), requests.limit(0)).count() == 0
    found = discover_answers(store(spark), spark.createDataFrame([("e.com",), ("https://o.org",), ("",), (None,), ("https://",), ("e.com",)], "url string"))
    answers = {r.url: r for r in found.answers.collect()}
    assert len(answers) == 5 and [answers[u].status for u in ("e.com", "https://o.org", "", None, "https://")] == [200, 200, 400, 400, 500]
    assert (answers["e.com"].n_sitemaps, answers["e.com"].total_urls, answers["https://o.org"].n_sitemaps) == (1, 1, 0) and answers[""].error == NO_URL
    assert [(r.request, r.url) for r in found.urls.collect()] == [("e.com", "https://e.com/1")]
