import random
import re
import time

import pytest

from webloom.operators.links import inline, links_table, read_links
from webloom.operators.politeness import fetch_schedule
from webloom.sql import register_functions

PATTERN = r"\[([^\]]*)\]\(([^)]+)\)"


def test_scan_equals_the_pattern():
    r = random.Random(1)
    for _ in range(5_000):
        text = "".join(r.choice("[]()!ab\n") for _ in range(r.randrange(0, 30)))
        assert list(inline(text)) == [(m.start(), m.end(), m[1], m[2]) for m in re.finditer(PATTERN, text)], text
        assert list(inline(text, "![")) == [(m.start(), m.end(), m[1], m[2]) for m in re.finditer("!" + PATTERN, text)], text


@pytest.mark.parametrize("text", ["[a](b)" + "[" * 1_000_000, "[a](" * 250_000, "[](" * 300_000 + ")", "![" * 500_000 + "](x)", "[a]()" * 200_000, "](" * 500_000 + ")"])
def test_hostile_brackets_take_no_more_than_a_second(text):
    began = time.perf_counter()
    read_links(text, "https://e.com/")
    assert time.perf_counter() - began < 3  # one second on a free machine


def test_table_functions(spark):
    register_functions(spark)
    pages = [(1, "https://e.com/", "[a](https://e.com/a) ![i](x.png) [b](https://f.com/#y) [again](https://e.com/a/)"), (2, "https://e.com/", "none"), (3, None, None), (4, "https://e.com/q", "[_c_](http://sub.e.com)")]
    df = spark.createDataFrame(pages, "page_id int, url string, markdown string")
    df.createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT page_id, l.* FROM sql_pages, LATERAL links(markdown, url) l").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, links_table(df, keys=["page_id"]).collect()))
    assert [r.url for r in got if r.page_id == 1] == ["https://e.com/a", "https://f.com/"]
    assert [tuple(r) for r in spark.sql("SELECT page_id, i.url, i.alt FROM sql_pages, LATERAL images(markdown) i").collect()] == [(1, "x.png", "i")]
    rules = "SELECT r.* FROM VALUES ('User-agent: *\\nDisallow: /x\\nAllow: /x/y\\nCrawl-delay: 2\\nUser-agent: bot\\nDisallow: /') AS t(c), LATERAL robots_rules(c{}) r"
    assert [tuple(r) for r in spark.sql(rules.format("")).collect()] == [(0, "/x", False, 2000.0), (1, "/x/y", True, 2000.0)]
    assert [tuple(r) for r in spark.sql(rules.format(", 'bot'")).collect()] == [(0, "/", False, None)]


def test_fetch_times_by_sql(spark):
    register_functions(spark)
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None, "hot", "hot"]), f"u{i}", r.randrange(5_000)) for i in range(200)]
    delays = spark.createDataFrame([("a", 70), ("hot", 11)], "host string, delay_ms long")
    requests = spark.createDataFrame(rows, "host string, url string, requested_at long")
    requests.join(delays, "host", "left").createOrReplaceTempView("sql_requests")
    got = spark.sql("SELECT host, url, requested_at, fetch_at FROM fetch_times(TABLE(sql_requests), 40)").collect()
    want = fetch_schedule(requests, delays, 40).select("host", "url", "requested_at", "fetch_at").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 200
    with pytest.raises(Exception, match="columns missing: url"):
        spark.sql("SELECT * FROM fetch_times(TABLE(SELECT host, requested_at FROM sql_requests), 40)")
