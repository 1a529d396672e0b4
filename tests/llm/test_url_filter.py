import random
import re

from webloom.llm import url_filter
from webloom.llm.queries import RULES
from webloom.llm.url_filter import Rule


def plain(url, rules, default="allow"):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.allow), default=None)
    return host, path, best and best.name, default if best is None else "allow" if best.allow else "block"


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/1", "http://m.Example.NET/en/1?x#y", "http://example.net/english", "http://badexample.com/de/", "https://x.example.com/de/1", "https://example.com/de", "http://a.org/fr/2", "http://a.org:80/fr/2", "x://y://z.net/", "http://.net/", "http://a..net//en/", "http://É.net/", "http://a.net/\nb", "http://example.net/en/"]


def test_judge_both_ways(spark, monkeypatch):
    r = random.Random(1)
    many = [Rule(".".join(r.choice("abc") for _ in range(r.randrange(1, 4))), "/".join(r.choice(["x", "y", "xy", ""]) for _ in range(r.randrange(1, 4))), r.random() < 0.5) for _ in range(60)]
    urls = URLS + [f"http://{'.'.join(r.choice('abc') for _ in range(r.randrange(1, 5)))}/{'/'.join(r.choice(['x', 'y', 'xyz', 'xy', '']) for _ in range(r.randrange(4)))}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS rule", "2 AS suffix")
    for rules in (RULES, many):
        want = sorted((i, *plain(u, rules)) for i, u in enumerate(urls))
        by_trie = url_filter.judge(df, rules)
        assert sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in by_trie.collect()) == want
        with monkeypatch.context() as m:
            m.setattr(url_filter, "BROADCAST_RULES", 1)
            assert sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(df, rules).collect()) == want
    assert url_filter.judge(df.limit(0), RULES).collect() == []
    upper = [Rule("EXAMPLE.Com", "de/", False)]
    for bound in (10, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", bound)
        assert {(x.rule, x.verdict) for x in url_filter.judge(df, upper).collect()} == {("example.com/de/", "block"), (None, "allow")}
        assert url_filter.judge(df.limit(0), upper).collect() == []
    monkeypatch.undo()
    table = spark.createDataFrame([("net", "", False)], "host string, path string, allow boolean")
    assert url_filter.judge(df, table, default="block").filter("verdict = 'allow'").count() == 0
