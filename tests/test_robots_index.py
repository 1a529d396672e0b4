import random
import time

from pyspark.sql import functions as F

from webloom.operators.robots import allowed_by_join, is_url_allowed


def verdicts(spark, pages, rules):
    """By all rules of each host, one after the other."""
    arrays = rules.groupBy("host").agg(F.collect_list(F.struct("pattern", "allow")).alias("rules"))
    return sorted(map(tuple, pages.join(arrays, "host", "left").select("id", is_url_allowed(F.col("url"), F.col("rules")).alias("a")).collect()))


def test_index_equals_all_rules(spark):
    r = random.Random(6)
    part = lambda n: "".join(r.choice(["/", "a", "b", "c", ".", "?", "x=1", "$", "(", "+", "é"]) for _ in range(r.randrange(n)))
    hosts = ["h.com", "i.com", "j.com"]
    rules = [(r.choice(hosts), r.choice(["/", "", "*"]) + part(4) + r.choice(["", "*", "*" + part(3), "$", "*$"]), r.random() < 0.4) for _ in range(150)] + [("h.com", "/", True), ("h.com", "/", False), (None, "/", False)]
    pages = [(i, r.choice([*hosts, "none.com", None]), f"https://x/{part(9)}") for i in range(400)]
    rules, pages = spark.createDataFrame(rules, "host string, pattern string, allow boolean"), spark.createDataFrame(pages, "id int, host string, url string")
    got = sorted(map(tuple, allowed_by_join(pages, rules, keys=["id"]).collect()))
    assert got == verdicts(spark, pages, rules) and {a for _, a in got} == {True, False}


def test_names_of_the_pages_do_not_clash(spark):
    pages = spark.createDataFrame([(1, "h", "https://h/a", 5)], "allow int, host string, url string, _h int").selectExpr("*", "2 AS _re", "3 AS pattern", "4 AS prefix", "6 AS `a.b`")
    rules = spark.createDataFrame([("h", "/a", False)], "host string, pattern string, allow boolean")
    assert [tuple(r) for r in allowed_by_join(pages, rules, keys=["allow", "_h", "a.b", "prefix"]).collect()] == [(1, 5, 6, 4, False)]


def test_a_host_of_ten_thousand_rules(spark):
    rules = spark.createDataFrame([("h.com", f"/d{i}/{'*' * (i % 3 == 0)}p{i % 7}", i % 5 == 0) for i in range(10_000)], "host string, pattern string, allow boolean")
    pages = spark.range(30_000).select(F.col("id"), F.lit("h.com").alias("host"), F.concat(F.lit("https://h.com/d"), F.col("id") % 12_000, F.lit("/p"), F.col("id") % 7).alias("url")).repartition(8)
    began = time.perf_counter()
    got = dict(map(tuple, allowed_by_join(pages, rules, keys=["id"]).collect()))
    assert time.perf_counter() - began < 60  # all pairs would be 300 million patterns
    for i in random.Random(1).sample(range(30_000), 400):
        d = i % 12_000
        assert got[i] == (d >= 10_000 or d % 7 != i % 7 or d % 5 == 0), i
