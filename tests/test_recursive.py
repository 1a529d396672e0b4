import random

from webloom.operators.sitemaps import sitemap_levels
from webloom.plans.crawl import bfs_levels
from webloom.plans.recursive import LEVELS, ROWS, sitemap_tree, walk


def test_walk_equals_levels(spark):
    r = random.Random(2)
    edges = spark.createDataFrame([(f"u{r.randrange(30)}", f"u{r.randrange(30)}") for _ in range(60)] + [(None, "u1"), ("u1", None), ("u2", "u2")], "src string, dst string")
    seeds = spark.createDataFrame([("u0",), ("u7",), ("u0",), ("lone",), (None,)], "url string")
    before = [spark.conf.get(k, None) for k in (LEVELS, ROWS)]
    for depth in (0, 1, 4):
        want = bfs_levels(seeds.filter("url IS NOT NULL"), edges.filter("dst IS NOT NULL"), depth)
        assert sorted(map(tuple, walk(seeds, edges, depth).collect())) == sorted(map(tuple, want.collect()))
    assert [spark.conf.get(k, None) for k in (LEVELS, ROWS)] == before
    assert walk(seeds.limit(0), edges, 3).collect() == []


def test_more_levels_than_the_default(spark):
    """A chain of 130 steps, more levels than a recursive query has by default."""
    chain = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(130)], "src string, dst string")
    got = walk(spark.createDataFrame([("0",)], "url string"), chain, 130).collect()
    assert sorted(r.depth for r in got) == list(range(131))


def test_tree_equals_levels(spark):
    index = lambda *kids: "<sitemapindex>" + "".join(f"<sitemap><loc>{k}</loc></sitemap>" for k in kids) + "</sitemapindex>"
    store = spark.createDataFrame([("a", index("b", "c", "gone")), ("b", index("a", "d")), ("c", "<urlset><url><loc>x</loc></url></urlset>"), ("d", index("c", "e")), ("e", ""), ("z", "<urlset/>")], "url string, content string")
    seeds = spark.createDataFrame([("h", "a"), ("h", "a"), ("i", "d"), ("i", "none")], "host string, url string")
    for depth in (0, 1, 3):
        assert sorted(map(tuple, sitemap_tree(seeds, store, depth).collect())) == sorted(map(tuple, sitemap_levels(seeds, store, depth).collect()))
