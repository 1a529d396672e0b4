import random

import pytest

from webloom.plans.blocks import bfs_whole
from webloom.plans.queries import QUERIES, graph


def plain(seeds, links):
    """Depths by a queue of whole levels."""
    want, depth = dict.fromkeys(seeds, 0), 0
    ahead = {}
    for src, dst in links:
        ahead.setdefault(src, []).append(dst)
    level = list(want)
    while level:
        depth, level = depth + 1, list(dict.fromkeys(d for u in level for d in ahead.get(u, ()) if d not in want))
        want |= dict.fromkeys(level, depth)
    return want


@pytest.mark.parametrize("seed,near,block", [(1, True, 3), (2, False, 3), (3, True, 1), (4, False, None), (5, True, 7)])
def test_any_graph_in_any_blocks(spark, seed, near, block):
    r = random.Random(seed)
    name = lambda i: f"https://h{i % 3}.com/{i:03d}"
    links = [(name(i), name(i + r.randrange(1, 4))) for i in range(30)] + [(name(r.randrange(60)), name(r.randrange(60))) for _ in range(30)]
    links += [(name(5), name(100 + i)) for i in range(10)] + links[:5]  # more edges than a block, pages without links, repeats
    rows = [(s, d, r.randrange(40) if seed == 3 else int(s[-3:])) for s, d in links] + [(None, name(1), 1), (name(0), None, 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, page long")
    seeds = spark.createDataFrame([(name(0),), (name(41),), (name(0),), ("alone",), (None,)], "url string")
    got = [tuple(x) for x in bfs_whole(seeds, edges, "page" if near else None, block).collect()]
    assert sorted(got) == sorted(plain([name(0), name(41), "alone"], links).items())
    assert [tuple(x) for x in bfs_whole(seeds.limit(0), edges, block=block).collect()] == []
    assert sorted(tuple(x) for x in bfs_whole(seeds, edges.limit(0), block=block).collect()) == [("alone", 0), (name(0), 0), (name(41), 0)]


def test_a_long_host_takes_few_rounds(spark, tmp_path):
    n = 600
    spark.createDataFrame([(i, f"https://long.com/p/{i * 7919 % n}", "") for i in range(n)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    seeds, edges = graph(spark, str(tmp_path))
    want = plain([x.url for x in seeds.collect()], [tuple(x) for x in edges.collect()])
    sc = spark.sparkContext
    sc.setJobGroup("long host", "")
    try:
        got = {x.url: x.depth for x in QUERIES["crawl_bfs_whole"](spark, str(tmp_path)).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("long host"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and max(want.values()) > 200
    assert jobs < 60  # a round a level takes some jobs for each of more than 200 levels
