import random

import pytest

from webloom.plans import versions
from webloom.plans.crawl import bfs_levels
from webloom.plans.versions import VersionedCrawl


def rows(df):
    return sorted(map(tuple, df.select("url", "depth").collect()))


@pytest.fixture
def graph(spark):
    r = random.Random(5)
    edges = [(f"u{i}", f"u{min(i + r.randrange(1, 5), 23)}") for i in range(24) for _ in range(2)] + [("u3", "hot")] + [(f"u{i}", "hot") for i in range(24)] + [(None, "u1"), ("u1", None)]
    return spark.createDataFrame([("u0",), ("u15",), ("u0",), (None,)], "url string"), spark.createDataFrame(edges, "src string, dst string")


def want(graph, depth):
    seeds, edges = graph
    return rows(bfs_levels(seeds.filter("url IS NOT NULL"), edges.filter("dst IS NOT NULL"), depth))


def test_killed_between_levels_and_in_a_write(spark, graph, tmp_path):
    path = f"file://{tmp_path}/state"
    state = VersionedCrawl(spark, path, buckets=4)
    state.start(*graph)
    assert state.resume(levels=2) is False
    state._append(state.candidates(2).selectExpr("url", "3L AS depth"), "visited", "url")  # a level written, killed before its commit
    state._append(spark.createDataFrame([("never", 3)], "url string, depth long"), "visited", "url")  # part of another
    state.forget()  # as in a new application with a catalog of its own
    again = VersionedCrawl(spark, path, buckets=7)
    assert again.buckets == 4 and rows(again.visited()) == want(graph, 2)
    again.start(*graph)  # changes nothing
    assert again.resume(max_depth=3) and rows(again.visited()) == want(graph, 3)
    assert again.resume() and rows(again.visited()) == want(graph, 100)
    assert rows(again.visited(version=3)) == want(graph, 2)
    assert again.resume() and [r.version for r in again.history()] == list(range(-1, len(again.history()) - 1))


def test_killed_between_edges_and_seeds(spark, graph, tmp_path):
    path = f"file://{tmp_path}/state"
    state = VersionedCrawl(spark, path, buckets=3)
    state._commit(0, state._append(graph[1].filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges", "src"), -1, 0, "edges")
    with pytest.raises(ValueError, match="no crawl"):
        state.resume()
    state.start(*graph)
    assert state.resume(3) and rows(state.visited()) == want(graph, 3)


def test_compaction_keeps_rows_and_versions(spark, graph, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "COMPACT_AFTER", 2)
    state = VersionedCrawl(spark, f"file://{tmp_path}/state", buckets=2)
    state.start(*graph)
    assert state.resume(max_depth=5) and rows(state.visited()) == want(graph, 5)
    kinds = [r.kind for r in state.history()]
    assert kinds.count("compaction") == 2
    for r in state.history():
        if r.kind == "level" and r.depth in (1, 4):
            assert rows(state.visited(r.version)) == want(graph, r.depth)


def test_level_moves_neither_edges_nor_visited(spark, graph, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        state = VersionedCrawl(spark, f"file://{tmp_path}/state")
        state.start(*graph)
        plan = state.candidates(0)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange ") == 1 and "hashpartitioning(url" in plan.split("Exchange ")[1]
    assert plan.index("HashAggregate") < plan.index("Exchange ") < plan.rindex("HashAggregate")  # repeats are dropped on both sides


def test_empty_seeds_and_two_writers(spark, graph, tmp_path):
    state = VersionedCrawl(spark, f"file://{tmp_path}/state", buckets=2)
    state.start(graph[0].limit(0), graph[1])
    assert state.resume() and rows(state.visited()) == []
    state._commit(1, "other", 0, 0, "level")
    with pytest.raises(ValueError, match="two writers"):
        state.resume()
