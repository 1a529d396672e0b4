"""Traversals as one recursive query: Catalyst runs the levels, the driver none.

The recursive part of a Spark query is UNION ALL, so it follows walks, not pages: rows grow with
the number of walks of at most max_depth steps. That is the form for shallow traversals and trees (sitemaps,
breadcrumbs, redirects); dense or deep graphs belong to bfs_levels, which drops what it has seen at each level.
A plan holds one UnionLoop over a LocalTableScan or a shuffle and a join for each step, and one aggregate
on top of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.sitemaps import parse_sitemap_table
from webloom.scratch import cut

#: Settings of a recursive query: levels, and rows in all (-1: any number).
LEVELS, ROWS = "spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"


@contextmanager
def _limits(spark: SparkSession, levels: int) -> Iterator[None]:
    """Bounds for queries that run inside; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in (LEVELS, ROWS)}
    spark.conf.set(LEVELS, levels)
    spark.conf.set(ROWS, -1)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def walk(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of what is reachable from seeds (url) over edges (src, dst) within max_depth steps, at its least depth: bfs_levels in one query.

    Null URLs and ends are left out; the result is cut, as the bounds of recursion hold while it runs.
    """
    spark = seeds.sparkSession
    with _limits(spark, max_depth + 2):
        return cut(
            spark.sql(
                """
                WITH RECURSIVE walks(url, depth) AS (
                  SELECT url, 0L FROM (SELECT DISTINCT url FROM {seeds} WHERE url IS NOT NULL)
                  UNION ALL
                  SELECT e.dst, w.depth + 1 FROM walks w JOIN {edges} e ON e.src = w.url WHERE w.depth < {most} AND e.dst IS NOT NULL)
                SELECT url, min(depth) AS depth FROM walks GROUP BY url
                """,
                seeds=seeds,
                edges=edges.select("src", "dst").distinct(),
                most=max_depth,
            )
        )


def sitemap_tree(seeds: DataFrame, store: DataFrame, max_depth: int = 3) -> DataFrame:
    """(host, url, depth, type, url_count): sitemap_levels in one query. Seeds (host, url); store (url, content). Cycles end at max_depth."""
    parsed = cut(parse_sitemap_table(store.filter("content <> ''")).drop("entries").dropDuplicates(["url"]))
    children = parsed.select(F.col("url").alias("src"), F.explode("child_sitemaps").alias("dst")).distinct()
    spark = seeds.sparkSession
    with _limits(spark, max_depth + 2):
        return cut(
            spark.sql(
                """
                WITH RECURSIVE tree(host, url, depth) AS (
                  SELECT host, url, 0L FROM (SELECT DISTINCT host, url FROM {seeds})
                  UNION ALL
                  SELECT t.host, c.dst, t.depth + 1 FROM tree t JOIN {children} c ON c.src = t.url WHERE t.depth < {most})
                SELECT t.host, t.url, t.depth, p.type, p.url_count
                FROM (SELECT host, url, min(depth) AS depth FROM tree GROUP BY host, url) t JOIN {parsed} p ON p.url = t.url
                """,
                seeds=seeds,
                children=children,
                parsed=parsed,
                most=max_depth,
            )
        )
