"""Table functions for SQL: links, images, robots rules, fetch times."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from webloom.operators.links import IMAGES, LINKS, read_links
from webloom.operators.robots import parse_robots_one
from webloom.session import ship

# Handlers travel by value; what they call comes with the shipped package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Links:
    """links(markdown, url): pos, url, anchor_text, type, location of each link that links_table gives."""

    def eval(self, markdown: str, url: str) -> Iterator[tuple]:
        for x in read_links(markdown, url)[0] if markdown else ():
            yield x["pos"], x["url"], x["anchor_text"], x["type"], x["location"]


class Images:
    """images(markdown): url, alt."""

    def eval(self, markdown: str) -> Iterator[tuple]:
        for x in read_links(markdown, None)[1] if markdown else ():
            yield x["url"], x["alt"]


class RobotsRules:
    """robots_rules(content, agent): pos, pattern, allow, crawl_delay (ms) of the group for an agent; agent "*" if left out."""

    def eval(self, content: str, agent: str = "*") -> Iterator[tuple]:
        found = parse_robots_one(content, agent)
        for pos, (pattern, allow) in enumerate(found.rules):
            yield pos, pattern, allow, found.crawl_delay


class FetchTimes:
    """fetch_times(TABLE(requests), default_delay_ms): the rows with fetch_at (ms), for a table with host, url, requested_at (ms) and, if it likes, delay_ms.

    The function itself asks for one partition a host, ordered by requested_at, then url, and holds the time at which the host is free.
    """

    def __init__(self) -> None:
        self.free = None

    @staticmethod
    def analyze(requests: AnalyzeArgument, default_delay_ms: AnalyzeArgument) -> AnalyzeResult:
        if not requests.isTable:
            raise ValueError("the first argument must be a table: TABLE(requests)")
        names = [f.name for f in requests.dataType.fields]
        if missing := {"host", "url", "requested_at"} - set(names):
            raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
        schema = T.StructType([*requests.dataType.fields, T.StructField("fetch_at", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("host")], orderBy=[OrderingColumn("requested_at"), OrderingColumn("url")])

    def eval(self, row: Row, default_delay_ms: int) -> Iterator[tuple]:
        at = row["requested_at"]
        if at is not None:
            at = at if self.free is None else max(at, self.free)
            delay = row["delay_ms"] if "delay_ms" in row.__fields__ else None
            self.free = at + (default_delay_ms if delay is None else delay)
        yield *row, at


def register_tables(spark: SparkSession) -> None:
    """links, images, robots_rules and fetch_times for FROM clauses, LATERAL included."""
    ship(spark)
    spark.udtf.register("links", udtf(Links, returnType=LINKS.elementType))
    spark.udtf.register("images", udtf(Images, returnType=IMAGES.elementType))
    spark.udtf.register("robots_rules", udtf(RobotsRules, returnType="pos bigint, pattern string, allow boolean, crawl_delay double"))
    spark.udtf.register("fetch_times", udtf(FetchTimes))
