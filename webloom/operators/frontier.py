"""Crawl state: the cursor and its codec, the frontier, and its table forms."""

from __future__ import annotations

import base64
import json
import zlib
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import url_hash_one
from webloom.operators.robots import Robots

#: Frontier capacity, JSON size from which a cursor is compressed, and the mark of compressed ones.
MAX_FRONTIER, COMPRESS_FROM, COMPRESSED = 200, 100_000, "z:"
#: Entries that a frontier without a capacity may hold on the driver; more are an error, never dropped.
DRIVER_FRONTIER = 100_000


@dataclass(frozen=True)
class CrawlConfig:
    """Options of a crawl. JSON names are camel case."""

    url: str
    source: str = "all"  # all, sitemaps or links
    strategy: str = "bfs"  # bfs or dfs
    max_depth: int = 10
    max_pages: int = 100
    concurrency: int = 3
    time_budget: int = 55_000  # ms
    render: bool = True
    obey_robots: bool = True
    extract_metadata: bool = False
    include_subdomains: bool = False
    include_external_links: bool = False
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    page_timeout: int = 15_000  # ms
    strip: tuple[str, ...] = ("css",)
    frontier_capacity: int | None = MAX_FRONTIER  # None: nothing found is dropped; crawl_batch holds up to DRIVER_FRONTIER

    def __post_init__(self) -> None:
        if not self.url:
            raise ValueError("url is required")
        if self.source not in ("all", "sitemaps", "links") or self.strategy not in ("bfs", "dfs"):
            raise ValueError(f"unknown source or strategy: {self.source}, {self.strategy}")
        if self.concurrency < 1:
            raise ValueError("concurrency must be 1 or more")
        if self.frontier_capacity is not None and self.frontier_capacity < 1:
            raise ValueError("frontier_capacity must be 1 or more, or None")

    @classmethod
    def of(cls, url: str, **options: Any) -> CrawlConfig:
        """Defaults overlaid by the options that are not None."""
        return cls(url, **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items() if v is not None})

    def to_json(self) -> dict[str, Any]:
        return {_camel(f.name): list(v) if isinstance(v := getattr(self, f.name), tuple) else v for f in fields(self)}

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> CrawlConfig:
        known = {_camel(f.name): f.name for f in fields(cls)}
        given = {known[k]: v for k, v in data.items() if k in known}
        out = cls.of(**given)
        return replace(out, frontier_capacity=None) if given.get("frontier_capacity", 0) is None else out


def page_preset(url: str, obey_robots: bool = False, **options: Any) -> CrawlConfig:
    """A crawl of one page for its report."""
    return replace(CrawlConfig.of(url, **options), max_pages=1, source="links", extract_metadata=True, obey_robots=obey_robots, page_timeout=25_000)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(map(str.title, rest))


@dataclass
class Cursor:
    config: CrawlConfig
    seed_domain: str
    frontier: list[tuple[str, int]] = field(default_factory=list)  # (url, depth), in order
    visited: dict[int, None] = field(default_factory=dict)  # hashes, in order
    robots: dict[str, Robots] = field(default_factory=dict)
    total: int = 0
    last_fetch: int | None = None

    @property
    def capacity(self) -> int | None:
        return self.config.frontier_capacity

    def is_visited(self, url: str) -> bool:
        return url_hash_one(url) in self.visited

    def add_visited(self, url: str) -> None:
        self.visited.setdefault(url_hash_one(url))

    def add(self, entries: list[tuple[str, int]]) -> None:
        """Append what fits; the rest is dropped silently. Without a capacity all is kept, up to DRIVER_FRONTIER."""
        if self.capacity is None and len(self.frontier) + len(entries) > DRIVER_FRONTIER:
            raise ValueError(f"a frontier of more than {DRIVER_FRONTIER} URLs doesn't belong on the driver: crawl_many keeps it on the executors")
        room = len(entries) if self.capacity is None else max(0, self.capacity - len(self.frontier))
        self.frontier += entries[:room]

    def take(self, n: int, strategy: str) -> list[tuple[str, int]]:
        """The first n (bfs) or the last n, last first (dfs)."""
        n = max(0, min(n, len(self.frontier)))
        if strategy == "bfs":
            out, self.frontier = self.frontier[:n], self.frontier[n:]
        else:
            cut = len(self.frontier) - n
            out, self.frontier = self.frontier[cut:][::-1], self.frontier[:cut]
        return out


def encode_cursor(state: Cursor) -> str:
    """Base64 of the state's JSON; compressed, with a prefix, where the JSON is long."""
    data = {
        "visitedHashes": list(state.visited),
        "frontier": [{"url": u, "depth": d} for u, d in state.frontier],
        "config": state.config.to_json(),
        "robotsCache": {h: {"rules": [{"pattern": p, "allow": a} for p, a in r.rules], "crawlDelay": r.crawl_delay, "sitemaps": r.sitemaps} for h, r in state.robots.items()},
        "totalPagesCrawled": state.total,
        "lastFetchTime": state.last_fetch,
        "seedDomain": state.seed_domain,
    }
    text = json.dumps(data, ensure_ascii=False, separators=(",", ":"))
    raw = text.encode("utf-8", "surrogatepass")
    if len(text) > COMPRESS_FROM:
        return COMPRESSED + base64.b64encode(zlib.compress(raw)).decode()
    return base64.b64encode(raw).decode()


def decode_cursor(text: str) -> Cursor:
    """State of an encoded cursor; ValueError where it is malformed."""
    try:
        packed = text.startswith(COMPRESSED)
        raw = base64.b64decode(text.removeprefix(COMPRESSED), validate=True)
        data = json.loads(zlib.decompress(raw) if packed else raw)
        robots = {h: Robots([(x["pattern"], x["allow"]) for x in r["rules"]], r.get("crawlDelay"), r.get("sitemaps", [])) for h, r in data["robotsCache"].items()}
        return Cursor(CrawlConfig.from_json(data["config"]), data["seedDomain"], [(e["url"], e["depth"]) for e in data["frontier"]], dict.fromkeys(data["visitedHashes"]), robots, data["totalPagesCrawled"], data.get("lastFetchTime"))
    except (ValueError, KeyError, TypeError, AttributeError, zlib.error) as e:
        raise ValueError(f"not a cursor: {e}") from e


def short_cursor(state: Column) -> Column:
    """Uncompressed form of a state struct, natively."""
    return F.regexp_replace(F.base64(F.encode(F.to_json(state), "UTF-8")), "[\\r\\n]", "")


def take(frontier: DataFrame, n: int, strategy: str = "bfs") -> DataFrame:
    """The n entries that a crawl takes next from (seq, url, depth): smallest seq first, or largest."""
    return frontier.orderBy(F.col("seq").asc() if strategy == "bfs" else F.col("seq").desc()).limit(n)


def append(frontier: DataFrame, new: DataFrame, capacity: int | None = MAX_FRONTIER) -> DataFrame:
    """frontier and new (both seq, url, depth; new's seq larger) up to a capacity; no deduplication."""
    both = frontier.unionByName(new)
    return both if capacity is None else both.orderBy("seq").limit(capacity)


def unvisited(candidates: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    return candidates.join(visited.select(url).distinct(), url, "left_anti")
