"""Live HTTP as a Python data source, for batch and streaming reads."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from webloom.operators.robots import parse_robots_one
from webloom.session import ship

# The source travels by value; what it calls comes with the shipped package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: URLs of one host that a task reads one after the other, where robots.txt must be read first.
TOGETHER = 50


@dataclass
class _Urls(InputPartition):
    urls: list[str]


def _host(url: str) -> str:
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


def may_fetch(target: str, rules: list[tuple[str, bool]]) -> bool:
    """Whether robots rules allow a path with its query: the longest pattern that fits decides, allow first among equals."""
    best = (-1, True)
    for pattern, allow in rules:
        anchored = pattern.endswith("$")
        parts = (pattern[:-1] if anchored else pattern).split("*")
        if re.match(r"[^\n\r]*".join(map(re.escape, parts)) + (r"\Z" if anchored else ""), target):
            best = max(best, (len(pattern.replace("*", "")), allow))
    return best[1]


class _Options:
    def __init__(self, options):
        get = lambda name, default: options.get(name.lower(), options.get(name, default))
        self.urls = get("urls", "").split()
        self.timeout = float(get("timeoutMs", "15000")) / 1000
        self.agent = " ".join(filter(None, (get("userAgent", "webloom/0.1"), get("userAgentSuffix", ""))))
        self.limit = int(get("maxBytes", str(100 << 20)))
        self.insecure = get("insecureTls", "false").lower() == "true"
        self.obey = get("obeyRobots", "false").lower() == "true"
        self.pushdown = get("pushdown", "false").lower() == "true"
        self.at_once = int(get("maxUrlsPerBatch", "100"))
        if self.at_once < 1:
            raise ValueError("maxUrlsPerBatch must be 1 or more")

    def split(self, urls: list[str]) -> list[InputPartition]:
        """A task for each URL; with obeyRobots one for up to TOGETHER URLs of a host, so that robots.txt is read once for them."""
        if not self.obey:
            return [_Urls([u]) for u in urls]
        hosts: dict[str, list[str]] = {}
        for u in urls:
            hosts.setdefault("/".join(u.split("/", 3)[:3]), []).append(u)
        return [_Urls(of[i : i + TOGETHER]) for of in hosts.values() for i in range(0, len(of), TOGETHER)]

    def _get(self, url: str) -> tuple[int, bytes]:
        import ssl
        import urllib.error
        import urllib.request

        context = ssl._create_unverified_context() if self.insecure else None
        request = urllib.request.Request(url, headers={"User-Agent": self.agent})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout, context=context) as r:
                return r.status, r.read(self.limit + 1)
        except urllib.error.HTTPError as e:  # an answer all the same
            return e.code, e.read(self.limit + 1)

    def rows(self, urls: list[str]) -> Iterator[tuple]:
        rules: dict[str, list[tuple[str, bool]]] = {}
        for url in urls:
            status = html = error = None
            try:
                origin = "/".join(url.split("/", 3)[:3])
                if self.obey and origin not in rules:
                    rules[origin] = self._rules(origin)
                parts = urlsplit(url)
                if self.obey and not may_fetch((parts.path or "/") + ("?" + parts.query if parts.query else ""), rules[origin]):
                    error = "Disallowed: robots.txt"
                else:
                    status, body = self._get(url)
                    if len(body) > self.limit:
                        error = f"TooLong: more than {self.limit} bytes"
                    else:
                        html = body.decode("utf-8", "replace")
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            yield url, status, html, error, _host(url)

    def _rules(self, origin: str) -> list[tuple[str, bool]]:
        """Rules of an origin's robots.txt; none where it can't be read."""
        try:
            status, body = self._get(origin + "/robots.txt")
        except Exception:
            return []
        return parse_robots_one(body.decode("utf-8", "replace")).rules if 200 <= status < 300 else []


class HttpPages(DataSource):
    """spark.read.format("webloom_http").option("urls", "u1 u2").load(): one row per URL.

    An error, a body of more than maxBytes or, with obeyRobots, a URL that robots.txt disallows gives a null html. With pushdown, which
    needs spark.sql.python.filterPushdown.enabled, equality, IN and prefix filters on url, and equality and IN on host, choose what is requested at all. As a stream a batch takes the next maxUrlsPerBatch URLs; its offset is their number.
    """

    @classmethod
    def name(cls) -> str:
        return "webloom_http"

    def schema(self) -> str:
        return "url string, status_code int, html string, error string, host string"

    def reader(self, schema) -> DataSourceReader:
        options = _Options(self.options)
        return _FilteredReader(options) if options.pushdown else _HttpReader(options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _HttpStream(_Options(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options, self.urls = options, options.urls

    def partitions(self) -> list[InputPartition]:
        return self.options.split(self.urls) or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        return self.options.rows(partition.urls)


class _FilteredReader(_HttpReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            of = {"url": lambda u: u, "host": _host}.get(column)
            if of and isinstance(f, EqualTo):
                self.urls = [u for u in self.urls if of(u) == f.value]
            elif of and isinstance(f, In):
                self.urls = [u for u in self.urls if of(u) in f.value]
            elif column == "url" and isinstance(f, StringStartsWith):
                self.urls = [u for u in self.urls if u.startswith(f.value)]
            else:
                yield f


class _HttpStream(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options, self.next = options, 0

    def initialOffset(self) -> dict:
        return {"urls": 0}

    def latestOffset(self) -> dict:
        self.next = min(len(self.options.urls), self.next + self.options.at_once)
        return {"urls": self.next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.next = max(self.next, end["urls"])
        return self.options.split(self.options.urls[start["urls"] : end["urls"]])

    def read(self, partition: _Urls) -> Iterator[tuple]:
        return self.options.rows(partition.urls)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(HttpPages)
