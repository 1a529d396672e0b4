"""Where pages, robots.txt and sitemaps come from: tables. Live HTTP: http_pages."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.render import render_html, with_base
from webloom.functions.text import fresh
from webloom.functions.urls import normalize_one, normalize_url, origin_of, safe_host
from webloom.operators.robots import allowed_by_join, parse_robots_table
from webloom.operators.sitemaps import with_origin
from webloom.session import ship
from webloom.sources.http_pages import HttpPages, register

__all__ = ["HttpPages", "PageStore", "gunzip_one", "register", "sitemap_content"]

FRAME = re.compile(r"""(<i?frame\b[^>]*?\bsrc\s*=\s*["']([^"'>]+)["'][^>]*>)(\s*</i?frame\s*>)?""", re.IGNORECASE)
_BODY = re.compile(r"<body[^>]*>(.*?)(?:</body\s*>|\Z)", re.IGNORECASE | re.DOTALL)


def gunzip_one(body: bytes | None, limit: int, piece: int = 1 << 16) -> str | None:
    """Text of a gzip body of one or more members, unpacked piece by piece; null if it is broken, cut off or longer than limit, which is never held."""
    out, size = [], 0
    rest = body
    try:
        while rest:
            member = zlib.decompressobj(31)
            while not member.eof:
                part = member.decompress(rest, piece)
                rest = member.unconsumed_tail
                size += len(part)
                if size > limit or not part and not rest and not member.eof:
                    return None
                out.append(part)
            rest = member.unused_data.lstrip(b"\0")
    except zlib.error:
        return None
    return b"".join(out).decode("utf-8", "replace") if body else None


def sitemap_content(url: Column, body: Column, max_bytes: int = 100 << 20) -> Column:
    """Text of a fetched sitemap: unpacked where the URL ends with .gz (null if that fails or gives more than max_bytes), else UTF-8."""

    @F.pandas_udf(T.StringType())
    def gunzip(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: gunzip_one(b, max_bytes), na_action="ignore")

    packed = url.endswith(".gz")
    return F.when(packed, gunzip(F.when(packed, body))).otherwise(F.decode(body, "UTF-8"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _frames_of(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else list(dict.fromkeys(u for m in FRAME.finditer(h) if (u := _absolute(b, m[2])))) for h, b in zip(pages, bases, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _with_bodies(pages: pd.Series, bases: pd.Series, bodies: pd.Series) -> pd.Series:
    def insert(html: str, base: str, found: list[tuple[str, str]]) -> str:
        known = dict(found)

        def after(m: re.Match) -> str:
            page = known.get(_absolute(base, m[2]))
            if page is None:
                return m[0]
            body = _BODY.search(page)
            return f"{m[0]}<div>{body[1] if body else page}</div>"

        return FRAME.sub(after, html)

    out = [h if h is None or f is None or not len(f) else insert(h, b, [(x["url"], x["html"]) for x in f]) for h, b, f in zip(pages, bases, bodies, strict=True)]
    return pd.Series(out, dtype=object)


def _absolute(base: str | None, src: str) -> str:
    try:
        return normalize_one(urljoin(base or "", src.strip())) or ""
    except ValueError:
        return ""


@dataclass
class PageStore:
    """Tables: pages (url, html, optional status_code), robots (host, content), sitemaps (url, content)."""

    pages: DataFrame
    robots: DataFrame | None = None
    sitemaps: DataFrame | None = None

    def __post_init__(self) -> None:
        ship(self.pages.sparkSession)
        self._repeats: bool | None = None
        status = F.col("status_code").cast("int") if "status_code" in self.pages.columns else F.lit(200)
        self.corpus = self.pages.select(normalize_url(F.col("url")).alias("url"), "html", status.alias("status_code")).filter("url <> ''")

    @classmethod
    def from_parquet(cls, spark: SparkSession, pages: str, robots: str | None = None, sitemaps: str | None = None) -> PageStore:
        read = lambda p: spark.read.parquet(p) if p else None
        return cls(spark.read.parquet(pages), read(robots), read(sitemaps))

    def fetch(self, urls: DataFrame, dump: str = "html", strip: list[str] | tuple[str, ...] = (), base: bool = False, obey_robots: bool = False, with_frames: bool = False) -> DataFrame:
        """urls (url, ...) with status_code and content in a dump format; nulls where the corpus has no such page. Filters and the two columns reach the scan.

        obey_robots: nulls too for URLs that their host's robots.txt disallows; hosts without one allow all. with_frames: each frame or iframe
        whose page the corpus has is followed by a div with that page's body, one level deep (of pages with one URL the least html).
        """
        found = self.head(urls)
        if obey_robots and self.robots is not None:
            no = fresh(found, "blocked")
            found = found.join(self.disallowed(urls).withColumn(no, F.lit(True)), "url", "left").withColumns({c: F.when(F.col(no).isNull(), F.col(c)) for c in ("status_code", "html")})
            found = found.select(*(f"`{c}`" for c in urls.columns if c not in ("status_code", "html")), "status_code", "html")
        if with_frames:
            found = self.framed(found)
        html = with_base(F.col("html"), F.col("url")) if base else F.col("html")
        return found.withColumn("content", render_html(html, F.col("url"), dump, strip)).drop("html")

    def disallowed(self, urls: DataFrame) -> DataFrame:
        """The distinct urls (url) that robots.txt of their host disallows."""
        asked = urls.select("url").distinct().withColumn("host", safe_host(F.col("url")))
        rules = parse_robots_table(self.robots.dropDuplicates(["host"]).join(asked.select("host").distinct(), "host", "left_semi"))
        return allowed_by_join(asked, rules, keys=["url"]).filter(~F.col("allowed")).select("url")

    def framed(self, rows: DataFrame) -> DataFrame:
        """rows (url, html, ...) whose html holds the bodies of its frames."""
        bodies, src = fresh(rows, "bodies"), fresh(rows, "src")
        has = F.lower("html").contains("frame")
        wanted = rows.filter(has).select("url", F.explode(_frames_of(F.col("html"), F.col("url"))).alias(src)).distinct()
        pages = self.corpus.select(F.col("url").alias(src), "html").join(wanted.select(src).distinct(), src, "left_semi").groupBy(src).agg(F.min("html").alias("html"))
        found = wanted.join(pages, src).groupBy("url").agg(F.collect_list(F.struct(F.col(src).alias("url"), "html")).alias(bodies))
        return rows.join(found, "url", "left").withColumn("html", F.coalesce(F.when(F.col(bodies).isNotNull(), _with_bodies(F.col("html"), F.col("url"), F.col(bodies))), F.col("html"))).select(*(f"`{c}`" for c in rows.columns))

    def head(self, urls: DataFrame) -> DataFrame:
        """urls with status_code and html, which replace columns of those names, as a plain read gives them; a row for each page of the URL, if the table has several."""
        rows, key = urls.drop("status_code", "html"), fresh(urls, "at")
        return rows.join(self.corpus.withColumnRenamed("url", key), F.col("url") == F.col(key), "left").drop(key)

    def head_once(self, urls: DataFrame) -> DataFrame:
        """head() of distinct urls (url, ...) with one row for each: of pages with one normalised URL the least html, then status_code. Whether the table has such
        pages is asked once, of its url column alone."""
        if self._repeats is None:
            self._repeats = not self.corpus.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        rows = self.head(urls)
        if not self._repeats:
            return rows
        rest = [c for c in rows.columns if c not in ("url", "status_code", "html")]
        one = rows.groupBy("url").agg(F.min(F.struct("html", "status_code")).alias("least"), *(F.first(c).alias(c) for c in rest))
        return one.select("url", *rest, "least.status_code", "least.html")

    def robots_txt(self, host: str) -> str | None:
        if self.robots is None:
            return None
        row = self.robots.filter(F.col("host") == host).select("content").first()
        return row and row[0]

    def robots_for(self, sites: DataFrame) -> DataFrame:
        """(site, host, robots_url, content) for a table of sites (site), hosts or URLs: where each one's robots.txt is read, at the origin, and what the store has for its host,
        null for none. Repeated sites count once, null ones not at all."""
        asked = with_origin(sites.select(F.col("site").alias("domain")).filter("domain IS NOT NULL").distinct())
        asked = asked.select(F.col("domain").alias("site"), "host", F.concat("origin", F.lit("/robots.txt")).alias("robots_url"))
        none = asked.withColumn("content", F.lit(None).cast("string"))
        return none if self.robots is None else asked.join(self.robots.groupBy("host").agg(F.min("content").alias("content")), "host", "left").select("site", "host", "robots_url", "content")

    def by_host(self) -> DataFrame:
        return self.corpus.withColumns({"host": safe_host(F.col("url")), "origin": origin_of(F.col("url"))})

    def write_by_host(self, path: str) -> None:
        """Corpus with a column host, clustered by it so that a host-scoped read prunes row groups."""
        self.by_host().repartitionByRange(F.col("host"), F.col("url")).sortWithinPartitions("host", "url").write.parquet(path)
