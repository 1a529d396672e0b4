"""Links and images of markdown: one scan of a text, as columns and as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import fresh
from webloom.functions.urls import normalize_one
from webloom.session import ship

#: Targets that are no pages, and paired marks in the order in which they are taken off.
NO_PAGE = r"^(?:javascript|mailto|tel|data):"
MARKS = (r"\*\*", "__", r"\*", "_", "`")
#: Links before and after these shares of the text are navigational.
EDGE = 0.15


_SPACE = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_NO_PAGE = re.compile(NO_PAGE)
_MARKS = [re.compile(f"{mark}([^\n\r\x85\u2028\u2029]*?){mark}") for mark in MARKS]
_HOST = re.compile(r"https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)")


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


def inline(text: str, opening: str = "[") -> Iterator[tuple[int, int, str, str]]:
    """(start, end, anchor, target) of each [anchor](target), leftmost first; opening "![" for images.

    Goes from one "](" to the next and looks back to the first opening after the last "]", so
    every character is passed a few times at most, whatever brackets stand alone.
    """
    at, j = 0, text.find("](")
    while j >= 0:
        start = text.find(opening, max(at, text.rfind("]", at, j) + 1), j)
        if start >= 0:
            end = text.find(")", j + 2)
            if end < 0:
                return
            if end > j + 2:
                yield start, end + 1, text[start + len(opening) : j], text[j + 2 : end]
                at = end + 1
        j = text.find("](", max(at, j + 1))


def read_links(markdown: str, base: str | None) -> tuple[list[dict], list[dict]]:
    """(links, images) of one text in page order, the first of each normalised URL, or of each raw image URL. pos: number of the link among all link syntax."""
    links: dict[str, dict] = {}
    images: dict[str, dict] = {}
    host = lambda u: m[1] if u and (m := _HOST.match(u)) else ""
    own, total, at, seen = host(normalize_one(base)), _units(markdown), 0, 0
    for pos, (start, _, text, raw) in enumerate(inline(markdown)):
        at += _units(markdown[seen:start])
        offset, seen = at, start
        target = raw.strip(_SPACE)
        if start and markdown[start - 1] == "!":
            continue
        anchor = text.strip(_SPACE)
        for mark in _MARKS:
            anchor = mark.sub(r"\1", anchor)
        anchor = anchor.strip(_SPACE)
        if not target or not anchor or _NO_PAGE.match(target) or not (url := normalize_one(target)) or url in links:
            continue
        name = host(url)
        internal = name != "" and (name == own or name.endswith("." + own))
        edge = total and (offset / total < EDGE or offset / total > 1 - EDGE)
        links[url] = {"pos": pos, "url": url, "anchor_text": anchor, "type": "internal" if internal else "external", "location": "navigational" if edge else "content"}
    for _, _, alt, raw in inline(markdown, "!["):  # a scan of its own: a link may begin before an image and reach into it
        if target := raw.strip(_SPACE):
            images.setdefault(target, {"url": target, "alt": alt.strip(_SPACE)})
    return list(links.values()), list(images.values())


_STRINGS = lambda *names: [T.StructField(n, T.StringType()) for n in names]
LINKS = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), *_STRINGS("url", "anchor_text", "type", "location")]))
IMAGES = T.ArrayType(T.StructType(_STRINGS("url", "alt")))


@F.pandas_udf(T.StructType([T.StructField("links", LINKS), T.StructField("images", IMAGES)]))
def _read(texts: pd.Series, bases: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else read_links(t, b) for t, b in zip(texts, bases, strict=True)]
    return pd.DataFrame(rows, columns=["links", "images"], dtype=object)


def _found(markdown: Column, url: Column) -> Column:
    """Struct of links and images, null for texts without link syntax, which stay in the JVM."""
    return _read(F.when(F.contains(markdown, F.lit("](")), markdown), url)


def extract_images(markdown: Column) -> Column:
    """array<struct<url, alt>> of ![alt](url): blank urls dropped, first of each raw url kept."""
    return F.coalesce(_found(markdown, F.lit(None).cast("string"))["images"], F.array().cast(IMAGES))


def with_links(pages: DataFrame, markdown: str = "markdown", url: str = "url", key: str | None = None) -> DataFrame:
    """pages with links (array of structs in page order) and images, which replace columns of those names.

    In the row, without join or shuffle, by one Arrow UDF whose time grows with the text. key is taken for older callers; rows need none.
    """
    ship(pages.sparkSession)
    made = fresh(pages, "read")
    rows = pages.withColumn(made, _found(F.col(f"`{markdown}`"), F.col(f"`{url}`")))
    links = F.transform(F.coalesce(f"`{made}`.links", F.array().cast(LINKS)), lambda x: F.struct(*(x[c].alias(c) for c in ("url", "anchor_text", "type", "location"))))
    return rows.withColumns({"links": links, "images": F.coalesce(f"`{made}`.images", F.array().cast(IMAGES))}).drop(made)


def links_table(pages: DataFrame, markdown: str = "markdown", url: str = "url", keys: list[str] | None = None) -> DataFrame:
    """One row per kept link: keys (default: the url column; url is named page_url), pos (number among the page's link syntax), url, anchor_text, type, location. First occurrence of each normalised URL, without a shuffle."""
    ship(pages.sparkSession)
    keys = keys or [url]
    rows = pages.select(*(F.col(f"`{k}`").alias("page_url" if k == "url" else k) for k in keys), F.explode(_found(F.col(f"`{markdown}`"), F.col(f"`{url}`"))["links"]).alias(made := fresh(pages, "link")))
    return rows.select("*", f"{made}.*").drop(made)


def link_counts(links: Column) -> Column:
    """Struct of total, internal, external, content and navigational links of an array."""
    n = lambda f, v: F.size(F.filter(links, lambda x: x[f] == v)).cast("long").alias(v)
    return F.struct(F.size(links).cast("long").alias("total"), n("type", "internal"), n("type", "external"), n("location", "content"), n("location", "navigational"))


def edges(links: DataFrame, src: str = "page_url") -> DataFrame:
    return links.select(F.col(src).alias("src"), F.col("url").alias("dst"), "pos", "type", "location")


def inlink_counts(edge_table: DataFrame) -> DataFrame:
    return edge_table.groupBy("dst").agg(F.count(F.lit(1)).alias("inlinks"), F.count_distinct("src").alias("sources"))
