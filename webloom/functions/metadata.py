"""Page metadata from HTML: title, meta tags, Open Graph, Twitter cards, canonical link, language, JSON-LD."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import ENTITIES, decode_entities, fresh, match_or_null, trim_ws

#: The patterns of quoted values, of JSON-LD scripts and of meta tags with a content.
QUOTED = r"""["']([^"']*)["']"""
FILLED = r"""["']([^"']+)["']"""
OG_FIELDS = ("title", "description", "image", "url", "type", "site_name")
TWITTER_FIELDS = ("card", "title", "description", "image", "site")
META = r"""(?i)<meta[^>]*content\s*=\s*["'][^"']*["'][^>]*>"""
JSON_LD = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def head_of(html: Column) -> Column:
    """Body of the first head element; the whole html where there is none."""
    return F.coalesce(match_or_null(html, r"(?is)<head[^>]*>(.*?)</head>"), html)


def _attribute(tag: str, key: str, value: str, want: str, content: str) -> tuple[str, str]:
    """Patterns for a closed tag with key="value" before and after the wanted attribute."""
    test, take = rf"""{key}\s*=\s*["']{value}["']""", rf"{want}\s*=\s*{content}"
    return rf"(?i)<{tag}[^>]*{test}[^>]*{take}[^>]*>", rf"(?i)<{tag}[^>]*{take}[^>]*{test}[^>]*>"


def meta_tags(head: Column) -> Column:
    """The head's meta tags that have a content, in order, each with its lower-case form: the short list that meta_in() looks through."""
    return F.transform(F.regexp_extract_all(head, F.lit(META), F.lit(0)), lambda t: F.struct(t.alias("tag"), F.lower(t).alias("low")))


def meta_in(tags: Column, key: str, value: str) -> Column:
    """content of the first tag of meta_tags() with key (name or property) = value: the order key, content anywhere wins over the other. "" is a hit."""
    near = F.filter(tags, lambda t: F.contains(t["low"], F.lit(value)))

    def first(pattern: str) -> Column:
        hits = F.filter(near, lambda t: F.rlike(t["tag"], F.lit(pattern)))
        return F.regexp_extract(F.get(hits, F.lit(0))["tag"], pattern, 1)

    return decode_entities(F.when(F.size(near) > 0, F.coalesce(*(first(p) for p in _attribute("meta", key, value.replace(".", r"\."), "content", QUOTED)))))


#: Every (key, value) that the metadata of a page asks for, by the name of its field.
_ASKED = {f"{k[0]}:{v}": (k, v) for k, v in [("name", "description"), ("name", "author"), ("name", "robots"), *(("property", f"og:{n}") for n in OG_FIELDS), *((k, f"twitter:{n}") for n in TWITTER_FIELDS for k in ("name", "property"))]}
_LOOK = T.StructType([T.StructField(n, T.StringType()) for n in _ASKED])


_FIND = {n: (v, [re.compile(p, re.ASCII) for p in _attribute("meta", k, re.escape(v), "content", QUOTED)]) for n, (k, v) in _ASKED.items()}

def look_up(tags: list[str]) -> list[str | None]:
    """What meta_in() gives for each field of _ASKED. Patterns run on tags that hold the field's name only."""
    low, out = [t.lower() for t in tags], []
    for value, patterns in _FIND.values():
        near = [t for t, x in zip(tags, low, strict=True) if value in x]
        found = next((m[1] for p in patterns for t in near if (m := p.search(t))), None)
        if found and "&" in found:
            for entity, char in ENTITIES:
                found = found.replace(entity, char)
        out.append(found)
    return out


@F.pandas_udf(_LOOK)
def _look_up(pages: pd.Series) -> pd.DataFrame:
    none = [None] * len(_ASKED)
    return pd.DataFrame([none if tags is None else look_up(list(tags)) for tags in pages], columns=list(_ASKED), dtype=object)


def with_look(pages: DataFrame, head: str, name: str) -> DataFrame:
    """pages with a struct of the contents that _ASKED names, by column head: the short list of its meta tags goes once through an Arrow UDF.

    As expressions each of the 19 look-ups passes over the list four times, and Spark merges them into their readers, so
    that they run several times a page; pages without meta tags stay in the JVM.
    """
    tags = F.regexp_extract_all(head, F.lit(META), F.lit(0))
    return pages.withColumn(name, _look_up(F.when(F.size(tags) > 0, tags)))


def meta_content(head: Column, key: str, value: str) -> Column:
    """meta_in() straight from a head."""
    return meta_in(meta_tags(head), key, value)


def title_of(head: Column) -> Column:
    return decode_entities(trim_ws(match_or_null(head, r"(?is)<title[^>]*>(.*?)</title>")))


def canonical_of(head: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in _attribute("link", "rel", "canonical", "href", FILLED)))


def language_of(html: Column) -> Column:
    """The last lang-suffixed attribute of the html tag."""
    return F.nullif(F.regexp_extract(html, rf"(?i)<html[^>]*lang\s*=\s*{FILLED}", 1), F.lit(""))


def _any_filled(fields: dict[str, Column], names: tuple[str, ...]) -> Column:
    return F.coalesce(F.greatest(*(F.coalesce(F.length(fields[n]), F.lit(0)) for n in names)), F.lit(0)) > 0


def _open_graph(look: Column) -> Column:
    f = {n: look[f"p:og:{n}"] for n in OG_FIELDS}
    return F.when(_any_filled(f, ("title", "description", "image", "url")), F.struct(*(c.alias(n) for n, c in f.items())))


def _twitter(look: Column) -> Column:
    f = {n: F.coalesce(look[f"n:twitter:{n}"], look[f"p:twitter:{n}"]) for n in TWITTER_FIELDS}
    return F.when(_any_filled(f, ("card", "title", "description", "image")), F.struct(*(c.alias(n) for n, c in f.items())))


def _plain_look(head: Column, kind: str) -> Column:
    tags = meta_tags(head)
    return F.struct(*(meta_in(tags, *a).alias(n) for n, a in _ASKED.items() if kind in n))


def open_graph_of(head: Column) -> Column:
    """Struct of the og: properties; null unless title, description, image or url is filled. As one expression; with_metadata() plans it in steps."""
    return _open_graph(_plain_look(head, ":og:"))


def twitter_of(head: Column) -> Column:
    """Struct of the twitter: fields, by name, else by property; null unless card, title, description or image is filled. As one expression."""
    return _twitter(_plain_look(head, ":twitter:"))


def canonical_json(text: str) -> str | None:
    """Strictly parsed JSON in canonical form; None where it is malformed. Lone surrogates, which UTF-8 can't hold, stay escapes."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        form = json.dumps(json.loads(text, parse_constant=refuse), ensure_ascii=False, separators=(",", ":"))
        return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", form)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _valid_json(found: pd.Series) -> pd.Series:
    return found.map(lambda xs: None if xs is None else ([y for x in xs if (y := canonical_json(x)) is not None] or None))


def json_ld_of(head: Column) -> Column:
    """Canonical JSON of each well-formed ld+json script in the head; null if there is none. Only pages that have such scripts reach Python."""
    found = F.transform(F.regexp_extract_all(head, F.lit(JSON_LD), F.lit(1)), trim_ws)
    return _valid_json(F.when(F.size(found) > 0, found))


def _fields(html: Column, head: Column, look: Column, json_ld: bool = True) -> dict[str, Column]:
    return {
        "title": title_of(head),
        "meta_description": look["n:description"],
        "canonical_url": canonical_of(head),
        "language": language_of(html),
        "author": look["n:author"],
        "robots": look["n:robots"],
        "og": _open_graph(look),
        "twitter": _twitter(look),
        "json_ld": json_ld_of(head) if json_ld else F.lit(None).cast("array<string>"),
    }


def extract_metadata(html: Column, json_ld: bool = True) -> Column:
    """Struct of all metadata of a page, as one expression. with_metadata() plans the same in steps, each pattern once."""
    head = head_of(html)
    return F.struct(*(c.alias(n) for n, c in _fields(html, head, _plain_look(head, ":"), json_ld).items()))


def with_metadata(pages: DataFrame, html: str = "html", name: str = "metadata") -> DataFrame:
    """pages with the metadata struct (null where html is), in steps: the head is cut once, its meta tags listed once and read once into keys and values, all fields looked up there."""
    head, look, text = (*(fresh(pages, n) for n in ("head", "look")), F.col(f"`{html}`"))
    rows = with_look(pages.withColumn(head, head_of(text)), head, look)
    fields = F.struct(*(c.alias(n) for n, c in _fields(text, F.col(head), F.col(look)).items()))
    return rows.withColumn(name, F.when(text.isNotNull(), fields)).drop(head, look)
