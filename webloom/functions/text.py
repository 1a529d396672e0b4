"""Text functions over HTML, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of ECMAScript, for trimming and collapsing.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Those of them beyond ASCII.
RARE_WS = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The entities that are decoded, in this order (so &amp;lt; becomes <).
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def decode_entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def drop_blocks(html: Column, tag: str) -> Column:
    """html without the tag's elements, case-insensitive, shortest match. Pages without the tag's end skip the search."""
    return F.when(F.contains(F.lower(html), F.lit(f"</{tag}>")), F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")).otherwise(html)


def strip_html_to_text(html: Column) -> Column:
    """Visible text: no script and style, each tag (comments too) a space, white space collapsed and trimmed. Entities stay."""
    bare = F.regexp_replace(drop_blocks(drop_blocks(html, "script"), "style"), r"<[^>]+>", " ")
    # Runs of ASCII white space first: of the single spaces left, only those beside other white space are looked at again.
    near = F.regexp_replace(bare, r"[\t-\r ]+", " ")
    return F.trim(F.when(F.rlike(near, F.lit(RARE_WS)), F.regexp_replace(near, f"{WS}+", " ")).otherwise(near))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units: code points, and once more each outside the basic plane."""
    return (F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def match_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null (not "") where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))
