"""Rendering of HTML as markdown or as a semantic tree, and strip modes."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import drop_blocks

FORMATS = ("html", "markdown", "semantic_tree", "semantic_tree_text")
STRIPS = ("js", "css", "ui")
UI_TAGS = ("nav", "footer", "aside", "header", "form", "button", "svg", "iframe")
_HIDDEN = ("script", "style", "head", "template", "noscript")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "nav", "footer", "aside", "header", "form", "body", "html", "figure"}
_WRAPS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Markdown(HTMLParser):
    """Builds markdown while parsing; hidden elements are skipped with all they hold."""

    def __init__(self, base: str, hidden: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.base, self.hidden = base, hidden
        self.out: list[str] = []
        self.skip: list[str] = []
        self.links: list[tuple[str | None, int]] = []
        self.pre = 0

    def break_line(self, n: int) -> None:
        self.out.append("\n" * n)

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden and tag not in _VOID:
            self.skip.append(tag)
        if self.skip:
            return
        a = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self.break_line(2)
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in _BLOCKS:
            self.break_line(2)
        elif tag == "br":
            self.break_line(1)
        elif tag == "li":
            self.break_line(1)
            self.out.append("- ")
        elif tag == "blockquote":
            self.break_line(2)
            self.out.append("> ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in _WRAPS and not self.pre:
            self.out.append(_WRAPS[tag])
        elif tag == "a":
            self.links.append((a.get("href"), len(self.out)))
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({self.absolute(a['src'])})")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        if re.fullmatch("h[1-6]", tag) or tag in _BLOCKS or tag == "blockquote":
            self.break_line(2)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in _WRAPS and not self.pre:
            self.out.append(_WRAPS[tag])
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            text = re.sub(r"\s+", " ", "".join(self.out[at:])).strip()
            del self.out[at:]
            self.out.append(f"[{text}]({self.absolute(href)})" if href else text)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def absolute(self, href: str) -> str:
        try:
            return urljoin(self.base, href.strip())
        except ValueError:
            return href.strip()

    def text(self) -> str:
        lines = "".join(self.out).split("\n")
        joined = "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in lines)
        return re.sub(r"\n{3,}", "\n\n", joined).strip()


class _Tree(HTMLParser):
    """Indented outline of elements: role or tag, and own text."""

    def __init__(self, hidden: tuple[str, ...], text_only: bool):
        super().__init__(convert_charrefs=True)
        self.hidden, self.text_only = hidden, text_only
        self.stack: list[str] = []
        self.skip: list[str] = []
        self.lines: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden and tag not in _VOID:
            self.skip.append(tag)
        if self.skip:
            return
        a = dict(attrs)
        if not self.text_only:
            notes = "".join(f" {k}={a[k]!r}" for k in ("role", "href", "src", "alt", "aria-label") if a.get(k))
            self.lines.append("  " * len(self.stack) + tag + notes)
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        text = re.sub(r"\s+", " ", data).strip()
        if text and not self.skip:
            self.lines.append("  " * len(self.stack) + (text if self.text_only else f'"{text}"'))


def render_one(html: str | None, base: str | None, fmt: str, strip: tuple[str, ...]) -> str | None:
    if html is None:
        return None
    hidden = _HIDDEN + (UI_TAGS if "ui" in strip else ())
    parser = _Markdown(base or "", hidden) if fmt == "markdown" else _Tree(hidden, fmt == "semantic_tree_text")
    parser.feed(html)
    parser.close()
    return parser.text() if fmt == "markdown" else "\n".join(parser.lines)


def strip_html(html: Column, strip: tuple[str, ...] | list[str]) -> Column:
    """html without script (js), style (css) or page furniture (ui) elements, natively."""
    unknown = set(strip) - set(STRIPS)
    if unknown:
        raise ValueError(f"unknown strip modes: {sorted(unknown)}")
    for tag in (("script",) if "js" in strip else ()) + (("style",) if "css" in strip else ()) + (UI_TAGS if "ui" in strip else ()):
        html = drop_blocks(html, tag)
    return html


def with_base(html: Column, url: Column) -> Column:
    """html with a base element for its URL at the start of its head."""
    return F.regexp_replace(html, r"(?i)(<head[^>]*>)", F.concat(F.lit("$1"), F.lit('<base href="'), F.regexp_replace(url, r"([\\$])", r"\\$1"), F.lit('">')))


def render_html(html: Column, url: Column, fmt: str = "html", strip: tuple[str, ...] | list[str] = ()) -> Column:
    """html in one of FORMATS. html itself stays native; the others are one Arrow UDF."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "html":
        return strip_html(html, strip)
    modes = tuple(strip)

    @F.pandas_udf(T.StringType())
    def render(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([render_one(h, b, fmt, modes) for h, b in zip(pages, bases, strict=True)], dtype=object)

    return render(html, url)
