"""URL functions: normalisation after the WHATWG URL standard, hosts, globs, domain filter, relative paths, hash."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: URLs that native expressions can normalise: plain lower-case host, plain path segments without dots of their own, plain query.
PLAIN = r"(?s)^https?://(?!\S*xn--)(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[A-Za-z0-9_~-]+(?:\.[A-Za-z0-9_~-]+)*)*/?(?:\?[A-Za-z0-9_=&.~/-]*)?(?:#.*)?$"

_C0_SPACE = "".join(map(chr, range(0x21)))
_FORBIDDEN_HOST = set(_C0_SPACE) | set('#/:<>?@[\\]^|%"`{}') - set('"`{}') | {"\x7f"}
_PATH_ESCAPES = set(' "<>`{}^')
_QUERY_ESCAPES = set(" \"<>'")
_USER_ESCAPES = _PATH_ESCAPES | set("/:;=@[\\]|?")


def _escape(text: str, marked: set[str]) -> str:
    return "".join("".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) if c in marked or not "\x1f" < c < "\x7f" else c for c in text)


def _ipv4(host: str) -> str | None:
    """Serialised address of a host whose last label is a number; None if it is no valid address."""
    parts = host.removesuffix(".").split(".")
    if len(parts) > 4:
        return None
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p, 16) if p[:2] in ("0x", "0X") and p[2:] else 0 if p[:2] in ("0x", "0X") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None
        if p[:1] in "+-" or "_" in p:
            return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") and "%" not in raw else None
        except ValueError:
            return None
    host = unquote_to_bytes(raw).decode("utf-8", "replace")
    if host.isascii():
        host = host.lower()
    else:
        try:
            host = ".".join(label.encode("idna").decode() if not label.isascii() else label for label in re.split("[.。．｡]", host)).lower()
        except UnicodeError:
            return None
    if not host or any(c in _FORBIDDEN_HOST for c in host):
        return None
    last = host.removesuffix(".").rpartition(".")[2]
    if last.isdigit() or re.fullmatch(r"0[xX][0-9a-fA-F]*", last):
        return _ipv4(host)
    return host


def parse_url(url: str) -> tuple[str, str, str, str, str] | None:
    """(scheme, authority before the host, host with port, path, query with its "?") of an absolute http(s) URL; None for anything else."""
    text = re.sub("[\t\n\r]", "", url.strip(_C0_SPACE))
    m = re.match(r"(?is)(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?", text)
    if not m:
        return None
    scheme, authority, path, query = m[1].lower(), m[2], m[3], m[4] or ""
    user, at, rest = authority.rpartition("@")
    name, colon, port = rest.rpartition(":") if not rest.endswith("]") else (rest, "", "")
    if not colon:
        name, port = rest, ""
    if (host := _host(name)) is None or port and (not re.fullmatch("[0-9]+", port) or int(port) > 65535):
        return None
    if port and int(port) == {"http": 80, "https": 443}[scheme]:
        port = ""
    if at:
        first, sep, second = user.partition(":")
        user = _escape(first, _USER_ESCAPES) + (":" + _escape(second, _USER_ESCAPES) if sep and second else "")
        user = user and user + "@"
    out: list[str] = []
    segments = re.split(r"[/\\]", path)[1:] if path else [""]
    for i, s in enumerate(segments):
        dots, end = re.sub("(?i)%2e", ".", s), i == len(segments) - 1
        if dots == "..":
            out = out[:-1]
        elif dots != ".":
            out.append(_escape(s, _PATH_ESCAPES))
            continue
        if end:
            out.append("")
    return scheme, user, host + (f":{int(port)}" if port else ""), "/" + "/".join(out), _escape(query, _QUERY_ESCAPES)


def href_one(url: str | None) -> str | None:
    """A parsed URL as it is written out, without fragment; "" for what is no absolute http(s) URL."""
    if url is None:
        return None
    return "" if (p := parse_url(url)) is None else f"{p[0]}://{p[1]}{p[2]}{p[3]}{p[4]}"


def normalize_one(url: str | None) -> str | None:
    """A URL without fragment and without one trailing slash of a path that isn't the root; "" for what is no absolute http(s) URL."""
    if url is None:
        return None
    if (p := parse_url(url)) is None:
        return ""
    path = p[3][:-1] if len(p[3]) > 1 and p[3].endswith("/") else p[3]
    return f"{p[0]}://{p[1]}{p[2]}{path}{p[4]}"


@F.pandas_udf(T.StringType())
def _normalize(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_one, na_action="ignore")


def normalize_url(url: Column) -> Column:
    """Normalised URL; plain URLs stay in the JVM and reach the UDF as nulls only."""
    plain = url.rlike(PLAIN)
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    rooted = F.regexp_replace(bare, r"^(https?://[^/?]+)(?=\?|$)", "$1/")
    native = F.regexp_replace(rooted, r"^(https?://[^/?]+/[^?]*[^/?])/(?=\?|$)", "$1")
    return F.when(plain, native).otherwise(_normalize(F.when(~plain, url)))


@F.pandas_udf(T.StringType())
def _href(urls: pd.Series) -> pd.Series:
    return urls.map(href_one, na_action="ignore")


def parsed_url(url: Column) -> Column:
    """URL as a parser writes it out, its trailing slash kept; plain URLs stay in the JVM."""
    plain = url.rlike(PLAIN)
    rooted = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^(https?://[^/?]+)(?=\?|$)", "$1/")
    return F.when(plain, rooted).otherwise(_href(F.when(~plain, url)))


def safe_host(normalized: Column) -> Column:
    """Host of a normalised URL without user and port; "" where there is none."""
    return F.coalesce(F.regexp_extract(normalized, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit(""))


def path_and_query(normalized: Column) -> Column:
    return F.regexp_extract(normalized, r"(?s)^https?://[^/?#]*([^#]*)", 1)


def origin_of(normalized: Column) -> Column:
    """scheme://host[:port] of a normalised URL."""
    return F.regexp_replace(F.regexp_extract(normalized, r"^https?://[^/?#]*", 0), r"//[^@]*@", "//")


def glob_to_regex(pattern: str) -> str:
    """* is a run without "/", ** any run without line ends; the rest is literal; the whole string must match."""
    parts = re.split(r"(\*\*|\*)", pattern)
    return "".join(r"[^\n\r\x{2028}\x{2029}]*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in parts)


def matches_pattern(url: Column, patterns: list[str]) -> Column:
    """True where any glob matches; false for an empty list. One literal alternation, compiled once."""
    return url.rlike("^(?:" + "|".join(map(glob_to_regex, patterns)) + r")\z") if patterns else F.lit(False)


def passes_domain_filter(url: Column, seed: str | Column, subdomains: bool = False, external: bool = False) -> Column:
    if external:
        return F.lit(True)
    seed = F.lit(seed) if isinstance(seed, str) else seed
    host = safe_host(url)
    ok = host == seed
    return (host != "") & (ok | host.endswith(F.concat(F.lit("."), seed)) if subdomains else ok)


def to_relative_path(url: Column, base: Column) -> Column:
    """Path and query of a normalised URL with the base's origin; others unchanged."""
    return F.when((origin_of(url) != "") & (origin_of(url) == origin_of(base)), path_and_query(url)).otherwise(url)


def sitemap_slug(url: Column) -> Column:
    """Last path segment, maybe ""; "sitemap.xml" for what is no URL."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.when(url.rlike("^https?://[^/?#]+"), F.element_at(F.split(path, "/", -1), -1)).otherwise(F.lit("sitemap.xml"))


def url_hash_one(url: str) -> int:
    """32-bit visited hash of a URL: its products are rounded to doubles, unlike canonical FNV-1a."""
    h = 2166136261
    units = url.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        x = h ^ (units[i] | units[i + 1] << 8)
        signed = x - (1 << 32) if x >= 1 << 31 else x
        h = int(float(signed) * 16777619.0) & 0xFFFFFFFF
    return h


def url_hash(url: Column) -> Column:
    """url_hash_one as an expression, for URLs in the basic plane."""
    units = F.transform(F.split(url, ""), lambda c: F.ascii(c).cast("long"))

    def step(h: Column, unit: Column) -> Column:
        x = h.bitwiseXOR(unit)
        signed = F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
        return (signed.cast("double") * F.lit(16777619.0)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))

    return F.when(url == "", F.lit(2166136261).cast("long")).otherwise(F.aggregate(units, F.lit(2166136261).cast("long"), step))
