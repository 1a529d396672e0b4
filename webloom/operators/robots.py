"""robots.txt: parsing, agent choice and URL permission as expressions or joins."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import trim_ws
from webloom.functions.urls import path_and_query

RULES = T.StructType(
    [
        T.StructField("rules", T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("allow", T.BooleanType())]))),
        T.StructField("crawl_delay", T.DoubleType()),
        T.StructField("sitemaps", T.ArrayType(T.StringType())),
    ]
)
_LINE = re.compile(r"(?i)(sitemap|user-agent|allow|disallow|crawl-delay):(.*)", re.DOTALL)
_FLOAT = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


@dataclass
class Robots:
    rules: list[tuple[str, bool]] = field(default_factory=list)
    crawl_delay: float | None = None  # milliseconds
    sitemaps: list[str] = field(default_factory=list)


@dataclass
class _Group:
    agents: list[str]
    rules: list[tuple[str, bool]] = field(default_factory=list)
    delay: float | None = None


def leading_float(text: str) -> float | None:
    """Number at the start of a text, as lenient parsers read it."""
    m = _FLOAT.match(text.strip())
    return float(m[0].replace("Infinity", "inf")) if m else None


def parse_robots_one(content: str | None, agent: str = "*") -> Robots:
    """Rules for an agent. A User-agent line opens a new group only after rules, so groups without rules merge into the next."""
    out, groups, agent = Robots(), [], agent.lower()
    for line in (content or "").split("\n"):
        m = _LINE.match(line.strip())
        if not m:
            continue
        name, value = m[1].lower(), m[2].strip()
        group = groups[-1] if groups else None
        if name == "sitemap":
            out.sitemaps += [value] if value else []
        elif name == "user-agent":
            if group is None or group.rules:
                groups.append(_Group([value.lower()]))
            else:
                group.agents.append(value.lower())
        elif group is None:
            continue
        elif name == "crawl-delay":
            if (seconds := leading_float(value)) is not None:
                group.delay = seconds * 1000
        elif value:
            group.rules.append((value, name == "allow"))
    named = wild = None
    for group in groups:
        if not group.rules:
            continue
        for a in group.agents:
            if a == "*":
                wild = group
            elif a in agent or agent in a:
                named = group
    if best := named or wild:
        out.rules, out.crawl_delay = best.rules, best.delay
    return out


def parse_robots(content: Column, agent: str = "*") -> Column:
    """Struct (rules, crawl_delay in ms, sitemaps); one robots.txt a host, so the UDF sees little."""

    @F.pandas_udf(RULES)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_robots_one(t, agent) for t in texts]
        return pd.DataFrame({"rules": [[{"pattern": p, "allow": a} for p, a in r.rules] for r in rows], "crawl_delay": pd.Series([r.crawl_delay for r in rows], dtype="float64"), "sitemaps": [r.sitemaps for r in rows]})

    return parse(content)


def parse_robots_table(robots: DataFrame, host: str = "host", content: str = "content", agent: str = "*") -> DataFrame:
    """(host, pos, pattern, allow, crawl_delay) of the chosen groups by window functions, without Python. host must be unique."""
    lines = robots.select(F.col(host).alias("host"), F.posexplode(F.split(content, "\n", -1)).alias("pos", "raw")).withColumn("line", trim_ws(F.col("raw")))
    part = r"(?is)^(user-agent|allow|disallow|crawl-delay):(.*)$"
    lines = lines.filter(F.col("line").rlike(part)).select("host", "pos", F.lower(F.regexp_extract("line", part, 1)).alias("name"), trim_ws(F.regexp_extract("line", part, 2)).alias("value"))
    order = Window.partitionBy("host").orderBy("pos")
    rule = F.col("name").isin("allow", "disallow") & (F.col("value") != "")
    # The start line of the current group: an agent line with rules (after some agent) since the last start.
    agents_so_far = F.sum((F.col("name") == "user-agent").cast("int")).over(order)
    lines = lines.withColumn("live", agents_so_far > 0).filter("live")
    lines = lines.withColumn("rules_before", F.coalesce(F.sum(rule.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = F.when(F.col("name") == "user-agent", F.col("rules_before"))
    lines = lines.withColumn("grp", F.max(starts).over(order))
    members = lines.groupBy("host", "grp").agg(F.collect_list(F.when(F.col("name") == "user-agent", F.lower("value"))).alias("agents"), F.sum(rule.cast("int")).alias("n"))
    me = F.lit(agent.lower())
    members = members.filter("n > 0").select("host", "grp", F.array_contains("agents", "*").alias("wild"), F.exists("agents", lambda a: (a != "*") & (F.contains(me, a) | F.contains(a, me))).alias("named"))
    best = members.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("named"), F.col("grp"))), F.max(F.when(F.col("wild"), F.col("grp")))).alias("grp"))
    number = F.expr(r"try_cast(regexp_extract(value, '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?', 0) AS double)")
    chosen = lines.join(best, ["host", "grp"])
    delay = chosen.filter("name = 'crawl-delay'").withColumn("d", number * 1000).filter("d is not null").groupBy("host").agg(F.max_by("d", "pos").alias("crawl_delay"))
    ranked = chosen.filter(rule).select("host", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("value").alias("pattern"), (F.col("name") == "allow").alias("allow"))
    return ranked.join(delay, "host", "left")


def rule_regex(pattern: Column, compat_dollar: bool = False) -> Column:
    """Regular expression of a rule: anchored at the start, * any run, a last $ anchors the end (compat_dollar: is literal)."""
    body = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    body = F.regexp_replace(body, r"\*", "[^\\\\n\\\\r]*")
    return F.concat(F.lit("^"), body if compat_dollar else F.regexp_replace(body, r"\\\$$", r"\$"))


def rule_length(pattern: Column) -> Column:
    return F.length(F.replace(pattern, F.lit("*"), F.lit("")))


def is_url_allowed(url: Column, rules: Column, compat_dollar: bool = False) -> Column:
    """Verdict of the longest matching rule (Allow wins ties), true where none matches. url: a column of normalised URLs (Python UDFs can't stand inside the test); rules: array<struct<pattern, allow>>."""
    target = path_and_query(url)
    hits = F.filter(rules, lambda r: F.rlike(target, rule_regex(r["pattern"], compat_dollar)))
    return F.coalesce(F.array_max(F.transform(hits, lambda r: F.struct(rule_length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))["allow"], F.lit(True))


def literal_prefix(pattern: Column) -> Column:
    """What a path must begin with to match a rule: the pattern up to its first *, without a last $."""
    return F.regexp_replace(F.substring_index(pattern, "*", 1), r"\$$", "")


def allowed_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", host: str = "host", keys: list[str] | None = None) -> DataFrame:
    """keys and allowed, from a table of rules (host, pattern, allow): the verdict of the longest matching rule, as is_url_allowed gives it.

    Rules are found by an index: equi-joined on host and literal prefix, with one look-up for each length of prefix that the host's rules have, so
    a page meets the few rules that begin like its path and not all of its host's. Regular expressions run on rules with * or $ among these only. A host with many pages
    spreads by its prefixes, and by adaptive skew joins where one prefix is common. keys must tell pages apart; null hosts have no rules.
    """
    keys = keys or [url]
    own = [f"k{i}" for i in range(len(keys))]
    r = rules.filter("host IS NOT NULL AND pattern IS NOT NULL").select("host", "allow", "pattern", literal_prefix(F.col("pattern")).alias("prefix")).distinct()
    lengths = r.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    r = r.select("host", "prefix", "allow", rule_length(F.col("pattern")).alias("n"), F.when(F.col("pattern").rlike(r"\*|\$$"), rule_regex(F.col("pattern"))).alias("re"))
    p = pages.select(F.col(f"`{host}`").alias("host"), path_and_query(F.col(f"`{url}`")).alias("path"), *(F.col(f"`{k}`").alias(n) for k, n in zip(keys, own, strict=True)))
    tried = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    p = p.join(lengths, "host", "left").withColumn("prefix", F.explode_outer(tried)).drop("lengths")
    met = p.join(r, ["host", "prefix"], "left")
    hit = F.col("allow").isNotNull() & (F.col("re").isNull() | F.rlike("path", F.col("re")))
    best = F.coalesce(F.max(F.when(hit, F.struct("n", "allow")))["allow"], F.lit(True))
    return met.groupBy(*own).agg(best.alias("allowed")).select(*(F.col(n).alias(k) for n, k in zip(own, keys, strict=True)), "allowed")
