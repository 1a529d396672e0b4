"""URL allow and block lists in a trie over reversed host labels and path segments.

A rule is (host, path, action), its host A-Z lower-cased. It fits its host and all subdomains, if the
url's path starts with "/" + the rule's path. Of several fitting rules the one
with most host labels wins, then the longest path; of an allow and a block rule
with the same host and path the allow rule wins. Where none fits, the verdict is
the default action.

The trie is broadcast while the rules are few enough (counted); a longer list is
joined on (host suffix, path prefix) keys instead, with the same results.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path:
then up to "?", "#" or the end. A null url or one without "://" has an empty host
and path, so no rule fits. Repeated and null page identifiers are ordinary rows;
an empty table gives an empty table; other columns are carried by judge().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import map_arrow
from webloom.llm._text import column

#: Rules, and bytes of their hosts and paths, up to which the trie is broadcast. A rule of usual length takes about 1,500 bytes in it (measured
#: with 100,000 rules): some 15 MB on the driver and in each Python worker.
BROADCAST_RULES, BROADCAST_TEXT = 10_000, 1 << 20


_UPPER_AZ, _LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER_AZ, _LOWER_AZ)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str  # without the leading "/"
    allow: bool

    def __post_init__(self) -> None:
        object.__setattr__(self, "host", self.host.translate(_LOWER))

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


@dataclass
class _Paths:
    """Path segments below one host: full segments lead on, ends are what a next segment must start with."""

    kids: dict[str, _Paths] = field(default_factory=dict)
    ends: dict[str, Rule] = field(default_factory=dict)


@dataclass
class _Labels:
    kids: dict[str, _Labels] = field(default_factory=dict)
    paths: _Paths | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Labels()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.kids.setdefault(label, _Labels())
            node.paths = at = node.paths or _Paths()
            *segments, end = rule.path.split("/")
            for s in segments:
                at = at.kids.setdefault(s, _Paths())
            if rule.allow or end not in at.ends:
                at.ends[end] = rule

    def match(self, host: str, path: str) -> Rule | None:
        """The fitting rule with most host labels, then the longest path."""
        if not path.startswith("/"):
            return None
        node, best = self.root, None
        segments = path[1:].split("/")
        for label in reversed(host.split(".")):
            node = node.kids.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._path(node.paths, segments) or best
        return best

    @staticmethod
    def _path(at: _Paths, segments: list[str]) -> Rule | None:
        best = None
        for i, s in enumerate(segments):
            fits = [e for e in at.ends if s.startswith(e)] if len(at.ends) < 8 else [s[:n] for n in range(len(s) + 1) if s[:n] in at.ends]
            if fits:
                best = at.ends[max(fits, key=len)]
            if i == len(segments) - 1 or (at := at.kids.get(s)) is None:
                break
        return best


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER_AZ, _LOWER_AZ)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict, which replace columns of those names. rules: a list, or a table (host, path, allow)."""
    rows = pages.withColumns({"host": host_of(F.col(f"`{url_col}`").cast("string")), "path": path_of(F.col(f"`{url_col}`").cast("string"))}).drop("rule", "verdict")
    if isinstance(rules, list):
        small = len(rules) <= BROADCAST_RULES and sum(len(f"{r.host}{r.path}".encode()) for r in rules) <= BROADCAST_TEXT
        few = rules if small else None
        if few is None:
            rules = pages.sparkSession.createDataFrame([(r.host, r.path, r.allow) for r in rules], "host string, path string, allow boolean")
    else:
        n, size = rules.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.concat_ws("", "host", "path")))).first()
        few = [Rule(*r) for r in rules.select("host", "path", "allow").collect()] if n <= BROADCAST_RULES and (size or 0) <= BROADCAST_TEXT else None
    return _by_trie(rows, few, default) if few is not None else _by_join(rows, rules, default)


def _by_trie(rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    trie = rows.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str | None] = []
            verdicts: list[str] = []
            for host, path in zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist(), strict=True):
                rule = trie.value.match(host, path)
                names.append(rule and rule.name)
                verdicts.append(default if rule is None else "allow" if rule.allow else "block")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], [*batch.schema.names, "rule", "verdict"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(rows, run, f"{fields}, rule string, verdict string")


def _by_join(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Each distinct (host, path) meets the rules under every suffix of its host; the longest that fits is kept."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pages = rows.select("host", "path").distinct()
    r = rules.select(F.translate("host", _UPPER_AZ, _LOWER_AZ).alias("suffix"), F.col("path").alias("rule_path"), "allow")
    tests = pages.select("host", "path", F.explode(suffixes).alias("suffix")).join(r, "suffix").filter(F.col("path").startswith(F.concat(F.lit("/"), F.col("rule_path"))))
    rank = F.struct(F.size(F.split("suffix", r"\.")), F.length("rule_path"), "allow")
    best = tests.groupBy("host", "path").agg(F.max_by(F.struct(F.concat_ws("/", "suffix", "rule_path").alias("rule"), F.when(F.col("allow"), "allow").otherwise("block").alias("verdict")), rank).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
