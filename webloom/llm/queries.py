"""Driver queries opN_<name> over the whole tables, and the SQL that checks them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import exact_dedup, filter_audit, importance, line_dedup, line_labels, ngram_join, packing, periodic_runs, piece_codec, secret_scan, token_counts, token_table, url_filter
from webloom.llm._common import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"), k=4, percent=85)


RULES = [url_filter.Rule("net", "", False), url_filter.Rule("example.net", "en/", True), url_filter.Rule("example.com", "de/", False), url_filter.Rule("org", "fr/", True)]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


ORACLES["op4_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, verdict) AS (VALUES ('net', '', 'block'), ('example.net', 'en/', 'allow'), ('example.com', 'de/', 'block'), ('org', 'fr/', 'allow'))
SELECT page_id, host, path, arg_max(h || '/' || p, length(h || '/' || p)) AS rule, coalesce(arg_max(verdict, length(h || '/' || p)), 'allow') AS verdict
FROM u LEFT JOIN r ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, '/' || p)
GROUP BY page_id, host, path
"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@query
def op3_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-table")
    token_table.write(table(spark, sf_dir, "documents"), folder)
    return token_table.read(spark, folder, digest_only=True)


@query
def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "weight", "kept")


@query
def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.sequences(table(spark, sf_dir, "documents")))


@query
def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.table_of(table(spark, sf_dir, "documents"))


@query
def op2_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_labels.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


@query
def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
m AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS f FROM w),
told AS (SELECT doc_id, coalesce(max(quality) = 1, FALSE) AS good, coalesce(max(toxic) = 1, FALSE) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, f, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n FROM m LEFT JOIN told USING (doc_id) GROUP BY ALL),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a JOIN x b ON a.l <> b.l JOIN x c ON c.l NOT IN (a.l, b.l)
  JOIN x d ON d.l NOT IN (a.l, b.l, c.l) JOIN x e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, f, good, toxic, n,
         contains(f, filter_order[step]) AS hit, translate(filter_order[1:step - 1], f, '') <> filter_order[1:step - 1] AS gone
  FROM c, o, range(1, 6) r(step)),
g AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (f = letter), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM g
"""


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents get a period from one of their words on, by the checksum of doc_id (null: none)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"), with_period)


# Documents are told apart by doc_id here, which is unique in the tables.
ORACLES["op1_line_templates"] = r"""
WITH l AS (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
m AS (
  SELECT doc_id, pos, line, list_transform(string_split_regex(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+'),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM l),
u AS (SELECT DISTINCT doc_id, toks FROM m WHERE toks[1] <> ''),
recurring AS (SELECT toks FROM u GROUP BY toks HAVING count(*) >= 10),
rest AS (SELECT doc_id, toks, len(toks) AS n, toks[1:2] AS lead FROM u WHERE toks NOT IN (SELECT toks FROM recurring)),
leaf AS (SELECT n, lead FROM rest GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT doc_id, toks, n, lead, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM rest JOIN leaf USING (n, lead)),
fixed AS (SELECT n, lead, pos, tok, TRUE AS is_fixed FROM x WHERE tok <> '<*>' GROUP BY n, lead, pos, tok HAVING count(*) >= 10),
shaped AS (
  SELECT doc_id, toks, list(CASE WHEN is_fixed THEN tok ELSE '<*>' END ORDER BY pos) AS shape, count(is_fixed) AS k
  FROM x LEFT JOIN fixed USING (n, lead, pos, tok) GROUP BY doc_id, toks),
solid AS (SELECT * FROM shaped WHERE 100 * k >= 70 * len(shape)),
gone AS (
  SELECT toks FROM recurring UNION
  SELECT toks FROM solid WHERE shape IN (SELECT shape FROM solid GROUP BY shape HAVING count(DISTINCT doc_id) >= 10))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (toks IN (SELECT toks FROM gone)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (toks NOT IN (SELECT toks FROM gone)), '')) AS text_sha256
FROM m GROUP BY doc_id
"""

ORACLES["op5_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x)
SELECT doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(m) AS component_id FROM n JOIN r USING (doc_id) GROUP BY doc_id
"""
