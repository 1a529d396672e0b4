"""Driver queries for the engine's operators, over whole tables, and the SQL that checks them.

The pages table has no meta tags, absolute links, robots files or sitemaps, so
queries derive such inputs from page_id, url and html in the same way on both sides.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.jsonld import json_ld_fields, json_ld_nodes, json_ld_profile, json_ld_schemas
from webloom.functions.metadata import canonical_of, head_of, json_ld_of, language_of, meta_content, title_of, with_metadata
from webloom.functions.render import render_html
from webloom.functions.text import strip_html_to_text, utf16_length
from webloom.functions.urls import matches_pattern, normalize_url, origin_of, passes_domain_filter, safe_host, sitemap_slug, to_relative_path, url_hash
from webloom.functions.tables import register_tables
from webloom.operators import frontier as fr
from webloom.operators.links import inlink_counts, link_counts, links_table, with_links
from webloom.operators.politeness import fetch_schedule
from webloom.operators.robots import allowed_by_join, is_url_allowed, parse_robots, parse_robots_table
from webloom.operators.sitemaps import common_sitemaps, discover_many, discover_sitemaps, parse_sitemap_table, sitemap_levels, urls_of
from webloom.plans.blocks import bfs_whole
from webloom.plans.crawl import bfs_levels, crawl_batch, followable, start
from webloom.plans.endpoints import BAD_FORMAT, NO_URL, discover_answers, fetch_answers
from webloom.plans.many import crawl_many
from webloom.plans.recursive import sitemap_tree, walk
from webloom.plans.report import page_report as report_of
from webloom.plans.report import page_rows, sitemap_pages
from webloom.plans.versions import VersionedCrawl
from webloom.scratch import checkpoint_base
from webloom.session import ship
from webloom.sources.page_store import PageStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


# Pieces of SQL shared by oracles. NORM: a page's normalised URL; HOST: its host.
NORM = r"regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]+/[^?]*[^/?])/(\?|$)', '\1\2')"
ORIGIN = "regexp_extract(url, '^https?://[^/?#]*', 0)"
HOST = r"regexp_extract(url, '^https?://([^/?#:]*)', 1)"
STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[\s\S]*?</script>', '', 'gi'), '<style[^>]*>[\s\S]*?</style>', '', 'gi'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
HEAD = r"CASE WHEN regexp_matches(html, '<head[^>]*>[\s\S]*?</head>', 'i') THEN regexp_extract(html, '<head[^>]*>([\s\S]*?)</head>', 1, 'i') ELSE html END"
DECODED = "replace(replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&#x2F;', '/')"
TITLE = f"(SELECT CASE WHEN regexp_matches(h, '<title[^>]*>[\\s\\S]*?</title>', 'i') THEN {DECODED.format(chr(116))} END FROM (SELECT trim(regexp_extract(h, '<title[^>]*>([\\s\\S]*?)</title>', 1, 'i')) AS t))"
LANGUAGE = r"""CASE WHEN regexp_matches(html, '<html[^>]*lang\s*=\s*["''][^"'']+["'']', 'i') THEN regexp_extract(html, '<html[^>]*lang\s*=\s*["'']([^"'']+)["'']', 1, 'i') END"""


@query(f"SELECT page_id, {STRIP} AS text, CAST(length({STRIP}) AS BIGINT) AS text_length FROM pages")
def page_text(spark, sf_dir):
    text = strip_html_to_text(F.col("html"))
    return pages_of(spark, sf_dir).select("page_id", text.alias("text"), utf16_length(text).alias("text_length"))


@query(f"WITH p AS (SELECT page_id, {HEAD} AS h FROM pages) SELECT page_id, {TITLE} AS title FROM p")
def page_title(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", title_of(head_of(F.col("html"))).alias("title"))


@query(f"SELECT page_id, {LANGUAGE} AS language FROM pages")
def page_language(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", language_of(F.col("html")).alias("language"))


@query()
def page_report_rendered(spark, sf_dir):
    pages = pages_of(spark, sf_dir).withColumns({"url": normalize_url(F.col("url")), "status_code": F.lit(200)})
    return report_of(page_rows(pages, key="page_id"), keep=["page_id"]).drop("processed_at")


@query()
def render_markdown(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", render_html(F.col("html"), F.col("url"), "markdown", ["js", "css"]).alias("markdown"))


@query()
def render_semantic_tree(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", render_html(F.col("html"), F.col("url"), "semantic_tree").alias("tree"), render_html(F.col("html"), F.col("url"), "semantic_tree_text").alias("tree_text"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>[\s\S]*?</script>', '', 'gi'), '<style[^>]*>[\s\S]*?</style>', '', 'gi') AS html FROM pages""")
def strip_modes(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", render_html(F.col("html"), F.col("url"), "html", ["js", "css"]).alias("html"))


# Metadata: tags made from page_id stand before the page's own html, inside a head of their own.
def tagged(spark, sf_dir) -> DataFrame:
    i = F.col("page_id")
    s = i.cast("string")
    meta = (
        F.when(i % 5 == 0, F.concat(F.lit('<meta name="description" content="About '), s, F.lit(" &amp;lt; it's here\">")))
        .when(i % 5 == 1, F.concat(F.lit("<meta content='Second order "), s, F.lit("' name='description'>")))
        .when(i % 5 == 2, F.lit('<META NAME = "Description" CONTENT = "">'))
        .otherwise(F.lit(""))
    )
    og = F.when(i % 3 == 0, F.concat(F.lit('<meta property="og:title" content="T'), s, F.lit('"><meta content="&quot;d&#39;" property="og:description"><meta property="og:site_name" content="S">'))).when(i % 3 == 1, F.lit('<meta property="og:type" content="website"><meta property="og:title" content="">')).otherwise(F.lit(""))
    tw = F.when(i % 4 == 0, F.concat(F.lit('<meta name="twitter:card" content="summary"><meta property="twitter:title" content="P'), s, F.lit('">'))).when(i % 4 == 1, F.lit('<meta name="twitter:site" content="@x">')).otherwise(F.lit(""))
    odd = F.when(i % 9 == 4, F.lit('<meta name="author" content="Nobody"')).when(i % 9 == 5, F.lit('<meta name="robots" content="a > b"><meta name="author" content="A > Z">')).otherwise(F.lit(""))
    canon = F.when(i % 2 == 0, F.concat(F.lit('<link rel="canonical" href="'), F.col("url"), F.lit('">'))).when(i % 7 == 0, F.concat(F.lit("<link href='"), F.col("url"), F.lit("' rel='canonical' data-x>"))).otherwise(F.lit(""))
    ld = F.when(i % 6 == 0, F.concat(F.lit('<script type="application/ld+json"> {"@id": '), s, F.lit(', "a": [1, null]} </script><script type="application/ld+json">{broken</script>'))).when(i % 6 == 1, F.lit('<script type="application/ld+json">{oops}</script>')).otherwise(F.lit(""))
    return pages_of(spark, sf_dir).withColumn("html", F.concat(F.lit("<head>"), meta, og, tw, canon, ld, odd, F.lit("</head>"), F.col("html")))


TAGGED = """WITH t AS (SELECT page_id, url, '<head>' ||
 CASE page_id % 5 WHEN 0 THEN '<meta name="description" content="About ' || page_id || ' &amp;lt; it''s here">' WHEN 1 THEN '<meta content=''Second order ' || page_id || ''' name=''description''>' WHEN 2 THEN '<META NAME = "Description" CONTENT = "">' ELSE '' END ||
 CASE page_id % 3 WHEN 0 THEN '<meta property="og:title" content="T' || page_id || '"><meta content="&quot;d&#39;" property="og:description"><meta property="og:site_name" content="S">' WHEN 1 THEN '<meta property="og:type" content="website"><meta property="og:title" content="">' ELSE '' END ||
 CASE page_id % 4 WHEN 0 THEN '<meta name="twitter:card" content="summary"><meta property="twitter:title" content="P' || page_id || '">' WHEN 1 THEN '<meta name="twitter:site" content="@x">' ELSE '' END ||
 CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="' || url || '">' WHEN page_id % 7 = 0 THEN '<link href=''' || url || ''' rel=''canonical'' data-x>' ELSE '' END ||
 CASE page_id % 6 WHEN 0 THEN '<script type="application/ld+json"> {"@id": ' || page_id || ', "a": [1, null]} </script><script type="application/ld+json">{broken</script>' WHEN 1 THEN '<script type="application/ld+json">{oops}</script>' ELSE '' END ||
 CASE page_id % 9 WHEN 4 THEN '<meta name="author" content="Nobody"' WHEN 5 THEN '<meta name="robots" content="a > b"><meta name="author" content="A > Z">' ELSE '' END ||
 '</head>' || html AS html FROM pages),
p AS (SELECT *, """ + HEAD + " AS h FROM t)\n"  # fmt: skip


def attr(key: str, value: str, tag: str = "meta", want: str = "content", some: str = "*") -> str:
    """SQL for the first match of either attribute order in h."""
    q, c = "[\"'']", f"[\"'']([^\"'']{some})[\"'']"
    one, two = rf"<{tag}[^>]*{key}\s*=\s*{q}{value}{q}[^>]*{want}\s*=\s*{c}[^>]*>", rf"<{tag}[^>]*{want}\s*=\s*{c}[^>]*{key}\s*=\s*{q}{value}{q}[^>]*>"
    sql = f"CASE WHEN regexp_matches(h, '{one}', 'i') THEN regexp_extract(h, '{one}', 1, 'i') WHEN regexp_matches(h, '{two}', 'i') THEN regexp_extract(h, '{two}', 1, 'i') END"
    return sql if tag == "link" else DECODED.format(sql)


@query(TAGGED + f"SELECT page_id, {attr('name', 'description')} AS meta_description, {attr('name', 'author')} AS author, {attr('name', 'robots')} AS robots FROM p")
def page_meta(spark, sf_dir):
    h = head_of(F.col("html"))
    return tagged(spark, sf_dir).select("page_id", meta_content(h, "name", "description").alias("meta_description"), meta_content(h, "name", "author").alias("author"), meta_content(h, "name", "robots").alias("robots"))


@query(TAGGED + f"""SELECT page_id, o IS NOT NULL AS present, o.title AS title, o.description AS description, o.type AS type, o.site_name AS site_name FROM (
SELECT page_id, CASE WHEN coalesce(title, '') || coalesce(description, '') || coalesce(image, '') || coalesce(u, '') <> '' THEN struct_pack(title := title, description := description, type := type, site_name := site_name) END AS o FROM (
SELECT page_id, {attr('property', 'og:title')} AS title, {attr('property', 'og:description')} AS description, {attr('property', 'og:image')} AS image, {attr('property', 'og:url')} AS u, {attr('property', 'og:type')} AS type, {attr('property', 'og:site_name')} AS site_name FROM p))""")
def page_og(spark, sf_dir):
    og = with_metadata(tagged(spark, sf_dir)).select("page_id", F.col("metadata.og").alias("og"))
    return og.select("page_id", F.col("og").isNotNull().alias("present"), *(F.col(f"og.{c}").alias(c) for c in ("title", "description", "type", "site_name")))


@query(TAGGED + f"""SELECT page_id, coalesce(card, '') || coalesce(title, '') || coalesce(d, '') || coalesce(i, '') <> '' AS present,
CASE WHEN coalesce(card, '') || coalesce(title, '') || coalesce(d, '') || coalesce(i, '') <> '' THEN card END AS card, CASE WHEN coalesce(card, '') || coalesce(title, '') || coalesce(d, '') || coalesce(i, '') <> '' THEN title END AS title FROM (
SELECT page_id, coalesce({attr('name', 'twitter:card')}, {attr('property', 'twitter:card')}) AS card, coalesce({attr('name', 'twitter:title')}, {attr('property', 'twitter:title')}) AS title,
 coalesce({attr('name', 'twitter:description')}, {attr('property', 'twitter:description')}) AS d, coalesce({attr('name', 'twitter:image')}, {attr('property', 'twitter:image')}) AS i FROM p)""")
def page_twitter(spark, sf_dir):
    t = with_metadata(tagged(spark, sf_dir)).select("page_id", F.col("metadata.twitter").alias("t"))
    return t.select("page_id", F.col("t").isNotNull().alias("present"), F.col("t.card").alias("card"), F.col("t.title").alias("title"))


@query(TAGGED + f"SELECT page_id, {attr('rel', 'canonical', 'link', 'href', '+')} AS canonical_url FROM p")
def page_canonical(spark, sf_dir):
    return tagged(spark, sf_dir).select("page_id", canonical_of(head_of(F.col("html"))).alias("canonical_url"))


@query(r"""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS n_json_ld, CASE WHEN page_id % 6 = 0 THEN '{"@id":' || page_id || ',"a":[1,null]}' END AS first FROM pages""")
def page_jsonld(spark, sf_dir):
    ld = tagged(spark, sf_dir).select("page_id", json_ld_of(head_of(F.col("html"))).alias("ld"))
    return ld.select("page_id", F.coalesce(F.size("ld"), F.lit(0)).cast("long").alias("n_json_ld"), F.get("ld", F.lit(0)).alias("first"))


# JSON-LD: scripts of six kinds by page_id: a graph, a list, equal keys, malformed ones, a text and an untyped node, none.
LD_SCRIPTS = (
    ('{"@context":"https://schema.org","@graph":[{"@type":"WebPage","@id":"#p%1$s","name":"Page %1$s"},{"@type":["Article","NewsArticle"],"headline":"H%1$s","wordCount":%1$s,"isAccessibleForFree":true}]}',),
    ('[{"@type":"Product","name":"P%1$s","offers":{"price":%1$s.5,"priceCurrency":"EUR"}},{"@type":"Product","name":null}]',),
    ('{"@type":"Product","name":"Q%1$s","name":"R%1$s","offers":[{"price":"%1$s"}]}',),
    ('{"@type":"Article",}', '{"@type":"Article","headline":"X"} more'),
    ('"text %1$s"', '{"name":"untyped %1$s"}'),
    (),
)


def with_scripts(spark, sf_dir) -> DataFrame:
    def html(scripts: tuple[str, ...]):
        return F.format_string("<head>" + "".join(f'<script type="application/ld+json">{x}</script>' for x in scripts) + "</head>", F.col("page_id").cast("string"))

    kind = F.col("page_id") % 6
    return pages_of(spark, sf_dir).withColumn("html", F.concat(functools.reduce(lambda c, k: c.when(kind == k, html(LD_SCRIPTS[k])), range(1, 6), F.when(kind == 0, html(LD_SCRIPTS[0]))), "html"))


LD = """WITH n AS (SELECT page_id, script :: BIGINT AS script, node_pos :: BIGINT AS node_pos, CASE WHEN k = 0 AND node_pos = 0 THEN '#p' || page_id END AS id, types,
 CASE WHEN k = 0 AND node_pos = 0 THEN 'Page ' || page_id WHEN k = 1 AND node_pos = 0 THEN 'P' || page_id WHEN k = 2 THEN 'R' || page_id WHEN k = 4 THEN 'untyped ' || page_id END AS name,
 CASE WHEN k = 0 AND node_pos = 1 THEN 'H' || page_id END AS headline, CASE WHEN k = 0 AND node_pos = 1 THEN page_id :: BIGINT END AS word_count,
 CASE WHEN k = 1 AND node_pos = 0 THEN page_id + 0.5 :: DOUBLE WHEN k = 2 THEN page_id :: DOUBLE END AS price, fields
 FROM (SELECT page_id, page_id % 6 AS kind FROM pages) JOIN (VALUES
 (0, 0, 0, 'WebPage', ['@id:string', '@type:string', 'name:string']), (0, 0, 1, 'Article,NewsArticle', ['@type:array', 'headline:string', 'isAccessibleForFree:boolean', 'wordCount:number']),
 (1, 0, 0, 'Product', ['@type:string', 'name:string', 'offers:object']), (1, 0, 1, 'Product', ['@type:string', 'name:null']),
 (2, 0, 0, 'Product', ['@type:string', 'name:string', 'offers:array']), (4, 1, 0, '', ['name:string'])) v(k, script, node_pos, types, fields) ON k = kind)
"""


@query(LD + "SELECT page_id, script, node_pos, id, types, name, headline, word_count, price FROM n")
def jsonld_nodes(spark, sf_dir):
    """Typed fields of each JSON-LD node."""
    rows = json_ld_fields(json_ld_nodes(with_scripts(spark, sf_dir), keep=["page_id"]), {"name": ("$.name", "string"), "headline": ("$.headline", "string"), "word_count": ("$.wordCount", "long"), "price": (("$.offers.price", "$.offers[0].price"), "double")})
    return rows.withColumn("types", F.array_join("types", ",")).drop("node")


@query(LD + "SELECT type, split_part(f, ':', 1) AS field, split_part(f, ':', 2) AS kind, count(*) AS n FROM (SELECT unnest(string_split(types, ',')) AS type, fields FROM n), unnest(fields) AS u(f) GROUP BY ALL")
def jsonld_profile(spark, sf_dir):
    """Fields and their kinds by type."""
    return json_ld_profile(json_ld_nodes(with_scripts(spark, sf_dir)))


@query(LD + """SELECT type, count(*) AS n, CASE type WHEN '' THEN 'OBJECT<name: STRING>' WHEN 'WebPage' THEN 'OBJECT<`@id`: STRING, `@type`: STRING, name: STRING>'
 WHEN 'Product' THEN CASE WHEN count(DISTINCT fields[3]) > 1 THEN 'OBJECT<`@type`: STRING, name: STRING, offers: VARIANT>' END ELSE 'OBJECT<`@type`: ARRAY<STRING>, headline: STRING, isAccessibleForFree: BOOLEAN, wordCount: BIGINT>' END AS schema
 FROM (SELECT unnest(string_split(types, ',')) AS type, fields FROM n) GROUP BY type""")
def jsonld_schemas(spark, sf_dir):
    """The merged schema of the nodes of each type."""
    return json_ld_schemas(json_ld_nodes(with_scripts(spark, sf_dir)))


# Markdown: a page's navigation anchors as links to its own host, with noise that the rules must drop.
ANCHOR = r'(?s)<a href="(/[A-Za-z0-9_/.-]*)">([^<]*)</a>'


def with_marks(pages: DataFrame) -> DataFrame:
    """pages (page_id, host, html) with markdown."""
    paths, names = (F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(g)) for g in (1, 2))
    links = F.transform(F.arrays_zip(paths.alias("p"), names.alias("n")), lambda a: F.concat(F.lit("[**"), a["n"], F.lit("**]("), F.lit("https://"), F.col("host"), a["p"], F.lit("#x)")))
    s = F.col("page_id").cast("string")
    noise = F.concat(F.lit("[me](mailto:a@b.c) ![pic "), s, F.lit("](https://img.example.org/"), (F.col("page_id") % 9).cast("string"), F.lit(".png) ![](https://img.example.org/0.png) [_Out_](https://other.example.org/"), (F.col("page_id") % 13).cast("string"), F.lit("/) [``](https://x.example.org/none) "))
    return pages.withColumn("marks", links).withColumn("markdown", F.concat(F.array_join("marks", " "), F.lit(" filler text "), noise, F.array_join("marks", " and again "))).drop("marks")


def marked(spark, sf_dir) -> DataFrame:
    pages = pages_of(spark, sf_dir).withColumn("host", safe_host(normalize_url(F.col("url"))))
    return with_marks(pages).select("page_id", "url", "host", "markdown")


MARKED = r"""WITH m AS (SELECT page_id, url, """ + HOST + r""" AS host,
  list_transform(generate_series(1, len(regexp_extract_all(html, '<a href="(/[A-Za-z0-9_/.-]*)">([^<]*)</a>', 1))), lambda i: '[**' || regexp_extract_all(html, '<a href="(/[A-Za-z0-9_/.-]*)">([^<]*)</a>', 2)[i] || '**](https://' || """ + HOST + r""" || regexp_extract_all(html, '<a href="(/[A-Za-z0-9_/.-]*)">([^<]*)</a>', 1)[i] || '#x)') AS l FROM pages),
k AS (SELECT page_id, host, array_to_string(l, ' ') || ' filler text [me](mailto:a@b.c) ![pic ' || page_id || '](https://img.example.org/' || (page_id % 9) || '.png) ![](https://img.example.org/0.png) [_Out_](https://other.example.org/' || (page_id % 13) || '/) [``](https://x.example.org/none) ' || array_to_string(l, ' and again ') AS md FROM m),
x AS (SELECT page_id, host, md, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS whole, unnest(a) AS anchor, unnest(t) AS target, s FROM (
  SELECT page_id, host, md, regexp_extract_all(md, '\[([^\]]*)\]\(([^)]+)\)', 0) AS w, regexp_extract_all(md, '\[([^\]]*)\]\(([^)]+)\)', 1) AS a, regexp_extract_all(md, '\[([^\]]*)\]\(([^)]+)\)', 2) AS t, string_split_regex(md, '\[([^\]]*)\]\(([^)]+)\)') AS s FROM k)),
y AS (SELECT page_id, host, pos, length(md) AS total, trim(regexp_replace(regexp_replace(regexp_replace(anchor, '\*\*(.*?)\*\*', '\1', 'g'), '_(.*?)_', '\1', 'g'), '`(.*?)`', '\1', 'g')) AS anchor, regexp_replace(regexp_replace(trim(target), '#.*$', ''), '^(https?://[^/?]+/[^?]*[^/?])/(\?|$)', '\1\2') AS url, target,
  list_sum(list_transform(s[1:pos + 1], lambda e: length(e))) AS gaps, s[pos + 1] AS gap, whole FROM x),
z AS (SELECT *, gaps + coalesce(sum(length(whole)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM y),
links AS (SELECT page_id, pos, url, anchor AS anchor_text, CASE WHEN regexp_extract(url, '^https?://([^/?#:]*)', 1) = host OR ends_with(regexp_extract(url, '^https?://([^/?#:]*)', 1), '.' || host) THEN 'internal' ELSE 'external' END AS type,
  CASE WHEN offs / total < 0.15 OR offs / total > 0.85 THEN 'navigational' ELSE 'content' END AS location
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS r FROM z WHERE NOT ends_with(gap, '!') AND anchor <> '' AND NOT regexp_matches(trim(target), '^(javascript|mailto|tel|data):')) WHERE r = 1)
"""


@query(MARKED + "SELECT page_id, pos, url, anchor_text, type, location FROM links")
def md_links(spark, sf_dir):
    return links_table(marked(spark, sf_dir).withColumnRenamed("url", "page_url"), "markdown", "page_url", ["page_id"]).select("page_id", "pos", "url", "anchor_text", "type", "location")


@query(MARKED + "SELECT page_id, pos, url, anchor_text, type, location FROM links")
def md_links_lateral(spark, sf_dir):
    """The same rows by the table function."""
    register_tables(spark)
    return spark.sql("SELECT page_id, l.* FROM {pages}, LATERAL links(markdown, url) l", pages=marked(spark, sf_dir))


@query(MARKED + """SELECT page_id, count(url) AS total, count(*) FILTER (type = 'internal') AS internal, count(*) FILTER (type = 'external') AS "external", count(*) FILTER (location = 'content') AS content, count(*) FILTER (location = 'navigational') AS navigational FROM links GROUP BY page_id""")
def md_link_counts(spark, sf_dir):
    rows = with_links(marked(spark, sf_dir), key="page_id")
    return rows.select("page_id", link_counts(F.col("links")).alias("c")).select("page_id", "c.*")


@query(MARKED + r"""SELECT page_id, url, alt FROM (SELECT page_id, trim(target) AS url, trim(anchor) AS alt, row_number() OVER (PARTITION BY page_id, trim(target) ORDER BY pos) AS r FROM x WHERE ends_with(s[pos + 1], '!')) WHERE r = 1""")
def md_images(spark, sf_dir):
    return with_links(marked(spark, sf_dir), key="page_id").select("page_id", F.explode("images").alias("i")).select("page_id", F.col("i.url").alias("url"), F.col("i.alt").alias("alt"))


@query(MARKED + "SELECT url AS dst, count(*) AS inlinks, count(DISTINCT page_id) AS sources FROM links GROUP BY url")
def inlinks(spark, sf_dir):
    links = links_table(marked(spark, sf_dir).withColumnRenamed("url", "page_url"), "markdown", "page_url", ["page_id"])
    return inlink_counts(links.select(F.col("page_id").alias("src"), F.col("url").alias("dst")))


@query(f"SELECT {HOST} AS host, count(*) AS pages, sum(length({STRIP})) :: BIGINT AS text_length FROM pages GROUP BY 1")
def host_rollup(spark, sf_dir):
    rows = pages_of(spark, sf_dir).select(safe_host(normalize_url(F.col("url"))).alias("host"), F.length(strip_html_to_text(F.col("html"))).alias("n"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("text_length"))


@query(f"SELECT page_id, {NORM} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, {HOST} AS host, regexp_extract(url, '^https?://[^/?#]*', 0) AS origin FROM pages")
def url_host(spark, sf_dir):
    n = normalize_url(F.col("url"))
    return pages_of(spark, sf_dir).select("page_id", safe_host(n).alias("host"), origin_of(n).alias("origin"))


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(n, '^https?://[^/?#]*([^#]*)', 1) ELSE n END AS relative, list_last(string_split(regexp_extract(n, '^https?://[^/?#]*([^?#]*)', 1), '/')) AS slug
FROM (SELECT page_id, {NORM} AS n FROM pages)""")
def url_relative(spark, sf_dir):
    rows = pages_of(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("n"))
    base = F.when(F.col("page_id") % 2 == 0, F.col("n")).otherwise(F.lit("https://elsewhere.example.org/"))
    return rows.select("page_id", to_relative_path(F.col("n"), base).alias("relative"), sitemap_slug(F.col("n")).alias("slug"))


@query(f"""SELECT page_id, list_reduce(list_prepend(2166136261 :: BIGINT, list_transform(string_split(n, ''), lambda c: ascii(c) :: BIGINT)),
  lambda h, c: CAST(CAST(CASE WHEN xor(h, c) >= 2147483648 THEN xor(h, c) - 4294967296 ELSE xor(h, c) END AS DOUBLE) * 16777619.0 AS BIGINT) & 4294967295) AS hash FROM (SELECT page_id, {NORM} AS n FROM pages)""")
def url_hash32(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", url_hash(normalize_url(F.col("url"))).alias("hash"))


@query(f"""SELECT page_id, regexp_full_match(n, 'https?://[^/]*/en/[^/]*') OR regexp_full_match(n, '.*\\.html') AS included, regexp_full_match(n, 'https://.*/de/[^/]*') AS excluded FROM (SELECT page_id, {NORM} AS n FROM pages)""")
def glob_filter(spark, sf_dir):
    n = normalize_url(F.col("url"))
    return pages_of(spark, sf_dir).select("page_id", matches_pattern(n, ["http://*/en/*", "https://*/en/*", "**.html"]).alias("included"), matches_pattern(n, ["https://**/de/*"]).alias("excluded"))


@query(f"""SELECT page_id, h = 'example.com' AS same, h = 'example.com' OR ends_with(h, '.example.com') AS with_subdomains, TRUE AS with_external FROM (SELECT page_id, {HOST} AS h FROM pages)""")
def domain_filter(spark, sf_dir):
    n = normalize_url(F.col("url"))
    return pages_of(spark, sf_dir).select("page_id", passes_domain_filter(n, "example.com").alias("same"), passes_domain_filter(n, "example.com", subdomains=True).alias("with_subdomains"), passes_domain_filter(n, "example.com", external=True).alias("with_external"))


# The flagship: every column of the flat report but its time. Meta tags are the derived ones; the text is that of the page with link syntax behind it.
def reported(spark, sf_dir) -> DataFrame:
    pages = tagged(spark, sf_dir).withColumn("whole", F.col("html")).withColumn("html", F.substring("html", F.instr("html", "</head>") + 7, F.length("html")))
    pages = with_marks(pages.withColumn("host", safe_host(normalize_url(F.col("url")))))
    rows = pages.select("page_id", normalize_url(F.col("url")).alias("url"), F.concat("whole", F.lit("<p>"), "markdown", F.lit("</p>")).alias("html"), F.when(F.col("page_id") % 8 != 0, 200 + F.col("page_id") % 5).cast("int").alias("status_code"))
    # Made once and dealt over the cores, as a corpus on disk would be: Spark would else merge the making into each pattern that reads the html.
    return rows.repartition(spark.sparkContext.defaultParallelism)


# Link syntax stands after the text, so that offsets shift by the text's length and one space.
REPORTED = MARKED.replace("WITH m AS", TAGGED.strip() + """,
b AS (SELECT page_id, t.url AS raw, h, html, """ + STRIP + """ AS body FROM p t),
m AS""").replace("md FROM m),", "md FROM m),\n", 1).replace("k AS (SELECT page_id, host, ", "k0 AS (SELECT page_id, host, ").replace("md FROM m),\n", "md FROM m),\nk AS (SELECT page_id, host, trim(regexp_replace(body || ' ' || md, '\\s+', ' ', 'g')) AS md FROM k0 JOIN b USING (page_id)),\n", 1)


def meta(key: str, value: str) -> str:
    return attr(key, value)


@query(REPORTED + f""", og AS (SELECT page_id, {meta('property', 'og:title')} AS t, {meta('property', 'og:description')} AS d, {meta('property', 'og:image')} AS i, {meta('property', 'og:url')} AS u FROM b),
tw AS (SELECT page_id, coalesce({meta('name', 'twitter:card')}, {meta('property', 'twitter:card')}) AS c, coalesce({meta('name', 'twitter:title')}, {meta('property', 'twitter:title')}) AS t,
  coalesce({meta('name', 'twitter:description')}, {meta('property', 'twitter:description')}) AS d, coalesce({meta('name', 'twitter:image')}, {meta('property', 'twitter:image')}) AS i FROM b),
ll AS (SELECT page_id, string_agg(url || '|' || anchor_text || '|' || type || '|' || location, ' ' ORDER BY pos) AS links, count(*) AS total, count(*) FILTER (type = 'internal') AS internal, count(*) FILTER (location = 'content') AS content FROM links GROUP BY page_id),
im AS (SELECT page_id, string_agg(url || '|' || alt || '|content', ' ' ORDER BY pos) AS images FROM (SELECT page_id, pos, trim(target) AS url, trim(anchor) AS alt, row_number() OVER (PARTITION BY page_id, trim(target) ORDER BY pos) AS r FROM x WHERE ends_with(s[pos + 1], '!')) WHERE r = 1 GROUP BY page_id)
SELECT b.page_id, (SELECT {NORM} FROM (SELECT raw AS url)) AS url, coalesce({TITLE}, '') AS title, {meta('name', 'description')} AS meta_description, {attr('rel', 'canonical', 'link', 'href', '+')} AS canonical_url, {meta('name', 'robots')} AS robots, {meta('name', 'author')} AS author, {LANGUAGE} AS language,
  CASE WHEN coalesce(og.t, '') || coalesce(og.d, '') || coalesce(og.i, '') || coalesce(og.u, '') <> '' THEN og.t END AS og_title, CASE WHEN coalesce(og.t, '') || coalesce(og.d, '') || coalesce(og.i, '') || coalesce(og.u, '') <> '' THEN og.d END AS og_description, og.i AS og_image, og.u AS og_url,
  CASE WHEN coalesce(tw.c, '') || coalesce(tw.t, '') || coalesce(tw.d, '') || coalesce(tw.i, '') <> '' THEN tw.t END AS twitter_title, tw.d AS twitter_description, tw.i AS twitter_image,
  CASE WHEN b.page_id % 6 = 0 THEN '{{"@id":' || b.page_id || ',"a":[1,null]}}' END AS page_schema, CASE WHEN b.page_id % 8 = 0 THEN 200 ELSE 200 + b.page_id % 5 END AS status_code, k.md AS content_snippet, length(k.md) AS text_length, coalesce(ll.links, '') AS links, coalesce(im.images, '') AS images,
  coalesce(ll.total, 0) AS links_total, coalesce(ll.internal, 0) AS links_internal, coalesce(ll.total - ll.internal, 0) AS links_external, coalesce(ll.content, 0) AS links_content, coalesce(ll.total - ll.content, 0) AS links_navigational
FROM b JOIN k USING (page_id) JOIN og USING (page_id) JOIN tw USING (page_id) LEFT JOIN ll USING (page_id) LEFT JOIN im USING (page_id)""")
def page_report(spark, sf_dir):
    """Flagship: the flat report of each page, read plainly (no renderer)."""
    out = report_of(page_rows(reported(spark, sf_dir), render=False), keep=["page_id"]).drop("processed_at")
    line = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(x[n] for n in f))), " ")
    rows = out.withColumns({"links": line("links", "url", "anchor_text", "type", "location"), "images": line("images", "url", "alt_text", "location"), "page_schema": F.array_join("page_schema", " ")})
    return rows.select(*(c for c in rows.columns if c != "links_count"), *(F.col(f"links_count.{n}").alias(f"links_{n}") for n in ("total", "internal", "external", "content", "navigational")))


# Robots: one file a host, of three kinds by the host's length.
ROBOTS = (
    "User-agent: *\nDisallow: /de/\nAllow: /de/1*\nCrawl-delay: 2\nSitemap: https://x.example.org/sitemap.xml",
    "# c\nUser-agent: badbot\nDisallow: /\n\nUser-agent: *\nUser-agent: other\nDisallow:\nDisallow: /*?\nAllow: /fr/*?page\nDisallow: /es/*.html$",
    "User-Agent: *\nCrawl-delay: 1.5s\nDisallow:\nuser-agent: late\nallow: /en\nDisallow: /en/*\n",
)


def robots_files(spark, sf_dir) -> DataFrame:
    host = safe_host(normalize_url(F.col("url")))
    kind = F.length("host") % 3
    return pages_of(spark, sf_dir).select(host.alias("host")).distinct().withColumn("content", F.when(kind == 0, ROBOTS[0]).when(kind == 1, ROBOTS[1]).otherwise(ROBOTS[2]))


RULES = f"""h AS (SELECT DISTINCT {HOST} AS host, length({HOST}) % 3 AS kind FROM pages),
r(kind, pos, pattern, allow, crawl_delay, re, n) AS (VALUES
 (0, 0, '/de/', FALSE, 2000.0 :: DOUBLE, '^/de/', 4), (0, 1, '/de/1*', TRUE, 2000.0, '^/de/1.*', 5),
 (1, 0, '/*?', FALSE, NULL, '^/.*\\?', 2), (1, 1, '/fr/*?page', TRUE, NULL, '^/fr/.*\\?page', 9), (1, 2, '/es/*.html$', FALSE, NULL, '^/es/.*\\.html$', 10),
 (2, 0, '/en', TRUE, 1500.0, '^/en', 3), (2, 1, '/en/*', FALSE, 1500.0, '^/en/.*', 4))"""


@query(f"WITH {RULES} SELECT host, pos :: BIGINT AS pos, pattern, allow, crawl_delay FROM h JOIN r USING (kind)")
def robots_parse(spark, sf_dir):
    return parse_robots_table(robots_files(spark, sf_dir)).select("host", "pos", "pattern", "allow", "crawl_delay")


@query(f"WITH {RULES} SELECT host, pos :: BIGINT AS pos, pattern, allow, crawl_delay, CASE kind WHEN 0 THEN 'https://x.example.org/sitemap.xml' END AS sitemap FROM h JOIN r USING (kind)")
def robots_parse_udf(spark, sf_dir):
    r = robots_files(spark, sf_dir).select("host", parse_robots(F.col("content")).alias("r"))
    return r.select("host", F.posexplode("r.rules").alias("pos", "x"), F.col("r.crawl_delay").alias("crawl_delay"), F.get("r.sitemaps", F.lit(0)).alias("sitemap")).select("host", F.col("pos").cast("long").alias("pos"), F.col("x.pattern").alias("pattern"), F.col("x.allow").alias("allow"), "crawl_delay", "sitemap")


ALLOWED = f"""WITH {RULES}, p AS (SELECT page_id, {HOST} AS host, regexp_extract({NORM}, '^https?://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, coalesce(arg_max(allow, n * 2 + allow :: INT), TRUE) AS allowed FROM p JOIN h USING (host) LEFT JOIN r ON r.kind = h.kind AND regexp_matches(path, re) GROUP BY page_id"""


@query(ALLOWED)
def robots_allowed(spark, sf_dir):
    pages = pages_of(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("url")).withColumn("host", safe_host(F.col("url")))
    return allowed_by_join(pages, parse_robots_table(robots_files(spark, sf_dir)), keys=["page_id"])


@query(ALLOWED)
def robots_allowed_array(spark, sf_dir):
    pages = pages_of(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("url")).withColumn("host", safe_host(F.col("url")))
    rules = robots_files(spark, sf_dir).select("host", parse_robots(F.col("content")).alias("r"))
    return pages.join(rules, "host", "left").select("page_id", is_url_allowed(F.col("url"), F.col("r.rules")).alias("allowed"))


# Fetch times: one queue for each top-level label, so queues are long; delays by the label's length, the default for two letters.
@query(f"""WITH p AS (SELECT list_last(string_split({HOST}, '.')) AS host, {NORM} AS url, page_id * 7919 % 100003 AS requested_at FROM pages),
d AS (SELECT *, CASE length(host) % 3 WHEN 0 THEN 90 WHEN 1 THEN 1500 ELSE 250 END AS delay, row_number() OVER (PARTITION BY host ORDER BY requested_at, url) - 1 AS seq FROM p)
SELECT host, url, requested_at, seq, delay * seq + max(requested_at - delay * seq) OVER (PARTITION BY host ORDER BY seq) AS fetch_at FROM d""")
def polite_schedule(spark, sf_dir):
    top = F.element_at(F.split(safe_host(F.col("url")), r"\."), -1)
    requests = pages_of(spark, sf_dir).select(normalize_url(F.col("url")).alias("url"), (F.col("page_id") * 7919 % 100003).alias("requested_at")).withColumn("host", top)
    known = F.when(F.length("host") % 3 == 0, 90).when(F.length("host") % 3 == 1, 1500)
    return fetch_schedule(requests, requests.select("host").distinct().withColumn("delay_ms", known), 250)


# Sitemaps: each host's pages as a urlset; an index of the hosts of each top-level label; a urlset that lists sitemap files.
def sitemap_files(spark, sf_dir) -> DataFrame:
    pages = pages_of(spark, sf_dir).select("page_id", "url", safe_host(normalize_url(F.col("url"))).alias("host"))
    prio = F.when(F.col("page_id") % 4 == 0, "<priority> 0.8abc </priority>").when(F.col("page_id") % 4 == 1, "<priority>high</priority>").when(F.col("page_id") % 4 == 2, "<priority>.35</priority>").otherwise("")
    entry = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc>"), prio, F.when(F.col("page_id") % 3 == 0, "<lastmod>2024-01-02</lastmod>").otherwise(""), F.lit("</url>\n"))
    sets = pages.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "").alias("content"))
    sets = sets.select("host", F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap-0.xml")).alias("url"), F.concat(F.lit("<urlset>"), F.col("content"), F.lit("</urlset>")).alias("content"))
    top = F.element_at(F.split("host", r"\."), -1)
    refs = sets.groupBy(top.alias("host"))
    listed = lambda a, b: F.array_join(F.transform(F.sort_array(F.collect_list("url")), lambda u: F.concat(F.lit(a), u, F.lit(b))), "")
    index = refs.agg(F.concat(F.lit("<sitemapindex>"), listed("<sitemap><loc>", "</loc></sitemap>"), F.lit("</sitemapindex>")).alias("content")).select("host", F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")).alias("url"), "content")
    like = refs.agg(F.concat(F.lit("<urlset>"), listed("<url><loc>", "</loc></url>"), F.lit("<url><loc>https://x/</loc></url></urlset>")).alias("content")).select("host", F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap1.xml")).alias("url"), "content")
    return sets.unionByName(index).unionByName(like)


SITEMAPS = f"""WITH p AS (SELECT page_id, url AS u, {HOST} AS host FROM pages),
s AS (SELECT host, 'https://' || host || '/sitemap-0.xml' AS url, count(*) AS n FROM p GROUP BY host),
t AS (SELECT list_last(string_split(host, '.')) AS top, count(*) AS n FROM s GROUP BY 1)
"""


@query(SITEMAPS + "SELECT url, 'urlset' AS type, n AS url_count FROM s UNION ALL SELECT 'https://' || top || '/sitemap.xml', 'index', n FROM t UNION ALL SELECT 'https://' || top || '/sitemap1.xml', 'index', n FROM t")
def sitemap_index_detect(spark, sf_dir):
    return parse_sitemap_table(sitemap_files(spark, sf_dir)).select("url", "type", "url_count")


ENTRIES = SITEMAPS + """, e AS (SELECT u AS url, CASE WHEN page_id % 3 = 0 THEN '2024-01-02' END AS lastmod, CASE page_id % 4 WHEN 0 THEN 0.8 :: DOUBLE WHEN 2 THEN 0.35 :: DOUBLE END AS priority, 'https://' || host || '/sitemap-0.xml' AS source, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS pos FROM p)
"""


@query(ENTRIES + "SELECT * FROM e")
def sitemap_parse(spark, sf_dir):
    return urls_of(parse_sitemap_table(sitemap_files(spark, sf_dir)))


@query(ENTRIES + f"""SELECT CASE WHEN regexp_extract(url, '^(https?://[^/?#]*)', 1) = 'https://example.com' THEN regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) ELSE url END AS url, 'sitemap-0.xml' AS sitemap_slug, source AS sitemap_url, priority, lastmod FROM e WHERE coalesce(priority, 0) >= 0.5""")
def sitemap_priority(spark, sf_dir):
    return sitemap_pages(urls_of(parse_sitemap_table(sitemap_files(spark, sf_dir))), "example.com", 0.5)


# Discovery of one domain, the first top-level label: its index and 49 of its children, by the cap of 50 sitemaps.
def first_top(spark, sf_dir) -> tuple[str, DataFrame]:
    store = sitemap_files(spark, sf_dir)
    return store.agg(F.min(F.element_at(F.split("host", r"\."), -1))).first()[0], store


DISCOVERED = ENTRIES + """, d AS (SELECT e.url, lastmod, priority, source, pos, dense_rank() OVER (ORDER BY source) AS ord, top FROM e, (SELECT min(top) AS top FROM t) WHERE list_last(string_split(regexp_extract(source, '^https://([^/]*)', 1), '.')) = top)
"""


@query(DISCOVERED + "SELECT ord, url, lastmod, priority, source, pos FROM d WHERE ord < 50")
def sitemap_discover_one(spark, sf_dir):
    top, store = first_top(spark, sf_dir)
    return discover_sitemaps(spark, top, store).urls.select("ord", "url", "lastmod", "priority", "source", "pos")


# Discovery of all top-level labels at once: each one's index and the first children in order, 12 sitemaps in all.
EACH_TOP = ENTRIES + """, a AS (SELECT top, 0 AS ord, 'https://' || top || '/sitemap.xml' AS source, 'index' AS type, n FROM t UNION ALL
  SELECT list_last(string_split(host, '.')), row_number() OVER (PARTITION BY list_last(string_split(host, '.')) ORDER BY url), url, 'urlset', n FROM s),
k AS (SELECT * FROM a WHERE ord < 12)
"""


def every_top(spark, sf_dir):
    store = sitemap_files(spark, sf_dir)
    return discover_many(store.select(F.element_at(F.split("host", r"\."), -1).alias("domain")).distinct(), store, max_sitemaps=12)


@query(EACH_TOP + "SELECT k.top AS domain, k.ord, e.pos, e.url, e.lastmod, e.priority, e.source FROM k JOIN e USING (source)")
def sitemap_discover_many(spark, sf_dir):
    return every_top(spark, sf_dir).urls


@query(EACH_TOP + "SELECT top AS domain, top AS host, count(*) AS n_sitemaps, CAST(coalesce(sum(n) FILTER (type = 'urlset'), 0) AS BIGINT) AS total_urls, (SELECT count(*) FROM a WHERE a.top = k.top) > 12 AS has_more FROM k GROUP BY top")
def sitemap_discover_totals(spark, sf_dir):
    return every_top(spark, sf_dir).summary


@query(EACH_TOP.replace("ord < 12", "ord < 50") + f"""SELECT top AS url, 200 AS status, top AS host, count(*) AS n_sitemaps, CAST(coalesce(sum(n) FILTER (type = 'urlset'), 0) AS BIGINT) AS total_urls,
(SELECT count(*) FROM a WHERE a.top = k.top) > 50 AS has_more, string_agg(source, ' ' ORDER BY ord) AS sitemaps, NULL AS error FROM k GROUP BY top
UNION ALL SELECT NULL, 400, NULL, NULL, NULL, NULL, NULL, '{NO_URL.replace("'", "''")}' UNION ALL SELECT 'https://', 500, NULL, NULL, NULL, NULL, NULL, 'Invalid URL'""")
def discover_endpoint(spark, sf_dir):
    """The discover endpoint for every top-level label, a request without url and one that is no URL."""
    store = sitemap_files(spark, sf_dir)
    odd = pages_of(spark, sf_dir).filter("page_id < 2").select(F.when(F.col("page_id") == 0, "https://").alias("url"))
    asked = store.select(F.element_at(F.split("host", r"\."), -1).alias("url")).unionByName(odd)
    found = discover_answers(PageStore(pages_of(spark, sf_dir).limit(0), sitemaps=store), asked).answers
    return found.withColumn("sitemaps", F.array_join(F.transform("sitemaps", lambda x: x["url"]), " "))


@query(DISCOVERED + f"""SELECT 0 :: BIGINT AS seq, 'https://' || min(top) || '/' AS url, 0 :: BIGINT AS depth FROM t UNION ALL
SELECT * FROM (SELECT row_number() OVER (ORDER BY ord, pos) AS seq, {NORM} AS url, 0 :: BIGINT FROM d WHERE ord < 50 ORDER BY seq LIMIT 199)""")
def crawl_start(spark, sf_dir):
    """The frontier that a crawl over sitemaps and links starts with: the seed, then sitemap URLs, 200 in all."""
    top, store = first_top(spark, sf_dir)
    state = start(spark, fr.CrawlConfig(f"https://{top}", obey_robots=False), PageStore(pages_of(spark, sf_dir).limit(0), sitemaps=store))
    return spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(state.frontier)], "seq long, url string, depth long")


@query(SITEMAPS + "SELECT host, url FROM s UNION ALL SELECT top, 'https://' || top || '/sitemap.xml' FROM t")
def sitemap_common(spark, sf_dir):
    store = sitemap_files(spark, sf_dir)
    hosts = store.select("host", F.concat(F.lit("https://"), F.col("host")).alias("origin")).distinct()
    return common_sitemaps(hosts, store)


TREE = SITEMAPS + "SELECT top AS host, 'https://' || top || '/sitemap.xml' AS url, 0 :: BIGINT AS depth, 'index' AS type, n AS url_count FROM t UNION ALL SELECT list_last(string_split(host, '.')), url, 1, 'urlset', n FROM s"


def tops(store: DataFrame) -> DataFrame:
    top = F.element_at(F.split("host", r"\."), -1)
    return common_sitemaps(store.select(top.alias("host"), F.concat(F.lit("https://"), top).alias("origin")).distinct(), store)


@query(TREE)
def sitemap_discover(spark, sf_dir):
    store = sitemap_files(spark, sf_dir)
    return sitemap_levels(tops(store), store)


@query(TREE)
def sitemap_discover_recursive(spark, sf_dir):
    store = sitemap_files(spark, sf_dir)
    return sitemap_tree(tops(store), store)


# Frontier: pages in order of page_id.
def queue(spark, sf_dir) -> DataFrame:
    return pages_of(spark, sf_dir).select(F.col("page_id").alias("seq"), normalize_url(F.col("url")).alias("url"), (F.col("page_id") % 4).alias("depth"))


QUEUE = f"WITH q AS (SELECT page_id AS seq, {NORM} AS url, page_id % 4 AS depth FROM pages)\n"


@query(QUEUE + "SELECT * FROM q ORDER BY seq LIMIT 25")
def frontier_take_bfs(spark, sf_dir):
    return fr.take(queue(spark, sf_dir), 25, "bfs")


@query(QUEUE + "SELECT * FROM q ORDER BY seq DESC LIMIT 25")
def frontier_take_dfs(spark, sf_dir):
    return fr.take(queue(spark, sf_dir), 25, "dfs")


@query(QUEUE + "SELECT * FROM (SELECT * FROM q WHERE depth < 2 UNION ALL SELECT seq + 1000000, url, depth FROM q WHERE depth >= 2) ORDER BY seq LIMIT 200")
def frontier_cap(spark, sf_dir):
    q = queue(spark, sf_dir)
    return fr.append(q.filter("depth < 2"), q.filter("depth >= 2").withColumn("seq", F.col("seq") + 1000000))


@query(QUEUE + "SELECT * FROM q WHERE url NOT IN (SELECT url FROM q WHERE seq % 5 = 0)")
def frontier_unvisited(spark, sf_dir):
    q = queue(spark, sf_dir)
    return fr.unvisited(q, q.filter("seq % 5 = 0"))


@query(QUEUE + """SELECT seq, base64(encode('{"url":"' || url || '","depth":' || depth || '}')) AS cursor FROM q""")
def cursor_short(spark, sf_dir):
    return queue(spark, sf_dir).select("seq", fr.short_cursor(F.struct("url", "depth")).alias("cursor"))


# Page graph: each page links to the next one to three pages of its host. near: edges have a column near, the page_id of the page that links.
def graph(spark, sf_dir, near: bool = False) -> tuple[DataFrame, DataFrame]:
    pages = pages_of(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("url")).withColumn("host", safe_host(F.col("url")))
    w = Window.partitionBy("host").orderBy("page_id")
    ahead = [F.when(F.col("page_id") % 3 >= k - 1, F.lead("url", k).over(w)) for k in (1, 2, 3)]
    edges = pages.withColumn("ahead", F.array(*ahead)).select(F.col("url").alias("src"), F.explode("ahead").alias("dst"), *[F.col("page_id").alias("near")] * near).filter("dst is not null")
    seeds = pages.groupBy("host").agg(F.min_by("url", "page_id").alias("url")).select("url")
    return seeds, edges


BFS = f"""WITH RECURSIVE p AS (SELECT page_id, {NORM} AS url, {HOST} AS host FROM pages),
e AS (SELECT url AS src, unnest([lead(url, 1) OVER w, CASE WHEN page_id % 3 >= 1 THEN lead(url, 2) OVER w END, CASE WHEN page_id % 3 >= 2 THEN lead(url, 3) OVER w END]) AS dst FROM p WINDOW w AS (PARTITION BY host ORDER BY page_id)),
b(url, depth) AS (SELECT arg_min(url, page_id), 0 :: BIGINT FROM p GROUP BY host UNION SELECT dst, depth + 1 FROM b JOIN e ON src = b.url WHERE dst IS NOT NULL AND depth < 6)
SELECT url, min(depth) AS depth FROM b GROUP BY url"""


@query(BFS)
def crawl_bfs_levels(spark, sf_dir):
    seeds, edges = graph(spark, sf_dir)
    return bfs_levels(seeds, edges, max_depth=6)


@query(BFS)
def crawl_bfs_recursive(spark, sf_dir):
    """The same traversal as one recursive query."""
    return walk(*graph(spark, sf_dir), max_depth=6)


@query(BFS)
def crawl_bfs_versioned(spark, sf_dir):
    """The same traversal, stopped after two levels and resumed from its versioned tables."""
    path = f"{checkpoint_base(spark)}/crawl-{uuid.uuid4().hex}"
    first = VersionedCrawl(spark, path)
    first.start(*graph(spark, sf_dir))
    first.resume(levels=2)
    first.forget()
    state = VersionedCrawl(spark, path)
    state.resume(max_depth=6)
    return state.visited()


@query()
def crawl_bfs_whole(spark, sf_dir):
    """Every reachable page: as many levels as the longest chain of a host has, so no recursive SQL and no round a level."""
    seeds, edges = graph(spark, sf_dir, near=True)
    return bfs_whole(seeds, edges, "near")


@query(f"""WITH {RULES}, p AS (SELECT page_id, {HOST} AS host, {NORM} AS u FROM pages),
a AS (SELECT page_id, any_value(u) AS u, coalesce(arg_max(allow, n * 2 + allow :: INT), TRUE) AS ok FROM p JOIN h USING (host) LEFT JOIN r ON r.kind = h.kind AND regexp_matches(regexp_extract(u, '^https?://[^/?#]*([^#]*)', 1), re) GROUP BY page_id)
SELECT CASE WHEN NOT ok THEN 'disallowed' WHEN regexp_full_match(u, '.*/es/.*') OR NOT regexp_full_match(u, 'https?://.*/[^/]*') THEN 'skipped' ELSE 'completed' END AS status, count(*) AS n FROM a GROUP BY 1""")
def crawl_status(spark, sf_dir):
    pages = pages_of(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("url")).withColumn("host", safe_host(F.col("url")))
    ok = allowed_by_join(pages, parse_robots_table(robots_files(spark, sf_dir)), keys=["page_id", "url"])
    skip = matches_pattern(F.col("url"), ["**/es/**"]) | ~matches_pattern(F.col("url"), ["http://**/*", "https://**/*"])
    return ok.select(F.when(~F.col("allowed"), "disallowed").when(skip, "skipped").otherwise("completed").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# A crawl of the host with most pages from its first page outside /de/ and /es/; its pages link to the next two: BFS takes them in order. /de/ is disallowed, /es/ not queued, so a
# page is reached from the page two before it, or else from the one before, if that one is completed.
def linked_store(spark, sf_dir) -> tuple[str, PageStore]:
    pages = pages_of(spark, sf_dir).groupBy(normalize_url(F.col("url")).alias("n")).agg(F.min("page_id").alias("page_id")).withColumn("host", safe_host(F.col("n")))
    w = Window.partitionBy("host").orderBy("page_id")
    body = F.concat(F.lit("<html><head><title>"), F.col("n"), F.lit("</title></head><body>"), *(F.coalesce(F.concat(F.lit('<a href="'), F.lead("n", k).over(w), F.lit('">next</a> ')), F.lit("")) for k in (1, 2)), F.lit("</body></html>"))
    most = pages.groupBy("host").count().orderBy(F.desc("count"), "host").first().host
    first = pages.filter((F.col("host") == most) & ~F.col("n").rlike("/(de|es)/")).orderBy("page_id").select("n", "host").first()
    robots = spark.createDataFrame([(first.host, "User-agent: *\nDisallow: /de/")], "host string, content string")
    return first.n, PageStore(pages.select(F.col("n").alias("url"), body.alias("html")), robots)


ONE_SEED = f"""WITH RECURSIVE n AS (SELECT min(page_id) AS page_id, {NORM} AS u, any_value({HOST}) AS h FROM pages GROUP BY 2),
o AS (SELECT page_id, u FROM n WHERE h = (SELECT h FROM n GROUP BY h ORDER BY count(*) DESC, h LIMIT 1)),
p AS (SELECT u, row_number() OVER (ORDER BY page_id) - 1 AS k, count(*) OVER () AS total FROM o WHERE page_id >= (SELECT min(page_id) FROM o WHERE NOT regexp_matches(u, '/(de|es)/'))),
s AS (SELECT u, k, total, u LIKE '%/es/%' AS skipped, regexp_matches(u, '^https?://[^/]*/de/') AS blocked FROM p),
r(k, depth, ok, depth0, ok0) AS (
  SELECT k, 0, NOT blocked, 0, FALSE FROM s WHERE k = 0 UNION ALL
  SELECT s.k, CASE WHEN skipped THEN NULL WHEN ok0 AND depth0 < 10 THEN depth0 + 1 WHEN ok AND depth < 10 THEN depth + 1 END,
    NOT skipped AND NOT blocked AND (ok0 AND depth0 < 10 OR ok AND depth < 10), depth, ok FROM r JOIN s ON s.k = r.k + 1 WHERE s.k < 2000)
SELECT row_number() OVER (ORDER BY k) - 1 AS ord, u AS url, CASE WHEN blocked THEN 'disallowed' ELSE 'completed' END AS status, depth, CASE WHEN NOT blocked THEN u END AS title, CASE WHEN blocked THEN 0 ELSE least(2, total - 1 - k) END AS n_links
FROM r JOIN s USING (k) WHERE depth IS NOT NULL ORDER BY k LIMIT 100"""


def crawled(pages: DataFrame) -> DataFrame:
    return pages.select("ord", "url", "status", "depth", F.col("metadata.title").alias("title"), F.size("links").alias("n_links"))


@query(ONE_SEED)
def crawl_one_seed(spark, sf_dir):
    """A bounded crawl from the first page, each URL once."""
    seed, store = linked_store(spark, sf_dir)
    config = fr.CrawlConfig(seed, source="links", extract_metadata=True, exclude_patterns=("**/es/**",))
    return crawled(crawl_batch(spark, config, store, compat=False, clock=lambda: 0).pages)


@query(ONE_SEED)
def crawl_resumed(spark, sf_dir):
    """The same crawl, stopped by its time budget again and again and resumed from the cursor."""
    seed, store = linked_store(spark, sf_dir)
    config = fr.CrawlConfig(seed, source="links", extract_metadata=True, exclude_patterns=("**/es/**",))
    out, cursor, before = [], None, 0
    while cursor or not out:
        ticks = itertools.count(step=3_000)
        batch = crawl_batch(spark, config, store, cursor, compat=False, clock=lambda: next(ticks))  # noqa: B023
        out.append(batch.pages.withColumn("ord", F.col("ord") + before))
        cursor, before = batch.cursor, batch.stats.total_pages_crawled
    return crawled(functools.reduce(DataFrame.unionByName, out))


# Crawls of many sites at once: 40 pages a site, page k links to 3k+1 to 3k+3, to k+1 and back; /de/ is disallowed, /es/ not followed, some pages are missing. The SQL
# takes one page after the other from each site's queue of at most 6.
def forty_page_sites(spark, sf_dir) -> tuple[DataFrame, PageStore]:
    pages = pages_of(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("title"), F.floor(F.col("page_id") / 40).alias("site"), (F.col("page_id") % 40).alias("k"))
    url = lambda k: F.concat(F.lit("https://s"), F.col("site"), F.lit(".example/"), F.when(k % 7 == 3, "de/").when(k % 9 == 5, "es/").otherwise("en/"), k)
    pages = pages.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("site")))
    k = F.col("k")
    to = [k * 3 + 1, k * 3 + 2, k * 3 + 3, k + 1, F.when(k > 0, F.floor((k - 1) / 3))]
    links = F.concat(*(F.coalesce(F.when(t < F.col("n"), F.concat(F.lit('<a href="'), url(t), F.lit('">go</a> '))), F.lit("")) for t in to))
    html = F.concat(F.lit("<html><head><title>"), "title", F.lit("</title></head><body>"), links, F.lit("</body></html>"))
    robots = pages.filter("k = 0").select(F.concat(F.lit("s"), "site", F.lit(".example")).alias("host"), F.lit("User-agent: *\nDisallow: /de/\nCrawl-delay: 1").alias("content"))
    return pages.filter("k = 0").select(url(k).alias("url")), PageStore(pages.filter("k % 10 <> 8").select(url(k).alias("url"), html.alias("html")), robots)


MANY = f"""WITH RECURSIVE s AS (SELECT page_id // 40 AS site, count(*) AS n FROM pages GROUP BY 1),
q(site, n, ord, k, depth, queue, seen) AS (
  SELECT site, n, 0 :: BIGINT, 0 :: BIGINT, 0 :: BIGINT, [] :: STRUCT(k BIGINT, d BIGINT)[], [0 :: BIGINT] FROM s UNION ALL
  SELECT site, n, ord + 1, rest[1].k, rest[1].d, rest[2:], seen || kids FROM (
    SELECT *, queue || list_transform(kids[:greatest(0, 6 - len(queue))], lambda x: {{'k': x, 'd': depth + 1}}) AS rest FROM (
      SELECT *, CASE WHEN k % 7 = 3 OR k % 10 = 8 THEN [] ELSE list_filter([3 * k + 1, 3 * k + 2, 3 * k + 3] || CASE WHEN k = 0 THEN [] ELSE [k + 1] END, lambda x: x < n AND x % 9 <> 5 AND NOT list_contains(seen, x)) END AS kids FROM q))
  WHERE len(rest) > 0 AND ord + 1 < 12),
u AS (SELECT *, 'https://s' || site || '.example/' AS root, CASE WHEN k % 7 = 3 THEN 'de/' WHEN k % 9 = 5 THEN 'es/' ELSE 'en/' END || k AS path,
  CASE WHEN k % 7 = 3 THEN 'disallowed' WHEN k % 10 = 8 THEN 'error' ELSE 'completed' END AS status FROM q)
"""


@query(MANY + f"""SELECT root || 'en/0' AS seed, ord, root || path AS url, status, depth, CASE WHEN status = 'completed' THEN t.title END AS title, ord * 1000.0 :: DOUBLE AS not_before,
CASE WHEN status = 'completed' THEN len(list_distinct(list_filter([3 * k + 1, 3 * k + 2, 3 * k + 3, k + 1] || CASE WHEN k = 0 THEN [] ELSE [(k - 1) // 3] END, lambda x: x < n))) ELSE 0 END AS n_links,
CASE WHEN status = 'error' THEN 'page not in store' END AS error FROM u JOIN (SELECT page_id, {NORM} AS title FROM pages) t ON t.page_id = site * 40 + k""")
def crawl_many_sites(spark, sf_dir):
    seeds, store = forty_page_sites(spark, sf_dir)
    pages = crawl_many(store, seeds, source="links", max_pages=12, frontier_capacity=6, concurrency=1, extract_metadata=True, exclude_patterns=("**/es/**",)).pages
    return pages.select("seed", "ord", "url", "status", "depth", F.col("metadata.title").alias("title"), "not_before", F.size("links").alias("n_links"), "error")


@query(MANY + """, last AS (SELECT root || 'en/0' AS seed, ord + 1 AS pages_crawled, len(queue) + CASE WHEN status <> 'completed' THEN 0 ELSE least(greatest(0, 6 - len(queue)),
  len(list_filter([3 * k + 1, 3 * k + 2, 3 * k + 3] || CASE WHEN k = 0 THEN [] ELSE [k + 1] END, lambda x: x < n AND x % 9 <> 5 AND NOT list_contains(seen, x)))) END AS pages_remaining
  FROM u QUALIFY ord = max(ord) OVER (PARTITION BY site))
SELECT *, CASE WHEN pages_remaining > 0 THEN 'limit' ELSE 'complete' END AS stop_reason FROM last""")
def crawl_many_stats(spark, sf_dir):
    seeds, store = forty_page_sites(spark, sf_dir)
    return crawl_many(store, seeds, source="links", max_pages=12, frontier_capacity=6, concurrency=1, exclude_patterns=("**/es/**",)).stats


@query(MARKED + "SELECT page_id, url FROM links WHERE type = 'internal' AND (regexp_extract(url, '^https?://([^/?#:]*)', 1) = 'example.com' OR ends_with(regexp_extract(url, '^https?://([^/?#:]*)', 1), '.example.com')) AND url NOT LIKE '%/es/%'")
def crawl_followable(spark, sf_dir):
    links = links_table(marked(spark, sf_dir).withColumnRenamed("url", "page_url"), "markdown", "page_url", ["page_id"])
    return followable(links, fr.CrawlConfig("https://example.com", include_subdomains=True, exclude_patterns=("**/es/**",)), "example.com").select("page_id", "url")


# One page for each normalised URL, the least html.
def least_pages(spark, sf_dir) -> DataFrame:
    return pages_of(spark, sf_dir).groupBy(normalize_url(F.col("url")).alias("url")).agg(F.min("html").alias("html"))


LEAST = f"w AS (SELECT {NORM} AS u, min(html) AS html, any_value({HOST}) AS host FROM pages GROUP BY 1)"


@query(f"""WITH {LEAST}, q AS (SELECT page_id, page_id % 4 = 1 AS bad, CASE page_id % 4 WHEN 2 THEN '' WHEN 3 THEN 'https://example.com/' ELSE {NORM} END AS u FROM pages),
a AS (SELECT page_id, bad, CASE WHEN NOT bad THEN w.html END AS body FROM q LEFT JOIN w USING (u))
SELECT page_id, CASE WHEN bad THEN 'pdf' ELSE 'html' END AS format, CASE WHEN bad THEN 400 WHEN body IS NULL THEN 500 ELSE 200 END AS status,
CASE WHEN body IS NULL THEN 'application/json' ELSE 'text/html; charset=utf-8' END AS content_type, body, CASE WHEN bad THEN '{BAD_FORMAT}' WHEN body IS NULL THEN 'page not in store' END AS error FROM a""")
def fetch_endpoint(spark, sf_dir):
    """The fetch endpoint: pages, a format that is none, pages that are missing, requests without url (the default page)."""
    i = F.col("page_id") % 4
    asked = pages_of(spark, sf_dir).select("page_id", F.when(i < 2, F.col("url")).when(i == 2, F.concat(normalize_url(F.col("url")), F.lit("-none"))).alias("url"), F.when(i == 1, "pdf").otherwise("html").alias("format"))
    return fetch_answers(PageStore(least_pages(spark, sf_dir)), asked).drop("url")


@query(f"""WITH {RULES}, {LEAST},
a AS (SELECT u, coalesce(arg_max(allow, n * 2 + allow :: INT), TRUE) AS ok FROM w JOIN h USING (host) LEFT JOIN r ON r.kind = h.kind AND regexp_matches(regexp_extract(u, '^https?://[^/?#]*([^#]*)', 1), re) GROUP BY u)
SELECT u AS url, CASE WHEN ok THEN 200 END AS status_code, CASE WHEN ok THEN html END AS content FROM a JOIN w USING (u)""")
def fetch_obeying_robots(spark, sf_dir):
    pages = least_pages(spark, sf_dir)
    return PageStore(pages, robots_files(spark, sf_dir)).fetch(pages.select("url"), obey_robots=True)


@query(f"""WITH {LEAST}, f AS (SELECT u, CASE WHEN length(u) % 3 = 0 THEN u || '-frame' WHEN length(u) % 3 = 1 THEN u || '-none' ELSE u || '-frame' END AS src FROM w)
SELECT u AS url, '<body><iframe src="' || src || '"></iframe>' || CASE WHEN src LIKE '%-frame' THEN '<div>$1 \\ framed by ' || u || '</div>' ELSE '' END || ' end</body>' AS content FROM f""")
def fetch_with_frames(spark, sf_dir):
    """Every page holds a frame; two in three frames have a page."""
    pages = least_pages(spark, sf_dir)
    src = F.concat("url", F.when(F.length("url") % 3 == 1, "-none").otherwise("-frame"))
    outer = pages.select("url", F.concat(F.lit('<body><iframe src="'), src, F.lit('"></iframe> end</body>')).alias("html"))
    inner = pages.select(F.concat("url", F.lit("-frame")).alias("url"), F.concat(F.lit("<html><body class='x'>$1 \\ framed by "), "url", F.lit("</body></html>")).alias("html"))
    return PageStore(outer.unionByName(inner)).fetch(outer.select("url"), with_frames=True).select("url", "content")


@query(f"""WITH {RULES}, s AS (SELECT DISTINCT host, kind, CASE WHEN length(host) % 2 = 0 THEN host ELSE 'https://' || host || '/a/b?c' END AS site FROM h)
SELECT site, host, 'https://' || host || '/robots.txt' AS robots_url, kind <> 1 AS found FROM s""")
def robots_read_many(spark, sf_dir):
    """robots.txt of all hosts, named by host or by some URL; a third of them have none."""
    files = robots_files(spark, sf_dir)
    site = F.when(F.length("host") % 2 == 0, F.col("host")).otherwise(F.concat(F.lit("https://"), "host", F.lit("/a/b?c")))
    store = PageStore(pages_of(spark, sf_dir).limit(0), files.filter(F.length("host") % 3 != 1))
    return store.robots_for(files.select(site.alias("site"))).select("site", "host", "robots_url", F.col("content").isNotNull().alias("found"))


# A page that SQL can write as markdown and as an outline.
@query(f"""SELECT page_id, '# Page ' || page_id || chr(10) || chr(10) || 'Some **bold** text & [go on](' || {ORIGIN} || '/x/' || page_id || ') ![pic](' || {ORIGIN} || '/p.png)' || chr(10) || chr(10) || '- a' || chr(10) || '- b' AS markdown,
'Page ' || page_id AS heading, CAST(11 AS BIGINT) AS nodes FROM pages""")
def render_simple(spark, sf_dir):
    s = F.col("page_id").cast("string")
    html = F.concat(F.lit("<html><head><title>t</title></head><body><script>x()</script><h1>Page "), s, F.lit('</h1><p>Some  <b>bold</b>\ntext &amp; <a href="/x/'), s, F.lit('">go <span>on</span></a> <img src="/p.png" alt="pic"></p><ul><li>a</li><li>b</li></ul></body></html>'))
    rows = pages_of(spark, sf_dir).select("page_id", "url", html.alias("html"))
    tree = F.split(render_html(F.col("html"), F.col("url"), "semantic_tree"), "\n")
    text = F.transform(F.split(render_html(F.col("html"), F.col("url"), "semantic_tree_text"), "\n"), lambda x: F.trim(x))
    return rows.select("page_id", render_html(F.col("html"), F.col("url"), "markdown").alias("markdown"), F.get(text, F.lit(0)).alias("heading"), F.size(F.filter(tree, lambda x: ~F.trim(x).startswith('"'))).cast("long").alias("nodes"))
