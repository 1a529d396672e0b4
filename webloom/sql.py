"""SQL names for the functions that Spark lacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.metadata import canonical_json
from webloom.functions.render import render_one
from webloom.functions.tables import register_tables
from webloom.functions.urls import normalize_one, url_hash_one
from webloom.operators.robots import RULES, parse_robots_one
from webloom.session import ship


def register_functions(spark: SparkSession) -> None:
    """normalize_url, render_markdown, parse_robots, url_hash and canonical_json for spark.sql(), and the table functions links, images, robots_rules and fetch_times."""
    ship(spark)
    register_tables(spark)

    @F.pandas_udf(T.StringType())
    def normalize_url(u: pd.Series) -> pd.Series:
        return u.map(normalize_one, na_action="ignore")

    @F.pandas_udf(T.StringType())
    def render_markdown(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([render_one(h, b, "markdown", ()) for h, b in zip(html, url, strict=True)], dtype=object)

    @F.pandas_udf(T.LongType())
    def url_hash(u: pd.Series) -> pd.Series:
        return u.map(url_hash_one, na_action="ignore")

    @F.pandas_udf(T.StringType())
    def json_form(s: pd.Series) -> pd.Series:
        return s.map(canonical_json, na_action="ignore")

    @F.pandas_udf(RULES)
    def parse_robots(content: pd.Series) -> pd.DataFrame:
        rows = [parse_robots_one(t) for t in content]
        return pd.DataFrame({"rules": [[{"pattern": p, "allow": a} for p, a in r.rules] for r in rows], "crawl_delay": pd.Series([r.crawl_delay for r in rows], dtype="float64"), "sitemaps": [r.sitemaps for r in rows]})

    for name, fn in {"normalize_url": normalize_url, "render_markdown": render_markdown, "url_hash": url_hash, "canonical_json": json_form, "parse_robots": parse_robots}.items():
        spark.udf.register(name, fn)
