"""JSON-LD as typed values: the nodes of a page's scripts as VARIANT, fields by path, and what a corpus holds by type.

Scripts are parsed strictly first (json_ld_of: malformed ones are left out, of equal keys the last wins), since
Spark's own parser stops at the end of the first value and refuses equal keys. From there all is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.metadata import head_of, json_ld_of
from webloom.functions.text import fresh
from webloom.session import ship


def variant_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null: the JSON type of a VARIANT; SQL null for SQL null."""
    form = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(value.isNull(), None).when(form.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(form)).when(form == "VOID", "null").otherwise("number")


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _nodes(script: Column) -> Column:
    """A script's values: of an array each element, of an object with an array @graph its elements, else the value itself."""
    tops = F.coalesce(_items(script, "$"), F.array(script))
    return F.flatten(F.transform(tops, lambda v: F.coalesce(_items(v, "$['@graph']"), F.array(v))))


def types_of(node: Column) -> Column:
    """@type as an array of its strings, in order; empty where there is none."""
    one = F.try_variant_get(node, "$['@type']", "variant")
    many = F.coalesce(_items(one, "$"), F.array(one))
    return F.transform(F.filter(many, lambda t: variant_kind(t) == "string"), lambda t: F.try_variant_get(t, "$", "string"))


def json_ld_nodes(pages: DataFrame, html: str = "html", keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keep, and script, node_pos (both long, from 0), id, types, node (VARIANT): one row for each object in the JSON-LD of a page's head.

    Values that aren't objects are no nodes, and leave a gap in node_pos. A number too large for Spark (1e400) makes its
    script no VARIANT; it then has no nodes. Null html has none.
    """
    ship(pages.sparkSession)
    texts, values = fresh(pages, "texts"), fresh(pages, "values")
    scripts = pages.select(*(F.col(f"`{c}`") for c in keep), json_ld_of(head_of(F.col(f"`{html}`"))).alias(texts))
    kept = [F.col(f"`{c}`") for c in keep]
    scripts = scripts.select(*kept, F.posexplode(texts).alias("script", values))
    nodes = scripts.select(*kept, F.col("script").cast("long").alias("script"), F.posexplode(_nodes(F.try_parse_json(values))).alias("node_pos", "node")).filter(variant_kind(F.col("node")) == "object")
    return nodes.select(*kept, "script", F.col("node_pos").cast("long").alias("node_pos"), F.try_variant_get("node", "$['@id']", "string").alias("id"), types_of(F.col("node")).alias("types"), "node")


def json_ld_fields(nodes: DataFrame, fields: dict[str, tuple[str | tuple[str, ...], str]]) -> DataFrame:
    """nodes with a column for each field: name -> (path or paths, type). The first path with a value of that type counts; else null."""

    def read(paths: str | tuple[str, ...], kind: str) -> Column:
        return F.coalesce(*(F.try_variant_get("node", p, kind) for p in ([paths] if isinstance(paths, str) else paths)))

    return nodes.withColumns({n: read(*spec) for n, spec in fields.items()})


def json_ld_profile(nodes: DataFrame) -> DataFrame:
    """type ("" for untyped nodes), field, kind, n: how many nodes of a type hold a top-level field with a value of each kind. A node of several types counts for each."""
    rows = nodes.select(F.explode(F.when(F.size("types") > 0, F.array_distinct("types")).otherwise(F.array(F.lit("")))).alias("type"), F.try_variant_get("node", "$", "map<string,variant>").alias("fields"))
    rows = rows.select("type", F.explode("fields").alias("field", "value"))
    return rows.select("type", "field", variant_kind(F.col("value")).alias("kind")).groupBy("type", "field", "kind").agg(F.count(F.lit(1)).alias("n"))


def json_ld_schemas(nodes: DataFrame) -> DataFrame:
    """type ("" for untyped nodes), n, schema: the merged schema of all nodes of a type, as Spark writes it, from partial schemas merged on both sides of the shuffle."""
    rows = nodes.select(F.explode(F.when(F.size("types") > 0, F.array_distinct("types")).otherwise(F.array(F.lit("")))).alias("type"), "node")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg("node").alias("schema"))
