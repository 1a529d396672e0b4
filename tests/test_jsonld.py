import json

from webloom.functions.jsonld import json_ld_fields, json_ld_nodes, json_ld_profile, json_ld_schemas
from webloom.functions.metadata import canonical_json, json_ld_of

SCRIPTS = [
    ['{"@type":"A","x":1}', '{"@type":"A",}', '{"@type":"A"} more'],
    ['[{"@type":["A","B",7],"x":"s"},3,"t",{"@graph":[{"@id":"g","x":null},{"@type":{"no":1}}]}]'],
    ['{"@type":"A","x":1,"x":[2.5]}', '"text"', "[]", "null"],
    ['{"@graph":{"x":true}}', '{"a":NaN}', "", '{"n":1e400}', '{"s":"\\ud800\\u00e9"}'],
    [],
]


def table(spark):
    page = lambda scripts: "<head>" + "".join(f"<script type='application/ld+json'>{x}</script>" for x in scripts) + "</head>"
    return spark.createDataFrame([(i, page(x), "n", "s") for i, x in enumerate(SCRIPTS)] + [(9, None, "n", "s")], "page_id int, html string, texts string, values string")


def plain():
    """(page, script, position, node) by Python's own parser."""
    for page, scripts in enumerate(SCRIPTS):
        good = [json.loads(c) for x in scripts if (c := canonical_json(x)) is not None]
        for s, value in enumerate(good):
            if value == {"n": float("inf")}:
                continue
            flat = [n for v in (value if isinstance(value, list) else [value]) for n in (v["@graph"] if isinstance(v, dict) and isinstance(v.get("@graph"), list) else [v])]
            yield from ((page, s, k, n) for k, n in enumerate(flat) if isinstance(n, dict))


def test_nodes_types_and_profile_against_plain_parsing(spark):
    nodes = json_ld_nodes(table(spark), keep=["page_id"])
    got = {(r.page_id, r.script, r.node_pos): (r.id, list(r.types), json.loads(r.text)) for r in nodes.selectExpr("*", "to_json(node) AS text").drop("node").collect()}
    want = {}
    for page, s, k, n in plain():
        t = n.get("@type")
        want[page, s, k] = (n.get("@id"), [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)], n)
    lone = (3, 2, 0)  # to_json replaces its lone surrogate
    assert {k: v for k, v in got.items() if k != lone} == {k: v for k, v in want.items() if k != lone} and lone in got
    counts = {}
    kind = lambda v: {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    for _, types, n in want.values():
        for t in dict.fromkeys(types) or [""]:
            for f, v in n.items():
                counts[t, f, kind(v)] = counts.get((t, f, kind(v)), 0) + 1
    assert {(r.type, r.field, r.kind): r.n for r in json_ld_profile(nodes).collect()} == counts


def test_typed_fields_and_schemas(spark):
    nodes = json_ld_nodes(table(spark), keep=["page_id"])
    rows = json_ld_fields(nodes, {"x": ("$.x", "long"), "first": (("$.x[0]", "$.x"), "double")}).filter("array_contains(types, 'A')").orderBy("page_id", "script", "node_pos").collect()
    assert [(r.page_id, r.x, r["first"]) for r in rows] == [(0, 1, 1.0), (1, None, None), (2, None, 2.5)]
    schemas = {r.type: (r.n, r.schema) for r in json_ld_schemas(nodes).collect()}
    assert schemas["A"] == (3, "OBJECT<`@type`: VARIANT, x: VARIANT>") and schemas["B"][0] == 1
    assert json_ld_nodes(table(spark).limit(0)).collect() == []


def test_lone_surrogates_stay_escaped(spark):
    """A lone surrogate has no UTF-8 form: its escape is kept, and the page doesn't fail."""
    assert canonical_json('"\\ud800 \\ud83d\\ude00"') == '"\\ud800 😀"'
    got = table(spark).filter("page_id = 3").select(json_ld_of("html").alias("x")).first().x
    assert got[-1] == '{"s":"\\ud800é"}'
