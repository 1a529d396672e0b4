import hashlib
import re

import pytest
from pyspark.sql import functions as F

from webloom.llm import exact_dedup

LONG = "Lorem ipsum dolor sit amet and so on. " * 400
ROWS = [(5, "a  b"), (3, "a\n\tb"), (9, "a b "), (4, None), (2, ""), (7, LONG), (8, LONG.replace(" ", "\n")), (6, LONG + "x"), (None, "a b"), (None, "only null"), (3, "a b"), (10, "z" * 9000), (11, "z" * 9001), (12, "naïve a b")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def want(rows):
    out = []
    for d, t in rows:
        ids = [i for i, x in rows if norm(x) == norm(t)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: F.pmod(F.length(c), F.lit(2)).cast("long")], ids=["hash", "clashing"])
def test_groups(spark, hash_of):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS recipe", "2 AS h")
    assert sorted(map(tuple, exact_dedup.groups(df, hash_of=hash_of).collect()), key=str) == want(ROWS)


def test_chunks_join_to_the_text(spark):
    df = spark.createDataFrame([(t,) for _, t in ROWS if t], "text string").withColumn("t", exact_dedup.normalised(F.col("text")))
    for r in df.withColumn("c", exact_dedup.chunks_of(F.col("t"))).collect():
        assert "".join(r.c) == r.t and all(len(c) <= exact_dedup.MOST for c in r.c)


def test_dedup_and_hot_group(spark, monkeypatch):
    from webloom.llm import _common

    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    df = spark.createDataFrame([*ROWS, (3, "a b")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "_key", "Key_", "kept", "chunks", "_chunks", "recipe", "doc", "_doc")})
    got = exact_dedup.dedup(df)
    assert got.columns == df.columns
    left = {(d, sha) for d, _, _, kept, sha in want(ROWS) if kept}
    assert sorted(str((r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest())) for r in got.collect()) == sorted(map(str, left))
    assert exact_dedup.groups(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    text = "".join(f"word{i % 9973} of {i}, " for i in range(150_000))
    rows = [(4, text), (2, text.replace(" ", "\n\t")), (3, text + "."), (9, "." + text)]
    assert sorted(map(tuple, exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want(rows)
