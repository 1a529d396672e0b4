import itertools
import random
from collections import Counter

import pytest

from webloom.llm import filter_audit


def fails(text, later):
    t = text or ""
    w = t.encode().split()
    tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), later]
    return "".join(x for x, y in zip("ABCDE", tests, strict=True) if y)


def brute(rows, labels):
    """By the contract's letter, one order and step at a time."""
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    masks = []
    for d, text, lang in rows:
        same = [e for e, t, _ in rows if (t or "") == (text or "") and e is not None]
        masks.append((lang or "", fails(text, any(d is None or e < d for e in same)), d in good, d in toxic))
    out = []
    for part in sorted({m[0] for m in masks}):
        removed = Counter()
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                now = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                unique = sum(m[1] == x for m in masks if m[0] == part)
                lines.append((part, order, step, len(left), len(now), sum(x in m[1] for m in gone), unique, sum(m[2] for m in now), sum(m[3] for m in now), x))
                gone += now
                removed[x] += len(now)
        out += [(*line[:-1], removed[line[-1]]) for line in lines]
    return out


def tables(spark, seed, n):
    r = random.Random(seed)
    long = [" ".join(f"w{r.randrange(k)}" for _ in range(m)) for k, m in ((90, 200), (900, 250), (900, 199), (50, 400))]
    pool = [None, "", " ", "a b", "A B", "x # y", "é" * 3, *long, *(t + " #" for t in long), long[1].upper(), long[1] + "!", *(t[:-1] + "z" for t in long)]
    rows = [(r.choice([None, *range(n)]), r.choice(pool) if r.random() < 0.7 else f"alone {i} " * r.randrange(1, 150), r.choice([None, "", "en", "de"])) for i in range(n)]
    labels = [(r.choice([None, *range(n)]), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS part", "2 AS k", "3 AS fails").repartition(4)
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_equals_brute_force_whatever_the_hashes(spark, bits):
    rows, labels, docs, told = tables(spark, 5 + bits, 150)
    assert sorted(map(tuple, filter_audit.audit(docs, told, bits).collect())) == sorted(brute(rows, labels))


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(filter_audit, "BITS", 64)
    rows, labels, docs, told = tables(spark, 9, 80)
    assert sorted(map(tuple, filter_audit.audit(docs, told).collect())) == sorted(brute(rows, labels))


def test_duplicates_of_long_texts(spark):
    """Texts that differ in one place only: the first block, the second, the last."""
    base = "abcdefghij" * 500
    rows = [(i, t) for i, t in enumerate([base, "X" + base[1:], base[:500] + "X" + base[501:], base[:-1] + "X", base, base[:-1], "😀" + base[1:], base])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.doc_id for r in filter_audit.duplicates(docs).collect() if r.later} == {4, 7}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and {r.part for r in got} == {""}
