import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from webloom.llm import periodic_runs
from webloom.llm.queries import QUERIES


def brute(ids, min_length=24, exponent=3):
    """All runs by trying every period."""
    n, out = len(ids), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            a, length = i, j + q - i
            i = j + 1
            if length >= max(min_length, exponent * q) and not any(all(ids[x] == ids[x + d] for x in range(a, a + length - d)) for d in range(1, q)):
                out.add((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(r):
    ids = []
    for _ in range(r.randrange(1, 6)):
        unit = [r.randrange(r.choice([2, 3, 50])) for _ in range(r.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40]))]
        ids += [r.randrange(r.choice([2, 60])) for _ in range(r.randrange(0, 12))] + (unit * 9)[: r.randrange(1, 5 * len(unit) + 20)]
    return ids


def test_equals_trying_every_period():
    r = random.Random(7)
    for _ in range(400):
        ids = planted(r)
        assert periodic_runs.find_runs(np.array(ids)) == brute(ids), ids


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 100, 257])
def test_one_word_and_small_alphabets(n):
    r = random.Random(n)
    for ids in ([0] * n, [i % 2 for i in range(n)], [r.randrange(2) for _ in range(n)], [bin(i).count("1") % 2 for i in range(n)]):
        assert periodic_runs.find_runs(np.array(ids, np.int64)) == brute(ids)


@pytest.mark.parametrize(("min_length", "exponent"), [(1, 3), (5, 3), (12, 4), (60, 3), (200, 5)])
def test_other_limits(min_length, exponent):
    r = random.Random(min_length)
    for _ in range(60):
        ids = planted(r)
        assert periodic_runs.find_runs(np.array(ids), min_length, exponent) == brute(ids, min_length, exponent)


def test_every_period_at_every_offset():
    for q in range(1, 70):
        length = max(24, 3 * q)
        for lead in (0, 1, 5, q):
            ids = [-1 - i for i in range(lead)] + [i % q for i in range(length)] + [-100 - lead]
            ids = np.unique(ids, return_inverse=True)[1]
            assert periodic_runs.find_runs(ids) == [(lead, length, q)]


def test_long_periodic_texts_take_little_time():
    for ids in (np.zeros(60_000, np.int64), np.arange(60_000) % 9_001, np.tile(np.random.default_rng(1).integers(0, 40, 300), 200)):
        began = time.perf_counter()
        ((start, length, _),) = periodic_runs.find_runs(ids)
        assert (start, length) == (0, 60_000) and time.perf_counter() - began < 20


def words_of(doc_id, text):
    """The contract's words, by its letter."""
    w = [x for x in (text or "").encode().split() if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = words_of(doc_id, text)
    ids = [dict((x, i) for i, x in enumerate(dict.fromkeys(w)))[x] for x in w] if len(w) < 500 else periodic_runs.number(w).tolist()
    runs = brute(ids)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    milli = 1000 * top[1] // top[2] if top else None
    return (doc_id, len(runs), *(top or (None,) * 3), milli, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    from compare import SF

    few = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r.text or "").split()) < 700]
    r = random.Random(3)
    many = [(10_000 + i, " ".join(map(str, planted(r)))) for i in range(200)]
    rows = [*few, *many, (-5, "a " * 40), (None, "b \t\x0b\x0c\r\n" * 30), (7, None), (8, ""), (9, "x y"), (9, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*x) for x in rows), key=str)
    assert sum(x[1] > 0 for x in got) > 50


def test_tables(spark):
    df = spark.createDataFrame([(1, "p " + "a b c " * 9 + "q", 1), (2, "none", 2), (3, None, 3)], "doc_id long, text string, start int")
    assert [tuple(r) for r in periodic_runs.runs(df).collect()] == [(1, 1, 27, 3, "a b c")]
    assert sorted(map(tuple, periodic_runs.collapse(df).collect())) == [(1, 1, 24, "p a b c q"), (2, 0, 0, "none"), (3, 0, 0, "")]
    assert periodic_runs.digest(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(30, np.int64), exponent=2)


def test_one_very_long_text(spark):
    text = " ".join(f"w{i * i % 9973}" for i in range(120_000)) + " tail" * 30
    (row,) = periodic_runs.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (120_000, 30, 1) in periodic_runs.find_runs(periodic_runs.number(text.encode().split())) and row.n_runs >= 1
