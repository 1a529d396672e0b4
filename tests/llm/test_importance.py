import random
import re

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import importance as I
from webloom.llm._text import slices


def corpus(n=300):
    r = random.Random(3)
    good = ["river", "walked", "the", "and", "slowly", "evening", "house"]
    bad = ["BUY!!", "CLICK!!", "$$$", "FREE!!"]
    return [(i, " ".join(r.choice(good if i % 3 else bad) for _ in range(40))) for i in range(n)]


def test_keeps_wanted(spark):
    rows = [*corpus(), (None, "the river"), (None, None), (1000, ""), (4, corpus()[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS kept", "3 AS _key")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    out = I.weigh(df, labels).collect()
    kept = {r.doc_id for r in out if r.kept}
    good = {i for i in range(300) if i % 3}
    assert len(out) == len(rows) and len(kept & good) >= 0.97 * len(good) and not {i for i in range(300) if i % 3 == 0} & kept
    assert all(r.weight is None and not r.kept for r in out if r.doc_id == 1000)
    held = I.keep(df, labels)
    assert held.columns == df.columns and held.count() == sum(r.kept for r in out)
    assert I.weigh(df, labels.limit(0)).filter("kept").count() == len(rows) - 2
    assert I.weigh(df.limit(0), labels).collect() == []


def test_features_count_every_gram():
    texts = ["a b c", None, "a", "", "a b"]
    ((_, _, offs, data),) = slices(pa.array(texts))
    bucket, text = I.features(data, offs)
    assert np.bincount(text, minlength=5).tolist() == [5, 0, 1, 0, 3]
    by = [sorted(bucket[text == i].tolist()) for i in range(5)]
    assert set(by[2]) <= set(by[4]) <= set(by[0])


@pytest.mark.parametrize("k", [1, 7, 60, 100, 101])
def test_kth_largest(spark, k):
    r = random.Random(k)
    values = [r.choice([r.randrange(-(1 << 62), 1 << 62), r.randrange(-3, 3)]) for _ in range(100)]
    got = I._kth_largest(spark.createDataFrame([(v,) for v in values], "v long"), k)
    assert got == (sorted(values, reverse=True)[k - 1] if k <= 100 else None)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_weights(spark, rows, labels):
    """Weight of each text with a word, from counts of its n-grams (each in its operator's bucket), and the wanted documents held out of the fit."""
    words = [words_of(t) for _, t in rows]
    grams = {i: [(w,) for w in ws] + list(zip(ws, ws[1:], strict=False)) for i, ws in enumerate(words)}
    known = sorted({g for found in grams.values() for g in found})
    bucket = {}
    for first, _, offs, data in slices(pa.array([" ".join(g) for g in known])):
        found, text = I.features(data, offs)
        bucket.update((known[first + t], int(b)) for t, b in zip(text.tolist(), found.tolist(), strict=True))  # the last feature of a gram's own text is the gram
    good = {d for d, q, t in labels if q == 1 and t == 0}
    half = {x.doc_id: x.fit for x in spark.createDataFrame([(d,) for d in good], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id, 'half') % 2 = 0 AS fit").collect()}
    count = lambda at: np.bincount([bucket[g] for i in at for g in grams[i]], minlength=I.BUCKETS).astype(float)
    model = lambda c: np.log((c + I.SMOOTH * c.sum() / I.BUCKETS) / (c.sum() * (1 + I.SMOOTH)))
    ratio = model(count([i for i, (d, _) in enumerate(rows) if half.get(d)])) - model(count(grams))
    return {rows[i][0]: sum(ratio[bucket[g]] for g in found) for i, found in grams.items() if found}, {d for d, fit in half.items() if not fit}


def plain_draw(weight, held, noisy, recall):
    """The ids with the k largest noisy weights; k: how many weights reach the percentile of the held ones."""
    reach = np.percentile([weight[d] for d in held if d in weight], 100 * (1 - recall))
    k = sum(w >= reach - 1e-9 for w in weight.values())
    least = sorted((np.floor(noisy[d] * 2.0**20) for d in weight), reverse=True)[k - 1]
    return {d for d in weight if np.floor(noisy[d] * 2.0**20) >= least}


def test_weights_and_draw_against_plain_counting(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["a", "b", "river", "BUY!!", "é", "of", "the"]) for _ in range(r.randrange(1, 30)))) for i in range(120)] + [(500, None), (501, "")]
    labels = [(i, int(i % 2 == 0), int(i % 10 == 0)) for i in range(80)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in I.weigh(df, lab, recall=0.8).collect()}
    weight, held = plain_weights(spark, rows, labels)
    assert got.keys() == dict(rows).keys() and all(abs(got[d].weight - w) < 1e-6 for d, w in weight.items())
    assert {d for d, x in got.items() if x.kept} == plain_draw(weight, held, {d: x.noisy for d, x in got.items()}, 0.8)
    noise = np.array([got[d].noisy - weight[d] for d in weight])
    assert abs(noise.mean() - 0.577) < 0.4 and abs(noise.std() - 1.28) < 0.4  # Gumbel


def test_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 300_000), (2, "w" * 500_000)], "doc_id long, text string")
    assert [x.kept for x in I.weigh(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()] == [True, True]


@pytest.mark.parametrize("n,share", [(0, 0.5), (1, 0.3), (2, 0.25), (90, 0.005), (90, 0.2), (101, 0.01), (101, 1.0)])
def test_percentile_of_all_values(spark, n, share):
    r = random.Random(n)
    values = np.array([r.choice([r.uniform(-1e9, 1e9), r.uniform(-1e-9, 1e-9), float(r.randrange(-2, 3))]) for _ in range(n)])
    longs = [(v,) for v in I._ordered(values.view(np.int64)).tolist()]
    got = I._percentile(spark.createDataFrame(longs, "v long"), share)
    want = spark.createDataFrame([(v,) for v in values.tolist()], "v double").selectExpr(f"percentile(v, {share}D)").first()[0]
    assert got == want and (n == 0 or got == pytest.approx(np.percentile(values, 100 * share), rel=1e-12))


def test_every_wanted_label_counts(spark):
    """More wanted labels than the 20,000 that an earlier version took."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefghij") for _ in range(4))) for i in range(23_000)]
    labels = [(i, 1, 0) for i in range(22_000)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in I.weigh(df, lab, recall=0.7).collect()}
    weight, held = plain_weights(spark, rows, labels)
    assert max(abs(got[d].weight - w) for d, w in weight.items()) < 1e-6
    assert {d for d, x in got.items() if x.kept} == plain_draw(weight, held, {d: x.noisy for d, x in got.items()}, 0.7)
