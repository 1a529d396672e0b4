import itertools
import random
import re

import numpy as np
import pyarrow as pa

from webloom.llm import line_labels as L
from webloom.llm._text import slices


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


def texts(n):
    r = random.Random(3)
    return ["".join(r.choice(["a", "bé", "日本", " ", " ", "\n", "\n", "#", "x.", "\t", " ", "a b c d e "]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_base_counts():
    rows = [*texts(400), None, "", "\n\n", "a\n", "a\na", " a\na", "x x x x x x"]
    for limit in (100, 1 << 20):
        for lo, hi, offs, data in slices(pa.array(rows), limit):
            lines, got, head = L.lines_of(data, offs)
            for i in range(hi - lo):
                assert got[i].tolist() == base(rows[lo + i]), rows[lo + i]
            assert head[-1] == len(lines.text) == len(lines.active)


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(1)
    crf = L.Crf(rng.normal(size=(L.N_FEATURES + 1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores, head = rng.normal(size=(12, 2)), np.array([0, 5, 5, 6, 12])
    got = L.viterbi(crf, scores, head)
    for a, b in itertools.pairwise(head):
        best = max(itertools.product((0, 1), repeat=b - a), key=lambda y: sum(scores[a + i, s] for i, s in enumerate(y)) + (crf.start[y[0]] if y else 0) + sum(crf.transition[p, q] for p, q in itertools.pairwise(y)))
        assert tuple(got[a:b]) == best


def test_fit_learns():
    rng = np.random.default_rng(2)
    truth = np.repeat(rng.integers(0, 2, 60), 5)
    active = np.stack([np.where(truth == 1, 3, 4), np.full(300, L.N_FEATURES)], 1)
    crf = L.fit(active, truth, np.arange(0, 301, 5))
    assert (L.viterbi(crf, crf.scores(active), np.arange(0, 301, 5)) == truth).all()
    assert crf.transition[0, 0] > crf.transition[0, 1]


def test_judge(spark):
    good = "The quick brown fox jumps over the lazy dog near the river.\nIt was a calm and pleasant evening in the old town."
    junk = "BUY!! NOW!! FREE!! $$$ CLICK!! HERE!! WIN!! BIG!! CASH!! TODAY!! ONLY!!"
    docs = [(i, good.replace("fox", f"fox{i} hen{i}")) for i in range(30)] + [(100 + i, junk.replace("WIN", f"WIN{i}")) for i in range(30)] + [(None, None), (1, good), (200, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "9 AS kept", "8 AS key", "7 AS _key")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r.kept for r in L.judge(df, labels).collect()}
    assert all(v for (d, _), v in got.items() if d is not None and d < 30) and not any(v for (d, _), v in got.items() if d is None or d >= 100)
    kept = L.keep(df, labels)
    assert kept.columns == df.columns and kept.count() == 31
    assert L.judge(df, labels.limit(0)).filter("kept").count() == 61
    assert L.judge(df.limit(0), labels).collect() == []


def test_fit_climbs_the_likelihood():
    """The fit's gradient vanishes where it ends: no weight can be moved to raise the likelihood, by enumeration, by more than the penalty allows."""
    rng = np.random.default_rng(4)
    truth, head = rng.integers(0, 2, 24), np.array([0, 4, 9, 9, 16, 24])
    active = np.stack([np.where(truth == rng.integers(0, 2, 24), 2, 5), np.full(24, L.N_FEATURES)], 1)

    def likelihood(crf):
        total, scores = 0.0, crf.scores(active)
        for a, b in itertools.pairwise(head):
            score = lambda y: sum(scores[a + i, s] for i, s in enumerate(y)) + (crf.start[y[0]] if len(y) else 0) + sum(crf.transition[p, q] for p, q in itertools.pairwise(y))  # noqa: B023, E731
            total += score(truth[a:b]) - np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=b - a)))
        return total / len(truth) - 0.5e-3 * sum((p**2).sum() for p in (crf.emission[:-1], crf.transition, crf.start))

    crf = L.fit(active, truth, head, steps=600)
    at = likelihood(crf)
    for array, places in ((crf.emission, [(2, 0), (5, 1)]), (crf.transition, [(0, 0), (0, 1), (1, 0)]), (crf.start, [0, 1])):
        for place in places:
            for step in (-0.05, 0.05):
                array[place] += step
                assert likelihood(crf) < at + 2e-5
                array[place] -= step


def test_kept_is_the_share_of_content_words(spark):
    """Kept by hand: labels from the operator's scores by enumeration of short sequences."""
    r = random.Random(6)
    rows = [(i, "\n".join(" ".join(r.choice(["word", "Sentence", "BUY!!", "$$$", "10", "and."]) + str(r.randrange(30)) for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 7)))) for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(40)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    crf = L.train(df, lab)
    for got in L.judge(df, lab).collect():
        ((_, _, offs, data),) = slices(pa.array([rows[got.doc_id][1]]))
        lines, _, _ = L.lines_of(data, offs)
        scores = crf.scores(lines.active)
        best = max(itertools.product((0, 1), repeat=len(scores)), key=lambda y: sum(scores[i, s] for i, s in enumerate(y)) + crf.start[y[0]] + sum(crf.transition[p, q] for p, q in itertools.pairwise(y)))
        words = [len(x.split()) for x in rows[got.doc_id][1].split("\n")]
        share = sum(w for w, y in zip(words, best, strict=True) if y == L.CONTENT) / sum(words)
        want = base(rows[got.doc_id][1])
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert (got.base_failed, got.kept) == (failed, not failed and share >= L.SHARE) and abs(got.content_share - share) < 1e-9


def test_long_text(spark):
    df = spark.createDataFrame([(1, "a line of some words\n" * 40_000), (2, "w" * 500_000)], "doc_id long, text string")
    got = {x.doc_id: x for x in L.judge(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert (got[1].n_words, got[1].n_dup_lines, got[1].n_repeat_words) == (200_000, 39_999, 200_000) and got[2].n_words == 1


def test_what_fitting_gathers_has_a_bound_in_bytes(spark, monkeypatch):
    good = "\n".join(f"a longer line of plain words number {i} follows here" for i in range(6))
    rows = [(i, good + f" {i}" if i % 2 else "menu | home | login\n" * 6) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, "x " * 5_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(99, 1, 0)], "doc_id long, quality int, toxic int")
    whole = L.train(docs.filter("doc_id < 40"), labels)
    monkeypatch.setattr(L, "SAMPLE_TEXT", 4_000)
    assert (L.train(docs, labels).emission == whole.emission).all()
    monkeypatch.setattr(L, "SAMPLE_BYTES", 10)
    assert not L.train(docs, labels).emission.any()
