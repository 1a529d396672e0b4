import random

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import ngram_join
from webloom.llm._text import shingle_sets, slices


def family(seed, n):
    r = random.Random(seed)
    vocab = [f"W{i}é" for i in range(400)]
    rows = []
    for f in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([3, 7, 20, 60, 300]))]
        for _ in range(r.choice([1, 2, 5])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((len(rows) * 3 % 1009, r.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_matches_brute_force(spark, k, percent):
    rows = family(k, 60) + [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, " \t"), (2005, "a b c"), (2006, "A  b\nc")]
    got = ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert sorted(tuple(r) for r in got.collect()) == ngram_join.brute_force(rows, k, percent)


def near_copies(seed, n, changes):
    r = random.Random(seed)
    base = [f"s{seed}w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(r.choice(changes)):
            words[r.randrange(100)] = f"x{r.randrange(100_000)}"
        rows.append((1000 * seed + i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("group", "frequent", "pieces"), [(8, 32, 2000), (3, 2, 400)])
def test_large_groups_and_blocks_in_pieces(spark, monkeypatch, group, frequent, pieces):
    """Groups beyond the bound become stars or are signed again; blocks of several pieces are joined by a pivot, then by what lies outside."""
    for name, value in {"PIECE_SHINGLES": pieces, "GROUP": group, "FREQUENT": frequent}.items():
        monkeypatch.setattr(ngram_join, name, value)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = near_copies(1, 40, [0, 1, 2, 3]) + near_copies(2, 30, [1, 2, 4, 6]) + [(5000 + i, passage + " " + t) for i, t in near_copies(3, 1, [0]) + near_copies(4, 12, [0, 1, 9])]
    r = random.Random(1)
    rows += [(9000 + i, passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    got = ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 4, 85)
    assert sorted(tuple(x) for x in got.collect()) == ngram_join.brute_force(rows, 4, 85)


def test_many_different_sets_under_one_signature(spark):
    """20,000 texts that share a passage of half their length, so thousands share a signature; ten of them are copied with a change."""
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"u{r.randrange(10**8)}" for _ in range(40))) for i in range(20_000)]
    rows += [(30_000 + i, rows[i * 7][1] + " end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in ngram_join.components_of(docs, 4, 85).collect()}
    assert got == {i: i for i in range(20_000)} | {30_000 + i: i * 7 for i in range(10)}


def test_groups_pass_through_without_being_held():
    rows = sorted([(5, 0, i) for i in range(30_000)] + [(6, -1, 3)] + [(6, 0, i) for i in range(4)] + [(6, 2, i) for i in range(40)] + [(7, 0, 1), (7, 0, 1), (7, 0, 2), (8, 0, 9)], key=lambda x: (x[0], max(x[1], 0), x[1], x[2]))
    table = pa.table({"sig": pa.array([x[0] for x in rows], pa.int64()), "salt": pa.array([x[1] for x in rows], pa.int32()), "set_key": pa.array([x[2] for x in rows], pa.int64())})
    for size in (1, 7, 1000, 100_000):
        out = list(ngram_join._groups_task(512)(iter(table.to_batches(size))))
        got = {(g, k, b) for x in out for g, k, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
        assert {k for g, k, b in got if g == 5 and b} == set(range(30_000)) and {k for g, k, b in got if g == 6 and b} == {*range(4), *range(40)}
        assert sorted(k for _, k, b in got if not b) == [1, 2]
        assert size > 1000 or max(x.num_rows for x in out) <= 1024 + size


def test_nulls_repeats_extra_columns_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t, 1), (7, t, 2), (7, t, 3), (9, t + " more", 4), (None, "zz", 5), (None, "zz", 6)], "doc_id long, text string, rep long")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in ngram_join.components_of(df, 4, 85).collect())
    assert got == sorted([("None", 27, "7"), ("7", 27, "7"), ("7", 27, "7"), ("9", 28, "7"), ("None", 1, "None"), ("None", 1, "None")])
    assert sorted(str(x.doc_id) for x in ngram_join.dedup(df, 4, 85).collect()) == ["7", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.components_of(empty).collect() == []


def test_trie_against_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, (8, 80), dtype=np.uint64)
    sets = []
    for i in range(120):
        s = base[i % 8].copy()
        at = rng.integers(0, 80, i % 15)
        s[at] = rng.integers(0, 2**60, len(at), dtype=np.uint64)
        sets.append((0, i, np.unique(s)))
    links = ngram_join.join_block(sets, 85, False)
    root = list(range(120))

    def find(root, i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(root, a)] = find(root, b)
    want = list(range(120))
    for _, i, a in sets:
        for _, j, b in sets[:i]:
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 85 * (len(a) + len(b) - inter):
                want[find(want, i)] = find(want, j)
    for i in range(120):
        for j in range(i):
            assert (find(root, i) == find(root, j)) == (find(want, i) == find(want, j))
    assert len(links) == 120 - len({find(want, i) for i in range(120)})


def test_words_split_at_ascii_space_only():
    col = pa.array(["a b c", None, "A b\x0bC", "a b c"])
    ((_, _, offs, data),) = slices(col)
    text, sh = shingle_sets(data, offs, 3)
    assert text.tolist() == [0, 2, 3]
    assert sh[1] == sh[2] and sh[0] != sh[1]


def test_sketch_never_parts_linked_sets():
    rng = np.random.default_rng(7)
    for n in (3, 40, 700, 5000, 70_000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        sets = [base]
        for share in (0.02, 0.08, 0.2, 0.6, 1.0):
            other = base.copy()
            at = rng.integers(0, len(base), int(share * len(base)))
            other[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
            sets.append(np.unique(other)[: max(1, int(len(base) * rng.uniform(0.9, 1)))])
        sizes = np.array([len(x) for x in sets])
        edges = ngram_join.may_link([ngram_join.sketch(x).tobytes() for x in sets], sizes, 85)
        part = list(range(len(sets)))
        for i, j in edges:
            part = [part[i] if p == part[j] else p for p in part]
        for i in range(len(sets)):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                assert 100 * inter < 85 * (sizes[i] + sizes[j] - inter) or part[i] == part[j]
        if 100 < n < 10_000:
            assert part[5] != part[0]  # nothing in common


def test_dedup_decides_by_row(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("a") + " end"), (5, text("b")), (None, text("c")), (None, text("c") + " end"), (None, text("d")), (7, text("e")), (7, text("e")), (7, text("e") + " end"), (8, None), (8, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, rep int").selectExpr("*", "1 AS _rep", "2 AS kept")
    assert ngram_join.dedup(df).columns == df.columns
    got = ngram_join.dedup(df).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:2]) for r in got) == [("1", "a0"), ("5", "b0"), ("7", "e0"), ("8", ""), ("8", ""), ("None", "c0"), ("None", "d0")]


def test_very_long_texts(spark):
    """Two texts of 200,000 words that share most of them link, and a third that shares a fifth doesn't."""
    words = [f"w{i}" for i in range(200_000)]
    rows = [(7, " ".join(words)), (3, " ".join([*words[:190_000], *(f"x{i}" for i in range(10_000))])), (1, " ".join([*words[:40_000], *(f"y{i}" for i in range(160_000))])), (9, "w" * 1_000_000)]
    got = ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 199_997, 1), (3, 199_997, 3), (7, 199_997, 3), (9, 1, 9)]
