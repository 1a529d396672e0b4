import itertools
import random

from webloom.llm import packing


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(40):
        h = {r.randrange(1, 40): r.randrange(1, 50) for _ in range(r.randrange(1, 9))}
        k = r.randrange(1, 5)
        best = min(padding(h, [*c, max(h)]) for n in range(k) for c in itertools.combinations(sorted(h), n))
        ends = packing.boundaries(h, k)
        assert len(ends) <= k and padding(h, ends) == best
    assert packing.boundaries({}, 3) == []


def test_pack_against_rank(spark):
    r = random.Random(4)
    rows = [(r.choice([None, *range(300)]), s, r.choice([1, 3, 50, 64])) for s in range(2) for _ in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, segment long, length long").repartition(5), 64, 256, 3).collect()
    histogram = {x: sum(row[2] == x for row in rows) for x in {row[2] for row in rows}}
    ends = packing.boundaries(histogram, 3)
    want = []
    for e in ends:
        inside = sorted((row for row in rows if min(x for x in ends if x >= row[2]) == e), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        want += [(*row, e, i // (256 // e), i % (256 // e)) for i, row in enumerate(inside)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a " * 10), (1, None), (None, ""), (2, "word")], "doc_id long, text string").selectExpr("*", "5 AS length", "6 AS segment")
    got = sorted(map(tuple, packing.sequences(docs, 8).collect()), key=str)
    assert got == sorted([(1, 0, 8), (1, 1, 4), (1, 0, 1), (None, 0, 1), (2, 0, 2)], key=str)
    assert packing.pack(packing.sequences(docs.limit(0))).collect() == []
