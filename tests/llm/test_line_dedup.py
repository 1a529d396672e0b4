import hashlib
import random

from webloom.llm import line_dedup


def corpus():
    r = random.Random(9)
    names = ["ann", "bob", "cy", "dee", "eve", "flo", "gus", "hal", "ivy", "jo", "kim", "lou"]
    rows = []
    for i in range(80):
        lines = [" ".join(r.choice(names) for _ in range(r.randrange(1, 9))) for _ in range(4)]
        if i % 2:
            lines.insert(1, f"Posted on {r.randrange(100)} May 20{i:02d} at noon")
        if i % 3 == 0:
            lines.append(f"Written by the editor {names[i % 12]}{'x' * (i % 5)} for our daily news page")
        if i % 4 == 0:
            lines += ["  \t", "All rights reserved. ", "All rights reserved."]
        rows.append((i, "\n".join(lines)))
    return [*rows, (None, None), (None, "All rights reserved."), (5, ""), rows[1], rows[2], (300, "x\x0b\n\n"), (301, "\n".join(f"Item {k} of the list" for k in range(40)))]


def test_matches_brute_force(spark):
    rows = corpus()
    for min_docs in (3, 10):
        got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pos", "'x' AS line", "2 AS mask"), min_docs)
        want = [(d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in line_dedup.brute_force(rows, min_docs)]
        assert sorted(map(str, ((r.doc_id, r.n_dropped, r.text_sha256) for r in got.collect()))) == sorted(map(str, want))
    assert sum(n for _, n, _ in line_dedup.brute_force(rows, 10)) > 80


def test_keeps_columns_and_plain_texts(spark):
    df = spark.createDataFrame([(1, "a b\r\nc", 7, 1, 2, 3, 4), (2, None, 8, 1, 2, 3, 4)], "doc_id long, text string, _gone long, gone int, _doc int, doc int, pos int")
    out = line_dedup.clean(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert line_dedup.report(df.limit(0)).collect() == []


def test_templates_of_a_large_leaf(spark, monkeypatch):
    """A template in under 1 % of its leaf recurs all the same; so do hot places, which are looked up by broadcast."""
    word = lambda n: "".join("abcdefghij"[int(c)] for c in f"{n:06d}")
    rows = [(i, f"{word(500 + i)}\nRead more about {word(i)} in our daily news section today") for i in range(12)]
    rows += [(100 + i, "\n".join("Read more " + " ".join(word(1000 + 8 * (50 * i + k) + j) for j in range(8)) for k in range(50))) for i in range(26)]
    want = [(d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in line_dedup.brute_force(rows, line_dedup.MIN_DOCS)]
    assert [n for _, n, _ in want] == [1] * 12 + [0] * 26
    for hot_rows in (10_000, 15):
        monkeypatch.setattr("webloom.llm._common.HOT_ROWS", hot_rows)
        got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r.doc_id, r.n_dropped, r.text_sha256) for r in got.collect()) == want


def test_long_text(spark):
    """A text of 30,000 lines, half of which go, among them the first, the last and neighbours; and one line of two million characters."""
    lines = ["Read all of it here", *(f"Item {k} of the list" if k % 4 < 2 else ["", "word " * (k % 5) + "abcdefghij"[k // 4 % 10] * (k % 97)][k % 2] for k in range(30_000)), "Read all of it here"]
    rows = [(1, "\n".join(lines)), (2, "x" * 2_000_000), (3, "\n")] + [(10 + i, "Item 7 of the list\nRead all of it here") for i in range(12)]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in line_dedup.brute_force(rows, line_dedup.MIN_DOCS)]
    assert sorted((r.doc_id, r.n_dropped, r.text_sha256) for r in got.collect()) == want and want[0][1] == 15_002
