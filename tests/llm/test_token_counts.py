import random

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import token_counts
from webloom.llm._text import slices
from webloom.llm.queries import QUERIES
from webloom.llm.token_table import default_vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = default_vocabulary()
LIB = tokenizers.Tokenizer.from_file(PATH)


def want(texts):
    return [len(e.ids) for e in LIB.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def got(texts, counter=None):
    counter = counter or token_counts.Counter(PATH)
    return [n for _, _, offs, data in slices(pa.array(texts, pa.string()), token_counts.SLICE) for n in counter.texts(data, offs).tolist()]


def texts(seed, n):
    r = random.Random(seed)
    letters = ["a", "b", "aa", "the", " ", "  ", "\n", "\t", "'s", "'ll", "1", "22", ".", "--", "é", "ß", "日本", "😀", " ", "́", "<|endoftext|>", "<|endof", "x" * 70]
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 120))) for _ in range(n)]


def test_equals_the_library_on_any_text():
    t = [*texts(1, 600), None, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> a"]
    assert got(t) == want(t)


@pytest.mark.parametrize("alphabet", ["a", "ab", "aeinrst", "0123456789abcdef", "日本語中文", "=-_"])
def test_long_pieces_take_the_sweep(alphabet):
    r = random.Random(3)
    t = ["".join(r.choice(alphabet) for _ in range(n)) for n in (2, 63, 64, 65, 66, 200, 3_000, 20_000)]
    assert got(t) == want(t)


def test_rounds_and_sweep_agree():
    m = token_counts.Merges(PATH)
    rng = np.random.default_rng(5)
    size = rng.integers(2, 40, 300)
    symbols = m.byte_id[rng.choice(np.frombuffer(b"aaabthei ", np.uint8), size.sum())]
    assert m._rounds(symbols.copy(), size.copy()).tolist() == m._sweep(symbols.copy(), size).tolist()


def test_long_texts_are_cut_where_the_library_cuts():
    t = ["one two  three\n four. é five <|endoftext|> 'll" * 60_000]
    assert len(t[0].encode()) > token_counts.SLICE
    data = np.frombuffer(t[0].encode(), np.uint8)
    assert len(token_counts.safe_cuts(data, token_counts.SLICE)) > 2
    assert got(t) == want(t)
    assert token_counts.safe_cuts(np.frombuffer(b"x" * 100, np.uint8), 10) == [0, 100]


def test_a_full_memory_of_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 5)
    t = texts(2, 50)
    assert got(t) == want(t)


def test_tables_out_of_order_are_refused(tmp_path):
    import json

    j = json.loads(LIB.to_str())
    j["model"]["merges"] = j["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(j))
    with pytest.raises(ValueError, match="order"):
        token_counts.Merges(str(tmp_path / "v.json"))


def test_table_cases(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, "word " * 600, 6), (3, None, None), (4, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted(map(tuple, token_counts.counts(df).collect()), key=str)
    assert out == sorted([(1, 3, 2, False)] * 2 + [(None, 3000, want(["word " * 600])[0], True), (3, 0, 0, False), (4, 0, 0, False)], key=str)
    assert token_counts.counts(df.limit(0)).collect() == []


def test_query_equals_the_library(spark):
    from compare import SF

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expect = sorted((d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(docs, want([t for _, t in docs]), strict=True))
    assert sorted(map(tuple, QUERIES["op11_token_counts"](spark, SF).collect())) == expect
