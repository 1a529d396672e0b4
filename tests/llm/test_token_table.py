import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")
from webloom.llm import token_table
from webloom.llm._common import new_path
from webloom.llm._text import slices


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_table.default_vocabulary())


def texts():
    r = random.Random(1)
    bits = ["don't", "'s", "'re", "'x", "''s", "s's", "I'll", "'llama", " ", "  ", "\n", "\n\n ", "\t", "a", "Zürich", "日本語", "١٢", "12 ", "<|endoftext|>", "!?", " …", "é", " ", "\U0001f600", "_x_", "\r\n", "O'd", "͸", "'", "'VE"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(3000)]


def test_encoder_equals_library(lib):
    enc = token_table.Encoder(token_table.default_vocabulary(), cache=500)
    all_texts = [*texts(), None, ""]
    for lo, hi, offs, data in slices(pa.array(all_texts), 2000):
        flat, at = enc.encode_slice(data, offs)
        for i in range(hi - lo):
            want = lib.encode(all_texts[lo + i] or "", add_special_tokens=False).ids
            assert flat[at[i] : at[i + 1]].tolist() == want, all_texts[lo + i]


def test_round_trip_and_lookup(spark, lib):
    rows = [(i * 7 - 500, t) for i, t in enumerate(texts()[:400])] + [(None, "null id"), (3, None), (3, "x"), (3, "again"), (10**15, "long " * 30000)]
    folder = new_path(spark, "tokens")
    token_table.write(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "doc_id AS file").repartition(7), folder)
    got = token_table.read(spark, folder).orderBy("start").collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    start = 0
    for have, (doc, text) in zip(got, sorted(rows, key=key), strict=True):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert (have.doc_id, have.start, have.n_tokens, have.ids) == (doc, start, len(ids), ids)
        start += len(ids)
    short = {(r.doc_id, r.start): r.ids_crc32 for r in token_table.read(spark, folder, digest_only=True).collect()}
    assert all(short[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    table = token_table.TokenTable(spark, folder)
    assert [x.tolist() for x in table.get(None)] == [[*lib.encode("null id").ids, 2]]
    assert [x.tolist()[-1] for x in table.get(3)] == [2, 2, 2]
    assert table.get(1) == [] and len(table.get(10**15)[0]) > 30000


def test_empty_table(spark):
    folder = new_path(spark, "tokens")
    token_table.write(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert token_table.read(spark, folder).collect() == []
