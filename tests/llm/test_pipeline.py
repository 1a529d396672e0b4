import collections
import importlib.util
import os
import re

import pytest

import corpus_pipeline
from webloom.llm import importance, ngram_join, packing, secret_scan
from webloom.llm.token_table import default_vocabulary

tokenizers = pytest.importorskip("tokenizers")


def _beside(name):
    spec = importlib.util.spec_from_file_location(f"{name}_for_pipeline", os.path.join(os.path.dirname(__file__), f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


plain_spans = _beside("test_secret_scan").plain_spans
_importance = _beside("test_importance")

DATA = "/root/testdata/sf0.001"


def least_padding(histogram, k):
    """The least padding of at most k buckets, by trying every last bucket of every prefix of the lengths."""
    lengths = sorted(histogram)
    cost = [[0] * (len(lengths) + 1) for _ in range(len(lengths) + 1)]
    for j in range(len(lengths)):
        for i in range(j, -1, -1):
            cost[i][j + 1] = cost[i + 1][j + 1] + histogram[lengths[i]] * (lengths[j] - lengths[i])
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(k):
        best = [min([best[j], *(best[i] + cost[i][j] for i in range(j))]) for j in range(len(lengths) + 1)]
    return best[-1]


def plain_packing(texts, packed):
    """The sequences are those of the library's counts, the boundaries are optimal, and each bucket is filled in order."""
    lib = tokenizers.Tokenizer.from_file(default_vocabulary())
    want = set()
    for i, text in texts.items():
        n = len(lib.encode(text or "", add_special_tokens=False).ids) + 1
        want |= {(i, k, min(packing.MAX_LEN, n - k * packing.MAX_LEN)) for k in range(-(-n // packing.MAX_LEN))}
    assert {(r.doc_id, r.segment, r.length) for r in packed} == want and len(packed) == len(want)
    histogram = collections.Counter(r.length for r in packed)
    ends = sorted({r.bucket for r in packed})
    assert len(ends) <= packing.BUCKETS and all(r.bucket == min(e for e in ends if e >= r.length) for r in packed)
    assert sum(r.bucket - r.length for r in packed) == least_padding(histogram, packing.BUCKETS)
    for e in ends:
        inside = sorted((r for r in packed if r.bucket == e), key=lambda r: (r.doc_id, r.segment))
        assert [(r.batch, r.slot) for r in inside] == [divmod(i, packing.BUDGET // e) for i in range(len(inside))]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    noisy = {r.doc_id: r.noisy for r in importance.weigh(docs, labels).collect()}  # its noise is the draw; weights and k are counted here
    weight, held = _importance.plain_weights(spark, list(rows.items()), [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    kept = _importance.plain_draw(weight, held, noisy, importance.RECALL)
    assert len(rows) == docs.count() and kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        if name == "quality":
            assert after == kept
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
            assert after == set(first.values())
        if name == "ngram_join":
            assert after == {d for d, _, c in ngram_join.brute_force(sorted(before.items()), 5, 80) if d == c}
        if name == "secret_scan":
            spans = {r.doc_id for r in secret_scan.scan(spark.createDataFrame(list(before.items()), "doc_id long, text string")).filter("size(spans) > 0").collect()}
            assert after == set(before) - spans and {i for i, t in before.items() if plain_spans(t)} <= spans
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert after <= set(rows)
    plain_packing({r.doc_id: r.text for r in docs.collect()}, packed)
    again = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, packed))


def test_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    """Every stage gives its columns back for an empty table, and takes null identifiers, null texts, repeats and extra columns."""
    docs = spark.createDataFrame([(None, None, "a", "b", 1, 2), (1, "", "a", "b", 1, 2), (1, "", "a", "b", 1, 2), (2, "some words of a text that is fine " * 3, "a", "b", 1, 2)], "doc_id long, text string, lang string, source string, _key int, rep int")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns
            assert {x.doc_id for x in out.collect()} <= {None, 1, 2}
        packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
        assert len(packed) == table.count()
