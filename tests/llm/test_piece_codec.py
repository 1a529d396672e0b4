import random
import struct
import zlib

import pytest

pytest.importorskip("ahocorasick")
sp = pytest.importorskip("sentencepiece")
from webloom.llm import piece_codec


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(piece_codec.default_model(), limit=200)


def texts(n):
    r = random.Random(6)
    bits = ["the", "ing", " ", "  ", "\n", "é", "日", "\U0001f600", "Zx", "123", "!!", "tion", "\t", " and", "'"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(n)]


def best_total(codec, word):
    """Highest score over all segmentations, by plain dynamic programming over substrings."""
    scores = {p: codec.lib.get_score(i) for i, p in enumerate(codec.pieces) if i not in codec.control and i not in codec.bytes}
    best = [0.0]
    for e in range(1, len(word) + 1):
        options = [best[s] + scores[word[s:e]] for s in range(max(0, e - 20), e) if word[s:e] in scores]
        if word[e - 1] not in codec.single:
            options.append(best[e - 1] + codec.unknown_score)
        best.append(max(options))
    return best[-1]


def test_score_equals_library_lattice(codec):
    """The library's lattice search (its n-best list) over the same pieces as a unigram model, where its single precision is exact."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb2.ModelProto()
    m.ParseFromString(codec.lib.serialized_model_proto())
    m.trainer_spec.model_type = 1
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    r, total = random.Random(8), lambda ids: sum(map(lib.get_score, ids))
    for _ in range(400):
        t = " ".join("".join(r.choice(["the", "ing", "at", "on", "er", "s", "ou"]) for _ in range(r.randrange(1, 4))) for _ in range(3))
        assert total(codec.encode(t).tolist()) == total(lib.nbest_encode_as_ids(t, 2)[0])


def test_best_score_and_round_trip(codec):
    for t in texts(300):
        ids = codec.encode(t).tolist()
        for w in codec.cut.findall(codec.lib.normalize(t)):
            got, unknown = 0.0, sum(c not in codec.single for c in w)
            got = sum(codec.lib.get_score(i) for i in codec.search(w) if i not in codec.bytes) + unknown * codec.unknown_score
            assert got == best_total(codec, w)
        assert codec.decode(ids) == t
        assert codec.decode(ids) == codec.lib.decode(ids)


def test_tables(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (1, None, 6), (None, "", 7), (3, "x" * 50_000 + " \n", 8)], "doc_id long, text string, ids_crc32 long")
    got = piece_codec.encode(df).collect()
    assert sorted(len(r.ids) for r in got)[:2] == [0, 0] and {r.ids_crc32 for r in got} == {5, 6, 7, 8}
    back = piece_codec.decode(piece_codec.encode(df)).collect()
    assert sorted(r.text for r in back) == sorted(["hello world", "", "", "x" * 50_000 + " \n"])
    assert all(r.round_trip for r in piece_codec.table_of(df).collect())
    assert piece_codec.table_of(df.limit(0)).collect() == []


def best_ids(codec, text):
    """Ids by plain dynamic programming over the whole normalised text: best total, then the longest last piece."""
    scores = {p: (codec.lib.get_score(i), i) for i, p in enumerate(codec.pieces) if i not in codec.control and i not in codec.bytes}
    text = codec.lib.normalize(text) if text else ""
    best, back = [0.0], [None]
    for e in range(1, len(text) + 1):
        options = [(best[s] + scores[text[s:e]][0], e - s, [scores[text[s:e]][1]]) for s in range(max(0, e - 24), e) if text[s:e] in scores]
        if text[e - 1] not in codec.single:
            options.append((best[e - 1] + codec.unknown_score, 0, [codec.byte_ids[b] for b in text[e - 1].encode()]))
        total, size, ids = max(options, key=lambda x: (x[0], x[1]))
        best.append(total)
        back.append((e - max(size, 1), ids))
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_digests_against_plain_programming(spark, codec):
    """n_tokens and ids_crc32 of table_of."""
    rows = [(i, t) for i, t in enumerate([*texts(60), None, "", "plain words of a text, and 12 more."])]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in piece_codec.table_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ids = best_ids(codec, t)
        assert got[i] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), t
