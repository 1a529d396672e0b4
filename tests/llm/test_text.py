"""Hashes of spans: families of texts that collide under polynomial hashes modulo 2^64."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import importance, line_dedup, line_labels, ngram_join, packing, token_table
from webloom.llm._common import new_path
from webloom.llm import _text
from webloom.llm._text import keyed_chain, keyed_hashes, keyed_values, mix, same_spans, slices, span_hashes, use_secret, word_spans


def thue_morse(n, zero, one):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


PAIRS = [("".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))) for n in (1024, 2048)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 1000, 1024, 1025, 4096])
def test_spans(n):
    a, b = (np.frombuffer("".join(thue_morse(n, x, y)).encode(), np.uint8) for x, y in ("ab", "ba"))
    data = np.concatenate([a, b, a])
    starts = np.array([0, n, 2 * n, 0])
    ends = np.array([n, 2 * n, 3 * n, 0])
    for hashes in (span_hashes, keyed_hashes):
        h = hashes(data, starts, ends)
        assert h[0] == h[2] and len({*h.tolist()}) == 3
    v = keyed_values(data.astype(np.uint64), starts, ends)
    assert v[0] == v[2] and len({*v.tolist()}) == 3
    assert same_spans(data, starts[[0, 0, 0]], ends[[0, 0, 0]], starts[[1, 2, 3]], ends[[1, 2, 3]]).tolist() == [False, True, False]


def test_hashes_tell_all_spans_apart():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 30_000).astype(np.uint8)
    starts = rng.integers(0, 29_000, 200_000)
    ends = starts + rng.integers(0, 20, 200_000)
    contents = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    for hashes in (span_hashes, keyed_hashes):
        assert len({*zip(contents, hashes(data, starts, ends).tolist(), strict=True)}) == len({*contents}) == len({*hashes(data, starts, ends).tolist()})


def cancelling(n):
    """Pairs of 16-letter words whose second halves cancel the difference of their first ones, as a known round allows."""
    rng, letters, out, base = np.random.default_rng(1), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8), [], np.uint64(16 * 0x9E3779B97F4A7C15 % 2**64)
    start, word = mix(np.array([base])), lambda m: np.ascontiguousarray(m).view("<u8")[:, 0]
    while len(out) < n:
        a = rng.choice(letters, (400_000, 8))
        state = mix(start ^ word(a))
        # Two states whose difference is one of letter halves: states that agree but for the low five bits of each byte.
        order = np.argsort(state & np.uint64(0xE0E0E0E0E0E0E0E0), kind="stable")
        for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            gap = int(state[i] ^ state[j])
            if gap & 0xE0E0E0E0E0E0E0E0:
                continue
            halves = [next(((x, x ^ d) for x in b"abcdefghijklmnopqrstuvwxyz" if x ^ d in b"abcdefghijklmnopqrstuvwxyz"), None) for d in gap.to_bytes(8, "little")]
            if all(halves):
                out.append(tuple((a[k].tobytes() + bytes(h[side] for h in halves)).decode() for side, k in enumerate((i, j))))
    return out[:n]


BUILT = [("syvzkskbaaaaaaab", "tzlijthzhknxkskc"), *cancelling(3)]


def spans_of(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return data, *word_spans(data, np.array([0, len(data)]))[:2]


def test_built_pairs_collide_in_the_open_hash_only():
    for pair in BUILT:
        assert len(set(span_hashes(*spans_of(pair)).tolist())) == 1
        assert len(set(keyed_hashes(*spans_of(pair)).tolist())) == 2


def test_operators_tell_built_pairs_apart(spark):
    rows = [(2 * i + j, w) for i, pair in enumerate(BUILT) for j, w in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id == r.doc_id for r in ngram_join.components_of(df, 4, 85).collect()] == [True] * len(rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lines = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(BUILT)], "doc_id long, text string")
    assert [r.n_dup_lines for r in line_labels.judge(lines, labels).collect()] == [0] * len(BUILT)
    many = [(10 * i + j, w) for i, p in enumerate(BUILT) for j, w in enumerate([p[0]] * 9 + [p[1]])]
    got = line_dedup.report(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert [r.n_dropped for r in got] == [n for _, n, _ in line_dedup.brute_force(many, line_dedup.MIN_DOCS)] == [0] * len(many)


def test_secrets():
    """Other secrets give other hashes; windows and values depend on content, place and length only."""
    data, starts, ends = spans_of(["a", "bb", "a", "bb", "a" * 3_000])
    before = _text._SECRET
    seen = set()
    for secret in (b"1", b"2"):
        use_secret(secret)
        h = keyed_hashes(data, starts, ends)
        w = keyed_chain(h, 2)
        v = keyed_values(h, np.array([0, 2, 0]), np.array([2, 4, 1]))
        assert h[0] == h[2] and h[1] == h[3] and w[0] == w[2] and w[0] != w[1] and v[0] == v[1] and len({*h.tolist(), *w.tolist(), *v.tolist()}) == 7  # a window is hashed like the same values
        seen |= {*h.tolist(), *w.tolist()}
    assert len(seen) == 12
    _text._SECRET = before


def test_equal_hashes_do_not_mix_pieces(monkeypatch):
    pytest.importorskip("tokenizers")
    monkeypatch.setattr(token_table, "span_hashes", lambda d, s, e: (e - s).astype(np.uint64))
    enc = token_table.Encoder(token_table.default_vocabulary())
    texts = ["abc abd xyz", "the cat sat on the mat"]
    for lo, hi, offs, data in slices(pa.array(texts)):
        flat, at = enc.encode_slice(data, offs)
        for i in range(hi - lo):
            assert flat[at[i] : at[i + 1]].tolist() == enc.lib.encode(texts[lo + i], add_special_tokens=False).ids


def test_operators_tell_the_pairs_apart(spark):
    rows = [(2 * i + j, t) for i, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Near duplicates: single words, so single shingles.
    assert sorted(tuple(r) for r in ngram_join.components_of(df, 4, 85).collect()) == ngram_join.brute_force(rows, 4, 85)
    # Lines: no text repeats a line.
    for a, b in PAIRS:
        words = " ".join(thue_morse(1024, "left", "right")), " ".join(thue_morse(1024, "right", "left"))
        ((_, _, offs, data),) = slices(pa.array([f"{a}\n{b}\n{a}", "\n".join(words)]))
        assert line_labels.lines_of(data, offs)[1][:, 3].tolist() == [1, 0]
        mask = line_dedup.lines_of(data, offs)[4]
        assert len(set(mask.tolist())) == 4
        bucket, text = importance.features(data, offs)
        assert (np.bincount(text) == [5, 4095]).all()


def test_tokens_of_the_pairs(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(token_table.default_vocabulary())
    rows = [(2 * i + j, t) for i, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = new_path(spark, "pairs")
    token_table.write(df, folder)
    got = {r.doc_id: r.ids_crc32 for r in token_table.read(spark, folder, digest_only=True).collect()}
    assert got == {d: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in rows}
    lengths = {r.doc_id: r.length for r in packing.sequences(df).collect()}
    assert lengths == {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}


def test_templates_of_long_lines(spark):
    """Ten documents with one long line are recurring; ten with its complement, one each, are not mixed with it."""
    a, b = (" ".join(thue_morse(1024, *p)) for p in (("left", "right"), ("right", "left")))
    rows = [(i, a) for i in range(9)] + [(20 + i, b) for i in range(9)]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_dropped for r in got] == [n for _, n, _ in line_dedup.brute_force(rows, line_dedup.MIN_DOCS)] == [0] * 18
