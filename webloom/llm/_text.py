"""Vectorised text primitives over Arrow buffers: no Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: ASCII white space: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_LOW = U64(0xFFFFFFFF)
#: Masks that leave the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans of more than so many steps of 8 bytes are taken one by one.
LONG_SPAN = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offsets, bytes) of consecutive rows with about limit bytes; a longer text comes alone. Null: empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, offs[lo : hi + 1] - offs[lo], data[offs[lo] : offs[hi]]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words in order, and where each text's words begin in that list (one more entry at the end)."""
    word = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty_like(word)
    after = np.empty_like(word)
    if len(word):
        before[0], before[1:] = True, ~word[:-1]
        after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _long_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray, key: bytes = b"") -> np.ndarray:
    """Which spans are short; the others get BLAKE2b hashes of their content."""
    size = ends - starts
    most = LONG_SPAN * 8 // values.itemsize
    for i in np.flatnonzero(size > most):
        out[i] = int.from_bytes(hashlib.blake2b(values[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return np.flatnonzero((size > 0) & (size <= most))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hashes of byte spans, the same in every run; spans of equal length up to 8 never collide.

    Collisions can be built on purpose. Use them where contents are compared after, or where buckets collide anyhow; else keyed_hashes.
    """
    out = mix((ends - starts).astype(U64) * U64(_BASE))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    live = _long_hashes(data, starts, ends, out)
    at, left = starts[live], ends[live] - starts[live]
    while len(live):
        out[live] = mix(out[live] ^ (words[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span equals the other one."""
    out = ends - starts == other_ends - other
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    live = np.flatnonzero(out & (starts != other))
    for i in live[(ends - starts)[live] > LONG_SPAN * 8]:
        out[i] = (data[starts[i] : ends[i]] == data[other[i] : other_ends[i]]).all()
    live = live[(ends - starts)[live] <= LONG_SPAN * 8]
    x, y, left = starts[live], other[live], (ends - starts)[live]
    while len(live):
        keep = ((words[x] ^ words[y]) & _FIRST[np.clip(left, 0, 8)]) == 0
        out[live[~keep]] = False
        keep &= left > 8
        live, x, y, left = live[keep], x[keep] + 8, y[keep] + 8, left[keep] - 8
    return out


class _Secret:
    """Multipliers of two lanes, drawn from a secret: one for the length, then one for each 32-bit word of a span."""

    def __init__(self, secret: bytes):
        words = 1 + 2 * LONG_SPAN
        self.key = hashlib.blake2b(secret, digest_size=32).digest()
        self.lanes = np.frombuffer(hashlib.shake_256(secret).digest(2 * 8 * words), np.uint64).reshape(2, words)


_SECRET = _Secret(b"outside an application")


def use_secret(secret: bytes) -> None:
    """From now on keyed_hashes, keyed_values and keyed_chain of this process are those of the secret."""
    global _SECRET
    _SECRET = _Secret(secret)


def _finish(lanes: list[np.ndarray]) -> np.ndarray:
    return mix((lanes[0] & ~_LOW) | (lanes[1] >> U64(32)))


def _add(lanes: list[np.ndarray], live: np.ndarray, words: np.ndarray, at: int) -> None:
    """Multilinear hashing of 64-bit words as two 32-bit words each."""
    low, high = words & _LOW, words >> U64(32)
    for lane, k in zip(lanes, _SECRET.lanes, strict=True):
        lane[live] += low * k[at] + high * k[at + 1]


def keyed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans under this application's secret.

    Two lanes of multilinear hashing over length and 32-bit words, upper halves taken: two different spans collide with probability 2^-64 over the
    secret, whatever the texts, so none can be built to collide. Spans above LONG_SPAN * 8 bytes: keyed BLAKE2b.
    """
    size = (ends - starts).astype(U64)
    lanes = [size * k[0] for k in _SECRET.lanes]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    long = np.zeros(len(starts), U64)
    live = _long_hashes(data, starts, ends, long, _SECRET.key)
    at, left, k = starts[live], ends[live] - starts[live], 1
    while len(live):
        _add(lanes, live, words[at] & _FIRST[np.minimum(left, 8)], k)
        more = left > 8
        live, at, left, k = live[more], at[more] + 8, left[more] - 8, k + 2
    return np.where(size > U64(LONG_SPAN * 8), long, _finish(lanes))


def keyed_values(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """keyed_hashes for spans of 64-bit values."""
    size = (ends - starts).astype(U64)
    lanes = [size * k[0] for k in _SECRET.lanes]
    long = np.zeros(len(starts), U64)
    live = _long_hashes(values, starts, ends, long, _SECRET.key)
    at, end, k = starts[live], ends[live], 1
    while len(live):
        _add(lanes, live, values[at], k)
        more = end - at > 1
        live, at, end, k = live[more], at[more] + 1, end[more], k + 2
    return np.where(size > U64(LONG_SPAN), long, _finish(lanes))


def keyed_chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Keyed hash of each window of k consecutive entries (len - k + 1 of them), k up to LONG_SPAN."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    lanes = [np.full(n, k, U64) * key[0] for key in _SECRET.lanes]
    low, high = hashes & _LOW, hashes >> U64(32)
    for lane, key in zip(lanes, _SECRET.lanes, strict=True):
        for j in range(k):
            lane += low[j : n + j] * key[1 + 2 * j] + high[j : n + j] * key[2 + 2 * j]
    return _finish(lanes)


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive entries (len - k + 1 of them), the same in every run."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = mix(hashes[:n] + U64(k))
    for j in range(1, k):
        out = mix(out * U64(_BASE) + hashes[j : n + j])
    return out


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int, hashed: Callable[[np.ndarray, int], np.ndarray] = keyed_chain) -> tuple[np.ndarray, np.ndarray]:
    """(window hash, text index) of the k-word windows that lie in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:n] == text[k - 1 :]
    return hashed(hashes, k)[inside], text[:n][inside]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as keyed hashes: (text index, hash), sorted by both. Fewer than k words: one shingle of them all."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    h = keyed_hashes(data, starts, ends)
    sh, text = window_hashes(h, first, k)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.concatenate([keyed_chain(h[first[i] : first[i + 1]], int(counts[i])) for i in short])
        sh, text = np.concatenate([sh, extra]), np.concatenate([text, short])
    order = np.lexsort((sh, text))
    sh, text = sh[order], text[order]
    if len(sh):
        keep = np.ones(len(sh), bool)
        keep[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
        sh, text = sh[keep], text[keep]
    return text, sh
