"""Periodic runs of words by block matching.

A run is a stretch of consecutive words with smallest period q and a length of at
least max(min_length, exponent * q) that can't be extended keeping q. Periods are
searched by scales: scale B (a power of two) is for q in [B, 2B), the least scale
for all q below 2B. A run of period q equals itself q words further on over a stretch long enough to hold
an aligned block of B words (one that begins at a multiple of B; at the least scale
min_length sees to that), so each run shows as an aligned block that occurs again
at a distance the scale allows. All aligned blocks of a scale are keys of one
Aho-Corasick automaton over integer sequences, which is run along the document once; occurrences
at such distances are seeds, and a seed is extended to both sides by comparing the words
themselves. No hash decides anything: words are numbered by content.

A seed inside a stretch known for its period is skipped, and so is one inside a known
run whose period divides its own (a stretch of a multiple of a run's period that lies
in the run is the run). Each scale has at most two seeds a position, so time grows with n log n
on plain text and memory with n. Documents in which no window of the least scale recurs have
no run and skip the search; that test hashes windows of numbers, where a collision only costs the search.

A document is worked on in one task, as a run may span all of it; memory is a few hundred bytes a word.

Defined cases: null and empty texts have no words and no runs; repeated rows give a row each; null doc_id stays null;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import map_arrow
from webloom.llm._text import chain, column

MIN_LENGTH, EXPONENT = 24, 3
#: (start, length, period) in words.
Run = tuple[int, int, int]


def least_scale(min_length: int, exponent: int) -> int:
    """The largest power of two B whose aligned blocks no run of a period below 2B can avoid."""
    scale = 1
    while all(max(min_length, exponent * q) - q >= 4 * scale - 1 for q in range(1, 4 * scale)):
        scale *= 2
    return scale


def number(words: list[bytes]) -> np.ndarray:
    """Words numbered by content, in order of first occurrence."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def recurs(ids: np.ndarray, width: int) -> bool:
    """Whether some window of that width may occur twice; False is certain."""
    h = np.sort(chain(ids.astype(np.uint64), width))
    return bool((h[1:] == h[:-1]).any())


def seeds(ids: np.ndarray, scale: int, low: int) -> list[tuple[int, int]]:
    """(distance, place) of each aligned block that occurs again at a distance in [low, 2 * scale), by both."""
    sequence = tuple(ids.tolist())
    blocks = len(sequence) // scale
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    kind = np.zeros(blocks, np.int64)  # number of each block's content
    for b in range(blocks):
        key = sequence[b * scale : (b + 1) * scale]
        kind[b] = automaton.get(key, -1)
        if kind[b] < 0:
            automaton.add_word(key, b)
            kind[b] = b
    automaton.make_automaton()
    found = np.array(list(automaton.iter(sequence)), np.int64).reshape(-1, 2)
    place, what = found[:, 0] - scale + 1, found[:, 1]
    out = []
    # The aligned places at a distance in [low, 2 * scale) before an occurrence: the last one, and those before it.
    last = (place - low) // scale
    for back in range(-(-(2 * scale - low) // scale)):
        b = last - back
        fits = (b >= 0) & (place - b * scale < 2 * scale)
        fits[fits] = kind[b[fits]] == what[fits]
        out.append(np.stack([place[fits] - b[fits] * scale, b[fits] * scale], 1))
    return sorted(map(tuple, np.concatenate(out).tolist()))


def _ahead(ids: np.ndarray, i: int, q: int) -> int:
    """The first place from i on whose word differs from the one q further on, or where that is past the end."""
    n, step = len(ids) - q, 64
    while i < n:
        end = min(n, i + step)
        differ = np.flatnonzero(ids[i:end] != ids[i + q : end + q])
        if len(differ):
            return i + int(differ[0])
        i, step = end, step * 2
    return n


def _back(ids: np.ndarray, i: int, q: int) -> int:
    """The first place of the stretch before i whose words equal those q further on."""
    step = 64
    while i > 0:
        begin = max(0, i - step)
        differ = np.flatnonzero(ids[begin:i] != ids[begin + q : i + q])
        if len(differ):
            return begin + int(differ[-1]) + 1
        i, step = begin, step * 2
    return 0


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[Run]:
    """All runs of a sequence of numbers, by start, then period."""
    if exponent < 3:
        raise ValueError("the exponent must be 3 or more")  # below, a stretch may hold no aligned block of its scale
    n, first = len(ids), least_scale(min_length, exponent)
    if n < min_length or not recurs(ids, first):
        return []
    runs: dict[tuple[int, int], int] = {}  # (start, end): smallest period
    reach, divisor_of = np.zeros(n, np.int64), np.zeros(n, np.int64)  # for each place, the end of a run over it that reaches far, and its period
    scale = first
    while scale == first or exponent * scale <= n:
        low = 1 if scale == first else scale
        q, upto = 0, 0
        for distance, place in seeds(ids, scale, low):
            if distance != q:
                q, upto = distance, 0  # upto: stretches of this period are known before it
            if place < upto or (divisor_of[place] and q % divisor_of[place] == 0 and reach[place] >= place + q + scale):
                continue
            start, upto = _back(ids, place, q), _ahead(ids, place, q)
            end = upto + q
            if end - start < max(min_length, exponent * q) or (start, end) in runs:
                continue
            if any(q % d == 0 and (ids[start : end - d] == ids[start + d : end]).all() for d in _proper_divisors(q)):
                continue
            runs[start, end] = q
            part = slice(start, end)
            further = reach[part] < end
            divisor_of[part][further], reach[part][further] = q, end
        scale *= 2
    return sorted(((a, b - a, q) for (a, b), q in runs.items()), key=lambda r: (r[0], r[2]))


def _proper_divisors(q: int) -> list[int]:
    small = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return sorted({d for s in small for d in (s, q // s)} - {q})


def best_run(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared exactly; then smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words lie in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


#: Words of a document, from its identifier and its words.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _documents(docs: DataFrame, per_document: Callable[[int | None, list[bytes], list[Run]], list[tuple]], schema: str, rewrite: Rewrite | None, id_col: str, text_col: str, min_length: int, exponent: int) -> DataFrame:
    """The rows that per_document makes of each document's words and runs."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(name, types[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()  # bytes split at \x20 and \x09-\x0D
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                out += per_document(doc_id, words, find_runs(number(words), min_length, exponent))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return map_arrow(rows, run, schema)


def runs(docs: DataFrame, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """One row for each run: doc_id, start, length, period in words, unit (its first period's words)."""

    def rows(doc_id: int | None, words: list[bytes], found: list[Run]) -> list[tuple]:
        return [(doc_id, s, n, q, b" ".join(words[s : s + q]).decode()) for s, n, q in found]

    return _documents(docs, rows, "doc_id long, start long, length long, period long, unit string", rewrite, id_col, text_col, min_length, exponent)


def collapse(docs: DataFrame, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_runs, n_dropped, text): the words of each document joined by blanks, of each run only the first period."""

    def rows(doc_id: int | None, words: list[bytes], found: list[Run]) -> list[tuple]:
        keep = kept_words(len(words), found)
        return [(doc_id, len(found), int((~keep).sum()), b" ".join(w for w, k in zip(words, keep, strict=True) if k).decode())]

    return _documents(docs, rows, "doc_id long, n_runs long, n_dropped long, text string", rewrite, id_col, text_col, min_length, exponent)


def digest(docs: DataFrame, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Each document's number of runs, its strongest run, and checksums of its runs and its collapsed text."""

    def rows(doc_id: int | None, words: list[bytes], found: list[Run]) -> list[tuple]:
        top = best_run(found)
        if found:
            keep = kept_words(len(words), found)
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        milli = 1000 * top[1] // top[2] if top else None
        return [(doc_id, len(found), *(top or (None,) * 3), milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())]

    return _documents(docs, rows, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", rewrite, id_col, text_col, min_length, exponent)
