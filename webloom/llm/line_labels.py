"""Quality rules and line labelling with a linear-chain conditional random field.

Base counts of a text (words are runs of anything but \\x20 and \\x09-\\x0D):
n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>;
n_dup_lines, \\n-split lines with a word that equal an earlier line; and
n_repeat_words, words in 5-word windows found twice or more in the text.
base_failed: n_words < 10, or n_repeat_words over 20 in 100 words.

The method labels each line that has a word as content or boilerplate: lines have
binary features (bands of length, share of capitals, digits, marks and symbols,
repeated words, mean word length, ending, place, repetition), and Viterbi decoding
of a two-state linear-chain CRF finds the best label sequence. A document is kept
if it passes the base and words of content lines are SHARE of its words or more.

The CRF is fitted on a bounded sample of labelled documents, at most SAMPLE (the
smallest by a hash): lines of documents of quality 1 are content, others
boilerplate, by maximum conditional likelihood (forward-backward, Adam steps from
zero, so repeated fits agree). For fitting alone, sequences are cut into pieces of
PIECE lines; every line of the sample takes part, and decoding covers whole texts.

Defined cases: null and empty texts have no words (base_failed); null or repeated
doc_id are ordinary rows; without labelled rows all lines are content; an empty
table gives an empty table; other columns are ignored by judge() and carried by keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import fresh, keyed_filter, map_arrow, save
from webloom.llm._text import column, slices, keyed_hashes, window_hashes, word_spans

SAMPLE, PIECE, STEPS, SHARE = 4_000, 64, 120, 0.5
#: Bytes that a labelled text, and all of them together, may have to be gathered for fitting.
SAMPLE_TEXT, SAMPLE_BYTES = 1 << 20, 32 << 20
CONTENT, BOILERPLATE = 0, 1

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _MARK = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!?", ".,;:"))
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
#: Band edges of each measured share or size; a value falls into the band below the first edge above it.
EDGES = {
    "words": (3, 6, 12, 25, 60, 150),
    "upper": (0.02, 0.08, 0.2, 0.5),
    "digit": (0.01, 0.05, 0.2),
    "symbol": (0.005, 0.03, 0.08),
    "bang": (0.005, 0.03, 0.08),
    "mark": (0.005, 0.02, 0.05),
    "repeat": (0.05, 0.15, 0.3, 0.5, 0.75),
    "length": (3, 5, 8, 12),
}
FLAGS = ("bias", "first", "last", "again", "stops")
N_FEATURES = sum(len(e) + 1 for e in EDGES.values()) + len(FLAGS)


@dataclass
class Lines:
    """Lines with a word of a slice of texts."""

    text: np.ndarray  # text index of each line, ascending
    words: np.ndarray
    active: np.ndarray  # (lines, columns) indices of the features that are on


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[Lines, np.ndarray, np.ndarray]:
    """(lines, base counts per text as columns, index of the first line of each text)."""
    n = len(offs) - 1
    starts, ends, first = word_spans(data, offs)
    h = keyed_hashes(data, starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    # Lines: pieces between \n and text bounds.
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_text = np.searchsorted(offs, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offs[line_text + 1])
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 0x0A))
    word_line = np.searchsorted(line_start, starts, "right") - 1
    words = np.bincount(word_line, minlength=len(line_start))
    used = np.flatnonzero(words)
    s, e, line_text, words = line_start[used], line_end[used], line_text[used], words[used]
    line_hash = keyed_hashes(data, s, e)
    order = np.lexsort((np.arange(len(used)), line_hash, line_text))
    again = np.zeros(len(used), bool)
    again[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (line_text[order[1:]] == line_text[order[:-1]])
    # Words in repeated 5-word windows.
    wh, wt = window_hashes(h, first, 5)
    at = np.flatnonzero(text[: len(h) - 4] == text[4:]) if len(h) > 4 else np.zeros(0, np.int64)
    order = np.lexsort((wh, wt))
    same = np.zeros(len(wh) + 1, bool)
    same[1:-1] = (wh[order[1:]] == wh[order[:-1]]) & (wt[order[1:]] == wt[order[:-1]]) if len(wh) > 1 else False
    twice = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    repeat = np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n)
    chars = np.bincount(text, _sums(_STARTS_CHAR[data], starts, ends), n).astype(np.int64)
    symbols = _sums(_SYMBOL[data], offs[:-1], offs[1:])
    base = np.stack([np.diff(first), chars, symbols, np.bincount(line_text[again], minlength=n), repeat], 1)
    # Features.
    place = np.searchsorted(used, word_line)
    pair = np.lexsort((h, place))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[pair[1:]] != h[pair[:-1]]) | (place[pair[1:]] != place[pair[:-1]])
    distinct = np.bincount(place[pair][fresh], minlength=len(used))
    length = np.maximum(e - s, 1)
    values = {"words": words, "repeat": 1 - distinct / np.maximum(words, 1), "length": np.bincount(place, ends - starts, len(used)) / np.maximum(words, 1)}
    values |= {k: _sums(t[data], s, e) / length for k, t in (("upper", _UPPER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("bang", _BANG), ("mark", _MARK))}
    cols, base_at = [], 0
    for name, edges in EDGES.items():
        cols.append(base_at + np.searchsorted(edges, values[name], "right"))
        base_at += len(edges) + 1
    head = np.searchsorted(line_text, np.arange(n + 1))
    lead, tail = np.zeros(len(used), bool), np.zeros(len(used), bool)
    some = np.flatnonzero(np.diff(head))
    lead[head[some]], tail[head[some + 1] - 1] = True, True
    off = N_FEATURES  # stands for a feature that is off
    for i, on in enumerate((np.ones(len(used), bool), lead, tail, again, np.isin(data[np.maximum(e - 1, 0)], [ord("."), ord("!"), ord("?")]))):
        cols.append(np.where(on, base_at + i, off))
    return Lines(line_text, words, np.stack(cols, 1) if cols else np.zeros((0, 0), int)), base, head


@dataclass
class Crf:
    """Weights: emission (features + 1, 2), the last row for absent features; transition (from, to); start."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    @classmethod
    def zero(cls) -> Crf:
        return cls(np.zeros((N_FEATURES + 1, 2)), np.zeros((2, 2)), np.zeros(2))

    def scores(self, active: np.ndarray) -> np.ndarray:
        return self.emission[active].sum(1)


def _packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and how many have more than t lines for each t."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")


def viterbi(crf: Crf, scores: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Best label of each line; sequences are the runs between entries of head."""
    lengths = np.diff(head)
    order, live = _packed(lengths)
    begin = head[:-1][order]
    labels, back = np.zeros(len(scores), np.int8), np.zeros((len(scores), 2), np.int8)
    best = np.zeros((len(order), 2))
    for t, n in enumerate(live):
        at = begin[:n] + t
        if t == 0:
            best[:n] = crf.start + scores[at]
            continue
        step = best[:n, :, None] + crf.transition
        back[at] = step.argmax(1)
        best[:n] = step.max(1) + scores[at]
    state = best.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def fit(active: np.ndarray, labels: np.ndarray, head: np.ndarray, steps: int = STEPS, rate: float = 0.1, l2: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam on forward-backward gradients."""
    crf = Crf.zero()
    lengths = np.diff(head)
    order, live = _packed(lengths)
    begin, total = head[:-1][order], max(1, len(labels))
    seen_e = np.zeros_like(crf.emission)
    for j in range(active.shape[1] if len(active) else 0):
        np.add.at(seen_e, (active[:, j], labels), 1.0)
    follows = np.ones(len(labels), bool)
    follows[head[:-1][lengths > 0]] = False
    at = np.flatnonzero(follows)
    seen_t, seen_s = np.zeros((2, 2)), np.zeros(2)
    np.add.at(seen_t, (labels[at - 1], labels[at]), 1.0)
    np.add.at(seen_s, labels[~follows], 1.0)
    params = [crf.emission, crf.transition, crf.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        scores = crf.scores(active)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        for t, n in enumerate(live):
            at = begin[:n] + t
            alpha[at] = scores[at] + (crf.start if t == 0 else np.logaddexp(alpha[at - 1, :1] + crf.transition[0], alpha[at - 1, 1:] + crf.transition[1]))
        for t in range(len(live) - 2, -1, -1):
            at = begin[: live[t + 1]] + t
            after = scores[at + 1] + beta[at + 1]
            beta[at] = np.stack([np.logaddexp(crf.transition[i, 0] + after[:, 0], crf.transition[i, 1] + after[:, 1]) for i in (0, 1)], 1)
        log_z = np.logaddexp(*(alpha + beta).T)
        chance = np.exp(alpha + beta - log_z[:, None])
        want_e = np.zeros_like(crf.emission)
        for j in range(active.shape[1] if len(active) else 0):
            for y in (0, 1):
                want_e[:, y] += np.bincount(active[:, j], chance[:, y], len(want_e))
        at = np.flatnonzero(follows)
        joint = alpha[at - 1][:, :, None] + crf.transition + (scores[at] + beta[at])[:, None, :] - log_z[at][:, None, None]
        grads = [seen_e - want_e, seen_t - np.exp(joint).sum(0), seen_s - chance[~follows].sum(0)]
        grads[0][-1] = 0
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g / total - l2 * p
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return crf


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """Fit on at most sample labelled documents (doc_id, quality), of at most SAMPLE_TEXT bytes each and SAMPLE_BYTES together: what the driver gathers."""
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = keyed_filter(docs, save(chosen, "labelled"), "doc_id", "inner").select("text", "quality").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT)
    rows = save(rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).orderBy(F.xxhash64("text"), "text", "quality").limit(sample), "sample")
    order = [F.xxhash64("text"), "text", "quality"]
    sizes = [r[0] for r in rows.orderBy(*order).select("size").collect()]  # at most sample numbers
    seen = rows.orderBy(*order).limit(int(np.searchsorted(np.cumsum(sizes), SAMPLE_BYTES, "right"))).select("text", "quality").toArrow()
    if not seen.num_rows:
        return Crf.zero()
    active, truth, heads, at = [], [], [], 0
    quality = np.array(seen["quality"].to_pylist())
    for lo, hi, offs, data in slices(seen["text"].combine_chunks()):
        lines, _, head = lines_of(data, offs)
        active.append(lines.active)
        truth.append(np.where(quality[lo:hi][lines.text] == 1, CONTENT, BOILERPLATE))
        heads += [at + x for a, b in zip(head[:-1], head[1:], strict=True) for x in range(int(a), int(b), PIECE)]
        at += len(lines.text)
    return fit(np.concatenate(active), np.concatenate(truth), np.array([*heads, at])) if at else Crf.zero()


def _judge_task(crf: Crf, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            for lo, hi, offs, data in slices(column(batch, "text")):
                lines, base, head = lines_of(data, offs)
                n = hi - lo
                label = viterbi(crf, crf.scores(lines.active), head) if len(lines.text) else np.zeros(0, np.int8)
                content = np.bincount(lines.text, lines.words * (label == CONTENT), n)
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                part = content / np.maximum(base[:, 0], 1)
                cols = [*(pa.array(base[:, i], pa.int64()) for i in range(5)), pa.array(failed), pa.array(~failed & (part >= share)), pa.array(np.diff(head), pa.int64()), pa.array(np.bincount(lines.text, label == CONTENT, n).astype(np.int64)), pa.array(part)]
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(lo, n) for c in rest), *cols], [*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"])

    return run


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"


def judge(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, key (of the row's doc_id and text), base counts, base_failed, kept, line counts and content share."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    crf = train(rows, labels, sample)
    return map_arrow(rows.withColumn("key", F.xxhash64("doc_id", "text")), _judge_task(crf, share), f"doc_id long, key long, {_OUT}")


def keep(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that are kept, columns as they were."""
    mark = fresh(docs, "key")
    out = save(judge(docs, labels, share, id_col, text_col).filter("not kept").select(F.col("key").alias(mark)).distinct(), "failed")
    key = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return keyed_filter(docs.withColumn(mark, key), out, mark, "left_anti").drop(mark)
