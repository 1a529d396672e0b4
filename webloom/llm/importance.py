"""Quality classifier by importance resampling with hashed n-gram generative models.

Texts are bags of hashed word n-grams (words are runs of anything but \\x20 and
\\x09-\\x0D; unigrams keep their case and marks, bigrams too) in BUCKETS buckets.
Two multinomials are fitted: the target model on one half (by hash) of all labelled
rows that are wanted, however many, the raw model on all documents. A document's log importance weight is the sum,
over its n-grams, of log p_target - log p_raw. Adding independent Gumbel noise to
the weights and taking the k largest draws k documents without replacement, with
chances in proportion to the weights.

k is set by the other half, whose weights the model has not seen: the weight that
RECALL of them reach is found, and k is the number of documents that reach it. Both this weight and the k-th largest
noisy weight (in steps of 2^-20) are found exactly by counting, digit by digit of
64 bits, over all rows: four tables of at most 65,536 counts. Noise is a
function of seed, doc_id and text, so runs repeat; rows that tie at the k-th place are
all kept.

Defined cases: null and empty texts have no n-grams: they can't be weighed and are
rejected; null or repeated doc_id are ordinary rows (they take part under their
text); without wanted labels everything with a word is kept; an empty table gives
an empty table; other columns are ignored by weigh() and carried by keep().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import fresh, keyed_filter, map_arrow, save
from webloom.llm._text import U64, chain, column, mix, slices, span_hashes, window_hashes, word_spans

BUCKETS = 1 << 15
#: Share of wanted labelled rows whose weight k must let in.
RECALL = 0.995
#: Added to each bucket's count, in average buckets: a strong prior, as most bigrams of a new text are unseen.
SMOOTH = 3.0


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every unigram and bigram."""
    starts, ends, first = word_spans(data, offs)
    h = span_hashes(data, starts, ends)
    one = np.repeat(np.arange(len(first) - 1), np.diff(first))
    two, where = window_hashes(h, first, 2, chain)
    return (mix(np.concatenate([h, two])) % U64(BUCKETS)).astype(np.int64), np.concatenate([one, where])


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: how often each bucket occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, offs, data in slices(column(batch, "text")):
            total += np.bincount(features(data, offs)[0], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def counts_of(texts: DataFrame) -> np.ndarray:
    """Bucket counts over all texts; the driver gets BUCKETS numbers, whatever the input."""
    rows = map_arrow(texts.select("text"), _count_task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.float64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p, q = (x + SMOOTH * max(x.sum(), 1) / BUCKETS for x in (target, raw))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as longs in the doubles' order, and back."""
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _weigh_task(ratio: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "key")
            for lo, hi, offs, data in slices(column(batch, "text")):
                bucket, text = features(data, offs)
                weight = np.bincount(text, ratio[bucket], minlength=hi - lo) + 0.0  # no -0.0, whose bits differ
                words = np.bincount(text, minlength=hi - lo)
                key = keys.slice(lo, hi - lo).to_numpy()
                unit = (mix(key.view(U64) + U64(seed)) >> U64(11)).astype(float)
                noise = -np.log(-np.log((unit + 0.5) / 2.0**53))
                none = words == 0
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(key), pa.array(weight, mask=none), pa.array(weight + noise, mask=none), pa.array(_ordered(weight.view(np.int64)), mask=none)], ["doc_id", "key", "weight", "noisy", "w"])

    return run


def _kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs in column v, 16 bits at a time; None if there are fewer."""
    top = F.shiftrightunsigned
    ordered = F.col("v").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    prefix, left = 0, k
    rows = values.select(ordered.alias("u"))
    for shift in (48, 32, 16, 0):
        here = rows if shift == 48 else rows.filter(top("u", shift + 16) == F.lit(prefix if prefix < 1 << 63 else prefix - (1 << 64)))
        counts = here.groupBy(top("u", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")).count().collect()
        for digit, n in sorted(counts, reverse=True):
            if left <= n:
                prefix = prefix << 16 | int(digit)
                break
            left -= n
        else:
            return None
    return (prefix ^ (1 << 63)) - (1 << 64) if prefix ^ (1 << 63) >= 1 << 63 else prefix ^ (1 << 63)


def _percentile(values: DataFrame, share: float) -> float | None:
    """The interpolated percentile, as F.percentile has it, of doubles given by their ordered bits in column v; None without values. No task holds them."""
    n = values.count()
    if n == 0:
        return None
    at = (n - 1) * share
    low = high = _kth_largest(values, n - math.floor(at))
    if at > math.floor(at) and values.filter(F.col("v") <= low).count() <= math.ceil(at):
        high = values.filter(F.col("v") > low).agg(F.min("v")).first()[0]
    low, high = _ordered(np.array([low, high], np.int64)).view(np.float64).tolist()
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def weigh(docs: DataFrame, labels: DataFrame, wanted: str = "quality = 1 and toxic = 0", id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, key, weight, noisy weight, kept. labels: doc_id and the columns that wanted speaks of."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    good = labels.filter(wanted).select("doc_id").filter("doc_id is not null").distinct()
    good = save(good.withColumn("fit", F.xxhash64("doc_id", F.lit("half")) % 2 == 0), "wanted")
    fit, held = good.filter("fit").select("doc_id"), good.filter("not fit").select("doc_id")
    ratio = log_ratio(counts_of(keyed_filter(rows, fit, "doc_id", "left_semi")), counts_of(rows)) if not fit.isEmpty() else np.zeros(BUCKETS)
    weighed = map_arrow(rows, _weigh_task(ratio, seed), "doc_id long, key long, weight double, noisy double, w long")
    weighed = save(weighed.withColumn("v", F.floor(F.col("noisy") * 2.0**20)), "weighed")
    reach = _percentile(save(keyed_filter(weighed.filter("w is not null"), held, "doc_id", "left_semi").select(F.col("w").alias("v")), "held"), 1 - recall)
    if reach is None:
        return weighed.select("doc_id", "key", "weight", "noisy", F.col("weight").isNotNull().alias("kept"))
    k = weighed.filter(F.col("weight") >= reach).count()
    least = _kth_largest(weighed.filter("v is not null"), max(1, k))
    return weighed.select("doc_id", "key", "weight", "noisy", F.coalesce(F.col("v") >= F.lit(least), F.lit(False)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, wanted: str = "quality = 1 and toxic = 0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that were not drawn."""
    mark = fresh(docs, "key")
    out = weigh(docs, labels, wanted, id_col, text_col).filter(~F.col("kept")).select(F.col("key").alias(mark)).distinct()
    key = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return keyed_filter(docs.withColumn(mark, key), save(out, "rejected"), mark, "left_anti").drop(mark)
