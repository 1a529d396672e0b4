"""Packing by optimal length buckets.

Documents become sequences of at most max_len tokens (a longer document gives
several; each document ends with one end token, so none is empty). The global
histogram of lengths has at most max_len rows, a proven bound, so it may reach
the driver; there dynamic programming chooses the bucket boundaries that minimise
padding. Inside each bucket sequences are ordered by doc_id, then segment, and
numbered, and each run of budget // boundary of them is one batch.

Numbering does not gather a bucket anywhere: rows are dealt by range of (bucket,
doc_id, segment), so that a bucket of any size spreads over tasks; a row's place
is its place in its partition plus the counts of the partitions before, a table
of at most partitions + buckets rows.

Defined cases: null and empty texts are one sequence with the end token only; null
doc_id comes first; repeated doc_id are separate documents whose equal sequences
are interchangeable; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import partitions_for, save
from webloom.llm.token_table import token_counts

MAX_LEN, BUDGET, BUCKETS = 2048, 32_768, 16


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper ends of at most so many buckets with the least total padding; the smallest set of ends in case of ties."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    count = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * lengths)])
    n = len(lengths)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        new, arg = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], arg[j] = cost[i], i
        choice.append(arg)
        best = new
    out, j = [], n
    for arg in reversed(choice):
        if arg[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(arg[j])
    return sorted(out)


def sequences(docs: DataFrame, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, segment, length) of each sequence."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = token_counts(rows, vocabulary).select("doc_id", (F.col("n_tokens") + 1).alias("n"))
    pieces = total.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_len))).alias("segment"))
    return pieces.select("doc_id", "segment", F.least(F.lit(max_len), F.col("n") - F.col("segment") * max_len).cast("long").alias("length"))


def pack(lengths: DataFrame, max_len: int = MAX_LEN, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """Rows (doc_id, segment, length) with bucket (its boundary), batch (a number in the bucket) and slot (place in the batch)."""
    if budget < max_len:
        raise ValueError("a batch must hold the longest sequence")
    rows = save(lengths.select("doc_id", "segment", "length"), "lengths")
    spark = rows.sparkSession
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most max_len rows
    if any(x > max_len or x < 1 for x in histogram):
        raise ValueError("lengths must lie in 1..max_len")
    ends = boundaries(histogram, buckets) or [max_len]
    bucket = F.get(F.array(*map(F.lit, ends)), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("length")))).cast("long")
    order = ["bucket", "doc_id", "segment", "length"]
    dealt = rows.withColumn("bucket", bucket).repartitionByRange(partitions_for(rows, 16 << 20), *order).sortWithinPartitions(*order)
    dealt = save(dealt.withColumn("at", F.monotonically_increasing_id()), "dealt").withColumn("part", F.shiftrightunsigned("at", 33))
    runs = sorted(map(tuple, dealt.groupBy("bucket", "part").agg(F.min("at"), F.count(F.lit(1))).collect()))
    table, before = [], {}
    for b, part, low, n in runs:
        table.append((b, part, low - before.get(b, 0)))
        before[b] = before.get(b, 0) + n
    shift = F.broadcast(spark.createDataFrame(table, "bucket long, part long, shift long"))
    rank = F.col("at") - F.col("shift")
    size = F.floor(F.lit(budget) / F.col("bucket"))
    return dealt.join(shift, ["bucket", "part"]).select("doc_id", "segment", "length", "bucket", F.floor(rank / size).alias("batch"), (rank % size).alias("slot"))
