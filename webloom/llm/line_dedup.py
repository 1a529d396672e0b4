"""Line deduplication by a tree of log templates.

Lines (\\n-split, with a word) are parsed into tokens; tokens with a digit are
variable fields, <*>. Two levels of templates follow, each found by aggregation:

1. A line's masked tokens. If MIN_DOCS or more documents have lines of this template,
   it is recurring.
2. Other lines descend a tree of fixed depth: by token count, then by their first
   DEPTH masked tokens. In a leaf, a token is a constant of its position if it stands
   there in MIN_DOCS lines or more, however many lines the leaf has; other tokens are
   generalised to <*>. Such a template is recurring if lines of MIN_DOCS documents have
   it and SOLID percent or more of its tokens are constants.

Lines of recurring templates are dropped from all documents. A document is its doc_id
and text; a line that it repeats counts once. All counts are combined before each
shuffle, so a hot line is one row per task and document; no group meets in one task.
Constants are marked by a join on leaf, position and token whose hot keys are broadcast,
so neither a large leaf nor a common token meets in one task or one list.
Tokens, templates and leaves are known by 64-bit hashes.

Defined cases: null text counts as empty; lines without a word are never dropped; null
or repeated doc_id are ordinary rows (rows equal in doc_id and text are one document); an
empty table gives an empty table; other columns are carried by clean() and ignored by
report().
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import attach, fresh, keyed_filter, map_arrow, save
from webloom.llm._text import U64, column, mix, slices, keyed_hashes, keyed_values, word_spans

DEPTH, MIN_DOCS, SOLID = 2, 10, 70
FIELD = "<*>"
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (hash of doc_id and text) and text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("doc"), text.alias("text"))


def field_hash() -> np.uint64:
    """The token hash of a variable field in this application."""
    return keyed_hashes(np.frombuffer(FIELD.encode(), np.uint8), np.array([0]), np.array([len(FIELD)]))[0]


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with a word: text index, place among the text's lines, first and end word, mask, leaf; and all masked token hashes."""
    starts, ends, _ = word_spans(data, offs)
    tokens = keyed_hashes(data, starts, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    tokens[digits[ends] > digits[starts]] = field_hash()
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    first = np.searchsorted(starts, begin)
    size = np.diff(np.append(first, len(starts)))
    used = np.flatnonzero(size)
    begin, first, size = begin[used], first[used], size[used]
    text = np.searchsorted(offs, begin, "right") - 1
    place = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offs[text])
    mask = keyed_values(mix(tokens), first, first + size) if len(used) else np.zeros(0, U64)
    leaf = mix(size.astype(U64))
    for d in range(DEPTH):
        there = np.where(size > d, tokens[np.minimum(first + d, max(len(tokens) - 1, 0))], U64(0)) if len(used) else np.zeros(0, U64)
        leaf = mix(leaf * U64(31) + there)
    return text, place, first, first + size, mask, leaf, tokens


def _lines_task(with_tokens: bool):
    """(doc, mask, leaf) of the distinct lines of each document, and their token hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = column(batch, "doc").to_numpy()
            for lo, _, offs, data in slices(column(batch, "text")):
                text, _, first, end, mask, leaf, tokens = lines_of(data, offs)
                order = np.lexsort((mask, text))
                new = np.ones(len(order), bool)
                new[1:] = (mask[order[1:]] != mask[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
                pick = order[new]
                cols = [pa.array(docs[lo + text[pick]]), pa.array(mask[pick].view(np.int64)), pa.array(leaf[pick].view(np.int64))]
                if with_tokens:
                    size = (end - first)[pick]
                    at = np.concatenate([[0], np.cumsum(size)])
                    flat = tokens[np.repeat(first[pick] - at[:-1], size) + np.arange(at[-1])]
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc", "mask", "leaf", "tokens"][: len(cols)])

    return run


def _places_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = column(batch, "doc").to_numpy()
        for lo, _, offs, data in slices(column(batch, "text")):
            text, place, _, _, mask, _, _ = lines_of(data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(docs[lo + text]), pa.array(place, pa.int32()), pa.array(mask.view(np.int64))], ["doc", "pos", "mask"])


def recurring_masks(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Masks of the lines to drop (one column, mask, saved)."""
    rows = _keyed(docs, id_col, text_col)
    plain = save(map_arrow(rows, _lines_task(False), "doc long, mask long, leaf long"), "masks").distinct()
    first = save(plain.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("mask"), "recurring-1")
    busy = keyed_filter(plain, first, "mask", "left_anti").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    busy = save(busy.filter(F.col("n") >= min_docs), "busy-leaves")
    if busy.isEmpty():
        return first
    lines = map_arrow(rows, _lines_task(True), "doc long, mask long, leaf long, tokens array<long>")
    held = save(keyed_filter(keyed_filter(lines, busy.select("leaf"), "leaf", "left_semi"), first, "mask", "left_anti").dropDuplicates(["doc", "mask"]), "busy-lines")
    field = F.lit(int(field_hash().view(np.int64)))
    place = F.xxhash64("leaf", "pos", "token").alias("place")
    at = lambda rows: rows.select("mask", "leaf", F.posexplode("tokens").alias("pos", "token")).filter(F.col("token") != field)
    counts = save(at(held).groupBy(place).agg(F.count(F.lit(1)).alias("k")), "places")
    total = counts.agg(F.sum("k")).first()[0] or 0
    constant = counts.filter(F.col("k") >= min_docs).withColumn("fixed", F.lit(True))
    # A mask here has fewer than min_docs documents; its tokens are looked up once.
    shapes = held.dropDuplicates(["mask"])
    spots = save(at(shapes).select("mask", "pos", "token", place), "spots")
    marked = attach(spots, constant, "place", "k", total).filter("fixed")
    marked = marked.groupBy("mask").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("shape"))
    marked = shapes.select("mask", F.size("tokens").alias("size")).join(marked, "mask").filter(100 * F.size("shape") >= SOLID * F.col("size"))
    solid = save(marked.select("mask", F.xxhash64("size", "shape").alias("template")), "templates")
    named = save(keyed_filter(held.select("doc", "mask"), solid, "mask", "inner"), "named")
    second = named.select("template", "doc").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("template")
    return save(first.union(keyed_filter(named, save(second, "recurring-2"), "template", "left_semi").select("mask").distinct()), "recurring")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", counter: str | None = None) -> DataFrame:
    """docs with the lines of recurring templates taken out of the text; texts that hold none are as they were. counter: a column for their number."""
    gone = recurring_masks(docs, min_docs, id_col, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    places = map_arrow(_keyed(docs, id_col, text_col), _places_task, "doc long, pos int, mask long")
    hit = keyed_filter(places, gone, "mask", "left_semi").select("doc", "pos").distinct()
    doc, held = fresh(docs, "doc"), fresh(docs, "gone")
    bad = save(hit.groupBy(F.col("doc").alias(doc)).agg(F.array_sort(F.collect_list("pos")).alias(held)), "hit-lines")
    rows = keyed_filter(docs.withColumn(doc, F.xxhash64(F.col(f"`{id_col}`"), text)), bad, doc, "left").select(*(f"`{c}`" for c in docs.columns), held)
    # A flag a line, from the gaps between the lines that go, so that the time grows with the lines and not with their square; array_join passes over nulls.
    flags = F.flatten(F.transform(F.col(held), lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(F.col(held), i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    left = F.array_join(F.zip_with(_split(text), flags, lambda line, go: F.when(go, None).otherwise(line)), "\n")
    out = rows.withColumn(text_col, F.when(F.col(held).isNull(), text).otherwise(left))
    if counter:
        out = out.withColumn(counter, F.coalesce(F.size(held), F.lit(0)).cast("long"))
    return out.drop(held)


def report(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines (\\n-split), n_dropped, text_sha256 of the text that is left (null counts as empty)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = clean(rows.withColumn("n_lines", F.size(_split(F.col("text"))).cast("long")), min_docs, counter="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], min_docs: int) -> list[tuple[int | None, int, str]]:
    """(doc_id, n_dropped, text left) by direct counting: for tests."""
    mask = lambda line: tuple(FIELD if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    docs = {row: {m for line in (row[1] or "").split("\n") if (m := mask(line))} for row in rows}
    by_mask: dict[tuple, set] = defaultdict(set)
    for row, masks in docs.items():
        for m in masks:
            by_mask[m].add(row)
    drop = {m for m, d in by_mask.items() if len(d) >= min_docs}
    leaves: dict[tuple, list] = defaultdict(list)
    for row, masks in docs.items():
        for m in masks - drop:
            leaves[(len(m), m[:DEPTH])].append((row, m))
    shapes: dict[tuple, list] = defaultdict(list)
    for held in leaves.values():
        count: dict[tuple, int] = defaultdict(int)
        for _, m in held:
            for place in enumerate(m):
                count[place] += 1
        for row, m in held:
            shape = tuple(t if t != FIELD and count[i, t] >= min_docs else FIELD for i, t in enumerate(m))
            if 100 * sum(t != FIELD for t in shape) >= SOLID * len(shape):
                shapes[shape].append((row, m))
    drop |= {m for found in shapes.values() if len({row for row, _ in found}) >= min_docs for _, m in found}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [line for line in lines if mask(line) not in drop]
        out.append((doc, len(lines) - len(left), "\n".join(left)))
    return out
