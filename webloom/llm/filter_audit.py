"""Filter interaction audit: what each filter removes, in every order of the filters.

Five filters, named by letters, each fail a document or not: A few words, B few distinct words, C many capitals, D
symbols, E a text that a smaller doc_id has. Filters applied in some order remove a document at the first
one it fails, so the set of filters it fails (its mask) decides every order; documents are counted by
part, mask and labels once, and all orders come from those counts.

E is found by partition refinement. One scan gives each row its number of code points and
hashes of successive blocks of its text. Classes of rows are split by number of code points, then by
the hash of each block in turn, and after each split rows alone in their class are dropped, so later splits see
candidates only. The texts of classes that are left are then compared in full: rows are grouped by the text itself, pre-aggregated
before the shuffle, so a group of any size moves one row a task. What may be compared is found in
the second scan by a bitmap of class hashes of a fixed size (BITS bits); a stray bit only costs a comparison. In each text's group all but the
smallest doc_id fail. Hashes never decide: a class that holds several texts is marked by text.

Defined cases: null text counts as empty, and equals an empty one; null lang is the part ''; null doc_id comes after
all others and rows with it don't fail each other; of repeated rows with one doc_id none is smaller, so they don't
fail each other; a label is 1 if any row of its doc_id says so; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import BROADCAST_BYTES, SPACE, attach, keyed_filter, save

FILTERS = "ABCDE"
#: Ends of all blocks but the last, in code points.
BLOCKS = (128, 2048)
#: Bits of the bitmap, as 64 to a row: at most BITS / 64 rows of 16 bytes are broadcast.
BITS = 1 << 24
LEVELS = [f"k{i}" for i in range(len(BLOCKS) + 2)]


def _rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def own_failures(text: Column) -> Column:
    """Letters of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    tests = {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }
    return F.concat(*(F.when(test, letter).otherwise("") for letter, test in tests.items()))


def _classes(text: Column, hash_bits: int) -> list[Column]:
    """Class of a row after each split: number of code points, then with one more block's hash each."""
    edges = [0, *BLOCKS, (1 << 31) - 1]
    blocks = [F.substring(text, a + 1, b - a) for a, b in itertools.pairwise(edges)]
    keys = [F.length(text).cast("long")]
    for block in blocks:
        keys.append(F.xxhash64(keys[-1], block).bitwiseAND(F.lit((1 << hash_bits) - 1 if hash_bits < 64 else -1).cast("long")))
    return [k.alias(name) for k, name in zip(keys, LEVELS, strict=True)]


def refine(rows: DataFrame) -> DataFrame:
    """The last classes (k, size) that hold several rows, from saved rows with LEVELS."""
    alive, total = rows.select(*LEVELS), rows.count()
    groups = None
    for level in LEVELS:
        groups = save(alive.groupBy(level).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "classes")
        if level != LEVELS[-1]:
            alive = save(attach(alive, groups, level, "size", total).filter("size IS NOT NULL").drop("size"), "candidates")
    return groups.withColumnRenamed(LEVELS[-1], "k")


def _maybe(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose class k may be among the classes, by the bitmap."""
    place = F.pmod("k", F.lit(BITS))
    word, bit = F.shiftrightunsigned(place, 6), F.expr("shiftleft(1L, CAST(pmod(k, 64) AS INT))")
    bitmap = classes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def duplicates(docs: DataFrame, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Each row's doc_id, part, own failures and whether a smaller doc_id has its text."""
    source = _rows(docs, id_col, text_col, part_col)
    failures = own_failures(F.col("text")).alias("fails")
    rows = save(source.select("doc_id", "part", failures, *_classes(F.col("text"), hash_bits)), "masks")
    keyed = source.withColumn("k", _classes(F.col("text"), hash_bits)[-1])
    texts = _maybe(keyed, refine(rows)).groupBy("k", "text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = save(texts.groupBy("k").agg(F.min("least").alias("least"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts")).filter("size > 1"), "found")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.col("doc_id").isNull() & F.col("least").isNotNull())
    rows = rows.withColumnRenamed(LEVELS[-1], "k").select("doc_id", "part", "fails", "k")
    mixed = save(found.filter("texts > 1").select("k"), "mixed")
    marked = attach(rows, found.select("k", "least", "size", "texts"), "k", "size", rows.count())
    out = marked.filter("texts IS NULL OR texts = 1").select("doc_id", "part", "fails", later.alias("later"))
    if mixed.isEmpty():
        return out
    clash = keyed_filter(keyed, mixed, "k", "inner")
    least = clash.groupBy("text").agg(F.min("doc_id").alias("least"))
    return out.unionByName(clash.join(least, "text").select("doc_id", "part", failures, later.alias("later")))


def masks(docs: DataFrame, labels: DataFrame, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Numbers of documents: part, fails (letters of all filters failed), good, toxic, n."""
    fails = F.concat("fails", F.when(F.col("later"), "E").otherwise("")).alias("fails")
    rows = duplicates(docs, hash_bits, id_col, text_col, part_col).select("doc_id", "part", fails)
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias({"quality": "good"}.get(c, c))
    told = save(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality"), flag("toxic")).filter("good OR toxic"), "told")
    small = told.count() * 16 <= BROADCAST_BYTES
    # Without the broadcast, repeated rows of one doc_id, and all without one, meet in few rows before the shuffle.
    rows = rows.withColumn("n", F.lit(1).cast("long")) if small else rows.groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(F.broadcast(told) if small else told, "doc_id", "left")
    return joined.groupBy("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def orders(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the letters and step, from counts (part, fails, good, toxic, n)."""
    permutations = F.array(*map(F.lit, map("".join, itertools.permutations(letters))))
    rows = counts.select("*", F.explode(permutations).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    gone = F.expr("translate(substring(filter_order, 1, step - 1), fails, '')") != before
    fails = F.instr(F.col("fails"), letter) > 0
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).alias
    table = rows.groupBy("part", "filter_order", "step", letter.alias("letter")).agg(
        n(~gone & ~fails)("kept"),
        n(~gone & fails)("removed"),
        n(gone & fails)("redundant"),
        n(F.col("fails") == letter)("unique_fails"),
        n(~gone & fails & F.col("good"))("good_lost"),
        n(~gone & fails & F.col("toxic"))("toxic_lost"),
    )
    share = table.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return table.join(share, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts of every part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(save(masks(docs, labels, hash_bits, id_col, text_col, part_col), "mask-counts"))
