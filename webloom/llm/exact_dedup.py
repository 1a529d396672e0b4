"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is normalised (each run of \\x20, \\x09-\\x0D becomes one space) and cut
into chunks where its content says so: a chunk ends at the first place, after a
least length, where the last characters match CUT, or at a largest length. A
chunk's identifier is its 64-bit hash plus an ordinal. Identifiers are verified:
the distinct (hash, chunk) pairs are gathered once, which moves each distinct
chunk at most once per map task, and where one hash stands for several contents
these are numbered in order. A document's recipe is the ordered list of its
chunk identifiers; equal recipes mean equal texts. Only recipes move from then
on, never texts.

Defined cases: null text counts as empty; empty texts form one group; a null
doc_id sorts after all others when the row to keep is chosen (and is kept only
if the whole group has null identifiers); repeated rows with the same doc_id
belong to one group and the kept flag is true for each row that carries the
kept identifier; an empty table gives an empty table; other columns are carried
by dedup() and ignored by groups().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import SPACE, attach, fresh, keyed_filter, save

#: Chunk ends: after 256 characters or more at a space that follows one of these letters and one of those, or at 4096.
LEAST, MOST, CUT = 256, 4096, r"[aeiou][dnrst]\x20"
CHUNK = rf"(?s).{{{LEAST}}}.{{0,{MOST - LEAST - 3}}}?{CUT}|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def chunks_of(text: Column) -> Column:
    """Ordered chunks of a normalised text; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, text_col: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """docs with a column recipe (binary), which replaces one of that name: the ordered verified chunk identifiers of each text."""
    chunks, doc = fresh(docs, "chunks"), fresh(docs, "doc")
    base = docs.drop("recipe").withColumn(chunks, chunks_of(normalised(F.col(f"`{text_col}`"))))
    pairs = base.select(F.explode(chunks).alias("chunk")).select(hash_of("chunk").alias("h"), "chunk")
    clashes = save(pairs.groupBy("h", "chunk").agg(F.lit(1).alias("one")).groupBy("h").count().filter("count > 1").select("h"), "clashes")
    if clashes.isEmpty():
        # Every hash stands for one content, so the hashes themselves are verified identifiers.
        ids = F.transform(chunks, lambda c: F.lpad(F.hex(hash_of(c)), 16, "0"))
        return base.withColumn("recipe", F.unhex(F.array_join(ids, ""))).drop(chunks)
    # Contents under a hash that several share are numbered; all their chunks pass through one join by hash and content.
    several = pairs.join(clashes, "h", "left_semi").distinct()
    # A clashing hash has a handful of contents; the rank of each is the count of smaller ones under its hash.
    other = several.select("h", F.col("chunk").alias("less"))
    numbered = save(several.join(other, "h").groupBy("h", "chunk").agg(F.sum((F.col("less") < F.col("chunk")).cast("int")).alias("ordinal")), "ordinals")
    keyed = base.withColumn(doc, F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    parts = keyed.select(F.col(doc).alias("doc"), F.col(chunks).alias("chunks")).dropDuplicates(["doc"]).select("doc", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", hash_of("chunk"))
    ids = parts.join(numbered, ["h", "chunk"], "left").select("doc", "pos", F.concat(F.lpad(F.hex("h"), 16, "0"), F.lpad(F.hex(F.coalesce("ordinal", F.lit(0))), 4, "0")).alias("id"))
    lists = ids.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l")).select(F.col("doc").alias(doc), F.unhex(F.array_join(F.col("l.id"), "")).alias("recipe"))
    return keyed.drop(chunks).join(lists, doc, "left").drop(doc).withColumn("recipe", F.coalesce("recipe", F.lit(b"")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = save(recipes(rows, "text", hash_of).select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), "recipe"), "recipes")
    by = made.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = attach(made, save(by, "recipe-groups"), "recipe", "group_size", made.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows whose text equals that of a row with a smaller identifier, columns as they were.

    Of several rows with the smallest identifier itself one stays.
    """
    key = F.concat_ws("|", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    mark = fresh(docs, "key")
    rows = docs.withColumn(mark, key)
    told = groups(docs, id_col, text_col).select(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias(mark), "kept")
    told = save(told.groupBy(mark).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    rest = keyed_filter(rows, told.filter(~F.col("kept")).select(mark), mark, "left_anti")
    twice = told.filter("kept and n > 1").select(mark)
    if twice.isEmpty():
        return rest.drop(mark)
    return keyed_filter(rest, twice, mark, "left_anti").union(keyed_filter(rest, twice, mark, "left_semi").dropDuplicates([mark])).drop(mark)
