"""Corpus preparation: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases: an empty table passes through as an empty table; rows with a null identifier are
ordinary rows, told apart by their text; documents without a word go in the first stage where labels
are given (they can't be weighed); of rows equal in identifier and text one stays after exact_dedup; extra columns are
carried, whatever their names, up to the last stage, which returns doc_id, segment, length, bucket, batch and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import exact_dedup, importance, ngram_join, packing, secret_scan
from webloom.llm._common import save, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents that are not drawn go."""
    return importance.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle Jaccard of 0.8 or more stays."""
    return ngram_join.dedup(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go."""
    return secret_scan.drop_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in optimal length buckets."""
    return packing.pack(packing.sequences(docs))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("secret_scan", secrets), ("packing", pack)]

#: Not expressible: resampling weights, tokenizer lengths and the bucket optimum have no SQL form; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark) as keep:  # what a stage has written for itself goes when its result is written
            docs = keep(save(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs
