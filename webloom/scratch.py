"""Cutting lineage with reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder, spark.checkpoint.dir; where that is unset, a folder of our own in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="webloom-")


def cut(df: DataFrame) -> DataFrame:
    """df read back from a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_base(df.sparkSession))
    return df.checkpoint()
