"""Scratch tables, salted lookups and connected components used by several operators."""

from __future__ import annotations

import atexit
import math
import secrets
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm._text import use_secret
from webloom.scratch import checkpoint_base
from webloom.session import ship

#: Words are runs of anything but these: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}
#: What save() wrote and nothing has released, in order.
_SAVED: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"{checkpoint_base(spark)}/webloom-{app}"
        atexit.register(clear_scratch, spark)
    return _OWN[app]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what save() wrote in this application. Results that still read it must be written first."""
    try:
        _delete(spark, _OWN[spark.sparkContext.applicationId])
    except Exception:  # the JVM may be gone at exit
        pass


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    _SAVED.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At the end, deletes what was saved meanwhile but for the saved tables passed to the yielded function. For steps whose results are written by then."""
    begin, kept = len(_SAVED), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.saved_at)
        return df

    yield keep
    for path in _SAVED[begin:]:
        if path not in kept:
            _delete(spark, path)
    _SAVED[begin:] = [p for p in _SAVED[begin:] if p in kept]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: texts make batches of 10,000 rows too large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


_SECRETS: dict[str, bytes] = {}


def own_secret(spark: SparkSession) -> bytes:
    """This application's secret for keyed hashes, drawn once and used on the driver from now on."""
    secret = _SECRETS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))
    use_secret(secret)
    return secret


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package and this application's secret on the workers, and batches of bounded size (a single longer text is its own batch)."""
    spark = df.sparkSession
    ship(spark)
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(name, default).removesuffix("b") in (default, "64m"):
            spark.conf.set(name, ours)
    secret = own_secret(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_secret(secret)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """At least the session's shuffle partitions, and enough for bytes_each of the plan's estimated size."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # sources without statistics count as endless
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bytes_each) if known else 1)


#: Bytes of values that a broadcast table may have; Spark's own form of it takes a few times that.
BROADCAST_BYTES = 16 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row's values."""

    def of(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(t, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in t.fields), F.lit(8))
        if isinstance(t, T.ArrayType):
            flat = not isinstance(t.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType)
            n = F.coalesce(F.size(c), F.lit(0)) * 8 if flat else F.aggregate(F.coalesce(c, F.array().cast(t)), F.lit(0).cast("long"), lambda a, x: a + of(x, t.elementType))
            return n + 8
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")


#: Groups of at least this many rows (and at least 1/100000 of all rows, so at most 100,000 groups) may count as hot.
HOT_ROWS, HOT_SHARE = 10_000, 100_000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one row per key (saved), whatever share one key has.

    Hot keys are broadcast: at most HOT_SHARE of them, and the largest by powers of two that stay within
    BROADCAST_BYTES. Other keys meet in a shuffle.
    """
    least = max(HOT_ROWS, math.ceil(total / HOT_SHARE))
    # One row for each power of two.
    weights = groups.filter(F.col(size) >= least).groupBy(F.floor(F.log2(size)).alias("p")).agg(F.sum(_width(groups)).alias("w")).collect()
    so_far, limit = 0, None
    for power, weight in sorted(weights, reverse=True):
        so_far += weight
        if so_far > BROADCAST_BYTES:
            break
        limit = max(least, 1 << power)
    if limit is None:
        return rows.join(groups, key, "left")
    names, mark = [c for c in groups.columns if c != key], fresh(rows, "hot")
    with_hot = rows.join(F.broadcast(groups.filter(F.col(size) >= limit).select(key, F.struct(*names).alias(mark))), key, "left")
    cold = with_hot.filter(F.col(mark).isNull()).drop(mark).join(groups.filter(F.col(size) < limit), key, "left")
    return with_hot.filter(F.col(mark).isNotNull()).select(*rows.columns, *[F.col(f"{mark}.{c}").alias(c) for c in names]).unionByName(cold)


def keyed_filter(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi, anti, left or inner join with a saved table of keys, which is broadcast only when its bytes allow."""
    small = (keys.agg(F.sum(_width(keys))).first()[0] or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(keys) if small else keys.hint("merge"), key, how)


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, root) for every end of edges (a, b), root the smallest node reachable.

    Contraction: each node points to its smallest neighbour, pointers are
    shortened twice, edges between the same pointers go. Edges shrink at least
    geometrically; a star goes in one round. Nothing is gathered on the driver.
    """
    spark = edges.sparkSession
    e = save(edges.select("a", "b").filter("a <> b").distinct(), what)
    mapping: DataFrame | None = None
    while not e.isEmpty():
        old = [e.saved_at] + ([mapping.saved_at] if mapping is not None else [])
        with scratch(spark) as keep:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            par = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
            for _ in range(2):
                par = save(par, what)
                up = par.select(F.col("a").alias("p"), F.col("p").alias("q"))
                par = par.join(up, "p").select("a", F.col("q").alias("p"))
            par = save(par, what)
            if mapping is None:
                mapping = par.select(F.col("a").alias("node"), F.col("p").alias("root"))
            else:
                mapping = mapping.join(par.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
            mapping = keep(save(mapping, what))
            pa_, pb = par.select("a", F.col("p").alias("x")), par.select(F.col("a").alias("b"), F.col("p").alias("y"))
            e = keep(save(e.join(pa_, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), what))
        for path in old:
            _delete(spark, path)
            _SAVED.remove(path)
    return mapping if mapping is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
