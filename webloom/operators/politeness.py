"""Fetch times that keep each host's crawl delay, for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.scratch import cut


def fetch_schedule(requests: DataFrame, delays: DataFrame, default_delay_ms: int = 0) -> DataFrame:
    """requests (host, url, requested_at in ms) with seq, the place in the host's queue, and fetch_at in ms.

    A host serves its requests in order of requested_at, then url; each fetch is at its request's time or, if later, delays
    (host, delay_ms; at most one row a host, null or none: the default) after the fetch before. That makes
    fetch_at = delay * seq + the greatest of requested_at - delay * seq so far, a running maximum, so a host's
    queue needs no single task: rows are dealt by range of (host, requested_at, url), each part has its own maximum, and the parts before
    it, a few rows a host, give the rest.

    Requests with a null time are left out; a null host is a host; repeated requests each have their place.
    """
    asked = requests.filter("requested_at IS NOT NULL").select("host", "url", F.col("requested_at").cast("long").alias("asked"))
    known = delays.select(F.col("host").alias("named"), F.col("delay_ms").cast("long").alias("delay"))
    rows = asked.join(known, F.col("host").eqNullSafe(F.col("named")), "left").select("host", "url", "asked", F.coalesce("delay", F.lit(default_delay_ms)).alias("delay"))
    order = ["host", "asked", "url"]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftrightunsigned("at", 33))
    parts = dealt.groupBy("host", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"), F.max(F.col("asked") - F.col("delay") * F.col("at")).alias("peak"), F.first("delay").alias("d"))
    earlier = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    parts = parts.withColumn("start", F.col("before") - F.col("low")).withColumn("prior", F.max(F.col("peak") - F.col("d") * F.col("start")).over(earlier))
    one = parts.select(F.col("host").alias("h"), F.col("part").alias("p"), "start", "prior")
    rows = dealt.join(one, F.col("host").eqNullSafe(F.col("h")) & (F.col("part") == F.col("p"))).withColumn("seq", F.col("at") + F.col("start"))
    so_far = F.max(F.col("asked") - F.col("delay") * F.col("seq")).over(Window.partitionBy("host", "part").orderBy("at"))
    return rows.select("host", "url", F.col("asked").alias("requested_at"), "seq", (F.col("delay") * F.col("seq") + F.greatest(so_far, "prior")).alias("fetch_at"))
