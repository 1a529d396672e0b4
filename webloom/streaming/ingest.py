"""Structured Streaming: pages arriving as files, reported once per URL; page counts per host and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions.metadata import head_of, title_of
from webloom.functions.text import strip_html_to_text, utf16_length
from webloom.functions.urls import normalize_url, safe_host
from webloom.session import ship
from webloom.streaming.keyed import first_seen, state_store

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def report_columns(pages: DataFrame) -> DataFrame:
    text = strip_html_to_text(F.col("html"))
    return pages.select(normalize_url(F.col("url")).alias("url"), title_of(head_of(F.col("html"))).alias("title"), utf16_length(text).alias("text_length")).filter("url <> ''")


def crawl_stream(pages: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, seen: DataFrame | None = None, revisit_ms: int | None = None) -> StreamingQuery:
    """Append each URL's report to out once: in the batch that brings it, its row of least text_length, then title.

    URLs seen are keyed state, so a batch costs what its own URLs cost, however many came before. seen: a table (url) of URLs reported elsewhere;
    it counts when the query first starts. revisit_ms: a URL may be reported again after so long. A batch that is repeated after
    a failure writes to the folder of its batch id again, so results stay exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    ship(pages.sparkSession)
    rows = first_seen(report_columns(pages), "url", ["text_length", "title"], seen, revisit_ms)
    with state_store(pages.sparkSession):
        return rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def host_rates(fetches: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Fetches (url, ts) per host and tumbling window, with a watermark for late ones: watches crawl delays."""
    return fetches.withColumn("host", safe_host(normalize_url(F.col("url")))).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "host").agg(F.count(F.lit(1)).alias("fetches")).select(F.col("w.start").alias("start"), "host", "fetches")
