"""A breadth-first crawl whose state is versioned tables in the shared folder, aligned by URL.

Three external Parquet tables: edges (bucketed by src), visited (bucketed by url) and commits. A level appends its rows
under an attempt of its own and then appends one row to commits; only attempts that are committed are ever read. The row
is a single file that appears by one rename (or one put), so a crawl killed at any moment, in the middle of a write too,
goes on from its last commit with equal rows. Every version stays readable.

A level reads no more than its frontier shuffled: the frontier meets edges and its candidates meet visited bucket by bucket,
so neither table is moved. What is found by many pages is reduced before the shuffle. One writer at a time; two are an error.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels after which the committed rows are written as one, as each level adds a file to each bucket.
COMPACT_AFTER = 16


class VersionedCrawl:
    """Crawl state below path, a folder of the shared storage. buckets counts for a new state (default: the session's shuffle partitions); an old one keeps its own.

    Null URLs in seeds and edges are left out; repeats count once; an empty seeds table is a finished crawl of no pages.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.prefix = "crawl_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        self._table("commits", "version BIGINT, attempt STRING, depth BIGINT, found BIGINT, kind STRING, buckets BIGINT")
        known = [r.buckets for r in self._commits().limit(1).collect()]
        self.buckets = known[0] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not known:
            self._commit(-1, "", -1, 0, "layout")
        self._table("edges", "src STRING, dst STRING, attempt STRING", "src")
        self._table("visited", "url STRING, depth BIGINT, attempt STRING", "url")

    def _name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def _table(self, table: str, columns: str, key: str | None = None) -> None:
        aligned = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS" if key else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}) USING parquet {aligned} LOCATION '{self.path}/{table}'")
        self.spark.catalog.refreshTable(self._name(table))

    def forget(self) -> None:
        """Drops the tables' names from the catalog; the files stay, and a crawl opened on the path goes on with them."""
        for table in ("commits", "edges", "visited"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")

    def _commits(self) -> DataFrame:
        return self.spark.table(self._name("commits"))

    def _commit(self, version: int, attempt: str, depth: int, found: int, kind: str) -> None:
        row = self.spark.createDataFrame([(version, attempt, depth, found, kind, self.buckets)], self._commits().schema)
        row.coalesce(1).write.insertInto(self._name("commits"))

    def _append(self, rows: DataFrame, table: str, key: str) -> str:
        """The rows under a new attempt, one file a bucket."""
        attempt = uuid.uuid4().hex
        rows.withColumn("attempt", F.lit(attempt)).repartition(self.buckets, key).write.insertInto(self._name(table))
        return attempt

    def history(self) -> list:
        """The commits in order (one row a level, edge set or compaction). ValueError where two writers committed one version."""
        rows = self._commits().orderBy("version").collect()
        if len({r.version for r in rows}) < len(rows):
            raise ValueError(f"two writers committed to {self.path}")
        return rows

    def _read(self, table: str, kinds: tuple[str, ...], version: int | None) -> DataFrame:
        rows = [r for r in self.history() if r.kind in kinds and (version is None or r.version <= version)]
        since = max((i for i, r in enumerate(rows) if r.kind == "compaction"), default=0)
        return self.spark.table(self._name(table)).filter(F.col("attempt").isin([r.attempt for r in rows[since:]])).drop("attempt")

    def visited(self, version: int | None = None) -> DataFrame:
        """(url, depth) as of a version, by default the last."""
        return self._read("visited", ("level", "compaction"), version)

    def edges(self) -> DataFrame:
        return self._read("edges", ("edges",), None)

    def candidates(self, depth: int) -> DataFrame:
        """URLs that the pages of a depth link to and that no committed level has: the plan of one level, aligned on both tables."""
        frontier = self.visited().filter(F.col("depth") == depth)
        found = frontier.join(self.edges(), F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        return found.join(self.visited().select("url"), "url", "left_anti")

    def start(self, seeds: DataFrame, edges: DataFrame) -> None:
        """Writes the edges and the seeds as level 0; what is there already stays."""
        done = {r.kind for r in self.history()}
        if "edges" not in done:
            attempt = self._append(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges", "src")
            self._commit(0, attempt, -1, 0, "edges")
        if "level" not in done:
            self._level(seeds.select("url").filter("url IS NOT NULL").distinct(), 1, 0)

    def _level(self, urls: DataFrame, version: int, depth: int) -> int:
        attempt = self._append(urls.withColumn("depth", F.lit(depth).cast("long")), "visited", "url")
        found = self.spark.table(self._name("visited")).filter(F.col("attempt") == attempt).count()
        self._commit(version, attempt, depth, found, "level")
        return found

    def resume(self, max_depth: int | None = None, levels: int | None = None) -> bool:
        """Crawls on from the last commit, at most so many levels; True when nothing new is left within max_depth. Needs no input but the path."""
        while True:
            rows = self.history()
            last = next((r for r in reversed(rows) if r.kind == "level"), None)
            if last is None:
                raise ValueError(f"no crawl was started in {self.path}")
            if last.found == 0 or max_depth is not None and last.depth >= max_depth:
                return True
            if levels is not None and levels <= 0:
                return False
            since = max((i for i, r in enumerate(rows) if r.kind == "compaction"), default=0)
            if sum(r.kind == "level" for r in rows[since:]) >= COMPACT_AFTER:
                self._commit(rows[-1].version + 1, self._append(self.visited(), "visited", "url"), last.depth, 0, "compaction")
                continue
            self._level(self.candidates(last.depth), rows[-1].version + 1, last.depth + 1)
            levels = levels if levels is None else levels - 1
