"""Breadth-first depths of a whole graph, block by block: rounds count blocks passed, not levels.

The edges are ranked by host and by a caller's order (pages that link stand near one another in it) and cut into blocks of
at most BLOCK edges, a page's edges together. A round gives each block that got mail its edges and the depths it knows; the
block spreads what is better through its own edges and mails depths to other blocks. It ends when no mail is left: then no
edge leads to a page from one more than a level above it, so depths are exact, whatever the order; a poor order costs rounds.
"""

from __future__ import annotations

import heapq
import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import safe_host
from webloom.scratch import cut
from webloom.session import ship

#: Edges of a block at most (and one page's more), and at least where there are so many: a block is one task's work in a round.
BLOCK, LEAST = 1 << 16, 1 << 12
#: Rounds after which the depths found are written as one table.
COMPACT_AFTER = 8

_EDGE, _KNOWN, _MAIL = 0, 1, 2
_OUT = "url string, block long, depth long, here boolean"


def _settle(rows: pa.Table) -> pa.Table:
    """One block's round: its pages whose depth is better now (here), and the depths of other pages that these lead to."""
    block = rows["block"][0].as_py()
    links: dict[str, list[tuple[str, int | None]]] = {}
    depth: dict[str, int] = {}
    mail = []
    for kind, a, b, n in zip(*(rows[c].to_pylist() for c in ("kind", "a", "b", "n")), strict=True):
        if kind == _EDGE:
            links.setdefault(a, []).append((b, n))
        elif kind == _KNOWN:
            depth[a] = min(n, depth.get(a, n))
        else:
            mail.append((n, a))
    queue = []
    for n, a in mail:
        if n < depth.get(a, n + 1):
            depth[a] = n
            queue.append((n, a))
    heapq.heapify(queue)
    here: dict[str, int] = {}
    away: dict[str, tuple[int | None, int]] = {}
    while queue:
        n, url = heapq.heappop(queue)
        if url in here:
            continue
        here[url] = n
        for dst, to in links.get(url, ()):
            if to != block:
                away.setdefault(dst, (to, n + 1))
            elif n + 1 < depth.get(dst, n + 2):
                depth[dst] = n + 1
                heapq.heappush(queue, (n + 1, dst))
    out = [(u, block, n, True) for u, n in here.items()] + [(u, to, n, False) for u, (to, n) in away.items()]
    names = ["url", "block", "depth", "here"]
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True))})


def _blocks(edges: DataFrame, near: str | None, block: int | None) -> DataFrame:
    """Distinct edges (src, dst) with the blocks of both ends; to_block is null where a page has no edges."""
    order = F.col(near) if near else F.lit(None).cast("long")
    rows = edges.select("src", "dst", order.alias("near")).filter("src is not null and dst is not null")
    rows = rows.groupBy("src").agg(F.min("near").alias("near"), F.collect_set("dst").alias("dst"))
    keys = [safe_host(F.col("src")), F.col("near"), F.col("src")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("src", F.explode("dst").alias("dst"))
    rows = cut(rows.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("m", 33)
    sizes = dict(map(tuple, rows.groupBy(part).count().collect()))  # one number a partition
    if not sizes:
        return rows.select("src", "dst", F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("to_block"))
    firsts = [0, *itertools.accumulate(sizes.get(i, 0) for i in range(max(sizes) + 1))]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = block or min(BLOCK, max(LEAST, math.ceil(firsts[-1] / tasks)))
    rank = F.element_at(F.lit(firsts), part.cast("int") + 1) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    place = rows.groupBy("src").agg(F.floor(F.min(rank) / block).alias("block"))
    to = place.select(F.col("src").alias("dst"), F.col("block").alias("to_block"))
    return cut(rows.join(place, "src").join(to, "dst", "left").select("src", "dst", "block", "to_block"))


def bfs_whole(seeds: DataFrame, edges: DataFrame, near: str | None = None, block: int | None = None) -> DataFrame:
    """(url, depth) of everything reachable from seeds (url) over edges (src, dst), each URL once at its least depth; null URLs are left out.

    near: a column of edges that is close for pages that link to one another, such as a number in order of
    fetching; without it pages stand by host and URL. block: edges of a block, by default by the table's size.
    """
    ship(seeds.sparkSession)
    arcs = _blocks(edges, near, block)
    place = arcs.select(F.col("src").alias("url"), "block").distinct()
    zero = F.lit(0).cast("long").alias("depth")
    begin = cut(seeds.select("url").filter("url is not null").distinct().join(place, "url", "left").select("url", "block", zero))
    seen, mail = begin.filter("block is null"), begin.filter("block is not null")
    shape = lambda df, kind, *cols: df.select("block", F.lit(kind).alias("kind"), *(F.expr(c).alias(x) for c, x in zip(cols, "abn", strict=True)))
    for turn in itertools.count(1):
        if mail.isEmpty():
            return seen.groupBy("url").agg(F.min("depth").alias("depth"))
        mail = mail.groupBy("url", "block").agg(F.min("depth").alias("depth"))
        have = shape(arcs, _EDGE, "src", "dst", "to_block").unionByName(shape(seen, _KNOWN, "url", "string(null)", "depth"))
        have = have.join(F.broadcast(mail.select("block").distinct()), "block", "left_semi")
        out = cut(have.unionByName(shape(mail, _MAIL, "url", "string(null)", "depth")).groupBy("block").applyInArrow(_settle, _OUT))
        seen = seen.unionByName(out.filter("here or block is null").select("url", "block", "depth"))
        if turn % COMPACT_AFTER == 0:
            seen = cut(seen.groupBy("url", "block").agg(F.min("depth").alias("depth")))
        mail = out.filter("not here and block is not null")
