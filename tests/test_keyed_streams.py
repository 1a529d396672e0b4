import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from webloom.operators.politeness import fetch_schedule
from webloom.streaming import ingest
from webloom.streaming.keyed import PROVIDER, first_seen, polite_stream, state_store

REQUESTS = "host string, url string, requested_at timestamp, delay_ms long"


def drop(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, tmp_path, name):
    with state_store(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(200) and q.exception() is None
    return q


def test_each_key_once_across_batches_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "u string, n int, t string"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get(PROVIDER, None)
    rows = first_seen(stream, "u", ["n", "t"], spark.createDataFrame([("known",), ("known",)], "u string"))
    drop(spark, tmp_path / "in", [("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 3, "q"), ("known", 0, "k"), (None, 1, "n")], schema)
    run(rows, tmp_path, "out")
    drop(spark, tmp_path / "in", [("a", 0, "x"), ("c", 5, "y"), (None, 0, "m"), ("c", 5, "x"), ("known", 1, "k")], schema)
    q = run(rows, tmp_path, "out")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == sorted([("a", 1, "y"), ("b", None, "z"), (None, 1, "n"), ("c", 5, "x")], key=str)
    # The second batch touched its own keys only.
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(s["numRowsUpdated"] for s in state) <= 1
    assert spark.conf.get(PROVIDER, None) == before


def test_reports_stay_once_per_url(spark, tmp_path):
    """A later batch with a known URL, a restart, and a seen table."""
    src, out, ck = (str(tmp_path / x) for x in ("pages", "out", "state"))
    (tmp_path / "pages").mkdir()
    page = lambda t: f"<html><head><title>{t}</title></head><body>{t}</body></html>"
    for i, rows in enumerate([[(1, "https://e.com/1", page("long title")), (2, "https://e.com/1#x", page("t")), (3, "https://e.com/old", page("o"))], [(4, "https://e.com/1", page("a")), (5, "https://e.com/2", page("b")), (6, "no url", page("c"))]]):
        drop(spark, src, rows, ingest.PAGES)
        q = ingest.crawl_stream(ingest.read_pages(spark, src), out, ck, seen=spark.createDataFrame([("https://e.com/old",)], "url string"))
        assert q.awaitTermination(200) and q.exception() is None, i
    got = sorted((r.url, r.title, r.batch) for r in spark.read.parquet(out).collect())
    assert got == [("https://e.com/1", "t", 0), ("https://e.com/2", "b", 1)]


def schedule(requests, delays, default):
    """One request after the other."""
    free, out = {}, []
    for host, url, asked in sorted(requests, key=lambda r: (str(r[0]), r[2], r[1])):
        at = max(asked, free.get(host, asked))
        d = delays.get(host)
        free[host] = at + (default if d is None else d)
        out.append((host, url, asked, at))
    return out


def test_released_when_their_time_comes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = polite_stream(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), 500)
    time = lambda s: datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
    delays = {"hot": 2000, "b": None, "c": 1000, "d": 0}
    batches = [[("hot", f"u{i:02}", 1) for i in range(20)] + [("b", "x", 2), ("b", "y", 2), ("d", "p", 3), ("d", "q", 3)], [("c", "z", 12), ("hot", "v", 12), ("c", "y", 12)], [("c", "w", 30)], [("d", "last", 200)]]
    asked, free, due = [], {}, []
    for batch in batches:
        drop(spark, tmp_path / "in", [(h, u, time(t), delays[h]) for h, u, t in batch], REQUESTS)
        run(stream, tmp_path, "out")
        asked += [(h, u, t * 1000) for h, u, t in batch]
        for h, u, t in sorted(batch, key=lambda r: (r[0], r[2], r[1])):
            at = max(t * 1000, free.get(h, 0))
            free[h] = at + (500 if delays[h] is None else delays[h])
            due.append((h, u, t * 1000, at))
        now = max(t for _, _, t in batch) * 1000
        got = spark.read.parquet(str(tmp_path / "out")).select("host", "url", F.unix_millis("requested_at"), F.unix_millis("fetch_at"))
        # What is due before the newest event time is out; nothing later is.
        rows = set(map(tuple, got.collect()))
        assert {r for r in due if r[3] < now} <= rows <= {r for r in due if r[3] <= now}
    assert len(rows) >= len(due) - 1


def test_schedule_of_a_table(spark):
    r = random.Random(4)
    hosts = [None, "a.com", "b.com", "c.com", "hot.com"]
    requests = [(h, f"u{r.randrange(200):03}", r.randrange(20_000)) for h in r.choices(hosts, [1, 1, 1, 1, 6], k=600)]
    delays = {"a.com": 700, "b.com": 0, "c.com": None, "hot.com": 90, "other": 5}
    df = spark.createDataFrame([*requests, ("a.com", "no time", None)], "host string, url string, requested_at long").repartition(6)
    got = fetch_schedule(df, spark.createDataFrame(list(delays.items()), "host string, delay_ms long"), 33).collect()
    assert sorted(((x.host, x.url, x.requested_at, x.fetch_at) for x in got), key=str) == sorted(schedule(requests, delays, 33), key=str)
    for h in hosts:
        mine = sorted((x.seq, x.fetch_at) for x in got if x.host == h)
        assert [s for s, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)
    assert fetch_schedule(df.limit(0), spark.createDataFrame([], "host string, delay_ms long")).collect() == []
