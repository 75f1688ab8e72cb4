import datetime as dt
import time

from pyspark.sql import functions as F

from siftwork.operators.keyed import KeyedTable
from siftwork.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)


def drain(stream, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql("SELECT * FROM out").collect()


def test_windows_and_dedup(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [(1, at(1), 7, "a", 1.0, "{}"), (2, at(3), 7, "a", 2.0, "{}"), (2, at(3), 7, "a", 2.0, "{}"), (3, at(200), 8, "b", 5.0, "{}")]
    late = [(4, at(2), 7, "a", 9.0, "{}"), (5, at(400), 8, "b", 1.0, "{}")]
    between = [(6, at(210), 8, "b", 1.0, "{}")]
    for rows in (first, between, late):
        spark.createDataFrame(rows, ev.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        time.sleep(1.5)  # files are taken in the order of their times
    s = ev.read_events(spark, str(tmp_path / "e"), 1)
    rows = drain(ev.windowed(s, "10 minutes", "1 hour"))
    got = {(r.start.replace(tzinfo=None), r.event_type): (r.n, r.v) for r in rows}
    # The first file moves the watermark to minute 140, with the second one the window is closed: the late row is dropped.
    assert got[(T0, "a")] == (3, 5.0)
    assert len(drain(ev.deduplicated(s, ["event_id"], "100 days"))) == 6


def test_keyed_state(spark, tmp_path):
    rows = [("u", 200, "x", T0), ("u", 200, "x", T0 + dt.timedelta(1)), ("u", 304, None, T0 + dt.timedelta(2)), ("u", 200, "y", T0 + dt.timedelta(3)), ("v", 200, "z", T0)]
    df = spark.createDataFrame(rows, "url string, status int, content_hash string, fetched_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "f"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "f"))
    got = sorted((r.url, r.fetched_at, r.outcome, r.version) for r in drain(ev.fetch_outcomes(s)))
    assert [(u, o, v) for u, _, o, v in got] == [("u", "new", 1), ("u", "unchanged", 1), ("u", "not_modified", 1), ("u", "changed", 2), ("v", "new", 1)]


def test_upsert(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(1, i, "a"), (2 + i, i, "b")], "k int, n int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
    s = spark.readStream.schema("k int, n int, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "u"))
    ev.upsert_latest(s, str(tmp_path / "t"), ["k"], ["n"], str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    out = KeyedTable(spark, str(tmp_path / "t"), ["k"]).read()
    assert {(r.k, r.n) for r in out.collect()} == {(1, 1), (2, 0), (3, 1)} and out.select(F.count("*")).first()[0] == 3
