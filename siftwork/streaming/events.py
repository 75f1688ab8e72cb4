"""Event-time streams and keyed state: the streaming twins of operators.state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums a type in tumbling (or sliding) windows, closed when the watermark passes."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark; state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """Per url, in order of arrival: new, changed, unchanged or not_modified, and the
    version so far. fetches: (url, status, content_hash, fetched_at)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["fetched_at", "content_hash"])
        out = []
        for status, content, at in rows[["status", "content_hash", "fetched_at"]].itertuples(index=False):
            if status == 304:
                what = "not_modified"
            elif last is None:
                what, version = "new", 1
            elif content == last:
                what = "unchanged"
            else:
                what, version = "changed", version + 1
            last = last if status == 304 else content
            out.append((key[0], at, what, version))
        state.update((last, version))
        yield pd.DataFrame(out, columns=["url", "fetched_at", "outcome", "version"])

    return fetches.groupBy("url").applyInPandasWithState(step, "url string, fetched_at timestamp, outcome string, version int", "last string, version int", "append", GroupStateTimeout.NoTimeout)


def run_health(runs: DataFrame) -> DataFrame:
    """Per source after each batch: runs, failures in a row and status. runs: (source, at, failed)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, streak = state.get if state.exists else (0, 0)
        for failed in pd.concat(list(batches)).sort_values("at")["failed"]:
            n, streak = n + 1, streak + 1 if failed else 0
        state.update((n, streak))
        status = "failing" if streak >= 6 else "backoff" if streak >= 3 else "degraded" if streak else "healthy"
        yield pd.DataFrame([(key[0], n, streak, status)], columns=["source", "runs", "failures", "status"])

    return runs.groupBy("source").applyInPandasWithState(step, "source string, runs int, failures int, status string", "runs int, streak int", "update", GroupStateTimeout.NoTimeout)


def upsert_latest(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str):
    """A query that keeps the latest row a key in the KeyedTable at path: a batch
    rewrites the buckets that it touches, and one that is run again changes nothing."""
    from siftwork.operators.keyed import KeyedTable

    def merge(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, path, key).merge(batch, order, number=number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
