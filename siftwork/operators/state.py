"""Keyed state over ordered observations, as window functions and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def failure_streaks(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds streak: failures in a row up to and with each row, 0 after a success."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    out = df.withColumn("_failed", failed.cast("int")).withColumn("_island", island)
    v = W.partitionBy(key, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("streak", F.sum("_failed").over(v)).drop("_failed", "_island")


def versions(df: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Adds outcome (new, changed, unchanged) and version, which rises when content changes."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.lag(content).over(w)
    first = F.row_number().over(w) == 1
    outcome = F.when(first, "new").when(before.eqNullSafe(F.col(content)), "unchanged").otherwise("changed")
    out = df.withColumn("outcome", outcome)
    return out.withColumn("version", F.sum(F.when(F.col("outcome") == "unchanged", 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, run, value, n): lengths of runs of equal values in order."""
    w = W.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", value).agg(F.count("*").alias("n"))


def backoff_hours(failures: Column) -> Column:
    """0 below 3 failures, then 2 hours doubled for each more, a week at most."""
    return F.when(failures < 3, 0.0).otherwise(F.least(F.lit(168.0), 2 * F.pow(F.lit(2.0), F.least(failures, F.lit(60)) - 3)))


def health(runs_: DataFrame, key: str, order: list[str], failed: Column, counters: list[str]) -> DataFrame:
    """One row a source: runs, counter totals, failures in a row, last time it worked, backoff and status."""
    marked = failure_streaks(runs_.withColumn("_bad", failed), key, order, F.col("_bad"))
    last = F.struct(*order)
    sums = marked.groupBy(key).agg(
        F.count("*").alias("runs"),
        *[F.sum(c).alias(c) for c in counters],
        F.max_by("streak", last).alias("failures"),
        F.max(F.when(~F.col("_bad"), F.col(order[0]))).alias("last_success"),
    )
    f = F.col("failures")
    status = F.when(F.col("runs") == 0, "idle").when(f >= 6, "failing").when(f >= 3, "backoff").when(f >= 1, "degraded").otherwise("healthy")
    return sums.withColumn("backoff_hours", backoff_hours(f)).withColumn("status", status)


def due(df: DataFrame, last: Column, every_hours: Column, backoff: Column, now: str, grace_minutes: int = 10) -> DataFrame:
    """Adds due: never run, or past its backoff and its schedule less the grace."""
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last)) / 3600
    return df.withColumn("due", F.when(last.isNull(), True).otherwise((hours >= backoff) & (hours >= every_hours - grace_minutes / 60)))


def needs_revalidation(fetched: Column, hinted: Column, now: str, max_age_days: int) -> Column:
    """No state, changed at the source after the last fetch, or too old."""
    old = F.datediff(F.lit(now).cast("date"), fetched.cast("date")) > max_age_days
    return F.when(fetched.isNull(), True).when(hinted > fetched, True).otherwise(old)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins: the row of each key with the greatest order; no sort, one shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def versioned_upsert(stored: DataFrame, incoming: DataFrame, key: str = "url") -> DataFrame:
    """stored (key, text_hash, version, ...) merged with incoming (key, text_hash, ...):
    event is kept, inserted, duplicate (same hash) or updated (version + 1)."""
    rest = [c for c in stored.columns if c not in (key, "version")]
    new = incoming.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in rest])
    both = stored.withColumn("_here", F.lit(True)).join(new, F.col(key) == F.col("_key"), "full_outer")
    event = (
        F.when(F.col("_key").isNull(), "kept").when(F.col("_here").isNull(), "inserted").when(F.col("text_hash").eqNullSafe(F.col("_text_hash")), "duplicate").otherwise("updated")
    )
    take = event.isin("inserted", "updated")
    return both.select(
        F.coalesce(key, "_key").alias(key),
        *[F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest],
        (F.coalesce("version", F.lit(0)) + F.when(take, 1).otherwise(0)).alias("version"),
        event.alias("event"),
    )


def upsert_and_prune(stored: DataFrame, batch: DataFrame, key: list[str], prune: bool = False, scope: Column | None = None) -> DataFrame:
    """batch's rows over stored's; with prune, rows in scope that the batch lacks go."""
    rest = stored.join(batch.select(*key), key, "left_anti")
    if prune:
        rest = rest.where(~scope) if scope is not None else rest.limit(0)
    return rest.unionByName(batch)


def add_counts(totals: DataFrame, more: DataFrame, key: str, count: str) -> DataFrame:
    """Counters of both tables summed by key."""
    return totals.select(key, count).unionByName(more.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def hide(df: DataFrame, bad: Column) -> DataFrame:
    """Marks bad rows rejected and remembers their status; rows no longer bad get it back."""
    was = F.col("previous_status")
    hidden = F.col("status") == "rejected"
    return df.select(
        *[c for c in df.columns if c not in ("status", "previous_status")],
        F.when(bad, "rejected").when(hidden, F.coalesce(was, F.lit("acquired"))).otherwise(F.col("status")).alias("status"),
        F.when(bad & ~hidden, F.col("status")).when(bad, was).otherwise(F.lit(None)).alias("previous_status"),
    )


def stale(version: Column, current: int) -> Column:
    """Rows whose version stamp differs or is missing."""
    return version.isNull() | (version != current)
