"""Keyed state, versions, health and time windows over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators import state as st
from siftwork.operators.keyed import KeyedTable
from siftwork.plans.catalog import query
from siftwork.session import shared_dir
from siftwork.session import table as t


def _events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_ISLANDS = """e AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
s AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM e)"""


@query(f"WITH {_ISLANDS} SELECT event_id, user_id, streak FROM s")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return st.failure_streaks(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "streak")


@query(f"""WITH {_ISLANDS}, h AS (SELECT user_id, count(*) AS runs, round(sum(value), 4) AS value, arg_max(streak, (ts, event_id)) AS failures, max(CASE WHEN NOT bad THEN ts END) AS last_success
FROM s JOIN (SELECT event_id AS e2, value FROM events) ON event_id = e2 GROUP BY 1)
SELECT user_id, runs, value, failures, epoch(last_success) AS last_success, CASE WHEN failures < 3 THEN 0.0 ELSE least(168.0, 2 * pow(2.0, least(failures, 60) - 3)) END AS backoff_hours,
CASE WHEN failures >= 6 THEN 'failing' WHEN failures >= 3 THEN 'backoff' WHEN failures >= 1 THEN 'degraded' ELSE 'healthy' END AS status FROM h""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    out = st.health(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error", ["value"])
    return out.withColumn("value", F.round("value", 4)).withColumn("last_success", F.unix_micros("last_success") / 1e6)


@query("""WITH l AS (SELECT event_id, user_id, ts, props, lag(props) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
o AS (SELECT *, CASE WHEN r = 1 THEN 'new' WHEN before IS NOT DISTINCT FROM props THEN 'unchanged' ELSE 'changed' END AS outcome FROM l)
SELECT event_id, outcome, sum(CASE WHEN outcome = 'unchanged' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS version FROM o""")
def fetch_versions(spark: SparkSession, d: str) -> DataFrame:
    return st.versions(_events(spark, d), "user_id", ["ts", "event_id"], "props").select("event_id", "outcome", "version")


@query("""WITH l AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def phase_runs(spark: SparkSession, d: str) -> DataFrame:
    return st.runs(_events(spark, d), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return st.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""WITH s AS (SELECT doc_id AS url, md5(text) AS text_hash, n_chars, 1 AS version FROM documents WHERE doc_id % 3 <> 0),
i AS (SELECT doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS text_hash, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 4 <> 1)
SELECT coalesce(s.url, i.url) AS url, CASE WHEN i.url IS NULL THEN 'kept' WHEN s.url IS NULL THEN 'inserted' WHEN s.text_hash = i.text_hash THEN 'duplicate' ELSE 'updated' END AS event,
CASE WHEN i.url IS NOT NULL AND (s.url IS NULL OR s.text_hash <> i.text_hash) THEN i.text_hash ELSE s.text_hash END AS text_hash,
CASE WHEN i.url IS NOT NULL AND (s.url IS NULL OR s.text_hash <> i.text_hash) THEN i.n_chars ELSE s.n_chars END AS n_chars,
coalesce(s.version, 0) + CASE WHEN i.url IS NOT NULL AND (s.url IS NULL OR s.text_hash <> i.text_hash) THEN 1 ELSE 0 END AS version FROM s FULL JOIN i ON s.url = i.url""")
def versioned_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    old = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("url"), F.md5("text").alias("text_hash"), "n_chars", F.lit(1).alias("version"))
    new = docs.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("url"), F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("text_hash"), (F.col("n_chars") + 1).alias("n_chars"))
    return st.versioned_upsert(old, new)


@query("""WITH l AS (SELECT user_id, max(ts) AS last, count(*) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY 1)
SELECT user_id, (epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last))) / 3600 >= CASE WHEN f < 3 THEN 0.0 ELSE least(168.0, 2 * pow(2.0, least(f, 60) - 3)) END
AND (epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last))) / 3600 >= 24 - 10 / 60 AS due FROM l""")
def sources_due(spark: SparkSession, d: str) -> DataFrame:
    last = _events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "error").alias("f"))
    return st.due(last, F.col("last"), F.lit(24), st.backoff_hours(F.col("f")), "2024-01-31 00:00:00").select("user_id", "due")


@query("""SELECT event_type, epoch(time_bucket(INTERVAL '1 day', ts)) AS day, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""")
def tumbling_daily(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the batch twin of the streaming window."""
    g = _events(spark, d).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return g.select("event_type", F.unix_seconds("w.start").alias("day"), "n", "v")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions with a gap of six hours."""
    g = _events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", (F.unix_micros("w.start") / 1e6).alias("start"), "n")


@query("""WITH a AS (SELECT doc_id, n_chars, source FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 1)
SELECT doc_id, n_chars, CASE WHEN a.doc_id IS NULL THEN 'new' ELSE source END AS source, lang FROM a FULL JOIN b USING (doc_id) WHERE doc_id % 7 <> 0""")
def keyed_merges(spark: SparkSession, d: str) -> DataFrame:
    """A stored table after three batches: whole rows, columns set with a default for new rows, keys that go."""
    docs, held = t(spark, d, "documents"), KeyedTable(spark, shared_dir(spark), ["doc_id"], 16)
    held.merge(docs.where("doc_id % 3 <> 0").select("doc_id", "n_chars", "source"))
    held.merge(docs.where("doc_id % 4 <> 1").select("doc_id", "lang"), partial=True, defaults={"source": F.lit("new")})
    held.delete(docs.where("doc_id % 7 = 0").select("doc_id"))
    return held.read().select("doc_id", "n_chars", "source", "lang")
