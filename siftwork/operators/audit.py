"""Audit of a library: one bucket a row, totals that add up, and a plan that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that count what a report is worth keeping for.
SIGNALS = ("iocs", "stages", "techniques", "cves", "actors", "malware")


def rules(words: Column, score: Column, url: Column, title: Column, n: dict[str, Column]) -> list[tuple[str, Column]]:
    """(bucket, condition) in the order in which they are tried. n: counts of SIGNALS."""
    bare = (n["iocs"] == 0) & (n["stages"] == 0) & (n["techniques"] == 0) & (n["cves"] == 0)
    path = F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*$", ""), r"^[a-z]+://[^/]*", "")
    return [
        ("Homepage / Root Index", path.rlike(r"^/?$")),
        ("Print view", url.rlike(r"(?i)\?pdf=print")),
        ("Aggregator / Index Path", path.rlike(r"(?i)/(?:tags?|categor(?:y|ies)|authors?|archives?|topics?)(?:/|$)") | url.rlike(r"(?i)\?f%5B|\?category=|\?filter=")),
        ("Multimedia / Podcast / Keynote", path.rlike(r"(?i)/(?:podcasts?|videos?|webinars?|keynotes?)(?:/|$)")),
        ("Product marketing", (title.rlike(r"(?i)free\s+\d+[- ]day\s+trial|request\s+(?:a\s+)?demo") | url.rlike(r"(?i)free-trial|request-demo")) & (n["iocs"] == 0) & (n["stages"] == 0) & (n["cves"] == 0)),
        ("Stub (<250 words, 0 artifacts)", bare & (words < 250)),
        ("Short News / Zero Technical Artifacts", bare & (words < 350) & (score < 0.45)),
        ("Zero Quality Score", bare & (score <= 0.10) & (n["actors"] == 0) & (n["malware"] == 0)),
        ("Zero artifacts", bare & (n["actors"] == 0) & (n["malware"] == 0)),
    ]


def audited(rows: DataFrame, key: str, table: list[tuple[str, Column]], keep: dict[str, Column], protected: Column | None = None) -> DataFrame:
    """(key, action, bucket, reasons): every row is in one bucket, that of the first rule
    that holds, or "Retained" with the reasons that hold. protected rows are retained."""
    bucket = F.lit("Retained")
    for name, hit in reversed(table):
        bucket = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(bucket)
    if protected is not None:
        bucket = F.when(F.coalesce(protected, F.lit(False)), "Retained").otherwise(bucket)
    why = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in keep.items()]))
    kept = bucket == "Retained"
    return rows.select(key, F.when(kept, "KEEP").otherwise("PRUNE").alias("action"), bucket.alias("bucket"), F.when(kept, why).otherwise(F.array().cast("array<string>")).alias("reasons"))


def totals(audit: DataFrame) -> DataFrame:
    """(bucket, action, rows, share): the buckets of all rows; their rows add up to all of them."""
    n = audit.agg(F.count("*").alias("all_rows"))
    by = audit.groupBy("bucket", "action").agg(F.count("*").alias("rows"))
    return by.crossJoin(F.broadcast(n)).select("bucket", "action", "rows", (F.col("rows") / F.col("all_rows")).alias("share"))  # one row


def plan(rows: DataFrame, audit: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, was, becomes, bucket): what pruning changes; rows that are rejected already aren't in it."""
    go = audit.where("action = 'PRUNE'").select(key, "bucket")
    return rows.join(go, key).where(~F.col(status).eqNullSafe(F.lit("rejected"))).select(key, F.col(status).alias("was"), F.lit("rejected").alias("becomes"), "bucket")


def applied(rows: DataFrame, steps: DataFrame, key: str, status: str = "status", undo: bool = False) -> DataFrame:
    """rows after a plan, or after it is undone: only rows that are as the plan left them go back."""
    old, new = ("becomes", "was") if undo else ("was", "becomes")
    side = steps.select(F.col(key).alias("_k"), F.col(old).alias("_old"), F.col(new).alias("_new"))
    j = rows.join(side, F.col(key) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull() & F.col(status).eqNullSafe(F.col("_old"))
    return j.select(*[F.when(hit, F.col("_new")).otherwise(F.col(status)).alias(status) if c == status else F.col(c) for c in rows.columns])
