"""Which techniques a test plan takes up: fit to platforms, scores of many parts, leaders of tactics, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What parts of a score weigh, and labels of sightings.
WEIGHTS = {"frequency": 0.25, "recency": 0.1, "confidence": 0.15, "attribution": 0.2, "plan": 0.05, "emulation": 0.1, "platform": 0.1, "prevalence": 0.05}
LABELS = {"observed": 1.0, "inferred": 0.7, "mapped": 0.5}
#: Age in days up to which a sighting counts how much, and what older ones count.
RECENCY = [(180, 1.0), (365, 0.6), (730, 0.3)]
OLDER = 0.1


def platform_fit(platforms: Column, wanted: list[str]) -> Column:
    """Those of a technique's platforms that are wanted (in any case); all if none are named."""
    if not wanted:
        return platforms
    return F.filter(platforms, lambda p: F.lower(p).isin([w.lower() for w in wanted]))


def scored(techniques: DataFrame, sightings: DataFrame, now: str, platforms: list[str] | None = None, synced: bool = True) -> DataFrame:
    """techniques with fit, reports, last_seen, parts (by name) and score, without those
    that fit none of the platforms. techniques: id, tactic, platforms, attributed, chosen,
    planned (flags), options (of an emulation library), prevalence (users) and share (of the
    most used one's); sightings: (id, report, label, confidence, day)."""
    weight = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    conf = F.col("confidence") * F.when(F.col("label") == "observed", 1.0).otherwise(0.8)
    seen = sightings.groupBy("id").agg(F.sum(weight[F.col("label")]).alias("freq"), F.max("day").alias("last_seen"), F.max(conf).alias("conf"), F.countDistinct("report").alias("reports"))
    t = techniques.join(seen, "id", "left")
    age = F.datediff(F.lit(now).cast("date"), F.col("last_seen").cast("date"))
    recency = F.lit(OLDER)
    for days, value in reversed(RECENCY):
        recency = F.when(age <= days, value).otherwise(recency)
    fit = platform_fit(F.coalesce("platforms", F.array().cast("array<string>")), platforms or [])
    t = t.withColumn("fit", fit)
    if platforms:
        t = t.where(F.size("fit") > 0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    parts = {
        "frequency": F.least(F.lit(1.0), F.coalesce("freq", F.lit(0.0)) / 3),
        "recency": F.when(F.col("last_seen").isNull(), 0.0).otherwise(recency),
        "confidence": F.coalesce("conf", F.lit(0.0)),
        "attribution": (flag("attributed") | flag("chosen")).cast("double"),
        "plan": flag("planned").cast("double"),
        "emulation": (F.lit(synced) & (F.coalesce("options", F.lit(0)) > 0)).cast("double"),
        "platform": 0.6 + 0.4 * F.size("fit") / F.size("platforms") if platforms else F.lit(0.5),
        "prevalence": F.coalesce("share", F.lit(0.0)),
    }
    total = F.lit(0.0)
    for k, v in parts.items():
        total += WEIGHTS[k] * v
    score = F.floor(F.round(F.least(F.lit(1.0), total) * 100, 6) + 0.5) / 100
    return t.select(*techniques.columns, "fit", F.coalesce("reports", F.lit(0)).alias("reports"), "last_seen", F.struct(*[v.cast("double").alias(k) for k, v in parts.items()]).alias("parts"), score.alias("score"))


def selected(ranked: DataFrame, tactics: DataFrame, most: int = 12, group: str | None = None, reported: bool = False) -> DataFrame:
    """ranked with step, null for those that are left out: of more than most rows the
    best of each tactic come first, so a plan goes from end to end, then the best of
    the rest. Steps follow the tactics' order, or with reported the positions in a report
    (column position). tactics: (tactic, place); group: a column whose values have plans of their own."""
    most = max(1, min(60, most))
    by = [group] if group else [F.lit(1)]
    r = ranked.join(F.broadcast(tactics), "tactic", "left").withColumn("place", F.coalesce("place", F.lit(1 << 30)))  # a row a tactic
    best = [F.desc("score"), F.desc("prevalence"), F.col("place"), F.col("id")]
    leads = r.withColumn("leader", F.row_number().over(W.partitionBy(*by, "tactic").orderBy(*best)) == 1)
    pick = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("leader"), *best)) <= most
    kept = leads.withColumn("kept", pick)
    order = ([F.coalesce("position", F.lit(1 << 30))] if reported else []) + [F.col("place"), F.desc("score"), F.col("id")]
    step = F.row_number().over(W.partitionBy(*by, "kept").orderBy(*order))
    return kept.withColumn("step", F.when(F.col("kept"), step)).select(*ranked.columns, "step")
