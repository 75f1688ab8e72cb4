"""Per-entity profiles: reports, techniques, first and last sight, activity, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.graph import decayed_activity


def resolve_names(mentions: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Adds id: the entity an alias stands for; of several kinds group, campaign, software,
    technique is the order; unknown names get a slug of their own. aliases: (alias, id, kind)."""
    clean = F.trim(F.regexp_replace(F.lower(name), r"\b(?:group|team|gang|actor|apt group|ransomware)\b|[^\p{L}\p{N} ]+", " "))
    clean = F.regexp_replace(clean, r"\s+", " ")
    order = F.when(F.col("kind") == "group", 0).when(F.col("kind") == "campaign", 1).when(F.col("kind") == "software", 2).otherwise(3)
    one = aliases.select(F.lower("alias").alias("_a"), "id", order.alias("_o")).groupBy("_a").agg(F.min_by("id", F.struct("_o", "id")).alias("_id"))
    exact = mentions.withColumn("_n", F.lower(F.trim(F.col(name)))).withColumn("_c", clean)
    a = exact.join(one.withColumnRenamed("_id", "_x"), exact["_n"] == F.col("_a"), "left").drop("_a")
    b = a.join(one.withColumnRenamed("_id", "_y"), a["_c"] == F.col("_a"), "left").drop("_a")
    return b.withColumn("id", F.coalesce("_x", "_y", F.concat(F.lit("name:"), F.regexp_replace("_c", " ", "-")))).drop("_n", "_c", "_x", "_y")


def actor_index(links: DataFrame, techniques: DataFrame, now: str) -> DataFrame:
    """(actor, reports, first_seen, last_seen, n_techniques, score): links (actor, report,
    seen) and techniques (report, technique); the score decays by halves each 180 days."""
    one = links.groupBy("actor", "report").agg(F.min("seen").alias("seen"))
    base = one.groupBy("actor").agg(F.count("*").alias("reports"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    t = one.join(techniques, "report").groupBy("actor").agg(F.countDistinct("technique").alias("n_techniques"))
    s = decayed_activity(one.withColumnRenamed("actor", "node"), now).withColumnRenamed("node", "actor")
    out = base.join(t, "actor", "left").join(s, "actor").withColumn("n_techniques", F.coalesce("n_techniques", F.lit(0)))
    return out.withColumn("score", F.round(F.col("score") + 0.25 * F.col("n_techniques"), 2))


def kpis(index: DataFrame, known: DataFrame) -> DataFrame:
    """One row: entities seen, those not in the knowledge base, the latest sight."""
    k = known.select(F.col("id").alias("actor"), F.lit(True).alias("_k"))
    return index.join(k, "actor", "left").agg(F.count("*").alias("observed"), F.count_if(F.col("_k").isNull()).alias("not_known"), F.max("last_seen").alias("last_seen"))


def tactic_coverage(observed: DataFrame, attributed: DataFrame, tactics: DataFrame) -> DataFrame:
    """(actor, tactic, attributed, observed): distinct techniques a tactic from each side."""
    a = attributed.select("actor", "technique", F.lit(1).alias("a"), F.lit(0).alias("o"))
    o = observed.select("actor", "technique", F.lit(0).alias("a"), F.lit(1).alias("o"))
    both = a.union(o).groupBy("actor", "technique").agg(F.max("a").alias("a"), F.max("o").alias("o")).join(tactics, "technique")
    return both.groupBy("actor", "tactic").agg(F.sum("a").alias("attributed"), F.sum("o").alias("observed"))


def suggest(names: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Autocomplete over (name, seen): exact, then prefix, then anywhere; half a step better if seen."""
    low, t = F.lower("name"), typed.lower()
    rank = F.when(low == t, 0.0).when(low.startswith(t), 1.0).when(low.contains(t), 2.0) - F.when(F.col("seen"), 0.5).otherwise(0.0)
    return names.withColumn("rank", rank).where("rank is not null").orderBy("rank", "name").limit(limit)
