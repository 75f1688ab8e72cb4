"""Joins, set operations and summaries that several views share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fallback_counts(df: DataFrame, tries: list[tuple[Column, DataFrame, str]], name: str = "n") -> DataFrame:
    """The first count above 0 of several tables (key, n), each met by another column of df."""
    out, found = df, []
    for i, (column, counts, key) in enumerate(tries):
        side = counts.select(F.col(key).alias(f"_k{i}"), F.col("n").alias(f"_n{i}"))
        out = out.join(side, column == F.col(f"_k{i}"), "left")
        found.append(F.nullif(F.col(f"_n{i}"), F.lit(0)))
    drop = [f"_{c}{i}" for i in range(len(tries)) for c in "kn"]
    return out.withColumn(name, F.coalesce(*found, F.lit(0))).drop(*drop)


def first_wins_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts, of each key the one from the earliest part."""
    all_ = None
    for i, p in enumerate(parts):
        p = p.withColumn("_p", F.lit(i))
        all_ = p if all_ is None else all_.unionByName(p)
    rest = [c for c in all_.columns if c != key]
    return all_.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col("_p"), *[F.col(c).cast("string") for c in rest if c != "_p"])).alias("_r")).select(key, "_r.*").drop("_p")


def distinct_spellings(values: Column, placeholders: tuple[str, ...] = ("unknown", "n/a", "none", "-")) -> Column:
    """Trimmed values without placeholders; of spellings that differ by case, the first."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: (v != "") & ~F.lower(v).isin(*placeholders))
    low = F.transform(clean, F.lower)
    return F.transform(F.array_distinct(low), lambda v: F.element_at(clean, F.array_position(low, v).cast("int")))


def parent_aware_difference(ids: Column, known: Column) -> Column:
    """Ids that are not known, nor is their parent, nor any child of theirs."""
    parents = F.transform(known, lambda k: F.split(k, r"\.")[0])
    return F.filter(ids, lambda x: ~F.array_contains(known, x) & ~F.array_contains(known, F.split(x, r"\.")[0]) & ~F.array_contains(parents, x))


def by_prefix(left: DataFrame, id_: str, right: DataFrame, parent: str) -> DataFrame:
    """left's rows whose id is right's or a child of it (`T1.001` of `T1`): an equi-join on the part before the dot."""
    side = right.withColumnRenamed(parent, "_parent")
    return left.join(side, F.split(id_, r"\.")[0] == F.col("_parent")).where((F.col(id_) == F.col("_parent")) | F.col(id_).startswith(F.concat(F.col("_parent"), F.lit(".")))).withColumnRenamed("_parent", parent)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def leaders_then_fill(df: DataFrame, group: str, score: str, key: str, most: int) -> DataFrame:
    """One leader of each group first, then the best of the rest, most rows in all."""
    r = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key))
    lead = F.when(r == 1, 0).otherwise(1)
    return df.withColumn("pass", lead).orderBy("pass", F.desc(score), key).limit(most)


def token_difference(source: Column, other: Column) -> Column:
    """Lost and added tokens of two token arrays, and whether the texts agree:
    nothing added and a tenth lost at most."""
    lost, added = F.array_except(source, other), F.array_except(other, source)
    share = F.size(lost) / F.greatest(F.size(F.array_distinct(source)), F.lit(1))
    return F.struct(lost.alias("lost"), added.alias("added"), ((F.size(added) == 0) & (share <= 0.1)).alias("agree"))


def conversation_rollup(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row a session: turns, first and last text, its user texts in order (a session's own bound)."""
    user = F.when(F.col(role) == "user", F.struct(F.col(turn).alias("turn"), F.col(text).alias("text")))
    return turns.groupBy(key).agg(
        F.count("*").alias("turns"),
        F.min_by(text, turn).alias("first_text"),
        F.max_by(text, turn).alias("last_text"),
        F.transform(F.array_sort(F.collect_list(user)), lambda x: x["text"]).alias("user_texts"),
    )


def verify(source: DataFrame, stored: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, problem) of rows that are missing, surplus or changed: one full outer join by key."""
    s, t = source.select(F.col(key).alias("a"), F.col(sha).alias("sa")), stored.select(F.col(key).alias("b"), F.col(sha).alias("sb"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "surplus").when(~F.col("sa").eqNullSafe(F.col("sb")), "changed")
    return s.join(t, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), problem.alias("problem")).where("problem is not null")


def stable_json_sha(doc: Column) -> Column:
    """sha256 of a struct's or map's JSON; give fields in sorted order for a stable result."""
    return F.sha2(F.translate(F.to_json(doc), chr(0), ""), 256)


def run_metrics(results: DataFrame, run: str, outcome: str) -> DataFrame:
    """Counts by outcome and rates over what was executed; null when nothing was."""
    o = F.col(outcome)
    sums = results.groupBy(run).agg(
        *[F.count_if(o == x).alias(x) for x in ("prevented", "detected", "logged", "missed", "not_run")], F.count("*").alias("steps")
    )
    done = F.col("prevented") + F.col("detected") + F.col("logged") + F.col("missed")
    return sums.withColumn("executed", done).withColumn("prevention_rate", F.try_divide("prevented", done)).withColumn("detection_rate", F.try_divide(F.col("prevented") + F.col("detected"), done)).withColumn("visibility_rate", F.try_divide(done - F.col("missed"), done))


def compare_runs(before: DataFrame, after: DataFrame, key: str, rank: Column) -> DataFrame:
    """(key, change) where a step's rank differs between two runs: improved or regressed."""
    a, b = before.select(key, rank.alias("ra")), after.select(key, rank.alias("rb"))
    return a.join(b, key).where("ra <> rb").select(key, F.when(F.col("rb") > F.col("ra"), "improved").otherwise("regressed").alias("change"))
