"""Facets, recency windows and coverage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(df: DataFrame, values: Column, limit: int | None = 12, descending_value: bool = False) -> DataFrame:
    """(value, n): rows per value, each row once per distinct value of its array,
    blanks left out; most frequent first, then by value."""
    one = df.select(F.explode(F.array_distinct(F.transform(values, lambda v: F.trim(v)))).alias("value")).where("value <> ''")
    counts = one.groupBy("value").agg(F.count("*").alias("n"))
    order = [F.desc("value")] if descending_value else [F.desc("n"), F.asc("value")]
    return counts.orderBy(*order).limit(limit) if limit else counts


def facet_set(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of several facets in one pass and one shuffle."""

    def tagged(name: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    entries = F.flatten(F.array(*[tagged(k, v) for k, v in facets.items()]))
    return df.select(F.explode(entries).alias("e")).where("e.value is not null and e.value <> ''").groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def recency_counts(df: DataFrame, day: Column, now: str, days: list[int]) -> DataFrame:
    """One row: rows in each cumulative window up to now, undated rows, all rows."""
    age = F.datediff(F.lit(now).cast("date"), day.cast("date"))
    return df.agg(
        *[F.count_if((age >= 0) & (age <= d)).alias(f"last_{d}d") for d in days],
        F.count_if(day.isNull()).alias("undated"),
        F.count("*").alias("any_time"),
    )


def facet_filter(df: DataFrame, chosen: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """Rows that hold any chosen value of every facet; case doesn't matter."""
    out = df
    for values, wanted in chosen.values():
        if wanted:
            low = F.transform(values, F.lower)
            out = out.where(F.arrays_overlap(low, F.array(*[F.lit(w.lower()) for w in wanted])))
    return out


def coverage(df: DataFrame, labels: Column, universe: list[str]) -> DataFrame:
    """(label, n) for every label of a fixed list, zeros included."""
    dim = df.sparkSession.createDataFrame([(x,) for x in universe], "label string")  # a fixed list
    counts = df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("k"))
    return dim.join(counts, "label", "left").select("label", F.coalesce("k", F.lit(0)).alias("n"))
