"""Search as one call: score, boosts, priors, copies, facets, filter, diversity, page and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import facets as fc
from siftwork.operators import search as sr

#: What a hit of each kind of structure adds to the text score; fixed values.
BOOSTS = {"entity_self": 8.0, "entity_mention": 4.0, "entity_title": 1.0, "cve": 5.0, "technique": 3.0, "technique_related": 1.5, "technique_self": 8.0, "tactic": 0.8, "intent": 2.0, "phrase": 1.5}
#: Ranked rows whose publishers are spread.
SPREAD = 200


@dataclass
class Found:
    """Results of a search: page (shown rows with rank and why), facets before the facet filter, counts by kind."""

    page: DataFrame
    facets: DataFrame
    counts: DataFrame


def mention_boost(mentions: Column, in_title: Column) -> Column:
    """An entity's mentions: 4, up to twice that with their number, and 1 in the title."""
    some = BOOSTS["entity_mention"] * (1 + F.least(F.lit(1.0), F.log2(1 + mentions) / 3))
    return F.when(mentions > 0, some).otherwise(0.0) + F.when(in_title, BOOSTS["entity_title"]).otherwise(0.0)


def technique_boost(ids: Column, technique: str, own: Column) -> Column:
    """A technique asked for: the document is about it, names it, or names its parent or a child."""
    parent = technique.split(".")[0]
    related = F.exists(ids, lambda x: (x == parent) | x.startswith(parent + "."))
    return F.when(own == technique, BOOSTS["technique_self"]).when(F.array_contains(ids, technique), BOOSTS["technique"]).when(related, BOOSTS["technique_related"]).otherwise(0.0)


def boosts(docs: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """(key, boost, parts): structural boosts of documents, named parts above 0 kept to explain them."""
    each = F.array(*[F.struct(F.lit(k).alias("part"), c.cast("double").alias("add")) for k, c in parts.items()])
    kept = F.filter(each, lambda p: p["add"] > 0)
    return docs.select(key, F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["add"]).alias("boost"), kept.alias("parts"))


def relevant(scored: DataFrame, wanted: list[str], share: float = 0.34) -> DataFrame:
    """The lexical gate: rows that hit enough of a query's signal terms, one at least."""
    signal = [t for t in wanted if t not in T.LOW_SIGNAL]
    least = max(1, int(len(signal) * share + 0.5)) if len(signal) > 2 else 1
    return scored.where(F.col("signal_hits") >= least)


def why(terms: DataFrame, wanted: list[str], key: str) -> DataFrame:
    """(key, matched): the query's terms that a document has, and in which fields."""
    hit = terms.where(F.col("term").isin(wanted)).groupBy(key, "term").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return hit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "fields"))).alias("matched"))


def snippet(text: Column, wanted: list[str], size: int = 260) -> Column:
    """A stretch of text around the first of the wanted terms in their order of weight, white space collapsed."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    low = F.lower(flat)
    at = F.coalesce(*[F.nullif(F.locate(w, low), F.lit(0)) for w in wanted], F.lit(1))
    start = F.greatest(at - size // 2, F.lit(1))
    return F.trim(F.substr(flat, start, F.lit(size)))


def run_search(scored: DataFrame, docs: DataFrame, key: str, kind: Column, publisher: Column, same: Column, prior: Column, facets: dict[str, Column], chosen: dict[str, list[str]], limit: int, offset: int = 0, boost: DataFrame | None = None, spread: int = SPREAD) -> Found:
    """scored: (key, score, ...), from bm25f(). Text scores and boosts are weighed by
    priors; of equal rows the best stays; facets count what is left before the chosen
    values filter it; of the first rows (spread) those of one publisher make way for
    others, and the rest follow in their own order."""
    s = scored.select(key, "score")
    if boost is not None:
        s = s.join(boost.select(key, "boost"), key, "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    facet_cols = {f"_f{i}": c for i, c in enumerate(facets.values())}
    rows = docs.select(key, kind.alias("kind"), publisher.alias("publisher"), same.alias("same"), prior.alias("prior"), *[c.alias(n) for n, c in facet_cols.items()])
    rows = s.join(rows, key).withColumn("score", F.round(F.col("score") * F.col("prior"), 6)).drop("prior")
    one = sr.collapse(rows, key, "score", "same")
    counted = fc.facet_set(one, dict(zip(facets, [F.col(n) for n in facet_cols], strict=True)))
    left = fc.facet_filter(one, {n: (F.col(c), chosen.get(n, [])) for n, c in zip(facets, facet_cols, strict=True)})
    order = [F.desc("score"), key]
    shown = ["rank", key, "kind", "publisher", "score", "copies"]
    first = sr.diversify(left.orderBy(*order).limit(spread), "publisher", "score", key)
    rank = F.row_number().over(W.orderBy(F.desc(F.round("adjusted", 6)), key))  # spread rows
    page = first.withColumn("rank", rank).withColumn("score", F.round("adjusted", 6)).where(F.col("rank").between(offset + 1, offset + limit)).select(*shown)
    if offset + limit > spread:
        skip = max(offset, spread)
        rest = left.orderBy(*order).offset(skip).limit(offset + limit - skip)
        page = page.unionByName(rest.withColumn("rank", skip + F.row_number().over(W.orderBy(*order))).select(*shown))  # limit rows
    return Found(page, counted, left.groupBy("kind").agg(F.count("*").alias("n")))
