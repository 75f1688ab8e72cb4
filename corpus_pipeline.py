"""A corpus pipeline: each stage reads what the one before wrote.

Stages take (spark, docs, sf_dir) and return a table with the columns of
documents: language identification rejects texts in no language, near-duplicate
detection keeps one document of each group, decontamination drops documents
with benchmark items, personal data is masked, and the last stage samples
documents so that sources, languages and topics meet their target shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.decontam import decontaminated
from siftwork.llm.langid import reject_foreign
from siftwork.llm.mixing import sampled
from siftwork.llm.neardup import near_duplicates
from siftwork.llm.pii import mask_pii
from siftwork.session import ship, stored, table

#: Share of the tokens left that the last stage keeps.
BUDGET = 0.5


#: Each row's own key: equal for rows that repeat in all columns only.
ROW = "_row"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64(*docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a learned language. Rows are judged one by one: null ids, ids that
    repeat, extra columns and empty tables need no care."""
    return reject_foreign(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id (null ids
    last). Rows with an empty set of shingles are in no group and all stay; of
    rows that repeat in all columns one stays. Rows that share an id, or have
    none, are told apart by a hash of all columns."""
    rows = keyed(docs)
    found = near_duplicates(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")).distinct()
    ids = rows.select(ROW, "doc_id").distinct().join(found, ROW)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    kept = stored(ids.groupBy("group").agg(F.min(order).alias("first")).select(f"first.{ROW}"))
    return rows.join(kept.hint("merge"), ROW, "left_semi").dropDuplicates([ROW, "doc_id", "text"]).select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; every row is judged by its own text, null
    ids and repeated ids included."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked in text and n_chars to match."""
    return mask_pii(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows sampled so that BUDGET of the tokens stay and margins meet their
    targets; a row is drawn by a hash of its id and text, so rows that repeat are
    drawn alike and rows without an id like all others."""
    return sampled(docs, BUDGET)


STAGES = [
    ("language identification", language),
    ("near-duplicates", unique),
    ("decontamination", clean_of_benchmark),
    ("personal data", without_pii),
    ("mixing", mixed),
]

#: Language models, spans that are learned and raking have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
