"""Token counts and the exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram
then answer totals, quantiles and truncated totals for every context limit
without another look at the texts. Null texts count as empty (0 tokens),
repeated rows count each, an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm.subwords import DEFAULT, WIDE_SPACE, count_memo, encoding, units, vocabulary
from siftwork.llm.textbatch import Block, blocks
from siftwork.session import ship, stored

#: Neighbouring lengths whose sums one task makes.
SPAN = 256


def _counted(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    ranks = sent.value
    memo, enc = count_memo(ranks), encoding(ranks)
    for batch in batches:
        for part in blocks(batch, "text"):
            text = part.column("text")
            b = Block(text, lower=False)
            starts, ends, off = units(b)
            total = np.zeros(len(text), np.int64)
            if len(starts):
                codes, each = memo(b, b.hashes(starts, ends), starts, ends)
                sums = np.concatenate([[0], np.cumsum(np.asarray(each, np.int64)[codes])])
                total = sums[off[1:]] - sums[off[:-1]]
            wide = pc.fill_null(pc.match_substring_regex(text, WIDE_SPACE), False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(wide):
                total[i] = len(enc.encode_ordinary(text[int(i)].as_py()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total)], ["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT) -> DataFrame:
    """doc_id and n_tokens of every row of docs. Ids are integers or null; other
    columns are not read, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(vocabulary(spark, tokenizer))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _counted(it, sent), "doc_id bigint, n_tokens bigint")


def length_histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per encoded length that occurs: n_docs and n_tokens of it,
    docs_from and tokens_from (that length or longer), truncated_total (tokens
    left if every text is cut at that length) and share_up_to (of documents of
    that length or shorter)."""
    hist = counts.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n_docs"))
    # Read three times below: counting the texts is done once.
    hist = stored(hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("span", F.floor(F.col("length") / SPAN)))
    # Sums within a span of lengths, then over the few spans: no task sees all lengths.
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = W.orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"))
    own = W.partitionBy("span").orderBy(F.desc("length"))
    total = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_tokens").alias("all_tokens"))
    out = (
        hist.withColumn("d_own", F.sum("n_docs").over(own))
        .withColumn("t_own", F.sum("n_tokens").over(own))
        .join(F.broadcast(spans), "span")  # a row per SPAN lengths: longest text / SPAN at most
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("docs_from", F.col("d_own") + F.col("d_later"))
        .withColumn("tokens_from", F.col("t_own") + F.col("t_later"))
    )
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if every text is cut at limit, for any limit."""
    longer: Column = F.col("length") >= limit
    return hist.agg(
        F.coalesce(F.sum(F.when(longer, F.lit(limit) * F.col("n_docs")).otherwise(F.col("n_tokens"))), F.lit(0)).alias("truncated_total"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_from"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share q of documents doesn't exceed."""
    return hist.where(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))
