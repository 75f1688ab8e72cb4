"""URL filters: rules first, then a logistic regression on host and path.

Character n-grams of host and path are hashed into a fixed number of weights,
which are fitted to a small labelled URL table. Rules (a host with all its
subdomains, and the start of a path) come before the model; of several that
fit, the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm import urllabels
from siftwork.llm.textbatch import mix, unpack
from siftwork.session import ship

#: Weights, n-gram lengths, and the most labelled rows that are fitted (those of
#: least hash, so no part of the alphabet comes first; a fit on the driver needs a bound).
WEIGHTS, GRAMS, MOST_LABELLED = 1 << 14, (3, 4, 5), 20_000
#: (verdict, host and path) of the registered query; fixed values.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lowered) and path (up to ? or #) of a url;
    both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        where, slash, rest = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def grams(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of all n-grams of ^host/path$, and the rows they belong to."""
    text = [f"^{h}|{p}$".encode() for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
    buf, off = unpack(pa.array(text, pa.binary()))
    row_of = np.repeat(np.arange(len(text)), np.diff(off))
    left = off[1:][row_of] - np.arange(len(buf))
    code = np.zeros(len(buf), np.uint64)
    at, row = [], []
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(buf), np.uint64)
        if n <= len(buf):
            shifted[: len(buf) - n + 1] = buf[n - 1 :]
        code = code * np.uint64(257) + shifted + np.uint64(1)
        if n in GRAMS:
            ok = left >= n
            at.append((mix(code[ok] + np.uint64(n)) % np.uint64(WEIGHTS)).astype(np.int64))
            row.append(row_of[ok])
    return np.concatenate(at), np.concatenate(row)


def fit(host: pa.Array, path: pa.Array, label: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights and a last one for the bias: full-batch gradient steps with an L2 pull."""
    w, n = np.zeros(WEIGHTS + 1), len(label)
    if not n:
        return w
    at, row = grams(host, path)
    share = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    for _ in range(steps):
        z = np.bincount(row, w[at], n) * share + w[-1]
        gap = (1 / (1 + np.exp(-z)) - label) / n
        w[:-1] -= 8 * (np.bincount(at, (gap * share)[row], WEIGHTS) + 1e-4 * w[:-1])
        w[-1] -= gap.sum()
    return w


def _judged(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    w = sent.value
    for batch in batches:
        n = batch.num_rows
        score = np.zeros(n)
        if n:
            at, row = grams(batch.column("host"), batch.column("path"))
            share = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
            score = 1 / (1 + np.exp(-(np.bincount(row, w[at], n) * share + w[-1])))
        yield batch.append_column("score", pa.array(score))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    rules: (allow or block, host/path start), a short list. labelled: url and
    label (1: block); rows with a null are left out. score is the model's
    probability of block for every url, ruled or not; without labelled rows of
    it the score is 0.5 and the verdict allow. Null urls and urls without ://
    have an empty host and path, fit no rule, and are judged as such. Ties
    and repeated rows: each row is judged alone.
    """
    spark = pages.sparkSession
    ship(spark)
    if labelled is None:
        labelled = spark.createDataFrame(urllabels.labelled(), "url string, label int")
    rows = labelled.select("url", "label").dropna().orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED)
    known = rows.select(*[c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path"), strict=True)], "label").toArrow()
    w = fit(known.column("host").combine_chunks(), known.column("path").combine_chunks(), known.column("label").to_numpy().astype(float))
    sent = spark.sparkContext.broadcast(w)
    host, path = parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    kind = dict(urls.dtypes)["page_id"]
    scored = urls.mapInArrow(lambda it: _judged(it, sent), f"page_id {kind}, host string, path string, score double")
    found = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    model = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.withColumn("r", found).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", model).alias("verdict"), "score")
