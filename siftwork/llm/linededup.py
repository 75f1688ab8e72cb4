"""Line deduplication by levelled sorted runs of line hashes.

A run is a table of line hashes with the smallest doc_id that holds each,
bucketed and sorted by hash, so a merge join reads it without a shuffle. Batches
come in ascending doc_id. A new batch

1. takes its own distinct hashes with the least and the greatest doc_id of each
   (minima and maxima combine before the shuffle, so a frequent line is one row
   a task);
2. merge-anti-joins them with every run: what is left is new and becomes the
   batch's own run at level 0;
3. drops the lines whose hash an earlier run holds, or whose doc_id is greater
   than the least of the batch.

Where a level holds FANOUT runs, the next batch first compacts them into one
run of the level above; keys of different runs never meet, so runs are as good
as one table and there are few of them however many batches have come.

Everything is DataFrame functions. A line's key is the line without white space
([\\x20\\x09-\\x0D]) at both ends and with A-Z lowered; a key's hash has 128 bits.
A document is what has one doc_id: rows that repeat an id are the same document
and lose nothing to each other. Rows without an id count as one document after
all others. Null or empty texts are one empty line. Keys under LEAST code points
are never dropped. An empty table gives an empty result; other columns are not
read, whatever their names. Ids are integers (anything else is cast).
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import forget, shared_dir, stored

#: Code points from which a key counts.
LEAST = 10
#: Runs of a level that are compacted into one of the next.
FANOUT = 2
#: Arrivals that a whole table is taken as.
BATCHES = 4
#: Hashes that one bucket of a run holds, about (24 bytes each).
BUCKET = 1 << 21
#: Where rows without an id stand, and what is before all ids.
LAST, BEFORE = (1 << 63) - 1, -(1 << 63)

KEY = ["h1", "h2"]
_WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and what a row is met again by: its place in the order of
    ids and a hash of its text. Rows that agree in both lose the same lines."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("at"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
    )


def hashed_lines(rows: DataFrame) -> DataFrame:
    """at, th, pos, h1, h2 of every line whose key is long enough."""
    lines = rows.select("at", "th", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return lines.where(F.length("key") >= LEAST).select("at", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Levels of sorted runs. runs[i] lists the tables of level i."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.runs: list[list[str]] = []
        self.known = 0

    def _write(self, keys: DataFrame) -> str:
        name = f"siftwork_run_{uuid.uuid4().hex}"
        # One task a bucket: every bucket is one sorted file.
        (
            keys.select(*KEY, "first")
            .repartition(self.buckets, *KEY)
            .write.format("parquet")
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", shared_dir(self.spark))
            .saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        df = self.spark.table(name)
        path = df.inputFiles()[:1]
        self.spark.sql(f"DROP TABLE {name}")
        if path:
            df._stored_at = path[0].rsplit("/", 1)[0]
            forget(df)

    def names(self) -> list[str]:
        """Upper levels first: they hold most hashes, so later merges see few."""
        return [n for level in reversed(self.runs) for n in level]

    def compact(self) -> None:
        """Merge the runs of every full level into one run of the next."""
        level = 0
        while level < len(self.runs):
            full = self.runs[level]
            if len(full) >= FANOUT:
                if level + 1 == len(self.runs):
                    self.runs.append([])
                self.runs[level + 1].append(self._write(reduce(DataFrame.unionByName, [self.spark.table(n) for n in full])))
                self.runs[level] = []
                for n in full:
                    self._drop(n)
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """The lines (at, th, pos) of a batch that are dropped. lines: as
        hashed_lines() gives them, ids beyond those of all earlier batches."""
        self.compact()
        own = stored(lines.groupBy(*KEY).agg(F.min("at").alias("lo"), F.max("at").alias("hi")))
        fresh = own
        for name in self.names():
            fresh = fresh.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        run = self._write(fresh.withColumnRenamed("lo", "first"))
        if not self.runs:
            self.runs.append([])
        self.runs[0].append(run)
        # What the new run doesn't hold was known before the batch: all its lines go.
        known = (
            own.join(self.spark.table(run).hint("merge"), KEY, "left")
            .select(*KEY, F.coalesce("first", F.lit(BEFORE)).alias("first"), "hi")
            .where("first < hi")
            .drop("hi")
        )
        # Stored, so that the adaptive skew join can split the rows of a frequent line.
        known = stored(known)
        gone = stored(lines.join(known, KEY).where("first < at").select("at", "th", "pos"))
        forget(own)
        forget(known)
        return gone

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        self.runs = []


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped and kept (the text
    without the lines that an earlier document holds)."""
    spark = docs.sparkSession
    rows = _row(docs, id_col, text_col)
    shares = [(i + 1) / batches for i in range(batches - 1)]
    cuts = rows.agg(F.percentile_approx("at", shares, 10000).alias("cuts")).first()["cuts"] if shares else []
    batch = sum((F.when(F.col("at") > c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    lines = stored(hashed_lines(rows))
    known = LineRuns(spark, max(8, math.ceil(lines.count() / batches / BUCKET)))
    gone = []
    for i in range(len(set(cuts or [])) + 1):
        gone.append(known.add(lines.where(batch == i)))
    known.close()
    forget(lines)
    places = reduce(DataFrame.unionByName, gone).groupBy("at", "th").agg(F.collect_set("pos").alias("gone"))
    # The array of lines is bound once, then read by place: work is linear in a text's lines.
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), F.col("gone"))
    text = F.transform(F.array(_lines(F.col("text"))), lambda all_: F.transform(left, lambda i: F.get(all_, i)))[0]
    whole = F.coalesce(F.col("text"), F.lit(""))
    return (
        rows.join(places, ["at", "th"], "left")
        .select(
            "doc_id",
            F.size(_lines(F.col("text"))).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(text, "\n")).alias("kept"),
        )
    )
