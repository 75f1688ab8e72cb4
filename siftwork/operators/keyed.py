"""A stored table with one row a key: batches are merged into the buckets they touch.

    data/<batch>/bucket=<b>   the rows of a bucket as one batch left them
    versions/<n>              of each bucket the batch that wrote it last

Keys are dealt into a fixed number of buckets by hash. A batch reads and writes
the buckets that its keys fall into and no others; the next version names the
new folders beside the untouched old ones and is renamed into place. Folders that
no version names any more are deleted by clean(). A batch that carries a number
is merged once, however often it is delivered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.state import latest
from siftwork.operators.versions import Versions

BUCKETS = 64


class KeyedTable:
    """The table at path. key: columns that identify a row (null is a value like any other)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.versions = Versions(spark, f"{self.path}/versions")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _held(self) -> tuple[int, dict[int, str], int]:
        """The newest version, the folder of each bucket, and the last batch number."""
        v = self.versions.newest()
        rows = self.versions.read(v).collect() if v else []  # a row a bucket
        return v, {r.bucket: r.folder for r in rows if r.bucket >= 0}, max((r.number for r in rows), default=-1)

    def _rows(self, held: dict[int, str], buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of buckets, read from the folders that hold them."""
        folders: dict[str, list[int]] = {}
        for b, folder in held.items():
            if buckets is None or b in buckets:
                folders.setdefault(folder, []).append(b)
        out = None
        for folder, own in sorted(folders.items()):
            top = f"{self.path}/data/{folder}"
            part = self.spark.read.option("basePath", top).parquet(*[f"{top}/bucket={b}" for b in own])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, schema: str | None = None) -> DataFrame:
        """All rows of the newest version. schema: of an empty table."""
        _, held, _ = self._held()
        rows = self._rows(held)
        if rows is None:
            if schema is None:
                raise ValueError(f"{self.path} has no rows and no schema was given")
            return self.spark.createDataFrame([], schema)
        return rows.drop("bucket")

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        _, held, _ = self._held()
        asked = self._bucketed(keys.select(*self.key).distinct())
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        rows = self._rows(held, buckets)
        if rows is None:
            return self._rows(held).drop("bucket").limit(0)
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.key]
        return rows.alias("l").join(asked.drop("bucket").alias("r"), same, "left_semi").drop("bucket")

    def _write(self, rows: DataFrame, v: int, held: dict[int, str], touched: list[int], number: int) -> None:
        folder = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = {int(n.split("=")[1]) for n in self.versions.children(f"{self.path}/data/{folder}") if n.startswith("bucket=")}
        now = {b: f for b, f in held.items() if b not in touched} | dict.fromkeys(written, folder)
        # A row that is no bucket carries the number where all rows are gone.
        self.versions.publish(self.spark.createDataFrame([*((b, f, number) for b, f in sorted(now.items())), (-1, "", number)], "bucket int, folder string, number bigint"), v)

    def merge(self, batch: DataFrame, order: list[str] | None = None, partial: bool = False, defaults: dict[str, Column] | None = None, number: int | None = None) -> int:
        """The batch's rows over the stored ones; returns the version.

        Of rows of the batch with one key the one with the greatest order counts
        (order: columns of the batch; without it keys are distinct). Stored rows
        with a greater order stay if the table has these columns. partial: columns
        of the batch are set and all others keep what they hold. defaults: values
        of columns of rows that are new. number: rising numbers of batches; one
        that was merged already changes nothing.
        """
        v, held, last = self._held()
        if number is not None and number <= last:
            return v
        batch = self._bucketed(latest(batch, self.key, order) if order else batch)
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
        old = self._rows(held, touched)
        fresh = batch
        for name, value in (defaults or {}).items():
            fresh = fresh.withColumn(name, F.coalesce(F.col(name), value) if name in batch.columns else value)
        if old is None:
            rows = fresh
        else:
            columns = list(dict.fromkeys([*old.columns, *fresh.columns]))
            a, b, f = old.withColumn("_old", F.lit(True)).alias("a"), batch.withColumn("_new", F.lit(True)).alias("b"), fresh.columns
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*self.key, "bucket"]]
            both = a.join(b, same, "full")
            known, asked = F.col("_old").isNotNull(), F.col("_new").isNotNull()
            if order and all(o in old.columns for o in order):
                newer = F.struct(*[F.col(f"b.{o}") for o in order]) >= F.struct(*[F.col(f"a.{o}") for o in order])
                asked &= ~known | newer

            def column(c: str) -> Column:
                mine = F.col(f"a.{c}") if c in old.columns else F.lit(None)
                theirs = F.col(f"b.{c}") if c in batch.columns else F.lit(None)
                first = F.coalesce(theirs, defaults[c]) if defaults and c in defaults else theirs
                kept = mine if partial and c not in batch.columns else theirs
                return F.when(known & asked, kept).when(asked, first).otherwise(mine).alias(c)

            rows = both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in [*self.key, "bucket"] else column(c) for c in columns])
        self._write(rows, v, held, touched, last if number is None else number)
        return self.versions.newest()

    def delete(self, keys: DataFrame) -> int:
        """Rows of keys go; returns the version."""
        v, held, last = self._held()
        asked = self._bucketed(keys.select(*self.key).distinct())
        touched = [r.bucket for r in asked.select("bucket").distinct().collect() if r.bucket in held]  # BUCKETS at most
        if touched:
            same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.key]
            self._write(self._rows(held, touched).alias("l").join(asked.drop("bucket").alias("r"), same, "left_anti"), v, held, touched, last)
        return self.versions.newest()

    def clean(self) -> None:
        """Delete versions before the newest, and folders that it doesn't name."""
        v, held, _ = self._held()
        self.versions.keep_only(v)
        for n in self.versions.children(f"{self.path}/data"):
            if n not in held.values():
                self.versions.delete(f"{self.path}/data/{n}")
