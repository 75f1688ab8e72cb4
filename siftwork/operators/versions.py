"""Numbered versions of a small table under a path, each put in place by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Readers see the version before or the new one, never half of it; of two
    writers that start from the same version one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def children(self, path: str) -> list[str]:
        fs, p = self.fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self.fs(path)
        fs.delete(p, True)

    def newest(self) -> int:
        """The number of the newest version, 0 if there is none."""
        return max((int(n) for n in self.children(self.path) if n.isdigit()), default=0)

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{number}")

    def publish(self, rows: DataFrame, after: int) -> int:
        aside, to = f"{self.path}/_{uuid.uuid4().hex}", f"{self.path}/{after + 1}"
        rows.coalesce(1).write.parquet(aside)
        fs, p = self.fs(aside)
        _, goal = self.fs(to)
        if fs.exists(goal) or not fs.rename(p, goal):
            raise RuntimeError(f"version {after + 1} of {self.path} was made by another writer")
        return after + 1

    def keep_only(self, number: int) -> None:
        for n in self.children(self.path):
            if n != str(number):
                self.delete(f"{self.path}/{n}")
