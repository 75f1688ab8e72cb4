"""Session settings, shared scratch space and code shipping."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftwork")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where
    that is unset and Spark runs in one process, a temporary folder takes its
    place; on a cluster, executors would not see each other's files there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftwork-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/siftwork-{uuid.uuid4().hex}"


def kept_dir(spark: SparkSession, df: DataFrame, what: str) -> str:
    """A path in the shared folder for what is derived from df's input files: the
    same for the same files, sizes and times, so it is made once and read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = [what]
    for name in sorted(df.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(name)
        at = p.getFileSystem(conf).getFileStatus(p)
        seen.append(f"{name} {at.getLen()} {at.getModificationTime()}")
    return f"{shared_dir(spark).rsplit('/', 1)[0]}/siftwork-{what}-{hashlib.sha256(chr(10).join(seen).encode()).hexdigest()[:32]}"


def pieces(df: DataFrame, size: int = 4 << 20) -> int:
    """Into how many parts to deal df, by the bytes of its input files: a task's share
    then stays the same as the input grows. At least one part a core."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(name) for name in df.inputFiles()]
    total = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return max(spark.sparkContext.defaultParallelism, total // size)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage
    ends here, and a lost executor costs a reread at most."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_siftwork_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="siftwork-"), "siftwork.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(to)
    sc._siftwork_shipped = True
