"""Embedding whitening with MLlib's distributed BlockMatrix.

1. Entries become integers x = floor(1024 c) + 100000. Rows of the fit list are
   numbered through, and sums a dimension are made exactly.
2. Rows are centred as (n x - S) / n, the difference exact, and indexed into a
   BlockMatrix of ROWS rows a block. Transpose times matrix is the scatter; its
   middle dimension (the rows) is cut into splits, whose partial products are
   added up, so no task sees all rows.
3. The scatter (dimensions squared, whatever the rows) is decomposed here by
   eigh, and the BlockMatrix times the whitening matrix projects all rows.
4. The covariance of what came out is measured against the identity.

The number of blocks is bounded (BLOCKS): MLlib lists their indices on the
driver when it multiplies, so with more rows, blocks have more rows. At 1e9 rows
of 64 entries a block has 31 MB; beyond about 1e10 rows cut the table first.

Left out of the fit and of the result are rows whose vector is null, holds a
null or a non-finite entry, has another length than most vectors (of lengths
equally frequent the greatest counts), or an |x| of 2^50 or more, which neither
a long nor a double could carry through. Ids may be null or repeat, rows count
each. Components whose eigenvalue is zero to double precision have a null
whitened value and don't enter identity_error; fewer than COMPONENTS dimensions
give as many components. deviation is null where it doesn't fit a long;
deviation_exact holds it always. An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRow, IndexedRowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.session import ship, stored

COMPONENTS = 8
#: Rows of a block, and the most blocks; with more rows, blocks are larger.
ROWS, BLOCKS = 1024, 1 << 14
#: An eigenvalue counts as zero below this share of the first, times the dimensions.
ZERO = 1e-14

SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 1024) + 100000)


def usable(vector: Column) -> Column:
    most = (1 << 50) / 1024
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < most)), F.lit(False))


def numbered(df: DataFrame) -> DataFrame:
    """df with i, counting its rows through from 0. Stored; nothing is shuffled."""
    made = stored(df.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))
    # A row a partition.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = made.groupBy("part").agg(F.count("*").alias("held"), F.min("row").alias("least"))
    sizes = sizes.select("part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    return made.join(sizes, "part").withColumn("i", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _centred(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], safe: bool) -> Iterator[pa.RecordBatch]:
    d = len(sums)
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        if safe:
            off = n * x - np.array(sums, np.int64)
            total = [int(t) for t in (off * off).sum(axis=1)]
        else:
            off = n * x.astype(object) - np.array(sums, object)
            total = [int(t) for t in (off * off).sum(axis=1)]
        centred = (off / n).astype(np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(centred.ravel()))
        fits = pa.array([t if t < 1 << 63 else None for t in total], pa.int64())
        exact = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("vec_id"), fits, exact, lists], ["i", "vec_id", "deviation", "deviation_exact", "centred"])


def times(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, the middle dimension cut into splits whose products are added
    up. MLlib's multiply has this argument; its Python form leaves it out."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def eigen(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit vectors as columns, the
    entry of greatest size of each positive."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2 / n)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def identity_error(w: DataFrame, k: int) -> float | None:
    """Greatest distance of an entry of w's covariance from the identity's."""
    if not k:
        return None
    c = [F.col("w")[j] for j in range(k)]
    mean = w.agg(*(F.avg(x).alias(f"m{j}") for j, x in enumerate(c))).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    cov = w.agg(*(F.avg((c[i] - mean[i]) * (c[j] - mean[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(cov[a] - (i == j)) for a, (i, j) in enumerate(pairs))


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For every usable row and component: vec_id, component (from 1), n,
    deviation (sum over dimensions of (n x - S)^2), whitened, explained (share
    of the variance), identity_error, deviation_exact."""
    spark = table.sparkSession
    ship(spark)
    good = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or not most["d"]:
        return spark.createDataFrame([], SCHEMA)
    d, n = most["d"], most["count"]
    rows = stored(numbered(good.where(F.size("v") == d).select("vec_id", integers(F.col("v")).alias("x"))))
    long = F.col("x").cast("decimal(38,0)")
    facts = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(long).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    sums = [int(r.s) for r in facts]
    far = max(max(n * r.high - int(r.s), int(r.s) - n * r.low) for r in facts)
    safe = far * far * d < 1 << 63 and n * max(max(abs(r.high), abs(r.low)) for r in facts) < 1 << 62
    held = stored(rows.mapInArrow(lambda it: _centred(it, n, sums, safe), "i bigint, vec_id bigint, deviation bigint, deviation_exact decimal(38,0), centred array<double>"))

    size = max(ROWS, -(-n // BLOCKS))
    indexed = held.select("i", "centred").rdd.map(lambda r: IndexedRow(r[0], r[1]))
    a = IndexedRowMatrix(indexed, n, d).toBlockMatrix(size, d)
    # Read three times; what an executor loses is read again from the stored rows.
    a.persist(StorageLevel.MEMORY_AND_DISK)
    scatter = times(a.transpose(), a, -(-n // size)).toLocalMatrix().toArray()
    values, vectors = eigen(scatter, n)
    count = min(components, d)
    rank = int((values[:count] > ZERO * d * values[0]).sum())
    if rank:
        project = vectors[:, :rank] / np.sqrt(values[:rank])
        one = spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, rank, project.ravel(order="F")))], 1)
        out = a.multiply(BlockMatrix(one, d, rank, d, rank)).toIndexedRowMatrix()
        w = out.rows.map(lambda r: (r.index, [float(v) for v in r.vector.toArray()])).toDF("i bigint, w array<double>")
    else:
        w = held.select("i", F.array().cast("array<double>").alias("w"))
    w = stored(w)
    error = identity_error(w, rank)
    trace = float(values.sum())
    shares = F.array(*(F.lit(float(values[j] / trace) if trace else None).cast("double") for j in range(count)))
    each = held.drop("centred").join(w, "i").select("*", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("component"))
    return each.select(
        "vec_id",
        "component",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.get("w", F.col("component") - 1).alias("whitened"),
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_exact",
    )
