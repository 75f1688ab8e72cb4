"""Whitening against numpy on the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import whitening
from siftwork.llm.whitening import whitened
from siftwork.session import table

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024.0 * float(np.float32(c)))) + 100000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    dev = ((n * x - s) ** 2).sum(axis=1)
    c = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in good], dev, c, values[::-1], vectors[:, ::-1]


def check(spark, rows, k=8):
    got = whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    ids, dev, c, values, vectors = brute(rows)
    assert len(got) == len(ids) * min(k, c.shape[1])
    w = c @ vectors[:, :k] / np.sqrt(values[:k])
    want = sorted((str(i), j + 1, len(ids), int(t)) for i, t in zip(ids, dev) for j in range(w.shape[1]))
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation) for r in got) == want
    for j in range(w.shape[1]):
        mine = {}
        for r in got:
            if r.component == j + 1:
                mine.setdefault((str(r.vec_id), r.deviation), []).append(r.whitened)
                assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
                assert r.identity_error < 1e-8 and r.deviation_exact == r.deviation
        theirs = {}
        for i, t, v in zip(ids, dev, w[:, j]):
            theirs.setdefault((str(i), int(t)), []).append(v)
        flat = lambda m: np.array([v for key in sorted(m) for v in sorted(m[key], key=abs)])
        a, b = flat(mine), flat(theirs)
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, -b, atol=1e-7)


def test_random(spark, monkeypatch):
    """Blocks of 16 rows: many blocks, the last one short."""
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(205, 12)) @ rng.normal(size=(12, 12)) + 3
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(v)]
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12), (904, [1.0]), (905, []), (906, [3e38] * 12)]
    good = [r for r in rows if r[0] < 900] + [(7, rows[7][1]), (None, rows[3][1]), (None, rows[9][1])]
    check(spark, good)
    got = whitened(spark.createDataFrame(rows, SCHEMA))
    assert {r.vec_id for r in got.collect()} == set(range(205))


def test_table(spark):
    check(spark, [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()])


def test_few_dimensions_and_no_variance(spark):
    flat = whitened(spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, [1.0, 3.0, 5.0]), (3, [1.0, 4.0, 5.0])], SCHEMA)).collect()
    assert len(flat) == 9
    assert [r.explained for r in flat if r.vec_id == 1] == [1.0, 0.0, 0.0]
    assert all((r.whitened is None) == (r.component > 1) for r in flat)
    assert sorted(round(abs(r.whitened), 6) for r in flat if r.component == 1) == [0.0, 1.224745, 1.224745]
    alone = whitened(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None)] * 2


def test_exact_beyond_a_long(spark):
    rows = [(1, [1e9]), (2, [-1e9]), (3, [0.0])]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).orderBy("vec_id").collect()
    x = [int(np.floor(1024 * np.float64(np.float32(v)))) + 100000 for _, (v,) in rows]
    want = [(3 * a - sum(x)) ** 2 for a in x]
    assert [int(r.deviation_exact) for r in got] == want
    assert [r.deviation for r in got] == [w if w < 2**63 else None for w in want] and got[0].deviation is None


def test_empty_and_clashing(spark):
    empty = whitened(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[:2] == ["vec_id", "component"]
    assert whitened(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    df = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(5)], SCHEMA)
    for name in ("i", "x", "row", "part", "v", "w", "n"):
        df = df.withColumn(name, F.lit("x"))
    assert whitened(df).count() == 10
