"""Line deduplication against brute force, over batches and compactions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm.linededup import LineRuns, drop_repeated_lines, hashed_lines
from siftwork.llm.linededup import _row as row

SCHEMA = "doc_id bigint, text string"
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    first = {}
    order = lambda i: float("inf") if i is None else i
    keys = lambda t: [x.strip(WHITE).translate(LOWER) for x in (t or "").split("\n")]
    for i, t in rows:
        for k in keys(t):
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if len(k) < 10 or first[k] == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(spark, rows, batches):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in drop_repeated_lines(df, batches=batches).collect()), key=repr)


LONG = "a line of the licence text"
CASES = [
    (1, None),
    (2, ""),
    (3, f"{LONG}\nshort\n{LONG}\n"),
    (4, f"\t{LONG.upper()} \nshort\nother text of four"),
    (5, f"{LONG}\n\n\nown words of number five"),
    (5, "own words of number five\nrow that repeats its id"),
    (6, "row that repeats its id"),
    (7, "Überlänge zählt\nÜBERLÄNGE ZÄHLT"),
    (8, "überlänge zählt\nÜberlänge zählt"),
    (9, "nine char\n         \n123456789"),
    (10, "nine char\n123456789\n1234567890"),
    (11, "1234567890"),
    (None, f"{LONG}\nlast of all rows here"),
    (None, "last of all rows here"),
    (12, "\n".join(f"line number {i % 700}" for i in range(3000))),
    (13, "\n".join(f"line number {i}" for i in range(600, 900))),
    (13, "\n".join(f"line number {i}" for i in range(600, 900))),
    (-4, "a line with a tail  "),
    (15, "a line with a tail"),
    (16, "a line with a tail  "),
]


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_cases(spark, batches):
    assert found(spark, CASES, batches) == brute(CASES)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.lists(st.sampled_from(["", "x", "common words one", "Common Words One ", "common words two", "another line", "tiny"]), max_size=6)), min_size=1, max_size=25))
def test_random(spark, rows):
    rows = [(i, "\n".join(t)) for i, t in rows]
    assert found(spark, rows, 4) == brute(rows)


def test_empty_and_clashing(spark):
    assert drop_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, LONG), (2, LONG)], SCHEMA)
    for name in ("at", "th", "pos", "h1", "key", "first", "kept"):
        df = df.withColumn(name, F.lit("x"))
    assert [(r.doc_id, r.kept) for r in drop_repeated_lines(df).orderBy("doc_id").collect()] == [(1, LONG), (2, "")]


def test_levels(spark):
    """Eleven batches of one document: runs are compacted, and stay disjoint."""
    docs = [(i, f"line that all share\nline of {i // 2} in pairs\nline of {i} alone") for i in range(11)]
    known, gone = LineRuns(spark, 2), []
    for d in docs:
        gone += [(r.at, r.pos) for r in known.add(hashed_lines(row(spark.createDataFrame([d], SCHEMA), "doc_id", "text"))).collect()]
        assert all(len(level) <= 2 for level in known.runs)
    assert len(known.runs) >= 3
    assert sorted(gone) == sorted([(i, 0) for i in range(1, 11)] + [(i, 1) for i in range(1, 11, 2)])
    held = [tuple(r)[:2] for n in known.names() for r in spark.table(n).collect()]
    assert len(held) == len(set(held)) == 1 + 6 + 11
    runs = [spark.table(n) for n in known.names()[:2]]
    plan = runs[0].join(runs[1].hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # a run is merged as it lies
    known.close()
