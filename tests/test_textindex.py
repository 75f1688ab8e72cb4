"""The stored index against sums over all texts: batches, replaced documents, compaction, files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import search as sr
from siftwork.operators.textindex import TextIndex
from siftwork.session import pieces, shared_dir

WORDS = ["alpha", "beta", "gamma", "delta", "loader", "beacon", "cve-2024-1234", "t1059.001", "host", "rare"]
FIELDS = {"title": 10.0, "cves": 8.0, "body": 2.0}


def texts(ids, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[:5], k=3)), rng.choice([None, "CVE-2024-1234", ""]), " ".join(rng.choices(WORDS, [9, 7, 5, 3, 3, 2, 1, 1, 2, 0.1], k=rng.randint(0, 30)))) for i in ids]


def runs(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def impacts(rows, terms):
    out = {}
    for i, title, cves, body in rows:
        s = sum(w * runs(x).count(t) for t in terms for w, x in zip(FIELDS.values(), (title, cves, body)))
        if s:
            out[i] = s
    return out


@pytest.fixture
def index(spark):
    return TextIndex(spark, shared_dir(spark), FIELDS, split=tx.plain_runs, buckets=4)


def add(spark, index, rows):
    df = spark.createDataFrame(rows, "doc_id long, title string, cves string, body string")
    index.add(df, {"title": F.col("title"), "cves": F.col("cves"), "body": F.col("body")})


def same_as(index, rows, terms, k):
    want = sorted(impacts(rows, terms).items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [(r.key, r.score) for r in index.top(terms, k).collect()] == want


def test_batches_and_replaced_documents(spark, index):
    first, second = texts(range(200), 1), texts(range(150, 260), 2)
    assert index.version() == 0 and index.segments() == []
    add(spark, index, first)
    same_as(index, first, ["alpha", "loader"], 10)
    files = {p for n in index.segments() for p in index._read(n, "postings").inputFiles()}
    add(spark, index, second)
    assert files < {p for n in index.segments() for p in index._read(n, "postings").inputFiles()} and index.version() == 2
    rows = [r for r in first if r[0] < 150] + second
    for terms, k in ((["alpha", "loader"], 10), (["rare"], 5), (["rare", "alpha"], 3), (["beacon", "host", "gamma"], 1000), (["nothing"], 5)):
        same_as(index, rows, terms, k)
    lists = {i: set(runs(a)) | set(runs(b)) | set(runs(c)) for i, a, b, c in rows}
    docs = {t: sum(t in s for s in lists.values()) for t in ("alpha", "rare", "2024")}
    assert {r.term: r.docs for r in index.terms(list(docs)).collect()} == docs
    lengths = [sum(len(runs(r[j])) for r in rows) for j in (1, 2, 3)]
    assert index.facts() == (len(rows), lengths)
    index.compact()
    assert len(index.segments()) == 1 and index.facts() == (len(rows), lengths)
    index.clean()
    same_as(index, rows, ["beta", "delta"], 7)


def test_only_the_terms_buckets_are_read(spark, index):
    add(spark, index, texts(range(50), 3))
    plan = index.hits(["alpha"])._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :]
    assert "bucket" in part.split("PushedFilters")[0] and "term" in part.split("PushedFilters")[1]


def test_bounded_rows_suffice(spark, index):
    """One document far ahead: rows that can't reach it are not among the candidates."""
    rows = texts(range(300), 4) + [(999, "alpha alpha alpha alpha alpha alpha alpha", "", "beta")]
    add(spark, index, rows)
    same_as(index, rows, ["alpha", "beta"], 1)


def test_identifiers_first(spark, index):
    rows = texts(range(120), 5)
    add(spark, index, rows)
    got = index.candidates(["alpha"], ["CVE"], ["cves"], 30).collect()
    own = sorted(r[0] for r in rows if "cve" in runs(r[2]))
    assert [r.key for r in got] == own[:30] and {r.matched_by for r in got} == {"exact_id"}
    mixed = index.candidates(["alpha"], ["nothing"], ["cves"], 30).collect()
    want = sorted(impacts(rows, ["alpha"]).items(), key=lambda x: (-x[1], x[0]))[:30]
    assert [(r.key, r.score, r.matched_by) for r in mixed] == [(i, s, "text") for i, s in want]


def test_bm25f_from_the_index(spark, index):
    first, second = texts(range(100), 6), texts(range(80, 140), 7)
    add(spark, index, first)
    add(spark, index, second)
    rows = [r for r in first if r[0] < 80] + second
    df = spark.createDataFrame(rows, "doc_id long, title string, cves string, body string")
    terms, lengths = sr.postings(df, {"title": F.col("title"), "cves": F.col("cves"), "body": F.col("body")}, split=tx.plain_runs)
    weights = {"title": (3.0, 0.5), "cves": (2.5, 0.4), "body": (1.0, 0.75)}
    plain = lambda d: sorted((r.doc_id, round(r.score, 9), r.n_hits) for r in d.collect())
    assert plain(index.scored(["alpha", "rare", "beacon"], weights)) == plain(sr.bm25f(terms, lengths, ["alpha", "rare", "beacon"], weights=weights))


def test_two_writers(spark, index):
    add(spark, index, texts(range(5), 8))
    with pytest.raises(RuntimeError):
        index._publish(["x"], 0)


def test_texts_are_shuffled_instead_of_their_terms(spark, tmp_path):
    """Terms of a document are counted by a hash where its texts are; parts follow the input."""
    spark.createDataFrame(texts(range(50), 3), "doc_id long, title string, cves string, body string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert pieces(df, 1) > 1000 and pieces(df) == spark.sparkContext.defaultParallelism
    index = TextIndex(spark, shared_dir(spark), FIELDS, split=tx.plain_runs)
    text = index._counted(df, {"body": F.col("body")}, 5)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "hashpartitioning(key" in text and "SortAggregate" not in text
