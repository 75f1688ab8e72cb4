import random

from siftwork.llm.subwords import DEFAULT, encoding
from siftwork.llm.tokencount import length_histogram, quantile, token_counts, truncated_total

TEXTS = ["", None, " ", "  two  blanks ", "tab\tand\n\n lines\n", "it's we'll 12,345.6 — naïve  wide　space", "x" * 5000, " ", "a\x1cb \x85 c", "👍🏽 ok\r\n\r\n  end  "]


def test_counts_equal_the_encoder(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(" \n\t.,'a1é—B ") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'clash' as n_tokens")
    enc = encoding(open(DEFAULT, "rb").read())
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == want


def test_histogram(spark):
    rng = random.Random(4)
    lengths = [rng.choice([0, 1, 5, 4095, 4096, 9000, rng.randrange(20000)]) for _ in range(400)]
    hist = length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")).cache()
    rows = {r.length: r for r in hist.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.docs_from == sum(x >= n for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert abs(r.share_up_to - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    for limit in (0, 7, 4096, 10**6):
        assert truncated_total(hist, limit).first().truncated_total == sum(min(x, limit) for x in lengths)
    assert quantile(hist, 0.5).first().length == sorted(lengths)[199]
    assert length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0
