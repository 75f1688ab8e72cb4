"""Fingerprints are made piece by piece: the same whatever the pieces' size."""

import re
import unicodedata

from pyspark.sql import functions as F

from siftwork.functions.batches import pieces
from siftwork.operators import dedup as dd


def test_pieces_change_no_fingerprint(spark, monkeypatch):
    texts = [None, "", "Plain words only. 1) And a list", "# Éte ﬁne Ａbc\n- ça va", "ä" * 50, "one two three " * 40, "x" * 99]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).cache()
    prints = lambda: [tuple(r) for r in dd.fingerprints(df, "doc_id", "text", F.col("text"), F.lit("p")).orderBy("doc_id").collect()]
    whole = prints()
    monkeypatch.setattr(dd, "pieces", lambda col: pieces(col, 20))
    assert prints() == whole and len({r[4] for r in whole}) == 6
    got = [r.n for r in df.select("doc_id", dd.normalized(F.col("text")).alias("n")).orderBy("doc_id").collect()]
    fold = ["".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)) for t in texts]
    want = [re.sub(r"[^\w.]+|\.(?!\w)", " ", re.sub(r"(?m)^\s*(?:[-*+#>]+|\d+[.)])\s+", " ", t).lower()) for t in fold]
    assert got == [re.sub(r"\s+", " ", t).strip() for t in want]
