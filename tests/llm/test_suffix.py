import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftwork.llm import extsort, suffix
from siftwork.llm.suffix import _least, remove_repeats


def sorted_by_comparing(t):
    n = len(t)
    order = sorted(range(n), key=lambda i: t[i:].tolist())
    same = [0]
    for i, j in zip(order, order[1:]):
        k = 0
        while max(i, j) + k < n and t[i + k] == t[j + k]:
            k += 1
        same.append(k)
    return order, same


def drained(t, letters):
    at, same = (np.concatenate(x).tolist() for x in zip(*extsort.suffix_order(t, letters)))
    return at[::-1], [0, *same[1:][::-1]]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("few", [0, 256])
def test_order_and_common_prefixes(small, few, monkeypatch):
    monkeypatch.setattr(extsort, "FEW", few)
    if small:  # queues, spools and arrays from scratch files throughout
        for name, value in (("QUEUE_BYTES", 100), ("MAP_BYTES", 64), ("BUCKET", 5), ("PART", 7), ("STEP", 9), ("FEW", few and 40)):
            monkeypatch.setattr(extsort, name, value)
    rng = np.random.default_rng(small)
    for trial in range(150):
        n, kinds = int(rng.integers(0, 120)), int(rng.integers(1, 6))
        t = rng.integers(1, kinds + 1, n)
        if trial % 3 == 0:
            t[n // 2 : n // 2 * 2] = t[: n // 2]
        if trial % 7 == 0:
            t = np.tile(t[:3], n // 3)
        t = np.append(t, 0).astype(np.uint32)
        assert drained(t, kinds + 1) == sorted_by_comparing(t)


def test_a_shard_far_larger_than_the_queues(monkeypatch):
    """Tuples of a shard take over a hundred times what queues may hold: most go through the file."""
    monkeypatch.setattr(extsort, "QUEUE_BYTES", 4096)
    monkeypatch.setattr(extsort, "MAP_BYTES", 4096)
    written = []
    monkeypatch.setattr(extsort.Scratch, "close", lambda self, f=extsort.Scratch.close: (written.append(self.written), f(self)))
    rng = np.random.default_rng(5)
    t = np.append(rng.integers(1, 30, 60_000), 0).astype(np.uint32)
    t[40_000:50_000] = t[:10_000]
    order, same = drained(t, 31)
    assert sum(written) > 100 * 4096
    raw = t.astype(">u4").tobytes()
    assert order == sorted(range(len(t)), key=lambda i: raw[4 * i :])
    assert max(same) >= 10_000


def test_least_place():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 9, 500).astype(np.uint64) << np.uint64(60)
    for w in (1, 2, 7, 169):
        assert _least(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


def brute(texts, k=200):
    seen = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [2 << 20, 400])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD_LETTERS", shard)
    rng = random.Random(shard)
    say = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [say(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = [None, "", "x", "z" * 700, "ab" * 150, "abcdefg" * 90, say(199)]
    for _ in range(60):
        texts.append("".join(rng.choice([say(rng.randrange(300)), rng.choice(shared), shared[5][: rng.randrange(700)]]) for _ in range(rng.randrange(1, 6))))
    texts += [texts[10], texts[11] + "!", "z" * 450, "q" + "abcdefg" * 60]
    rows = [*enumerate(texts), (8, texts[8]), (None, texts[12]), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as runs", "2 as key", "3 as h")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    want = sorted((i or -1, *x) for (i, _), x in zip(rows, brute([(t or "").encode() for _, t in rows])))
    assert got == want


def test_long_periodic_texts_and_empty_tables(spark):
    texts = ["z" * 1_000_000, "abcdefg" * 60_000, "only once " + "".join(map(str, range(400)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = df.selectExpr("doc_id as id", "doc_id as h", "cast(text as binary) as text").mapInArrow(suffix._anchors, suffix._PIECES)
    assert pieces.where("id < 2").count() < 30  # and not one for each byte
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df).collect()}
    assert got == {0: (1_000_000, 1_000_000, 1), 1: (420_000, 420_000, 1), 2: (len(texts[2]), 0, 0)}
    assert remove_repeats(df.limit(0)).count() == 0
