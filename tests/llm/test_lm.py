import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from siftwork.llm import lm, subwords
from siftwork.llm.lm import Model, score_texts
from siftwork.llm.subwords import DEFAULT, encoding


def test_base_and_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    rng = random.Random(2)
    tongues = [["the", "of", "and", "tion", "her"], ["le", "que", "aux", "eau", "ment"]]
    texts = [None, "", " \n", "Zzz Été unseen" * 3]
    for i in range(400):
        t = tongues[i % 2]
        texts.append(" ".join("".join(rng.choices(t, k=rng.choice([1, 1, 2, 3]))).capitalize() for _ in range(rng.choice([3, 40, 120]))))
    df = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string").selectExpr("*", "1 as score", "2 as row")
    got = [r.asDict() for r in score_texts(df).collect()]
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = list(enumerate(texts)) + [(5, texts[5])]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c, ends = Counter(), 0
    for i, t in rows:
        if not held[i]:
            c.update(low(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    assert len(got) == len(rows)
    for r in got:
        w = low(texts[r["doc_id"]])
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert abs(r["base_score"] - want) < 1e-6
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w) + 1, sum(x in c for x in w) + 1, n)
        assert r["score"] < 0
    out = [r for r in got if r["held_out"] and r["doc_id"] > 3]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    many = rng.integers(0, 50, 3001)
    m = Model(many, rng.normal(size=(3001, lm.PROFILE)) * many[:, None])
    m.follow(rng.integers(0, 9, (lm.INPUTS + lm.CLASSES, lm.CLASSES)).astype(float), rng.integers(0, 9, (lm.INPUTS, lm.INPUTS)).astype(float))
    m.train(np.where(rng.random((50, lm.SPAN + 1)) < 0.1, -1, rng.integers(0, 3000, (50, lm.SPAN + 1))), 20, 0)
    m.tables()
    past = [m.end, *rng.integers(0, 3000, 40)]
    last = [m.score(np.array(past + [x], np.int32), np.array([0, len(past) + 1]))[0] for x in range(3001)]
    before = m.score(np.array(past, np.int32), np.array([0, len(past)]))[0]
    assert abs(np.exp(np.array(last) - before).sum() - 1) < 1e-3


def plain_score(m, ids):
    """Subword by subword: attention over the window's past, then class and subword."""
    p, gap = {k: x.astype(float) for k, x in m.p.items()}, lm.INPUTS + lm.CLASSES
    total = 0.0
    for i in range(len(ids) - 1):
        first = i // lm.STEP * lm.STEP - (lm.SPAN - lm.STEP)
        seen = list(range(max(first, 0), i + 1))
        x = p["E"][m.inputs[[ids[j] for j in seen]]]
        a = np.exp((x[-1] @ p["Q"]) @ (x @ p["K"]).T / math.sqrt(lm.DIM) + p["r"][[i - j for j in seen]])
        h = x[-1] + a @ (x @ p["V"]) / a.sum()
        z = h @ p["O"] + p["b"] + m.after[m.inputs[ids[i]]]
        y = ids[i + 1]
        total += z[m.cls[y]] - np.log(np.exp(z).sum()) + m.within[y]
        if m.inputs[ids[i]] < lm.INPUTS:
            total += m.left[m.inputs[ids[i]], m.cls[y]]
            if m.inputs[y] < lm.INPUTS:
                total += m.gain[m.inputs[ids[i]], m.inputs[y]]
    return total


def test_score_against_a_plain_pass():
    """Texts of one subword to several windows, together and alone."""
    rng = np.random.default_rng(3)
    many = rng.integers(0, 50, 2001)
    m = Model(many, rng.normal(size=(2001, lm.PROFILE)) * many[:, None])
    m.follow(rng.integers(0, 9, (lm.INPUTS + lm.CLASSES, lm.CLASSES)).astype(float), rng.integers(0, 9, (lm.INPUTS, lm.INPUTS)).astype(float))
    m.train(rng.integers(0, 2001, (300, lm.SPAN + 1)), 30, 0)
    m.tables()
    texts = [[m.end, *rng.integers(0, 2000, n), m.end] for n in (0, 1, 15, 16, 17, 200)]
    got = m.score(np.array(sum(texts, []), np.int32), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got, [plain_score(m, t) for t in texts], rtol=1e-4, atol=1e-3)


def test_every_subword_is_a_goal_once():
    """Windows lie end to end over whole texts."""
    text = pa.array(["a few words " * 90, None, "", "one"])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 3, 4, 5]), text], ["doc_id", "text"])
    class Sent:
        def __init__(self, value):
            self.value = value
    with open(DEFAULT, "rb") as f:
        ranks = f.read()
    end = encoding(ranks).n_vocab
    m = Model(np.ones(end + 1, np.int64), np.ones((end + 1, lm.PROFILE)))
    found = [b for b in lm._sequences(iter([batch]), Sent(ranks), Sent(m)) if b.column("kind")[0].as_py() == 1]
    w = np.concatenate([b.column("w").flatten().to_numpy().reshape(-1, lm.SPAN + 1) for b in found])
    goals = w[:, 1:][w[:, 1:] >= 0]
    ids = encoding(ranks).encode_ordinary(" a few words" * 90)
    held = lm.held_out([1, 3, 4, 5])
    want = sum((x for x, h in zip([[*ids, end], [end], [end], [*encoding(ranks).encode_ordinary(" one"), end]], held) if not h), [])
    assert goals.tolist() == want


def test_words_are_encoded_in_one_call(monkeypatch):
    """Ids as of each word alone, with wide white space and bytes that are no UTF-8; one call for words without these."""
    with open(DEFAULT, "rb") as f:
        ranks = f.read()
    enc, calls = encoding(ranks), []

    class Counted:
        n_vocab = enc.n_vocab

        def encode_ordinary(self, text):
            calls.append(text)
            return enc.encode_ordinary(text)

        def encode_to_numpy(self, text, **more):
            calls.append(text)
            return enc.encode_to_numpy(text, **more)

    monkeypatch.setattr(subwords, "encoding", lambda ranks: Counted())
    rng = random.Random(4)
    plain = ["".join(rng.choices("abeé.,'1\u4e2d", k=rng.choice([1, 2, 5, 30]))).encode() for _ in range(500)]
    wide = [b"a\xc2\xa0", b"\xe3\x80\x80b", b"\xc2\x85", b"\xc2\xa0\xc2\xa0", b"x\xe2\x80", b"\xff", b"'s"]
    for words, most in ((plain, 1), (plain + wide + plain, 1 + 4), (wide, 1 + 4), (wide[4:], 1), ([], 1)):
        calls.clear()
        ids, size = subwords.word_ids(ranks, words)
        assert len(calls) <= most
        each = [enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        assert ids.tolist() == [i for x in each for i in x] and size.tolist() == [len(x) for x in each]


def test_a_step_with_gaps_follows_the_loss():
    """The parameters after one step move against the difference quotient of the loss, gaps inside a window included."""
    rng = np.random.default_rng(5)
    many = rng.integers(1, 50, 501)
    m = Model(many, rng.normal(size=(501, lm.PROFILE)) * many[:, None])
    m.follow(rng.integers(0, 9, (lm.INPUTS + lm.CLASSES, lm.CLASSES)).astype(float), np.zeros((lm.INPUTS, lm.INPUTS)))
    w = np.where(rng.random((40, lm.SPAN + 1)) < 0.2, -1, rng.integers(0, 500, (40, lm.SPAN + 1)))

    def loss(p):
        ids = np.where(w >= 0, m.inputs[np.maximum(w, 0)], lm.INPUTS + lm.CLASSES)[:, : lm.SPAN]
        x = p["E"].astype(float)[ids]
        back = np.arange(lm.SPAN)[:, None] - np.arange(lm.SPAN)
        a = np.exp((x @ p["Q"]) @ (x @ p["K"]).transpose(0, 2, 1) / math.sqrt(lm.DIM) + p["r"][np.maximum(back, 0)]) * (back >= 0) * (w[:, None, : lm.SPAN] >= 0)
        z = (x + a @ (x @ p["V"]) / (a.sum(2, keepdims=True) + 1e-9)) @ p["O"] + p["b"] + m.after[ids]
        own = np.take_along_axis(z, m.cls[np.maximum(w[:, 1:], 0)][..., None], 2)[..., 0]
        return (np.log(np.exp(z).sum(2)) - own)[w[:, 1:] >= 0].mean()

    before = {k: x.astype(float) for k, x in m.p.items()}
    m.train(w, 1, 0)
    for k, x in m.p.items():
        moved = (x - before[k]).ravel()
        for i in np.argsort(-np.abs(moved))[[0, 1, 2]]:
            up = {n: y.copy() for n, y in before.items()}
            down = {n: y.copy() for n, y in before.items()}
            up[k].flat[i] += 1e-4
            down[k].flat[i] -= 1e-4
            g = (loss(up) - loss(down)) / 2e-4
            assert g * moved[i] < 0 or abs(g) < 1e-6, (k, i)


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
