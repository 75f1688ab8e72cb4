import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwork.llm import langid
from siftwork.llm.langid import identify, reject_foreign

TONGUES = {"aa": ["the", "of", "her", "tion", "and"], "bb": ["le", "que", "eaux", "ment", "oui"], "cc": ["der", "ich", "ung", "sch", "zu"]}


def make(n=300):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        rows.append((i, " ".join("".join(rng.choices(TONGUES[lang], k=rng.choice([1, 2, 3]))) for _ in range(rng.choice([4, 30]))), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = make() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34", "bb"), (1003, "The OF and", None), (None, "der ich und zu", "cc"), (2000, "x", "aa"), (2000, "x", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'z' as held_out")
    got = [r.asDict() for r in identify(df).collect()]
    truth = {i: lang for i, _, lang in make()}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    test = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    bad = [(r, truth[r['doc_id']]) for r in test if r['lang_pred'] != truth[r['doc_id']]]
    assert len(bad) <= 0.02 * len(test) and len(test) > 20, bad
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in test) >= 0.98 * len(test) > 20
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "aa"
    kept = {r.doc_id for r in reject_foreign(df).collect()}
    assert not kept & {1000, 1001, 1002} and set(truth) <= kept
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(none).collect()] == [("und", 0.0)]
    assert identify(none.limit(0)).count() == 0


@pytest.mark.parametrize("nodes", [10**9, 12])
def test_code_lengths_against_a_walk_down_the_tree(spark, monkeypatch, nodes):
    """Bits of texts, seen and unseen bytes alike, with whole and with pruned trees."""
    monkeypatch.setattr(langid, "NODES", nodes)
    rng = random.Random(3)
    texts = {"aa": ["".join(rng.choice("abAB й") for _ in range(rng.randrange(60))) for _ in range(9)], "bb": ["".join(rng.choice("abcü, ") for _ in range(40)) for _ in range(4)]}
    rows = [(None, t, lang) for lang in texts for t in texts[lang]]
    model = langid.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["aa", "bb"]
    asked = ["", "abab", "zq 東京 ab", "a", texts["aa"][0], "x" * 300]
    raw = [t.encode() for t in asked]
    got = model.bits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for j, lang in enumerate(model.names):
        trees = defaultdict(Counter)
        for t in texts[lang]:
            s = bytes(langid.ORDER) + t.lower().encode()
            for i in range(langid.ORDER, len(s)):
                for k in range(langid.ORDER + 1):
                    trees[s[i - k : i]][s[i]] += 1
        whole = sum(trees[b""].values())
        kept = {c: own for c, own in trees.items() if len(c) < 2 or sum(own.values()) * nodes >= whole}

        def p(context, x):
            shorter = (lambda y: p(context[1:], y)) if context else (lambda y: 1 / 256)
            if context not in kept:
                return shorter(x)
            own = kept[context]
            total, kinds = sum(own.values()), len(own)
            escape = kinds / (total + kinds)
            if x in own:
                return own[x] / total * (1 - escape)
            return escape * shorter(x) / (1 - sum(shorter(y) for y in own))

        for i, t in enumerate(raw):
            s = bytes(langid.ORDER) + t.lower()
            want = sum(-math.log2(p(s[k - langid.ORDER : k], s[k])) for k in range(langid.ORDER, len(s)))
            assert abs(got[i, j] - want) < 1e-3 * max(want, 1)
        assert nodes > 100 or len(kept) < len(trees)


def test_scripts_are_told_apart(spark):
    """Scripts that are rare in the corpus keep their own bytes."""
    rng = random.Random(4)
    said = {"ru": "мир дом кот снег река", "el": "και την του λόγος νερό", "zh": "我們 他們 天氣 今天 中國"}
    rows = [(10 * i, "the cat and of her " * 9, "en") for i in range(120)]
    rows += [(10_000 + i, " ".join(rng.choices(words.split(), k=12)), lang) for i, (lang, words) in enumerate(list(said.items()) * 30)]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_long_texts_and_ties(spark):
    rows = [(1, "the cat " * 200_000, "aa"), (3, "le chat " * 10, "bb"), (4, "the cat " * 10, "aa")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == ("aa", 1.0) and got[3][0] == "bb"
    same = [(i, "one and the same", lang) for i, lang in ((1, "bb"), (3, "aa"), (5, "bb"), (7, "aa"))]
    got = [(r.lang_pred, r.score) for r in identify(spark.createDataFrame(same, "doc_id long, text string, lang string")).collect()]
    assert got == [("aa", 0.5)] * 4
