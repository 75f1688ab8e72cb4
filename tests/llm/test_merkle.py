"""The manifest against a plain recursive tree, and the closed form against a walk."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siftwork.llm import merkle
from siftwork.llm.merkle import Piece, counts, folded, place, verified_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(leaves):
    """Root, and of every leaf the runs it meets on its way: (run, place)."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            ways[k].append((runs[i // 8], i % 8))
        at = [i // 8 for i in at]
        level = [H(*r) for r in runs]
    return level[0], ways


def brute(rows):
    leaf = lambda r, low: H(*(enc(v) for v in (r[0], r[3], r[2], r[4])), enc(r[1] if r[1] is None or not low else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        rs = sorted(langs[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, False)))
        trees[k] = (rs, *climb([leaf(r, False) for r in rs]))
    root, above = climb([trees[k][1] for k in order])
    out = []
    for k, up in zip(order, above):
        rs, subroot, ways = trees[k]
        for r, way in zip(rs, ways):
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            proof = []
            for run, i in way + up:
                proof += run[:i] + run[i + 1 :]
                h = H(*run[:i], h, *run[i + 1 :])
            out.append((r[0], leaf(r, False), subroot, root, H(*proof), h, h == root))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in verified_manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def doc(i, lang="en", text=None):
    return (i, f"Text NUMBER {i}" if text is None else text, lang, f"s{i % 3}", i % 7 or None)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_small_trees(spark, n):
    rows = [doc(i) for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_many_cases(spark):
    rows = [doc(i, ["en", "de", None, "é", "", "z"][i * i % 11 % 6]) for i in range(-20, 1300)]
    rows += [(5, None, "en", None, None), (None, "NO ID", "en", "s", 1), (None, "NO ID too", None, "s", 1), (7, "", "de", "s", 0), (3, "X" * 200_000, "fr", "s", 1)]
    rows += [doc(44, "twice"), doc(44, "twice"), doc(2**62 + 1, "en")] + [doc(i, f"lang{i}") for i in range(70)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_three_tiers(spark, monkeypatch):
    """Builders of 8 leaves: 600 leaves need four tiers."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    rows = [doc(i, "en" if i % 10 else "de") for i in range(600)]
    want = {r[0]: r for r in brute(rows)}
    leaves = merkle.placed(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), ["doc_id", "leaf"]).where("tree = 'en'").orderBy("i").collect()
    assert [r.i for r in leaves] == list(range(540)) and leaves[0].n == 540
    level, tiers = [r.leaf for r in leaves], 0
    while len(level) > 1:
        level = [Piece.built(i, len(level), level[i : i + 8]).root() for i in range(0, len(level), 8)]
        tiers += 1
    assert tiers == 4 and level[0] == want[1][2]


@pytest.mark.parametrize("n", [1, 5, 8, 64, 65, 511, 512, 513, 1000, 4097])
def test_closed_form(n):
    """Places count up without a gap in the order in which nodes are completed."""
    log, widths = [], counts(n)
    for i in range(1, n + 1):
        level = 0
        log.append((0, i - 1))
        while level + 1 < len(widths) and (i % 8 ** (level + 1) == 0 or i == n):
            level += 1
            log.append((level, (i - 1) // 8**level))
    assert [place(level, i, n) for level, i in log] == list(range(len(log)))
    leaves = [H(str(i)) for i in range(n)]
    first = (n - 1) // merkle.SPAN * merkle.SPAN
    piece = Piece.built(first, n, leaves[first:])
    assert folded(leaves[-1], list(piece.siblings(n - 1))) == piece.root()
    if n <= merkle.SPAN:
        assert piece.root() == climb(leaves)[0]


def test_empty_and_clashing(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([doc(1), doc(2)], SCHEMA)
    for name in ("leaf", "tree", "row", "part", "i", "n", "block", "above"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted((tuple(r) for r in verified_manifest(df).collect()), key=repr) == brute([doc(1), doc(2)])
