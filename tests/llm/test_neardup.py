import random

from siftwork.llm.neardup import components, near_duplicates


def brute(rows, percent=85):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def rows_of(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
        # a chain: each differs from the one before only
        for j in range(6):
            base = base[1:] + [rng.choice(words)]
            rows.append(" ".join(base))
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "É b"), (906, "é b")]
    monkeypatch.setattr("siftwork.llm.neardup.CELL", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    got = near_duplicates(df.selectExpr("doc_id", "text", "1 as n_shingles", "2 as label", "'x' as rep"))
    assert rows_of(got) == brute(rows)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True)]


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}


def test_a_cell_gives_fewer_links_than_components():
    """Sixty sets that are all alike and in components of their own: 59 links, whatever the pairs."""
    import pandas as pd

    from siftwork.llm.neardup import _linked

    n = 60
    pdf = pd.DataFrame({"rep": range(n), "label": range(n), "asks": True, "asked": True, "set": [list(range(100)) + [1000 + i] for i in range(n)]})
    got = _linked(pdf, 85)
    assert len(got) == n - 1 and (got["a"] < got["b"]).all()
    root = list(range(n))
    for a, b in got.itertuples(index=False):
        root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root)) == 1
    pdf["set"] = [[i, i + n] for i in range(n)]
    assert _linked(pdf, 85).empty
    pdf["label"] = 5
    pdf["set"] = [list(range(100))] * n
    assert _linked(pdf, 85).empty
