import random

import corpus_pipeline
from siftwork.llm.langid import identify
from siftwork.llm.mixing import document_mix
from siftwork.llm.pii import find_pii


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    tongues = {"en": ["the", "of", "and", "tion", "her", "ing"], "fr": ["le", "que", "aux", "eau", "ment", "oi"]}
    say = lambda lang, n: " ".join("".join(rng.choices(tongues[lang], k=rng.choice([1, 2, 3]))) for _ in range(n))
    item = say("en", 40)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "en", "fr"])
        rows.append([i, say(lang, rng.choice([30, 80])), lang, f"s{i % 3}"])
    for i in range(20):
        rows.append([200 + i, rows[i][1] + (" x" if i % 2 else ""), rows[i][2], "s0"])
    rows[5][1] = say("en", 30) + " " + item + " " + say("en", 20)
    rows[7][1] += " mail me@site.example.org"
    rows += [[300, "12 34 -- 56", "en", "s1"], [301, "", "en", "s1"], [302, None, None, None], [None, say("en", 60), "en", "s2"], [400, say("en", 60), "en", "s2"], [400, say("fr", 60), "fr", "s2"]]
    rows += [list(rows[60])]  # a row that repeats
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rest, steps, sizes = docs, [], []
    for _, stage in corpus_pipeline.STAGES:
        rest = stage(spark, rest, str(tmp_path)).cache()
        assert rest.columns == docs.columns
        steps.append({(r.doc_id, r.text) if r.doc_id in (None, 400) else r.doc_id: r.text for r in rest.collect()})
        sizes.append(rest.count())
    special = {(r[0], r[1]) for r in rows if r[0] in (None, 400)}
    everything = {r[0] for r in rows} - {None, 400} | special
    assert set(steps[0]) == everything - {300, 301, 302} - {r.doc_id for r in identify(docs).where("lang_pred = 'und' or bits_per_byte > 6").collect()}
    copies = {200 + i for i in range(20)}  # of the two altered sources, the copies differ by now
    assert set(steps[1]) == set(steps[0]) - copies | {205, 207} & set(steps[1])
    assert special <= set(steps[1]) and sizes[1] == len(steps[1])
    assert set(steps[2]) == set(steps[1]) - {5}
    assert len(steps[3]) == len(steps[2]) and steps[3][7].endswith("mail <EMAIL>")
    assert sum(a != steps[2][k] for k, a in steps[3].items() if k in steps[2]) == find_pii(spark.createDataFrame([(0, t) for k, t in steps[2].items() if k in steps[3]], "doc_id long, text string")).where("spans <> ''").count()
    assert 0 < len(steps[4]) < len(steps[3]) and all(steps[3][k] == t for k, t in steps[4].items())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.text) if r.doc_id in (None, 400) else r.doc_id: r.text for r in again.collect()} == steps[4]
    assert document_mix(docs).count() == len(rows)
