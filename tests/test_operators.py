"""Small tables with known answers for operators without an SQL twin."""

import datetime as dt
import random

from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import actors, dedup, evidence, extract, quality, search, state
from siftwork.operators import graph as g
from siftwork.operators import relational as rel
from siftwork.sources import feeds, structured


def test_tokens_and_query_language(spark):
    text = "Cobalt-Strike used T1059.001 and CVE-2024-12345 on 10.0.0.1, a x 7 v2.1 the"
    row = spark.createDataFrame([(text,)], "t string").select(tx.tokens(F.col("t")).alias("x")).first()
    assert row.x == search.tokenize(text) == ["cobalt-strike", "cobalt", "strike", "used", "t1059.001", "t1059", "cve-2024-12345", "10.0.0.1", "7", "v2.1", "v2"]
    q = search.interpret('lang:en,fr -source:src3 "of the" -bad foo:bar since:2024-02 until:2024-02 since:x "open')
    assert q.filters == {"lang": [("en", False), ("fr", False)], "source": [("src3", True)]}
    assert (q.since, q.until, q.phrases, q.excluded) == ("2024-02-01", "2024-02-29", ["of the", "open"], ["bad"])
    assert len(q.warnings) == 2 and "foo" in q.terms and search.interpret("lang:en").filter_only


def test_passages_are_exact(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "é. ", "\n", "longerword"]) for _ in range(900))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = search.passages(df, size=300, overlap=60).orderBy("start").collect()
    assert all(text[r.start : r.end] == r.passage for r in rows) and rows[-1].end == len(text)
    assert all(a.end >= b.start > a.start for a, b in zip(rows, rows[1:]))
    assert search.select_passages(search.passages(df), ["word"]).count() >= 1


def test_collapse_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, base, 3.0), (2, base + " x", 2.0), (3, "other " * 20, 1.0), (4, base, 0.5)], "doc_id long, text string, score double")
    df = df.withColumn("same", F.md5("text")).withColumn("sh", tx.word_shingles(F.col("text")))
    assert {r.doc_id for r in search.collapse(df, "doc_id", "score", "same", "sh").collect()} == {1, 3}


def test_simhash_pairs_and_cascade(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    near = base[:300] + ["changed"] + base[301:]
    far = [rng.choice(words) for _ in range(600)]
    rows = [(i, " ".join(w), "A fine title of a report", "src") for i, w in enumerate([base, near, far, base])]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, source string")
    prints = dedup.fingerprints(df, "doc_id", "text", F.col("title"), F.col("source")).cache()
    h = {r.doc_id: r for r in prints.collect()}
    apart = lambda a, b: bin((h[a].simhash ^ h[b].simhash) & (2**64 - 1)).count("1")
    assert apart(0, 1) <= 6 < 10 < apart(0, 2) and h[0].text_sha == h[3].text_sha
    want = {(a, b) for a in (0, 1, 2) for b in (0, 1, 2) if a < b and apart(a, b) <= 3}
    assert {(r.a, r.b) for r in dedup.near_pairs(prints, "doc_id").collect()} == want
    dated = prints.withColumn("day", F.lit(dt.date(2024, 1, 1)))
    got = {r.doc_id: (r.match, r.how) for r in dedup.match_new(dated.where("doc_id in (1, 3)"), dated.where("doc_id in (0, 2)"), "doc_id").collect()}
    assert got[3] == (0, "content") and got[1][1] in ("title", "simhash")


def test_simhash_links_reach_every_copy(spark):
    # 0, 7 and 9 are equal, 3 differs in one bit and has a copy 4, 5 is far, 6 is too short to tell.
    rows = [(7, 0b1111, 100), (0, 0b1111, 100), (9, 0b1111, 90), (3, 0b0111, 100), (4, 0b0111, 100), (5, -1, 100), (6, 0b1111, 10), (9, 0b1111, 90)]
    prints = spark.createDataFrame(rows, "doc_id long, simhash long, tokens int")
    got = [tuple(r) for r in dedup.near_links(prints, "doc_id").collect()]
    assert sorted(got) == [(0, 3, 1), (0, 7, 0), (0, 9, 0), (3, 4, 0)]
    root = {b: a for a, b, d in got if d == 0}
    linked = {(a, b) for a, b, d in got if d}
    full = {k: h for k, h, n in rows if n >= 80}
    for a in full:
        for b in full:
            if a != b:
                ra, rb = sorted((root.get(a, a), root.get(b, b)))
                assert (bin((full[a] ^ full[b]) & (2**64 - 1)).count("1") <= 3) == (ra == rb or (ra, rb) in linked)


def test_whole_texts_and_every_document(spark, tmp_path):
    import re

    from siftwork.plans import catalog

    tail = " malware threat payload beacon then powershell -enc AAAABBBB CVE-2024-1111 T1059 kill chain"
    texts = ["plain " * 1300 + tail, "short text", "Event ID 4688 and HKLM\\Software\\Run was set, stage 2", "attack " + "word " * 600 + "phishing", "", "long " * 500 + "hxxp://a[.]b (at) end"]
    rows = [(i, x, len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "good") for i in range(6)], "doc_id long, quality string").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: {r[0]: r for r in catalog.queries()[name](spark, str(tmp_path)).collect()}

    def score(text):
        low, n = text.lower(), len(text.split())
        has = lambda p, where=text, flags=re.I: re.search(p, where, flags) is not None
        commands, registry, cve = has(r"(?:powershell|reg)\b[^\r\n]{5,100}"), has(r"\bHKLM\\[a-z0-9_\\]{4,80}\b"), has(r"CVE-\d{4}-\d+")
        hits = sum(w in low for w in quality.SIGNAL_WORDS)
        out = 0.22 + (0.28 if n >= 2500 else 0.2 if n >= 1200 else 0.1 if n >= 500 else 0.16 if commands or registry or cve else -0.12)
        out += 0.28 if hits >= 8 else 0.18 if hits >= 4 else 0.08 if hits >= 2 else -0.1
        out += 0.22 * commands + 0.12 * registry + 0.12 * has(r"\bEvent\s*ID\s*4688\b") + 0.18 * has(r"\bstage\s*[123]|kill chain", low) + 0.12 * has(r"\bT1\d{3}\b", text, 0) + 0.1 * cve
        return round(max(0.0, min(1.0, out)), 2)

    got = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", quality.word_count(F.col("text")).alias("n"), quality.quality_score(F.col("text"), F.lit("")).alias("score")).collect()}
    assert {i: (r.n, r.score) for i, r in got.items()} == {i: (len(x.split()), score(x)) for i, x in enumerate(texts)}
    assert len({r.score for r in got.values()}) > 3
    words = [set(re.findall("[a-z0-9]+", x.lower())) for x in texts]
    assert run("quality_by_vocabulary")["good"][1:] == (sum(bool(w) for w in words), sum(map(len, words)))
    cut = [(set(re.findall("[a-z0-9]+", x[: max(len(x) - 39, 0)].lower())), set(re.findall("[a-z0-9]+", x[39:].lower()))) for x in texts]
    assert {i: r[1:] for i, r in run("token_difference").items()} == {i: (len(a - b), len(b - a)) for i, (a, b) in enumerate(cut)}
    assert run("refanged")[5].text.endswith("http://a.b.@.end@x.y")  # blanks were bent to [.]


def test_short_quotes_are_grounded(spark, tmp_path):
    from siftwork.plans import catalog

    texts = ["one two three four five, then six", "so one two\nthree four", "xone twoy", "", "one two three four five six seven eight"]
    quotes = ["one two three four five", "one two three four", "two three four", "one two", "one", "two three four five six seven", "absent", "one two\nthree four"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["quotes_grounded"](spark, str(tmp_path)).collect())
    assert got == sorted((i, j) for i, q in enumerate(quotes) for j, x in enumerate(texts) if q in x)


def test_paths_and_views(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")], "source string, target string")
    e = e.select("source", F.lit("p").alias("predicate"), "target", F.lit(0.5).alias("confidence"), F.lit(2).alias("weight"), F.lit(0).alias("stated"), F.lit(None).cast("date").alias("last_seen"))
    rows = g.paths(e, "a", "d").collect()
    assert [(r.hops, r.path) for r in rows] == [(2, ["a", "x", "d"])]
    assert g.paths(e, "a", "zz").count() == 0
    assert {r.peer for r in g.related_through(e, "a").collect()} == {"c", "d"}


def test_state_rules(spark):
    df = spark.createDataFrame([(0,), (3,), (5,), (40,)], "n int").select(state.backoff_hours(F.col("n")).alias("h"))
    assert [r.h for r in df.collect()] == [0.0, 2.0, 8.0, 168.0]
    rows = spark.createDataFrame([(1, "acquired", None), (2, "rejected", "mirror"), (3, "acquired", None)], "id int, status string, previous_status string")
    got = {r.id: (r.status, r.previous_status) for r in state.hide(rows, F.col("id") == 1).collect()}
    assert got == {1: ("rejected", "acquired"), 2: ("mirror", None), 3: ("acquired", None)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B")], "k int, v string")
    assert {(r.k, r.v) for r in state.upsert_and_prune(old, new, ["k"]).collect()} == {(1, "a"), (2, "B")}
    assert {(r.k, r.v) for r in state.upsert_and_prune(old, new, ["k"], True, F.col("k") > 1).collect()} == {(1, "a"), (2, "B")}


def test_relational_shapes(spark):
    df = spark.createDataFrame([(["T1.001", "T2", "T3"], ["T1", "T2"])], "a array<string>, b array<string>")
    assert df.select(rel.parent_aware_difference(F.col("a"), F.col("b")).alias("x")).first().x == ["T3"]
    names = spark.createDataFrame([([" Fox ", "fox", "", "n/a", "Bear"],)], "a array<string>")
    assert names.select(rel.distinct_spellings(F.col("a")).alias("x")).first().x == ["Fox", "Bear"]
    left = spark.createDataFrame([("T1.001",), ("T1",), ("T10",)], "id string")
    assert {r.id for r in rel.by_prefix(left, "id", spark.createDataFrame([("T1",)], "p string"), "p").collect()} == {"T1.001", "T1"}


def test_urls_and_pages(spark):
    assert extract.canonical_url("HTTPS://m.Site.example.com:443//a//index.html?utm_source=x&b=2&a=1#top") == "https://site.example.com/a?a=1&b=2"
    assert extract.canonical_url("https://x.cdn.ampproject.org/c/s/site.example.com/p/amp") == "https://site.example.com/p"
    assert extract.canonical_url("mailto:a@b.c") is None and extract.canonical_url(None) is None
    html = "<html><head><title>T</title><meta name='author' content='A B'></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; two</p><script>x()</script><a href='http://o.example.net/q'>go</a></article></body></html>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = {r.page_id: r for r in extract.pages_to_text(df).collect()}
    assert (rows[1].title, rows[1].text, rows[1].author) == ("Head", "Head\nOne & two\ngo", "A B") and rows[2].text == ""
    links = extract.outlinks(extract.pages_to_text(df).withColumn("base", F.lit("http://s.example.org/")), "page_id", "base").collect()
    assert [(r.url, r.label) for r in links] == [("http://o.example.net/q", "go")]


def test_indicators_sentences_evidence(spark):
    text = "We saw T1059.001 used, e.g. by hxxps://bad[.]example[.]com/x. Beacon to 8[.]8[.]8[.]8 and 10.0.0.1.\nYou should block CVE-2024-12345. T1059.001 was executed again."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {(r.kind, r.value) for r in extract.harvest(df).collect()}
    assert found == {("technique", "T1059.001"), ("url", "https://bad.example.com/x"), ("ipv4", "8.8.8.8"), ("cve", "CVE-2024-12345")}
    s = extract.split_sentences(df).withColumn("label", evidence.sentence_label(F.col("sentence")))
    rows = s.orderBy("n").collect()
    assert all(text[r.start : r.end] == r.sentence for r in rows)
    assert [r.label for r in rows] == ["observed", "observed", "defensive", "observed"]
    ev = extract.technique_evidence(s).first()
    assert (ev.technique, ev.label, ev.mentions, ev.confidence) == ("T1059.001", "observed", 2, 0.88)
    names = spark.createDataFrame([("g1", "Saw"), ("g2", "bad example")], "id string, alias string")
    assert extract.name_mentions(df, names).count() == 0
    said = spark.createDataFrame([(1, "Fancy Bear, and the Bear again. fancy bear; bears (Bear)")], "doc_id long, text string")
    two = spark.createDataFrame([("a", "Fancy Bear"), ("b", "Bear"), ("c", "Fancy")], "id string, alias string")
    assert sorted(tuple(r) for r in extract.name_mentions(said, two).collect()) == [(1, "a", "Fancy Bear", 2), (1, "b", "Bear", 2)]
    day = extract.publication_day([("meta", F.lit("2099-01-01")), ("text", F.lit("Mon, 02 Jan 2023 10:00:00 GMT"))], "2024-01-01")
    assert spark.range(1).select(day.alias("d")).first().d.day == dt.date(2023, 1, 2)


def test_actor_names(spark):
    m = spark.createDataFrame([("Fancy Fox Group",), ("Nobody",)], "name string")
    a = spark.createDataFrame([("fancy fox", "G1", "group"), ("fancy fox", "S1", "software")], "alias string, id string, kind string")
    assert {r.name: r.id for r in actors.resolve_names(m, a).collect()} == {"Fancy Fox Group": "G1", "Nobody": "name:nobody"}


def test_gate_and_types(spark):
    row = spark.range(1).select(
        quality.quality_score(F.lit("powershell -enc AAAA " + "threat malware " * 300 + "CVE-2024-1111 T1059"), F.lit("x")).alias("q"),
        quality.severity(F.lit(False), F.lit(True), F.lit(False), F.lit(0), F.lit(0.1), F.lit(5), F.lit(1)).alias("s"),
        quality.review_action(F.lit("bad"), F.lit(False), F.lit(0.9), F.lit(None).cast("string"), F.lit(True), F.lit(False)).alias("r"),
    ).first()
    assert (row.q, row.s, row.r) == (0.66, "high", "hide")
    v = spark.createDataFrame([(1, "A", 3.0, "x"), (1, "B", 1.0, "y"), (1, "B", 1.5, "z")], "k int, type string, weight double, reason string")
    assert [(r.type, r.score, r.reason) for r in quality.type_votes(v, "k").orderBy("type").collect()] == [("A", 3.0, "x"), ("B", 2.5, "z")]


def test_feeds_sitemaps_robots(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x.example.com/1</link></item><item><link>ftp://no</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="alternate" href="https://x.example.com/2"/></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom), ("b", "<broken"), ("n", None)], "key string, xml string")
    assert {(r.key, r.url, r.title) for r in feeds.read_feeds(df, "key", "xml").collect()} == {("r", "http://x.example.com/1", "A & B"), ("a", "https://x.example.com/2", "T")}
    sm = "<urlset><url><loc>u1</loc><lastmod>2024-01-05</lastmod></url><url><loc>u1</loc></url><url><loc>u2</loc></url></urlset>"
    e = feeds.read_sitemaps(spark.createDataFrame([("s", sm)], "key string, xml string"), "key", "xml")
    assert {r.loc for r in feeds.sitemap_window(e, "2024-01-05", "2024-01-06").collect()} == {"u1"}
    assert feeds.sitemap_window(e, None, "2024-01-05", True).count() == 1
    rules = feeds.read_robots(spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nAllow: /a/b$\nDisallow: /*.php")], "host string, t string"), "host", "t")
    urls = spark.createDataFrame([("h", p) for p in ("/a/x", "/a/b", "/a/bc", "/z.php", "/ok")], "host string, p string")
    assert {r.p: r.allowed for r in feeds.robots_allowed(urls, rules.withColumnRenamed("path", "path"), "host", "p").collect()} == {"/a/x": False, "/a/b": True, "/a/bc": False, "/z.php": False, "/ok": True}


def test_structured_sources(spark, tmp_path):
    import json

    ref = lambda x: [{"source_name": "mitre-attack", "external_id": x}]
    objects = [
        {"type": "attack-pattern", "id": "t1", "name": "Parent", "external_references": ref("T1")},
        {"type": "attack-pattern", "id": "t2", "name": "Child", "external_references": ref("T1.001")},
        {"type": "attack-pattern", "id": "t3", "name": "Gone", "external_references": ref("T9"), "revoked": True},
        {"type": "malware", "id": "m1", "name": "M", "external_references": ref("S1")},
        {"type": "intrusion-set", "id": "g1", "name": "G", "aliases": ["G", "Alt"], "external_references": ref("G1")},
        {"type": "campaign", "id": "c1", "name": "C", "external_references": ref("C1")},
        {"type": "relationship", "id": "r1", "relationship_type": "uses", "source_ref": "g1", "target_ref": "t2"},
        {"type": "relationship", "id": "r2", "relationship_type": "attributed-to", "source_ref": "c1", "target_ref": "g1"},
        {"type": "relationship", "id": "r3", "relationship_type": "uses", "source_ref": "c1", "target_ref": "m1"},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"objects": objects}))
    o = structured.read_stix(spark, str(tmp_path / "b.json"))
    assert {(r.id, r.name) for r in structured.stix_techniques(o).collect()} == {("T1", "Parent"), ("T1.001", "Parent: Child")}
    a = structured.stix_actors(o).first()
    assert (a.id, a.aliases, a.techniques, a.software) == ("G1", ["Alt"], ["T1.001"], ["S1"])
    kev = [{"cveID": "cve-2024-1111", "knownRansomwareCampaignUse": "Known"}, {"cveID": "CVE-2024-1111"}, {"cveID": "bad"}]
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": kev}))
    k = structured.read_kev(spark, str(tmp_path / "k.json"))
    assert [(r.cveID, r.ransomware) for r in k.collect()] == [("CVE-2024-1111", True)]
    (tmp_path / "reports.jsonl").write_text('{"_id": {"$oid": "5f"}, "docType": "report"}\n{"_id": "x", "docType": "odd"}\n')
    b = structured.route(structured.read_backup(spark, str(tmp_path / "reports.jsonl")), {"report": "reports"})
    assert {(r.collection, r.id, r.route) for r in b.collect()} == {("reports", "5f", "reports"), ("reports", "x", "unclassified_documents")}


def test_rules(spark):
    from siftwork.operators import rules as ru

    row = spark.range(1).select(
        ru.detect_language(F.lit("the cat of the house is in that " * 10), F.lit(None).cast("string")).alias("en"),
        ru.detect_language(F.lit("der hund und das haus ist nicht mit " * 10), F.lit("en-US")).alias("de"),
        ru.detect_language(F.lit("zz"), F.lit("fr-FR")).alias("fr"),
        ru.in_scope(F.lit("https://a.b.example.com/x/y"), F.lit("other.net; *.example.com/x*")).alias("s1"),
        ru.in_scope(F.lit("https://a.example.com/z"), F.lit("example.com/x")).alias("s2"),
        ru.domain_trust(F.lit("www.agency.gov")).alias("t"),
        ru.technical_depth(F.lit(9), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(True)).alias("d"),
        ru.protected_tokens(F.lit("CVE-2024-1111 at evil[.]example[.]com, T1059.001")).alias("p"),
        ru.citations(F.lit("As said [S1, S9] and [S2]."), F.lit(3)).alias("c"),
        ru.redact_config(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("name"), F.lit("y"))).alias("m"),
        ru.next_window(F.lit(None).cast("date"), "2024-03-01").alias("w"),
        ru.gaps(F.lit(0), F.lit(3), F.lit(0), F.lit(10)).alias("g"),
        ru.relevance(F.lit("CVE-2024-1111 exploited"), F.lit("join our webinar"), F.lit("http://x/research/1"), ["exploit"], ["webinar"], F.lit(8), F.lit(10), F.lit(1), F.lit(False)).alias("r"),
    ).first()
    assert (row.en, row.de, row.fr, row.s1, row.s2, row.t, row.d) == ("en", "de", "fr", True, False, 0.98, 47)
    assert row.p == ["cve-2024-1111", "evil[.]example[.]com", "t1059.001"] and (row.c.known, row.c.unknown) == ([1, 2], [9])
    assert row.m == {"api_key": "***", "name": "y"} and str(row.w.since) == "2024-01-01" and row.g == ["no observed behaviour", "no detections"]
    assert 0.7 < row.r < 0.9
    steps = spark.createDataFrame([("T1", "missed", 2, 2), ("T2", "logged", 0, 1), ("T3", "detected", 2, 2)], "technique_id string, outcome string, priority int, risk int")
    before = steps.withColumn("outcome", F.lit("detected"))
    assert {(r.technique_id, r.severity, r.trend) for r in ru.findings(steps, before).collect()} == {("T1", "critical", "regressed"), ("T2", "low", "regressed")}


def test_results_indexes_flows(spark):
    import json

    from siftwork.sources import plans

    a = json.dumps({"results": [{"url": "http://x.example.com", "title": "T", "content": "c"}, {"url": "ftp://no"}]})
    b = json.dumps({"web": {"results": [{"url": "https://y.example.com", "title": "U", "description": "d"}]}})
    df = spark.createDataFrame([("a", a), ("b", b), ("c", "broken")], "k string, body string")
    got = {r.k: [tuple(x) for x in r.r] for r in df.select("k", plans.json_results(F.col("body")).alias("r")).collect()}
    assert got == {"a": [("http://x.example.com", "T", "c")], "b": [("https://y.example.com", "U", "d")], "c": []}
    html = '<a rel="x" class="result__a" href="//d/?uddg=https%3A%2F%2Fz.example.com%2Fp&r=1">A <b>bold</b> one</a>'
    one = spark.createDataFrame([(html,)], "h string").select(plans.html_results(F.col("h")).alias("r")).first().r
    assert [(x.url, x.title) for x in one] == [("https://z.example.com/p", "A bold one")]
    md = "| Name | Kind |\n|-|-|\n| [One](./one/) | full |\n| [Two](https://e.example.com) | x |\n| [One](one) | full |"
    rows = plans.readme_index(spark.createDataFrame([("r", md)], "k string, t string"), "k", "t").collect()
    assert [(r.name, r.folder, r.summary) for r in rows] == [("One", "one", "full")]
    flow = {"objects": [{"id": "action", "instance": "n1", "anchors": {"0": "a1"}}, {"id": "action2", "instance": "n2", "anchors": {"0": "a2"}}, {"instance": "a1", "latches": ["l1"]}, {"instance": "a2", "latches": ["l2"]}, {"template": "dynamic_line", "source": "l1", "target": "l2"}]}
    e = plans.flow_edges(spark.createDataFrame([("f", json.dumps(flow))], "k string, b string"), "k", "b").collect()
    assert [(r.source, r.target) for r in e] == [("action", "action2")]


def test_sentence_labels(spark):
    cases = [
        ("The attackers disabled Windows Defender before encryption.", None, "observed"),
        ("title: Suspicious service creation", None, "defensive"),
        ("| T1059.001 | PowerShell | used to run a loader", None, "observed"),
        ("T1003 - not observed in this intrusion", None, "negated"),
        ("There is no evidence that data left the network.", None, "negated"),
        ("T1027 is a technique that hides code.", None, "reference"),
        ("If an attacker gains access, the key is lost.", None, "hypothetical"),
        ("Organizations should patch the gateway.", None, "defensive"),
        ("Block outbound SMB.", None, "defensive"),
        ("APT29 then used a scheduled task.", None, "observed"),
        ("The group uses a loader to evade detection.", None, "observed"),
        ("This improves detection of loaders.", None, "defensive"),
        ("The loader could fetch a second stage.", None, "hypothetical"),
        ("A second stage was fetched.", None, "observed"),
        ("Rotate the keys of all hosts", "Report › Recommendations", "defensive"),
        ("Tools were renamed.", "Report › Defense Evasion", "observed"),
    ]
    df = spark.createDataFrame(cases, "s string, h string, want string")
    got = df.select("s", "want", evidence.sentence_label(F.col("s"), F.col("h")).alias("label"), evidence.is_mitigation(F.col("s"), F.lit("defensive"), F.col("h")).alias("m")).collect()
    assert [(r.s, r.label) for r in got] == [(r.s, r.want) for r in got]
    assert [r.s for r in got if r.m] == ["Organizations should patch the gateway.", "Rotate the keys of all hosts"]
    labelled = spark.createDataFrame([(1, "banks in France", "hypothetical"), (1, "a bank in France fell", "observed"), (1, "Spain was not hit", "negated"), (2, "block France", "defensive")], "doc_id long, sentence string, label string")
    names = spark.createDataFrame([("France",), ("Spain",)], "name string")
    assert {(r.doc_id, r.name, r.status) for r in evidence.targeting(labelled, names).collect()} == {(1, "France", "at_risk"), (1, "Spain", "mentioned"), (2, "France", "at_risk")}


def test_passages_are_read_once(spark):
    """Texts are cut, and their tokens found, once for all that the choice needs."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(i, "some word here. " * (i + 1)) for i in range(6)], "doc_id long, text string")
    pieces = docs.select("doc_id", F.lit(0).alias("start"), F.length("text").alias("end"), seen("text").alias("passage"))
    got = search.select_passages(pieces, ["word", "nothing"]).collect()
    assert got and all("word" in r.passage for r in got) and read.value == 6


def test_quality_patterns_run_only_behind_their_pieces(spark):
    """Each pattern is tried only where a text has a piece of it, and what it says is as the pattern alone says."""
    texts = [
        "reg add HKLM\\Software\\Run", "a region and a regent ran on", "REG: none at all", "NET\tUser add someone", "network of users here", "PSexec to every host", "hkcu\\abcd", "hkcu\\ab", "Event  ID4688", "events 4688", "Sysmon 10",
        "cve-2024-1", "CVE-24", "Stage3 came", "lateral movement and exfil", "lateral movement\nexfil", "a kill chain", "chains", "T1059", "t1059", "T10599", "Att&Ck", "BYOVD", "xlotcx", "lotc", None, "", "\u212arypt \u0130 amsi bypass",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    low = F.lower(F.coalesce("text", F.lit("")))
    both = df.select(*[F.struct(F.coalesce(quality._found(k, F.col("text"), low), F.lit(False)), F.coalesce(F.col("text").rlike(p), F.lit(False))).alias(k) for k, (p, _) in quality.EVIDENCE.items()]).collect()
    assert all(x[0] == x[1] for r in both for x in r) and all(any(r[k][0] for r in both) for k in quality.EVIDENCE)
    got = df.select("id", quality.assessed(F.col("text"), F.lit("")).alias("q"))
    assert [r.q.word_count for r in got.orderBy("id").collect()] == [len((x or "").split()) for x in texts]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("lower(") == 1 and plan.count("[^\\r\\n]{5,100}") == 1
