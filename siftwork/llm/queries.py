"""The registered query of each operator, over its whole table, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.session import ship, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.mixing import document_mix

    return document_mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op10_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.tokencount import length_histogram, token_counts

    return length_histogram(token_counts(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.merkle import verified_manifest

    return verified_manifest(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from siftwork.llm.linededup import drop_repeated_lines

    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 without labelled rows: what the rules alone say of every page."""
    from siftwork.llm.urls import judge

    none = spark.createDataFrame([], "url string, label int")
    return judge(table(spark, sf_dir, "pages"), labelled=none).drop("score")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3's default targets: flattened token shares of source and language."""
    from pyspark.sql import functions as F

    from siftwork.llm.mixing import tempered, words

    cells = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(words(F.col("text"))).alias("tokens"))
    found = tempered(cells, ["source", "lang"], 0.5)
    one = lambda m: found[m].select(F.lit(m).alias("margin"), "value", F.round("share", 9).alias("share"))
    return one("source").union(one("lang"))


def length_histogram_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's histogram over word counts, which SQL can state."""
    from pyspark.sql import functions as F

    from siftwork.llm.mixing import words
    from siftwork.llm.tokencount import length_histogram

    return length_histogram(table(spark, sf_dir, "documents").select(words(F.col("text")).alias("n_tokens")))


_SPACE = "[^\\x20\\x09-\\x0D]+"
_FITS = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')"
_BY_LENGTH = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]
_RULE = " ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)
_VERDICT = " ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)

#: CRC-32, bit by bit: 8 steps for every byte of a decimal id.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b:
list_reduce(list_concat([xor(s, b)], range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"""
_PART = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Levels of a tree: node i of a level is the hash of nodes 8 i to 8 i + 7 of the one below.
_UP = "SELECT {0}level + 1 AS level, i // 8 AS i, max((m + 7) // 8) AS m, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {1} WHERE m > 1 GROUP BY {0}level, i // 8"
#: One step of a proof: the other nodes of the run, left to right, and where among them the path goes.
_OTHERS = "coalesce((SELECT string_agg(h, '' ORDER BY i) FROM {1} o WHERE {0}o.level = p.level AND o.i // 8 = p.i // 8 AND o.i < p.i), '') AS a, coalesce((SELECT string_agg(h, '' ORDER BY i) FROM {1} o WHERE {0}o.level = p.level AND o.i // 8 = p.i // 8 AND o.i > p.i), '') AS b"
_LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op11_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({_HEAD} || {_PART.format("text")}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_PART.format(_LOWERED)}) END AS changed FROM documents),
l AS (SELECT *, coalesce('=' || lang, '') AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM d),
n AS (SELECT t, 0 AS level, i, m, leaf AS h FROM l UNION ALL (SELECT t, {_UP.format("", "n").removeprefix("SELECT ").replace("GROUP BY level", "GROUP BY t, level")})),
s AS (SELECT t, h AS subroot, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS m FROM n WHERE m = 1),
u AS (SELECT 0 AS level, i, m, subroot AS h FROM s UNION ALL ({_UP.format("", "u")})),
v AS (SELECT level, t, i, m, {_OTHERS.format("o.t = p.t AND ", "n")} FROM n p WHERE m > 1),
w AS (SELECT level, i, m, {_OTHERS.format("", "u")} FROM u p WHERE m > 1),
x AS (SELECT doc_id, leaf, t, 0 AS level, i, coalesce(changed, leaf) AS h, '' AS proof FROM l UNION ALL (SELECT doc_id, leaf, x.t, x.level + 1, x.i // 8, sha256(a || h || b), proof || a || b FROM x JOIN v ON v.t = x.t AND v.level = x.level AND v.i = x.i)),
y AS (SELECT x.*, subroot, s.i AS j FROM x JOIN (SELECT t, max(level) AS level FROM n GROUP BY t) e USING (t, level) JOIN s USING (t)),
z AS (SELECT doc_id, leaf, subroot, 0 AS level, j AS i, h, proof FROM y UNION ALL (SELECT doc_id, leaf, subroot, z.level + 1, z.i // 8, sha256(a || h || b), proof || a || b FROM z JOIN w ON w.level = z.level AND w.i = z.i))
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE m = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM u WHERE m = 1) AS verified FROM z WHERE level = (SELECT max(level) FROM u)""",
    "op13_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LINE_KEY} AS key FROM l), f AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "url_rules": f"""WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p) SELECT page_id, host, path, CASE {_RULE} END AS rule, CASE {_VERDICT} ELSE 'allow' END AS verdict FROM h""",
    "mixing_targets": f"""WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS n FROM documents), s AS (SELECT 'source' AS margin, source AS value, sqrt(sum(n)) AS p FROM d GROUP BY source HAVING sum(n) > 0 UNION ALL SELECT 'lang', lang, sqrt(sum(n)) FROM d GROUP BY lang HAVING sum(n) > 0)
SELECT margin, value, round(p / sum(p) OVER (PARTITION BY margin), 9) AS share FROM s""",
    "length_histogram_of_words": f"""WITH l AS (SELECT len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS length FROM documents), h AS (SELECT length, count(*) AS n_docs, count(*) * length AS n_tokens FROM l GROUP BY 1),
s AS (SELECT *, sum(n_docs) OVER (ORDER BY length DESC) AS docs_from, sum(n_tokens) OVER (ORDER BY length DESC) AS tokens_from, sum(n_docs) OVER () AS d, sum(n_tokens) OVER () AS t FROM h)
SELECT length, n_docs, n_tokens, docs_from, tokens_from, t - tokens_from + length * docs_from AS truncated_total, (d - docs_from + n_docs) / CAST(d AS DOUBLE) AS share_up_to FROM s""",
}


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    more = {k: globals()[k] for k in SQL if k not in found}

    def shipped(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        query.__name__ = f.__name__
        return query

    ops = sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))
    return {k: shipped(f) for k, f in [*ops, *more.items()]}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
