"""Phrases of a dictionary in texts and queries: names, shorthand and words that cover a name.

A dictionary is a table (phrase, id). In texts, all its phrases are looked for in
one pass: an automaton over normalised words, built once in each worker, as long
as the dictionary has at most MOST phrases; a larger one is joined with the runs
of words of the lengths that occur in it. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.session import ship

#: Phrases that are sent to every worker (some tens of bytes each).
MOST = 200_000
# Words that say nothing in a name, single words that are too common to be one, and shorthand for tactics.
STOP = "a an and the of or to for in on with by from via at as is are be using use used over into through".split()
GENERIC = (
    "services service software modify proxy screen exfiltration impact discovery execution "
    "collection persistence resources accounts malware tools domains server botnet code"
).split()
TACTIC_SHORT = {
    "c2": "Command and Control",
    "command & control": "Command and Control",
    "privesc": "Privilege Escalation",
    "lateral": "Lateral Movement",
    "recon": "Reconnaissance",
    "exfil": "Exfiltration",
    "defense evasion": "Defense Evasion",
}


def normal(c: Column) -> Column:
    """Lower case; letters, digits, points and apostrophes stay, all else parts words."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[‘’`´]", "'")
    c = F.regexp_replace(c, r"[^a-z0-9.'/ -]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[-/]", " "), r"\s+", " "))


def bounded(c: Column) -> Column:
    """Words of letters, digits, _ and -, in their own case: what a name in a text is bounded by."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_-]+", " "))


def stems(c: Column) -> Column:
    """Distinct stems of the words of a phrase that say something."""
    words = F.filter(F.split(normal(c), " "), lambda w: (w != "") & ~w.isin(STOP))
    return F.array_distinct(F.transform(words, T.stem))


# ---- In texts ---------------------------------------------------------------


def _scan(batches: Iterator[pa.RecordBatch], sent, key: str) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    trie = ahocorasick.Automaton()
    for phrase in sent.value:
        trie.add_word(f" {phrase} ", phrase)
    trie.make_automaton()
    for batch in batches:
        at, phrases, counts, firsts = [], [], [], []
        for i, text in enumerate(batch.column("words").to_pylist()):
            padded, seen = f" {text} ", {}
            for end, phrase in trie.iter(padded):
                seen.setdefault(phrase, []).append(end - len(phrase))
            if seen:
                gaps = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 0x20)
                for phrase, places in seen.items():
                    at.append(i)
                    phrases.append(phrase)
                    counts.append(len(places))
                    firsts.append(int(np.searchsorted(gaps, min(places))) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(phrases, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], [key, "phrase", "n", "first"])


def by_automaton(rows: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast([r.phrase for r in dictionary.select("phrase").distinct().collect()])  # MOST at most
    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(lambda it: _scan(it, sent, key), f"{key} {kind}, phrase string, n bigint, first bigint")


def by_join(rows: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    phrases = dictionary.select("phrase").distinct()
    sizes = [r[0] for r in phrases.select(F.size(F.split("phrase", " ")).alias("k")).distinct().collect()]  # lengths in words
    each = None
    for k in sizes:
        words = F.split("words", " ")
        run = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))  # noqa: B023
        part = rows.where(F.size(words) >= k).select(key, F.posexplode(run).alias("at", "phrase"))
        each = part if each is None else each.unionByName(part)
    if each is None:
        return rows.select(key, F.lit("").alias("phrase"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("first")).limit(0)
    return each.join(phrases, "phrase").groupBy(key, "phrase").agg(F.count("*").alias("n"), F.min("at").cast("bigint").alias("first"))


def find(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, form: Callable[[Column], Column] = normal) -> DataFrame:
    """(key, id, phrase, n, first): how often each phrase of dictionary (phrase, id)
    occurs in a text, in whole words and overlapping others, and the number of the
    word (from 0) that it first begins with. Rows without text have none. Keys
    are distinct. form: what texts and phrases are compared by."""
    said = dictionary.select(form(F.col("phrase")).alias("phrase"), "id").where("phrase <> ''").distinct()
    rows = docs.select(key, form(F.col(text)).alias("words")).where("words <> ''")
    few = said.select("phrase").distinct().limit(most + 1).count() <= most
    hits = (by_automaton if few else by_join)(rows, said, key)
    return hits.join(said, "phrase").select(key, "id", "phrase", "n", "first")


# ---- Names of techniques ----------------------------------------------------


def technique_phrases(techniques: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(phrase, id, via): what names a technique outright. techniques: (id, name), a
    sub-technique's name after ": " counts too; of several ids the shortest, then the
    first. Short or common single words name none. synonyms: (phrase, id); those of
    unknown ids are left out, and they come before names."""
    name = techniques.select("id", F.col("name").alias("phrase")).unionByName(techniques.where(F.col("name").contains(": ")).select("id", F.regexp_replace("name", r"^[\s\S]*?: ", "").alias("phrase")))
    exact = name.select(normal(F.col("phrase")).alias("phrase"), "id").where("phrase <> ''")
    single = ~F.col("phrase").contains(" ")
    exact = exact.where(~(single & (F.col("phrase").isin(GENERIC) | (F.length("phrase") < 5))))
    exact = exact.groupBy("phrase").agg(F.min_by("id", F.struct(F.length("id"), "id")).alias("id"))
    short = synonyms.select(normal(F.col("phrase")).alias("phrase"), "id").where("phrase <> ''").join(techniques.select("id").distinct(), "id", "left_semi").groupBy("phrase").agg(F.min("id").alias("id"))
    return short.select("phrase", "id", F.lit("synonym").alias("via")).unionByName(exact.join(short, "phrase", "left_anti").select("phrase", "id", F.lit("name").alias("via")))


def match_phrases(phrases: DataFrame, techniques: DataFrame, synonyms: DataFrame, cover: bool = True) -> DataFrame:
    """(phrase, id, via) of each of phrases (phrase): a synonym, else a name, else
    the techniques whose names hold all its stems: of three at most, those of the
    fewest stems, two at most. Phrases of one word are not covered."""
    asked = phrases.select("phrase").distinct().withColumn("key", normal(F.col("phrase"))).where("key <> ''")
    known = technique_phrases(techniques, synonyms)
    outright = asked.join(known.withColumnRenamed("phrase", "key"), "key").select("phrase", "id", "via")
    if not cover:
        return outright
    # A known name that is too common to count is no phrase to be covered either.
    names = techniques.select(normal(F.col("name")).alias("key")).unionByName(techniques.select(normal(F.regexp_replace("name", r"^[\s\S]*?: ", "")).alias("key"))).distinct()
    left = asked.join(outright.select("phrase").distinct(), "phrase", "left_anti").join(names, "key", "left_anti").where(F.col("key").contains(" "))
    words = left.select("phrase", stems(F.col("key")).alias("s")).where(F.size("s") >= 2).select("phrase", F.size("s").alias("k"), F.explode("s").alias("stem"))
    theirs = techniques.select("id", stems(F.col("name")).alias("s")).select("id", F.size("s").alias("of"), F.explode("s").alias("stem"))
    hits = words.join(theirs, "stem").groupBy("phrase", "k", "id", "of").agg(F.count("*").alias("met")).where("met = k")
    w = W.partitionBy("phrase")
    best = hits.withColumn("hits", F.count("*").over(w)).withColumn("least", F.min("of").over(w)).where("hits <= 3 and of = least")
    best = best.withColumn("r", F.row_number().over(w.orderBy("id"))).where("r <= 2")
    return outright.unionByName(best.select("phrase", "id", F.lit("token-cover").alias("via")))


def related(ids: DataFrame, techniques: DataFrame) -> DataFrame:
    """(id, other): a sub-technique's parent, and a technique's sub-techniques, as far
    as techniques (id) has them."""
    asked = ids.select(F.upper("id").alias("id")).distinct()
    known = techniques.select(F.col("id").alias("other")).distinct()
    parent = F.substring_index("other", ".", 1)
    up = asked.where(F.col("id").contains(".")).withColumn("other", F.substring_index("id", ".", 1)).join(known, "other")
    down = known.where(F.col("other").contains(".")).select("other", parent.alias("id")).join(asked, "id")
    return up.select("id", "other").unionByName(down.select("id", "other"))


def match_tactics(phrases: DataFrame, tactics: list[str]) -> DataFrame:
    """(phrase, tactic) of phrases that name a tactic, in full or by its shorthand."""
    spark = phrases.sparkSession
    known = spark.createDataFrame([*((t, t) for t in tactics), *TACTIC_SHORT.items()], "said string, tactic string").select(normal(F.col("said")).alias("key"), "tactic")
    known = known.groupBy("key").agg(F.max("tactic").alias("tactic"))
    return phrases.select("phrase").distinct().join(F.broadcast(known), normal(F.col("phrase")) == F.col("key")).select("phrase", "tactic")  # a row a tactic


def resolve_words(spark: SparkSession, words: list[str], techniques: DataFrame, synonyms: DataFrame, most: int = 6) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(phrase, id, via) of the techniques that a query's words name, and the words
    left over. Left to right; at each word the longest phrase that names one is taken."""
    n = len(words)
    runs = {(i, k): " ".join(words[i : i + k]) for i in range(n) for k in range(1, min(most, n - i) + 1)}
    if not runs:
        return [], []
    found: dict[str, list[tuple[str, str]]] = {}
    asked = spark.createDataFrame([(r,) for r in runs.values()], "phrase string")
    for r in match_phrases(asked, techniques, synonyms).orderBy("phrase", "id").collect():  # a query's runs
        found.setdefault(r.phrase, []).append((r.id, r.via))
    out, left, i = [], [], 0
    while i < n:
        k = next((k for k in range(min(most, n - i), 0, -1) if runs[i, k] in found), 0)
        if k:
            out += [(runs[i, k], *hit) for hit in found[runs[i, k]]]
        else:
            left.append(words[i])
        i += max(k, 1)
    return out, left
