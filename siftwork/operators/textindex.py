"""A stored inverted index with weighted fields: added to batch by batch, read by query.

Layout under its path:

    segments/<name>/postings/bucket=<b>  term, impact, key, tf, len; by term, impact falling
    segments/<name>/terms/bucket=<b>     term, docs, top (the greatest impact)
    segments/<name>/docs                 key
    segments/<name>/facts                one row: documents and their lengths by field
    segments/<name>/gone                 keys of earlier segments that this one replaces
    versions/<n>                         the names of the segments of version n, in order

A batch is one new segment; nothing written earlier is touched. What a batch
replaces is listed in it, with its counts taken back, so numbers stay exact
without a rebuild. A version is written aside and renamed into place: readers
see the one before or the new one. compact() makes one segment of all.

A query reads the buckets of its terms, and of these the rows of its terms.
impact is the sum of weight * count over fields. Scores add impacts up, so the
greatest impacts of the other terms bound what a row can still reach: rows below
that bound are left in their files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators.versions import Versions
from siftwork.session import forget, pieces, stored

#: What a hit in a field counts; fixed values.
WEIGHTS = {"title": 10.0, "actors": 8.0, "malware": 8.0, "cves": 8.0, "techniques": 7.0, "summary": 6.0, "body": 2.0}
#: Buckets of terms; a query reads one a term.
BUCKETS = 64
#: Score of a document whose own list of identifiers holds one that was asked for; fixed value.
BY_ID = 1000.0


class TextIndex:
    """The index at path. fields: of each field, its weight; split: text to terms."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float], key: str = "doc_id", split: Callable[[Column], Column] = T.tokens, buckets: int = BUCKETS):
        self.spark, self.path, self.fields, self.key, self.split, self.buckets = spark, path.rstrip("/"), fields, key, split, buckets
        self.versions = Versions(spark, f"{self.path}/versions")

    # -- Files -----------------------------------------------------------------

    def version(self) -> int:
        """The newest version, 0 for an index without one."""
        return self.versions.newest()

    def segments(self) -> list[str]:
        v = self.version()
        return [r.name for r in self.versions.read(v).orderBy("at").collect()] if v else []  # a row a segment

    def _publish(self, names: list[str], after: int) -> None:
        self.versions.publish(self.spark.createDataFrame(list(enumerate(names)), "at int, name string"), after)

    def _read(self, name: str, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{name}/{what}")

    def _where(self, name: str, what: str) -> str:
        return f"{self.path}/segments/{name}/{what}"

    # -- Writing ---------------------------------------------------------------

    def _counted(self, docs: DataFrame, columns: dict[str, Column], parts: int) -> DataFrame:
        """(key, term, n0, n1, ...): a field's length and count of the term
        in one number each. Texts are dealt by key, so that a document's terms are counted
        where it is: a shuffle of the texts instead of their terms. Each document has one
        more row, without a term. Aggregates of plain numbers are hashed, not sorted."""
        of = [columns[f].cast("string") if f in columns else F.lit(None).cast("string") for f in self.fields]
        texts = docs.select(F.col(self.key).alias("key"), *[c.alias(f"f{i}") for i, c in enumerate(of)]).repartition(parts, "key")
        rows = texts.select("key", F.array(*[self.split(F.coalesce(f"f{i}", F.lit(""))) for i in range(len(of))]).alias("lists"))
        each = rows.select("key", *[F.size(F.col("lists")[i]).alias(f"l{i}") for i in range(len(of))], F.posexplode("lists").alias("f", "terms"))
        terms = F.when(F.col("f") == 0, F.concat("terms", F.array(F.lit(None).cast("string")))).otherwise(F.col("terms"))
        each = each.select("key", *[f"l{i}" for i in range(len(of))], "f", F.explode(terms).alias("term"))
        n = [F.shiftleft(F.first(f"l{i}").cast("bigint"), 32) + F.count_if((F.col("f") == i) & F.col("term").isNotNull()) for i in range(len(of))]
        return each.groupBy("key", "term").agg(*[c.alias(f"n{i}") for i, c in enumerate(n)])

    def _packed(self, tf: Column, length: Column) -> list[Column]:
        return [(F.shiftleft(length[i].cast("bigint"), 32) + tf[i]).alias(f"n{i}") for i in range(len(self.fields))]

    def _bucket(self) -> Column:
        return (F.crc32(F.col("term")) % self.buckets).cast("int")

    def _write_postings(self, name: str, postings: DataFrame, parts: int) -> None:
        """By ranges of (bucket, term, impact): a frequent term takes many tasks. What
        follows from a row's term and counts is left out of the shuffle."""
        ns = [F.col(f"n{i}") for i in range(len(self.fields))]
        tf, length = [x.cast("int") for x in (n.bitwiseAND(F.lit((1 << 32) - 1)) for n in ns)], [F.shiftright(n, 32).cast("int") for n in ns]
        impact = reduce(lambda a, x: a + x, [c * w for c, w in zip(tf, self.fields.values(), strict=True)])
        dealt = postings.select("term", "key", *ns).repartitionByRange(parts, self._bucket(), F.col("term"), F.desc(impact), F.col("key"))
        out = dealt.select("term", impact.alias("impact"), "key", F.array(*tf).alias("tf"), F.array(*length).alias("len"), self._bucket().alias("bucket"))
        out.sortWithinPartitions("bucket", "term", F.desc("impact"), "key").write.partitionBy("bucket").parquet(self._where(name, "postings"))

    def _write_terms(self, name: str, terms: DataFrame) -> None:
        out = terms.withColumn("bucket", self._bucket())
        out.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self._where(name, "terms"))

    def add(self, docs: DataFrame, columns: dict[str, Column]) -> None:
        """Index a batch; documents whose key is indexed already are replaced. Keys
        are distinct within a batch and not null."""
        v, names, new = self.version(), self.segments(), f"s{uuid.uuid4().hex}"
        parts = pieces(docs)
        staged = stored(self._counted(docs, columns, parts))
        self._write_postings(new, staged.where("term IS NOT NULL"), parts)
        staged.where("term IS NULL").select("key", F.array(*[F.shiftright(f"n{i}", 32).cast("int") for i in range(len(self.fields))]).alias("len")).coalesce(parts).write.parquet(self._where(new, "docs"))
        forget(staged)
        held, keys = self._read(new, "postings"), self._read(new, "docs")
        old = self._live(names, "docs") if names else None
        gone = (old.select("key") if old is not None else keys.select("key").limit(0)).join(keys, "key", "left_semi")
        gone.write.parquet(self._where(new, "gone"))
        gone = self._read(new, "gone")
        terms = held.groupBy("term").agg(F.count("*").alias("docs"), F.max("impact").alias("top"))
        facts = keys.select(F.lit(1).alias("n"), "len")
        if names and not gone.isEmpty():
            back = self._live(names, "postings").join(gone, "key", "left_semi").groupBy("term").agg((-F.count("*")).alias("docs"), F.lit(0.0).alias("top"))
            terms = terms.unionByName(back).groupBy("term").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
            facts = facts.unionByName(old.join(gone, "key", "left_semi").select(F.lit(-1).alias("n"), "len"))
        self._write_terms(new, terms)
        self._write_facts(new, facts)
        self._publish([*names, new], v)

    def _write_facts(self, name: str, facts: DataFrame) -> None:
        total = [F.coalesce(F.sum(F.col("n") * F.col("len")[i]), F.lit(0)).cast("bigint") for i in range(len(self.fields))]
        one = facts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("docs"), F.array(*total).alias("lengths"))
        one.write.parquet(self._where(name, "facts"))

    def compact(self) -> None:
        """One segment of all live rows."""
        v, names, new = self.version(), self.segments(), f"s{uuid.uuid4().hex}"
        if len(names) < 2:
            return
        live = self._live(names, "postings")
        self._write_postings(new, live.select("term", "key", *self._packed(F.col("tf"), F.col("len"))), pieces(live))
        self._live(names, "docs").write.parquet(self._where(new, "docs"))
        self._read(new, "docs").select("key").limit(0).write.parquet(self._where(new, "gone"))
        self._write_terms(new, self._read(new, "postings").groupBy("term").agg(F.count("*").alias("docs"), F.max("impact").alias("top")))
        self._write_facts(new, self._read(new, "docs").select(F.lit(1).alias("n"), "len"))
        self._publish([new], v)

    def clean(self) -> None:
        """Delete segments and versions that the newest version doesn't name."""
        v, names = self.version(), self.segments()
        for n in self.versions.children(f"{self.path}/segments"):
            if n not in names:
                self.versions.delete(f"{self.path}/segments/{n}")
        self.versions.keep_only(v)

    # -- Reading ---------------------------------------------------------------

    def _live(self, names: list[str], what: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Rows of segments, without those that a later one replaces."""
        out = []
        for i, name in enumerate(names):
            rows = keep(self._read(name, what))
            for later in names[i + 1 :]:
                rows = rows.join(self._read(later, "gone"), "key", "left_anti")
            out.append(rows)
        return reduce(DataFrame.unionByName, out)

    def _in(self, terms: list[str]) -> Column:
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return F.col("bucket").isin(buckets) & F.col("term").isin(terms)

    def hits(self, terms: list[str], least: dict[str, float] | None = None) -> DataFrame:
        """key, term, impact, tf, len of the terms; of each at least the given impact."""
        ask = self._in(terms)
        if least:
            ask &= reduce(lambda a, b: a | b, [(F.col("term") == t) & (F.col("impact") >= x) for t, x in least.items()])
        return self._live(self.segments(), "postings", lambda df: df.where(ask)).select("key", "term", "impact", "tf", "len")

    def terms(self, terms: list[str]) -> DataFrame:
        """term, docs (how many documents have it now), top (no impact is greater)."""
        each = [self._read(n, "terms").where(self._in(terms)) for n in self.segments()]
        return reduce(DataFrame.unionByName, each).groupBy("term").agg(F.sum("docs").alias("docs"), F.max("top").alias("top")).where("docs > 0")

    def facts(self) -> tuple[int, list[int]]:
        """Documents, and the sum of their lengths by field: a row a segment."""
        rows = [self._read(n, "facts").first() for n in self.segments()]
        return sum(r.docs for r in rows), [sum(r.lengths[i] for r in rows) for i in range(len(self.fields))]

    def top(self, terms: list[str], k: int) -> DataFrame:
        """The k documents (key, score) with the greatest sums of impacts over
        distinct terms, ties by key. Rows that can't be of a top document are not read."""
        known = {r.term: r.top for r in self.terms(terms).collect()}  # a row a query term
        if not known:
            return self.hits(terms).groupBy("key").agg(F.sum("impact").alias("score")).limit(0)
        first = W.partitionBy("term").orderBy(F.desc("impact"), "key")
        heads = self.hits(list(known)).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
        sums = heads.groupBy("key").agg(F.sum("impact").alias("s")).orderBy(F.desc("s")).limit(k).agg(F.count("*").alias("n"), F.min("s").alias("s")).first()
        reach = sums.s if sums.n == k else 0.0
        rest = sum(known.values())
        least = {t: reach - (rest - top) for t, top in known.items()}
        hits = self.hits(list(known))
        if any(x > 0 for x in least.values()):
            may = self.hits(list(known), {t: x - 1e-9 * abs(rest) for t, x in least.items()}).select("key").distinct()
            hits = hits.join(may, "key", "left_semi")
        return hits.groupBy("key").agg(F.sum("impact").alias("score")).orderBy(F.desc("score"), "key").limit(k)

    def candidates(self, query: list[str], ids: list[str], id_fields: list[str], limit: int) -> DataFrame:
        """key, score, matched_by: documents whose own lists hold an identifier that
        was asked for come first, then those of the best sums, limit in all or
        as many as the identifiers give."""
        limit = max(1, min(100, limit))
        none = self.hits([""]).select("key", F.lit(0.0).alias("score"), F.lit("").alias("matched_by")).limit(0)
        at = [list(self.fields).index(f) for f in id_fields]
        own = reduce(lambda a, i: a | (F.col("tf")[i] > 0), at, F.lit(False))
        asked = [i.lower() for i in ids]
        by_id = self.hits(asked).where(own).select("key").distinct().orderBy("key").limit(limit) if asked else none.select("key")
        by_id = by_id.select("key", F.lit(BY_ID).alias("score"), F.lit("exact_id").alias("matched_by"))
        text = self.top(query, limit).select("key", "score", F.lit("text").alias("matched_by")) if query else none
        both = by_id.unionByName(text.join(by_id.select("key"), "key", "left_anti"))
        return both.orderBy((F.col("matched_by") != "exact_id"), F.desc("score"), "key").limit(limit)

    def scored(self, wanted: list[str], weights: dict[str, tuple[float, float]], k1: float = 1.4) -> DataFrame:
        """(key, score, n_hits, signal_hits) as search.bm25f() has it, from the index
        alone: lengths stand beside the counts, document counts in the terms' table."""
        n, lengths = self.facts()
        signal = [t for t in wanted if t not in T.LOW_SIGNAL]
        tfw = F.lit(0.0)
        for i, f in enumerate(self.fields):
            w, b = weights.get(f, (0.0, 0.0))
            average = max(lengths[i] / max(n, 1), 1.0)
            tfw += w * F.col("tf")[i] / (1 - b + b * F.col("len")[i] / average)
        df = self.terms(wanted).select("term", F.greatest(F.lit(0.2), F.log(1 + (n - F.col("docs") + 0.5) / (F.col("docs") + 0.5))).alias("idf"))
        hits = self.hits(wanted).select("key", "term", tfw.alias("tfw")).join(F.broadcast(df), "term")  # a row a query term
        part = T.term_weight(F.col("term")) * F.col("idf") * F.col("tfw") / (k1 + F.col("tfw"))
        out = hits.groupBy("key").agg(F.sum(part).alias("text"), F.count("*").alias("n_hits"), F.count_if(~T.is_low_signal(F.col("term"))).alias("signal_hits"))
        score = F.when(F.col("signal_hits") == 0, 0.0).otherwise(F.col("text") * (0.5 + 0.5 * F.col("signal_hits") / max(len(signal), 1)))
        return out.select(F.col("key").alias(self.key), score.alias("score"), "n_hits", "signal_hits")

    def matched(self, wanted: list[str]) -> DataFrame:
        """(key, field, term): as search.postings() has it, of the wanted terms only."""
        names = F.array(*map(F.lit, self.fields))
        each = self.hits(wanted).select("key", "term", F.posexplode("tf").alias("i", "n")).where("n > 0")
        return each.select(F.col("key").alias(self.key), F.get(names, F.col("i")).alias("field"), "term", F.col("n").alias("tf"))
