"""Fingerprints, the duplicate cascade and the choice of the canonical copy."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions.batches import pieces

#: Bits of the hash's four bands: two hashes within 3 bits share one band whole.
BANDS, NEAR, LEAST_TOKENS = 4, 3, 80
#: Rows over which a class is dealt when its members look for their representative.
SALTS = 32


def normalized(text: Column) -> Column:
    """Unicode compatibility form without marks, list and heading marks, lower case, one blank between words."""

    @F.arrow_udf("string")
    def fold(col: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            return t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(one, col[at:to].to_pylist()), pa.string()) for at, to in pieces(col))])

    # An ASCII text is its own form and stays where it is.
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    folded = F.coalesce(fold(odd), text, F.lit(""))
    out = F.regexp_replace(folded, r"(?m)^\s*(?:[-*+#>]+|\d+[.)])\s+", " ")
    out = F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\.", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normal_title(title: Column) -> Column:
    """Lower case without up to two branding suffixes, if 16 characters stay."""
    out = F.trim(title)
    for _ in range(2):
        cut = F.regexp_replace(out, r"\s+[|–—-]\s+[^|–—-]{2,40}$", "")
        out = F.when(F.length(cut) >= 16, cut).otherwise(out)
    return F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "))


def normal_publisher(name: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(low, r"\b(?:inc|llc|ltd|gmbh|corp|corporation|company|co|labs?|blog|team|the)\b", " "))


def title_publisher_hash(title: Column, publisher: Column) -> Column:
    """Null for titles under four words."""
    t = normal_title(title)
    return F.when(F.size(F.split(t, " ")) >= 4, F.sha2(F.concat_ws("|", t, normal_publisher(publisher)), 256))


def simhash64(text: Column) -> Column:
    """64 sign votes of words (by count) and runs of three words (one each)."""

    @F.arrow_udf("long")
    def votes(col: pa.Array) -> pa.Array:
        shift = np.arange(64, dtype=np.uint64)

        def one(t: str | None) -> int:
            words = (t or "").split()
            if not words:
                return 0
            code, uniq = pd.factorize(np.array(words, object))
            h = pd.util.hash_array(np.asarray(uniq, object), categorize=False)
            weight = np.bincount(code).astype(np.float64)
            if len(words) >= 3:
                w = h[code]
                tri = np.unique((w[:-2] * np.uint64(31) + w[1:-1]) * np.uint64(1_000_003) + w[2:] * np.uint64(0x9E3779B97F4A7C15))
                h, weight = np.concatenate([h, tri]), np.concatenate([weight, np.ones(len(tri))])
            total = np.zeros(64)
            for at in range(0, len(h), 2048):  # bounded memory for long texts
                bits = (h[at : at + 2048, None] >> shift) & np.uint64(1)
                total += (weight[at : at + 2048, None] * (bits.astype(np.float64) * 2 - 1)).sum(axis=0)
            return int(np.bitwise_or.reduce((total > 0).astype(np.uint64) << shift).astype(np.int64))

        return pa.array([one(t) for at, to in pieces(col) for t in col[at:to].to_pylist()], pa.int64())

    return votes(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprints(docs: DataFrame, key: str, text: str, title: Column, publisher: Column) -> DataFrame:
    """(key, content_sha, text_sha, title_hash, simhash, tokens)"""
    n = docs.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_sha"), normalized(F.col(text)).alias("_n"), title_publisher_hash(title, publisher).alias("title_hash"))
    return n.select(key, "content_sha", F.sha2("_n", 256).alias("text_sha"), "title_hash", simhash64(F.col("_n")).alias("simhash"), F.when(F.col("_n") == "", 0).otherwise(F.size(F.split("_n", " "))).alias("tokens"))


def near_pairs(prints: DataFrame, key: str, near: int = NEAR) -> DataFrame:
    """(a, b, distance) of hashes within near bits (3 at most), a < b. Equal hashes
    are taken once: pairs are between the least keys of distinct hashes."""
    one = prints.where(F.col("tokens") >= LEAST_TOKENS).groupBy("simhash").agg(F.min(key).alias("k"))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("v")) for i in range(BANDS)])
    cut = one.select("k", "simhash", F.explode(bands).alias("x")).select("k", "simhash", "x.band", "x.v")
    a, b = cut.select("band", "v", F.col("k").alias("a"), F.col("simhash").alias("ha")), cut.select("band", "v", F.col("k").alias("b"), F.col("simhash").alias("hb"))
    d = hamming(F.col("ha"), F.col("hb"))
    return a.join(b, ["band", "v"]).where((F.col("a") < F.col("b")) & (d <= near)).select("a", "b", d.alias("distance")).distinct()


def equal_members(prints: DataFrame, key: str) -> DataFrame:
    """(a, b, distance 0): a is the least key of a hash, b each other key of it. A
    row a member, not a pair of members; a large class is dealt over SALTS."""
    full = prints.where(F.col("tokens") >= LEAST_TOKENS).select(F.col(key).alias("b"), "simhash")
    one = full.groupBy("simhash").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    one = one.select("simhash", "a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = full.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))
    return dealt.join(one, ["simhash", "salt"]).where(F.col("a") < F.col("b")).select("a", "b", F.lit(0).alias("distance")).distinct()


def near_links(prints: DataFrame, key: str, near: int = NEAR) -> DataFrame:
    """(a, b, distance), a < b: near_pairs() between representatives, and each other
    document's link to the representative of its hash at distance 0. Two documents
    are within near bits exactly if their representatives are one or linked."""
    return near_pairs(prints, key, near).unionByName(equal_members(prints, key))


def match_new(new: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """For each new print the stored one it copies: (key, match, how), by content,
    then normalized text, then confirmed title, then nearest simhash. Never itself."""
    left = new.select(F.col(key).alias("k"), "content_sha", "text_sha", "title_hash", "simhash", "tokens", "day")

    def by(column: str, how: str, level: int, confirmed: bool = False) -> DataFrame:
        side = index.select(F.col(key).alias("m"), F.col(column).alias("c"), F.col("simhash").alias("ms"), F.col("day").alias("md"))
        ok = (F.col("m") != F.col("k")) & F.col("c").isNotNull()
        if confirmed:
            ok &= (hamming(F.col("simhash"), F.col("ms")) <= 16) | (F.abs(F.datediff("day", "md")) <= 3)
        # The least match of each value first: a hot value costs a row, not a product.
        if not confirmed:
            side = side.groupBy("c").agg(F.min("m").alias("m"), F.min(F.struct(F.col("m").alias("x"), "ms", "md")).alias("s")).select("m", "c", "s.ms", "s.md")
        return left.join(side, F.col(column) == F.col("c")).where(ok).select("k", "m", F.lit(how).alias("how"), F.lit(level).alias("level"), F.lit(0).alias("distance"))

    split = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(c, 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("v")) for i in range(BANDS)]))
    mine = left.where(F.col("tokens") >= LEAST_TOKENS).select("k", "simhash", split("simhash").alias("x")).select("k", "simhash", "x.band", "x.v")
    theirs = index.where(F.col("tokens") >= LEAST_TOKENS).select(F.col(key).alias("m"), F.col("simhash").alias("ms"), split("simhash").alias("x")).select("m", "ms", "x.band", "x.v")
    d = hamming(F.col("simhash"), F.col("ms"))
    near = mine.join(theirs, ["band", "v"]).where((F.col("m") != F.col("k")) & (d <= NEAR)).select("k", "m", F.lit("simhash").alias("how"), F.lit(4).alias("level"), d.alias("distance"))
    all_ = by("content_sha", "content", 1).union(by("text_sha", "text", 2)).union(by("title_hash", "title", 3, True)).union(near)
    best = all_.groupBy("k").agg(F.min(F.struct("level", "distance", "m", "how")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("b.m").alias("match"), F.col("b.how").alias("how"))


def is_syndicator(domain: Column, syndicators: list[str]) -> Column:
    out = F.lit(False)
    for s in syndicators:
        out |= (domain == s) | domain.endswith("." + s)
    return out


def canonical(docs: DataFrame, group: str, key: str, domain: Column, tier: Column, day: Column, syndicators: list[str]) -> DataFrame:
    """(group, canonical, copies): an original over a syndicator, then the lower
    tier (none: 4), then the earlier day, then the least key."""
    rank = F.struct(is_syndicator(domain, syndicators).cast("int").alias("s"), F.coalesce(tier, F.lit(4)).alias("t"), F.coalesce(day.cast("string"), F.lit("9999")).alias("d"), F.col(key).alias("k"))
    return docs.groupBy(group).agg(F.min(rank).alias("r"), F.count("*").alias("copies")).select(group, F.col("r.k").alias("canonical"), "copies")


def merged_mirrors(mirrors: DataFrame, key: str, url: str, seen: str, most: int = 50) -> DataFrame:
    """Mirrors of each key, newest first, one per url, most of them at most (a list that is shown)."""
    one = mirrors.groupBy(key, url).agg(F.max(seen).alias(seen))
    return one.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seen), url))).where(F.col("n") <= most)
