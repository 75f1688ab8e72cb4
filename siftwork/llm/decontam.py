"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text's words become a template: numbers, units after a number, and names
(capitalised inside a sentence) turn into typed placeholders, all else into
lower case. Windows of WINDOW template words are hashed and hash-joined with
the benchmark items' windows, so a question asked again with other numbers,
units or names still meets its template. Windows of raw words are hashed and
joined too, so text word for word is met whatever type its words were given.
For each run of windows of a document, item and offset the slots are then
compared: one slot value of the item must always meet the same value in the
document, and two values never one, as in a re-parameterised question; an
accidental template match breaks that. Windows that hold a slot at odds with
another of their run don't count; windows equal word for word always do.

An item with fewer words is one window of all its words. Windows in which
fewer than half the words are literal match word for word only, those without
a literal word never. Items with fewer than LEAST_WORDS words are too short to
be told apart inside a text: they match a text that has just their words. A
document and an item are brought together by the item's rarest windows only: so
many that no leak can do without one, and places that VERBATIM words in a row
can't step over. Phrases that all questions begin with then join little, no leak
is lost, and all windows count. A capital at an item's start is taken as a name
or not, as the document has it; a stop word there has to be the same word.
Null and empty texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions.text import STOPWORDS, let
from siftwork.session import stored

WINDOW, LEAST_WORDS = 8, 4
#: Share of an item's windows that a document must hold to be taken as leaked.
COVERED = 0.5
#: Or so many of an item's words in a row, word for word.
VERBATIM = 20
#: Windows of one join's broadcast side (about 8 MB). More are joined block by block.
BLOCK = 500_000
#: Units; fixed values.
UNITS = "km m cm mm mi ft in kg g mg lb lbs oz l ml s sec min h hr hrs hours days years usd eur gbp percent degrees mph kmh mw kw".split()

_NAME, _UNIT = chr(0xA7), chr(0xA4)  # marks put before a name and a unit
_TOKEN = rf"[{_NAME}{_UNIT}]?[\p{{L}}\p{{N}}]+(?:[.,]\p{{N}}+)*"


def tokens(text: Column) -> Column:
    """Lower-case words of a text, names and units marked. Each step is taken by
    the texts that need it only: most have no mark, inner capital or digit."""
    plain = F.when(text.contains(_NAME) | text.contains(_UNIT), F.translate(text, _NAME + _UNIT, "")).otherwise(text)
    named = F.regexp_replace(plain, r"([\p{Ll}\p{N},;:] )(\p{Lu})", "$1" + _NAME + "$2")
    unit = rf"(?<=\p{{N}} ?)(?<![\p{{L}}{_NAME}])(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))"
    low = F.lower(named)
    measured = F.when(low.rlike(r"\p{N} ?\p{L}"), F.regexp_replace(low, unit, _UNIT)).otherwise(low)
    return F.regexp_extract_all(measured, F.lit(_TOKEN), F.lit(0))


def template(token: Column) -> Column:
    """A token's template word; placeholders start with a blank."""
    return F.when(_slot(token), F.when(token.startswith(_NAME), F.lit(" name")).when(token.startswith(_UNIT), F.lit(" unit")).otherwise(F.lit(" number"))).otherwise(token)


def _slot(token: Column) -> Column:
    """Digits come before all letters, and the marks after ASCII: two comparisons settle most words."""
    return (token < "a") | ((token > "~") & (token.startswith(_NAME) | token.startswith(_UNIT)))


def _bare(token: Column) -> Column:
    """A token without its mark."""
    return F.when(token.startswith(_NAME) | token.startswith(_UNIT), F.substring(token, 2, 1_000_000)).otherwise(token)


def _windows(words: Column, size: int) -> Column:
    """Hashes of all runs of size template words; none in shorter texts. Then as
    many of raw words, if some word is a slot (else they are the same)."""
    none = F.array().cast("array<bigint>")

    def runs(h: Column) -> Column:
        n = F.size(h) - (size - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, size)))).otherwise(none)

    typed, raw = (let(F.transform(words, lambda t: F.xxhash64(of(t))), runs) for of in (template, _bare))
    return F.when(F.exists(words, _slot), F.concat(typed, raw)).otherwise(typed)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, at, hash, raw, typed, same_first): windows of each item by
    template, by raw words, and by template with a name for a first word with a
    capital. typed: has enough literal words for a template; same_first: the first
    word has to be the document's."""
    first = F.regexp_extract(text_col, r"[\p{L}\p{N}]", 0).rlike(r"\p{Lu}").alias("capital")
    t = benchmark.select(F.col(id_col).alias("item_id"), tokens(F.col(text_col)).alias("raw"), first).where(F.size("raw") >= LEAST_WORDS)
    t = t.withColumn("size", F.least(F.size("raw"), F.lit(WINDOW)))
    t = t.select("item_id", "size", "raw", "capital", F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("size") + 1)).alias("at"))
    t = t.withColumn("raw", F.slice("raw", F.col("at"), F.col("size"))).withColumn("slots", F.size(F.filter("raw", _slot)))
    t = t.withColumn("typed", 2 * F.col("slots") <= F.col("size"))
    words, bare = F.transform("raw", template), F.transform("raw", _bare)
    named = F.concat(F.array(F.lit(" name")), F.slice(words, F.lit(2), F.col("size")))
    no = F.lit(False)

    def kind(keep: Column, of: Column, same: Column) -> Column:
        return F.struct(keep.alias("keep"), F.xxhash64(F.transform(of, lambda w: F.xxhash64(w))).alias("hash"), same.alias("same_first"))

    kinds = F.array(
        kind(F.col("typed"), words, no),
        kind(F.col("slots") < F.col("size"), bare, no),
        kind(F.col("typed") & F.col("capital") & (F.col("at") == 1), named, bare[0].isin(STOPWORDS)),
    )
    return t.select("item_id", "size", "at", "raw", "typed", F.explode(F.filter(kinds, lambda k: k["keep"])).alias("k")).select("item_id", "size", "at", "k.hash", "raw", "typed", "k.same_first")


def _short(text: Column) -> Column:
    """The words of a text with fewer than LEAST_WORDS, else null. A first look, that
    ends at the word too many, keeps other texts from being cut into words again."""
    plain = F.translate(text, _NAME + _UNIT, "")
    enough = plain.rlike(rf"\A(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++(?:[.,]\p{{N}}++)*+){{{LEAST_WORDS}}}")
    low = F.transform(tokens(text), _bare)
    return F.when(~enough, let(low, lambda w: F.when((F.size(w) > 0) & (F.size(w) < LEAST_WORDS), w)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, n_slots): each item
    that a document holds, word for word or with other slot values: COVERED of its
    windows, or VERBATIM words in a row.

    Rows that repeat count once. Windows are all of the item's, or those with a
    template, whichever gives the larger share. n_slots: slots compared in the best run.
    """
    items = stored(item_windows(benchmark, item_col, item_text))
    # The benchmark is held out of training: small beside it, but not bounded. Its size is looked at.
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # WINDOW values at most
    keys = items.groupBy("size", "hash").agg(F.countDistinct("item_id").alias("same"))
    blocks = 1 + keys.count() // BLOCK
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("words"))
    found = words.select("doc_id", F.lit(0).alias("pos"), F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("hash"), "words").where("false")
    if sizes:
        # One look at the texts for all sizes; more only if the items' windows fill several blocks.
        per_size = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), _windows(F.col("words"), s).alias("hashes")) for s in sizes])).alias("w")
        each = words.select("doc_id", "words", per_size) if len(sizes) > 1 else words.select("doc_id", "words", F.struct(F.lit(sizes[0]).alias("size"), _windows(F.col("words"), sizes[0]).alias("hashes")).alias("w"))
        each = each.select("doc_id", "words", F.col("w.size").alias("size"), F.posexplode("w.hashes").alias("pos", "hash"))
        at = F.col("pos") % (F.size("words") - (F.col("size") - 1)) + 1  # raw windows come after those of templates
        for b in range(blocks):
            own = keys.where(F.pmod("hash", F.lit(blocks)) == b).select("size", "hash")
            # Within the BLOCK bound. The words stay a reference until a window has met its like.
            found = found.unionByName(each.join(F.broadcast(own), ["size", "hash"]).select("doc_id", at.alias("pos"), "size", "hash", F.slice("words", at, F.col("size")).alias("words")))
    found = stored(found)
    # A leak holds COVERED of an item's windows, or of those with a template: it can miss
    # one of the rarest only if it has another of them. The rest may hold VERBATIM words
    # in a row: of so many windows one is at a multiple.
    rarity = items.join(keys, ["size", "hash"])
    spots = rarity.groupBy("item_id", "at").agg(F.max("same").alias("same"), F.max("typed").alias("typed"))
    rarest = W.partitionBy("item_id").orderBy("same", "at")
    rarest_typed = W.partitionBy("item_id", "typed").orderBy("same", "at")
    spots = spots.withColumn("r", F.row_number().over(rarest)).withColumn("of", F.count("*").over(W.partitionBy("item_id")))
    spots = spots.withColumn("rt", F.row_number().over(rarest_typed)).withColumn("oft", F.count("*").over(W.partitionBy("item_id", "typed")))
    enough = lambda r, of: F.col(r) <= F.col(of) - F.ceil(F.col(of) * COVERED) + 1
    row = VERBATIM - WINDOW + 1
    spots = spots.where(enough("r", "of") | (F.col("typed") & enough("rt", "oft")) | ((F.ceil(F.col("of") * COVERED) > row) & (F.col("at") % row == 0)))
    telling = rarity.join(spots.select("item_id", "at"), ["item_id", "at"]).select("item_id", "size", "hash").distinct()
    paired = found.select("doc_id", "size", "hash").distinct().join(telling, ["size", "hash"]).select("doc_id", "item_id").distinct()
    theirs = found.withColumnRenamed("doc_id", "of")
    own = paired.join(items, "item_id")
    met = own.join(theirs, F.col("doc_id").eqNullSafe(F.col("of")) & (own["size"] == theirs["size"]) & (own["hash"] == theirs["hash"])).select("doc_id", "item_id", "at", "raw", "typed", "same_first", "words", (F.col("pos") - F.col("at")).alias("shift"))
    met = met.where(~F.col("same_first") | (_bare(F.col("raw")[0]) == _bare(F.col("words")[0])))
    pairs = F.filter(F.arrays_zip(F.col("raw").alias("mine"), F.col("words").alias("theirs")), lambda x: _slot(x["mine"]) | _slot(x["theirs"]))
    pairs = F.transform(pairs, lambda x: F.struct(_bare(x["mine"]).alias("mine"), _bare(x["theirs"]).alias("theirs")))
    # Windows one after the other are a run: one row each; windows of an item bound what it gathers.
    place = W.partitionBy("doc_id", "item_id", "shift").orderBy("at")
    placed = met.select("doc_id", "item_id", "shift", "at", "typed", pairs.alias("pairs")).withColumn("run", F.col("at") - F.dense_rank().over(place))
    runs = placed.groupBy("doc_id", "item_id", "shift", "run").agg(F.collect_set(F.struct("at", "typed", "pairs")).alias("ws"))
    runs = runs.withColumn("slots", F.array_distinct(F.flatten(F.transform("ws", lambda w: w["pairs"]))))
    odd = F.filter("slots", lambda p: F.exists("slots", lambda q: (p["mine"] == q["mine"]) != (p["theirs"] == q["theirs"])))
    equal = lambda w: F.forall(w["pairs"], lambda p: p["mine"] == p["theirs"])
    runs = runs.withColumn("odd", odd).withColumn("verbatim", F.transform(F.filter("ws", equal), lambda w: w["at"]))
    counted = F.filter("ws", lambda w: equal(w) | ~F.arrays_overlap(w["pairs"], F.col("odd")))
    long = F.exists("verbatim", lambda a: F.forall(F.sequence(a, a + (VERBATIM - WINDOW)), lambda x: F.array_contains("verbatim", x)))
    runs = runs.select("doc_id", "item_id", F.transform(counted, lambda w: F.struct(w["at"].alias("at"), w["typed"].alias("typed"))).alias("ats"), F.size("slots").alias("slots"), long.alias("long"))
    total = items.groupBy("item_id").agg(F.countDistinct("at").alias("of_all"), F.countDistinct(F.when(F.col("typed"), F.col("at"))).alias("of_typed"))
    # Text put in or left out shifts what follows: all runs at all offsets count together.
    whole = runs.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.max("slots").alias("n_slots"), F.max("long").alias("long"))
    whole = whole.join(total, "item_id").select("doc_id", "item_id", "n_slots", "long", "of_all", "of_typed", F.size("ats").alias("all"), F.size(F.filter("ats", lambda x: x["typed"])).alias("typed"))
    best = F.greatest(*[F.struct(F.try_divide(F.col(n), F.col(of)).alias("share"), F.col(n).cast("bigint").alias("n"), F.col(of).alias("of")) for n, of in (("all", "of_all"), ("typed", "of_typed"))])
    leaked = whole.withColumn("best", best).where((F.col("best.share") >= COVERED) | F.col("long")).select(
        "doc_id", "item_id", F.col("best.n").alias("n_windows"), F.col("best.of").alias("item_windows"), F.col("best.share").alias("coverage"), F.col("n_slots").cast("bigint").alias("n_slots")
    )
    # Items too short for a window, against texts of just their words.
    short = benchmark.select(F.col(item_col).alias("item_id"), _short(F.col(item_text)).alias("same")).where("same is not null")
    exact = docs.select(F.col(id_col).alias("doc_id"), _short(F.col(text_col)).alias("same")).where("same is not null").distinct().join(short.distinct(), "same")
    one = F.lit(1).cast("bigint")
    return leaked.union(exact.select("doc_id", "item_id", one, one, F.lit(1.0), F.lit(0).cast("bigint")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item. Rows are known by a hash of
    all columns, so a null id or one that repeats takes no other row with it."""
    rows = docs.withColumn("_row", F.xxhash64(*docs.columns))
    found = leaks(rows, benchmark, id_col="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(found, "_row", "left_anti").select(docs.columns)
