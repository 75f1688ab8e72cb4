"""MinHash near-duplicate detection with exact confirmation.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes) and
   HASHES minima under universal (multiply-add-shift) hash functions, cut into
   bands. Documents with equal sets form one class before anything is paired.
2. Every member of a band's bucket is paired with the bucket's smallest id
   only, so a bucket of n costs n pairs. Pairs are confirmed on full sets.
3. Alternating large-star and small-star gives the components so far. Within
   a bucket, pairs inside one component can't change the result any more. The
   members outside a bucket's main component are compared with all others in
   cells of bounded size: a first pass on minima finds the members that need
   it, a second one intersects their full sets. Only links that join components
   leave a cell, never pairs. A pair that shares several buckets is looked at in the first one. So
   no link between different texts is lost, but for pairs that share no band:
   below 1e-8 at a similarity of 0.85.

What a key is joined with is stored first, so that the adaptive skew join can
split a hot bucket or a text with very many copies.

Null or blank texts have an empty set and are linked with nothing. Repeated
rows are copies of each other. Ids are integers; rows that share an id but not
their text are one node, with the set of one of them: give such rows keys of
their own first (corpus_pipeline does). An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.textbatch import Block, blocks, mix, shingles
from siftwork.session import forget, ship, stored

ROWS, BANDS = 3, 20
HASHES = ROWS * BANDS
#: Members of a bucket that one task compares with one another.
CELL = 1000
#: Shingles of a cell's members, about (8 bytes each).
CELL_SHINGLES = 1 << 20
#: Least share of equal minima for a pair across components to be confirmed
#: on full sets; 0.85 lies over five standard deviations above it.
PLAUSIBLE = 0.6

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a block's texts, their offsets, and which occur first in their text."""
    b = Block(column)
    b.words()
    h, off = shingles(b.hashes(b.starts, b.ends), b.first, k)
    text = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    new = ~pd.Series(mix(h ^ mix(text + np.uint64(1)))).duplicated().to_numpy() if len(h) else np.zeros(0, bool)
    return h, off, new


def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, "text"):
            h, off, new = _sets(part.column("text"), k)
            n = len(off) - 1
            full = np.flatnonzero(np.diff(off))
            at = off[:-1][full]
            size, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            minima = np.zeros((n, HASHES), np.uint32)
            if len(full):
                size[full] = np.add.reduceat(new.astype(np.int64), at)
                own = np.where(new, h, np.uint64(0))
                k1[full] = np.add.reduceat(own, at)
                k2[full] = np.add.reduceat(np.where(new, mix(h + np.uint64(99)), np.uint64(0)), at)
                x = h >> np.uint64(32)
                for i in range(HASHES):
                    minima[full, i] = np.minimum.reduceat((_A[i] * x + _B[i]) >> np.uint64(32), at)
            bands = np.zeros((n, BANDS), np.uint64)
            for j in range(BANDS):
                key = np.full(n, j + 1, np.uint64)
                for i in range(j * ROWS, (j + 1) * ROWS):
                    key = mix(key * np.uint64(0x100000001B3) + minima[:, i])
                bands[:, j] = key
            sig = minima.tobytes()
            w = HASHES * 4
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(size),
                    pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel())),
                    pa.array([sig[i * w : i * w + w] for i in range(n)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, "text"):
            h, off, new = _sets(part.column("text"), k)
            offsets = np.concatenate([[0], np.cumsum(new)])[off]
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], ["doc_id", "set"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that hold 100 * intersection >= percent * union."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("both", both)
        .where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both")))
        .select("a", "b")
    )
    return stored(linked)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its
    component. Alternating large-star and small-star (Kiveris and others, 2014):
    no group is ever gathered, minima are combined before each shuffle."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large-star: every larger neighbour of u is tied to u's least neighbour
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours are tied to the least of them
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        small = stored(small)
        found = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(30,0)"))).first()
        forget(large)
        forget(now)
        now = small
        if found == state:
            break
        state = found
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v").distinct())


def _needed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of one cell that have a partner in another component whose
    minima agree, and share no earlier band with it."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), HASHES)
    label, band = pdf["label"].to_numpy(), int(pdf["band"].iloc[0])
    mine, there = np.flatnonzero(pdf["asks"].to_numpy()), np.flatnonzero(pdf["asked"].to_numpy())
    need = np.zeros(len(pdf), bool)
    for i in mine:
        same = sig[there] == sig[i]
        fits = (same.sum(axis=1) >= PLAUSIBLE * HASHES) & (label[there] != label[i])
        if band and fits.any():
            fits &= ~same[:, : band * ROWS].reshape(len(there), band, ROWS).all(axis=2).any(axis=1)
        if fits.any():
            need[i] = True
            need[there[fits]] = True
    return pdf.loc[need, ["key", "cell", "rare_cell", "rep", "label", "asks", "asked"]]


def _linked(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links on full sets that join the components met in one cell: every member
    that asks is compared with all that are asked, but components that links of
    this cell have joined already are one, and two are joined by one link. So a
    cell gives fewer links than it has components, and the same components."""
    ids = pdf["rep"].to_numpy()
    part, found = pd.factorize(pdf["label"])
    part = part.astype(np.int64)
    size = pdf["set"].map(len).to_numpy()
    codes, distinct = pd.factorize(np.concatenate(pdf["set"].to_numpy()))
    off = np.concatenate([[0], np.cumsum(size)])
    there = pdf["asked"].to_numpy()
    a, b = [], []
    for i in np.flatnonzero(pdf["asks"].to_numpy()):
        if len(a) == len(found) - 1:
            break  # all are one
        others = there & (part != part[i])
        if not others.any():
            continue
        mark = np.zeros(len(distinct), np.int32)
        mark[codes[off[i] : off[i + 1]]] = 1
        both = np.add.reduceat(mark[codes], off[:-1])  # sets of representatives are never empty
        hits = np.flatnonzero(others & (100 * both >= percent * (size + size[i] - both)))
        for j in hits[np.unique(part[hits], return_index=True)[1]]:
            a.append(min(ids[i], ids[j]))
            b.append(max(ids[i], ids[j]))
            part[part == part[j]] = part[i]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs: integer ids and texts. component_id is the smallest id reachable over
    links; kept tells whether it is the row's own. A null id joins its copies'
    component and is kept only if it has none.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    feats = stored(
        docs.mapInArrow(
            lambda it: _features(it, k),
            "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sig binary",
        )
    )
    full = feats.where("n_shingles > 0")
    classes = stored(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    member = full.select("doc_id", "n_shingles", "k1", "k2").join(classes.hint("merge"), ["k1", "k2"]).select("doc_id", "n_shingles", "rep")

    reps = full.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    banded = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    hubs = stored(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    shared = stored(banded.join(hubs.hint("merge"), "key"))
    stars = stored(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    ids = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # One row an id, though rows may repeat. Ids grow with the input: the same join at every size.
    texts = docs.join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = stored(texts.mapInArrow(lambda it: _full_sets(it, k), "doc_id bigint, set array<bigint>"))
    links = _confirmed(stars, sets, percent)
    roots = stored(components(links))

    labelled = (
        shared.where("n > 2")
        .join(roots, shared.rep == roots.node, "left")
        .select("key", "band", "rep", "n_shingles", F.coalesce("root", "rep").alias("label"))
    )
    labelled = stored(labelled)
    main = F.max_by(F.struct("label", "count", "held"), F.struct("count", "label")).alias("main")
    split = stored(
        labelled.groupBy("key", "label")
        .agg(F.count("*").alias("count"), F.sum("n_shingles").alias("held"))
        .groupBy("key")
        .agg(main, F.count("*").alias("labels"), F.sum("count").alias("n"), F.sum("held").alias("held"))
        .where("labels > 1")
        .select("key", F.col("main.label").alias("main"), "n", "held", (F.col("n") - F.col("main.count")).alias("rare_n"), (F.col("held") - F.col("main.held")).alias("rare_held"))
    )
    cells = F.ceil(F.greatest(F.col("n") / CELL, F.col("held") / CELL_SHINGLES)).cast("int")
    rare_cells = F.ceil(F.greatest(F.col("rare_n") / CELL, F.col("rare_held") / CELL_SHINGLES)).cast("int")
    sides = (
        labelled.join(split.hint("merge"), "key")
        .withColumn("rare", F.col("label") != F.col("main"))
        .withColumn("h", F.abs(F.xxhash64("rep")))
        .select(
            "key",
            "band",
            "rep",
            "label",
            "rare",
            (F.col("h") % cells).cast("int").alias("cell"),
            (F.col("h") % rare_cells).cast("int").alias("rare_cell"),
            cells.alias("cells"),
            rare_cells.alias("rare_cells"),
        )
    )
    asked = sides.select("key", "band", "rep", "label", "cell", F.explode(F.sequence(F.lit(0), F.col("rare_cells") - 1)).alias("rare_cell"), F.lit(False).alias("asks"), F.lit(True).alias("asked"))
    asks = sides.where("rare").select("key", "band", "rep", "label", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "rare_cell", F.lit(True).alias("asks"), F.lit(False).alias("asked"))
    sigs = feats.select(F.col("doc_id").alias("rep"), "sig").dropDuplicates(["rep"])
    cell = ["key", "cell", "rare_cell"]
    needed = (
        asked.unionByName(asks)
        .join(sigs, "rep")
        .groupBy(*cell)
        .applyInPandas(_needed, "key bigint, cell int, rare_cell int, rep bigint, label bigint, asks boolean, asked boolean")
    )
    more = stored(
        stored(needed)
        .join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        .groupBy(*cell)
        .applyInPandas(lambda pdf: _linked(pdf, percent), "a bigint, b bigint")
        .distinct()
    )
    if not more.isEmpty():
        roots = stored(components(links.union(more)))
    whole = (
        member.join(roots, member.rep == roots.node, "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
        .union(feats.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
