"""Merkle manifest of a table: a postorder append log and proofs read from it.

Trees have one leaf a row and ARITY children a node; every lang has a tree, and
the roots of these are the leaves of one more. Nodes are logged in postorder,
the order in which they are completed when leaves arrive one by one. A node's
place in that log is a closed form of sizes alone: with n leaves, node i of
level l ends at leaf e = min((i + 1) * 8^l, n); before it stand all nodes of the
levels below that begin before e, i nodes of its own level, and those of the
levels above that end at or before its first leaf.

1. Rows are range-sorted by (tree, doc_id, leaf) into a table. Counts a sorted
   part and tree give every leaf its place; no tree is sorted in one task.
2. Aligned builders: SPAN consecutive leaves that begin at a multiple of SPAN
   (a power of ARITY) are a whole subtree, so one builder logs its nodes as one
   unbroken piece of the postorder. The subtrees' roots are the leaves of the
   next tier, and so on up; a tier has 1 / SPAN of the rows of the one below.
3. Proofs go down the same tiers. A piece of the log answers for all its leaves:
   siblings are read from it at their closed-form places, and what a piece's own
   root needs above it is handed down once a piece, not once a leaf.

A piece has at most SPAN leaves, however large a tree is, and nothing is
collected but the greatest number of leaves of a tree.

Rows are ordered by doc_id within their lang (null ids first), rows that share
an id by their leaf; rows that repeat in all columns are leaves of their own and
their proofs are dealt out among them. A null lang is a tree of its own; null
values are hashed as "-". An empty table gives an empty result. Other columns
are not read, whatever their names. Ids and n_chars are hashed by their decimal
or text form. A row without an id is never tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.session import ship, stored

ARITY = 8
#: Levels that one builder completes, and the leaves it takes.
LEVELS = 3
SPAN = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def counts(n: int) -> list[int]:
    """Nodes of each level of a tree with n leaves, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def place(level: int, i: int, n: int) -> int:
    """Where the postorder log of a tree with n leaves has node i of a level."""
    first, end = i * ARITY**level, min((i + 1) * ARITY**level, n)
    height = len(counts(n)) - 1
    below = sum(-(-end // ARITY**j) for j in range(level))
    above = sum(first // ARITY**j for j in range(level + 1, height + 1))
    return below + i + above


class Piece:
    """The part of a tree's log that one builder writes: the nodes over leaves
    first to first + len(leaves) of a tree of n leaves, up to LEVELS levels."""

    def __init__(self, first: int, n: int, log: list[str]):
        self.first, self.n, self.log = first, n, log
        self.levels = counts(n)
        self.top = min(LEVELS, len(self.levels) - 1)
        self.start = place(0, first, n)

    @classmethod
    def built(cls, first: int, n: int, leaves: list[str]) -> Piece:
        piece = cls(first, n, [])
        open_: list[list[str]] = [[] for _ in range(piece.top + 1)]
        for i, leaf in enumerate(leaves, first + 1):
            node, level = leaf, 0
            while True:
                piece.log.append(node)
                open_[level].append(node)
                # A run is complete with its last child: the eighth, or the tree's last.
                if level == piece.top or (i % ARITY ** (level + 1) and i < n):
                    break
                node = digest(open_[level])
                open_[level] = []
                level += 1
        return piece

    def node(self, level: int, i: int) -> str:
        return self.log[place(level, i, self.n) - self.start]

    def root(self) -> str:
        return self.log[-1]

    def siblings(self, leaf: int) -> Iterator[tuple[int, list[str]]]:
        """Level by level: which child of its run leads to leaf, and the others."""
        for level in range(self.top):
            i = leaf // ARITY**level
            run = i // ARITY * ARITY
            others = [j for j in range(run, min(run + ARITY, self.levels[level])) if j != i]
            yield i - run, [self.node(level, j) for j in others]


def encoded(path: list[tuple[int, list[str]]]) -> str:
    """Steps of a proof as text: a digit for the place, then the siblings."""
    return ",".join(str(at) + "".join(others) for at, others in path)


def decoded(path: str) -> list[tuple[int, list[str]]]:
    return [(int(s[0]), [s[i : i + 64] for i in range(1, len(s), 64)]) for s in path.split(",")] if path else []


def folded(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf leads to over its siblings."""
    for at, others in path:
        leaf = digest([*others[:at], leaf, *others[at:]])
    return leaf


def part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (lang), doc_id, leaf and changed: the leaf that tampering leaves
    behind, null where the row is not tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    head = F.concat(*(part(F.col(c)) for c in COLUMNS[:-1]))
    leaf = F.sha2(F.concat(head, part(F.col("text"))), 256)
    other = F.sha2(F.concat(head, part(F.translate("text", _UPPER, _UPPER.lower()))), 256)
    return docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf.alias("leaf"), F.when(tampered, other).alias("changed"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, their place (from 0) in their tree, and n, its leaves. Stored."""
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    row = F.monotonically_increasing_id()
    made = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", row).withColumn("part", F.shiftright("row", 33)))
    # A row a sorted part and tree in it: the parts plus the trees in all.
    sizes = made.groupBy("tree", "part").agg(F.min("row").alias("least"), F.count("*").alias("held"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("least")).alias("shift"), F.sum("held").over(W.partitionBy("tree")).alias("n"))
    sizes = sizes.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), "shift", "n")
    out = made.join(sizes, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part")))
    return out.withColumn("i", F.col("row") + F.col("shift")).drop("row", "part", "_tree", "_part", "shift")


_TIER = "tree string, n bigint, block bigint, log array<string>, root string, ids array<bigint>, was array<string>, changed array<string>"
_ARROW = pa.schema(
    [("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("log", pa.list_(pa.string())), ("root", pa.string())]
    + [("ids", pa.list_(pa.int64())), ("was", pa.list_(pa.string())), ("changed", pa.list_(pa.string()))]
)


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("i")
    col = {c: rows.column(c).to_pylist() for c in ("tree", "n", "i", "leaf", "doc_id", "changed")}
    first, n = col["i"][0], col["n"][0]
    piece = Piece.built(first, n, col["leaf"])
    one = [col["tree"][0], n, first // SPAN, piece.log, piece.root(), col["doc_id"], col["leaf"], col["changed"]]
    return pa.Table.from_pydict(dict(zip(_ARROW.names, [[x] for x in one])), schema=_ARROW)


def tiers(rows: DataFrame) -> list[DataFrame]:
    """The log, a table a tier: a row is a piece of a tree's postorder with the
    leaves it was built from. rows: tree, i, n, leaf, doc_id, changed."""
    out, n = [], None
    while True:
        made = rows.withColumn("block", F.expr(f"i div {SPAN}")).groupBy("tree", "block")
        out.append(stored(made.applyInArrow(_build, _TIER)))
        if n is None:
            n = out[0].agg(F.max("n")).first()[0] or 0
        n = -(-n // SPAN)
        if n <= 1:
            return out
        # Trees that are complete stay behind; of the others, pieces become leaves.
        above = F.ceil(F.col("n") / SPAN).cast("bigint")
        none = F.lit(None)
        rows = out[-1].where(above > 1).select("tree", F.col("block").alias("i"), above.alias("n"), F.col("root").alias("leaf"), none.cast("bigint").alias("doc_id"), none.cast("string").alias("changed"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[str]]]:
    """Each piece with the proofs of its leaves: steps in it, then above it."""
    for batch in batches:
        for p in batch.to_pylist():
            first = p["block"] * SPAN
            piece = Piece(first, p["n"], p["log"])
            own = (encoded(list(piece.siblings(first + k))) for k in range(len(p["was"])))
            yield p, [",".join(s for s in (o, p["above"]) if s) for o in own]


_PATHS = "tree string, i bigint, path string, subroot string"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, steps in _steps(batches):
        m, first = len(steps), p["block"] * SPAN
        held = {"i": pa.array(range(first, first + m), pa.int64()), "path": steps, "subroot": pa.array([p["top"] or p["root"]] * m, pa.string())}
        yield pa.RecordBatch.from_pydict({"tree": pa.array([p["tree"]] * m, pa.string())} | held)


def handed_down(log: list[DataFrame]) -> DataFrame:
    """The lowest tier of a log, with what its pieces need from those above:
    above (steps from a piece's root to the tree's) and top (the tree's root,
    null where it is the piece's own). Read top down, a row a piece."""
    for k in range(len(log) - 1, -1, -1):
        if k == len(log) - 1:
            given = log[k].withColumn("above", F.lit("")).withColumn("top", F.lit(None).cast("string"))
        else:
            up = stored(given.mapInArrow(_paths, _PATHS))
            up = up.select(F.col("tree").alias("_tree"), F.col("i").alias("_i"), F.col("path").alias("above"), F.col("subroot").alias("top"))
            given = log[k].join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_i")), "left").drop("_tree", "_i").fillna("", ["above"])
    return given


def subroots(log: list[DataFrame]) -> DataFrame:
    """tree and root of every tree: the root of the piece that is its last."""
    return reduce(DataFrame.unionByName, [tier.where(F.col("n") <= SPAN).select("tree", "root") for tier in log])


_CHECKED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf's proof, and the root that the leaf or what tampering made of
    it leads to over the original siblings."""
    for p, steps in _steps(batches):
        beyond, root, subroot = decoded(p["beyond"]), p["whole"], p["top"] or p["root"]
        proof, again = [], []
        for leaf, changed, path in zip(p["was"], p["changed"], steps):
            path = decoded(path) + beyond
            proof.append(digest([d for _, others in path for d in others]))
            again.append(folded(leaf if changed is None else changed, path))
        m = len(steps)
        held = [pa.array(x, pa.string()) for x in (p["was"], [subroot] * m, [root] * m, proof, again)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p["ids"], pa.int64()), *held, pa.array([a == root for a in again])],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified. docs: doc_id, source, lang, n_chars, text."""
    ship(docs.sparkSession)
    log = tiers(placed(leaves(docs), ["doc_id", "leaf"]))
    # One leaf a tree, in the order of trees: the same steps again.
    trees = subroots(log).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("leaf"))
    trees = stored(placed(trees, ["lang"]))
    of_trees = trees.select("tree", "i", "n", "leaf", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("changed"))
    top = handed_down(tiers(of_trees)).mapInArrow(_paths, _PATHS).select("i", F.col("path").alias("beyond"), F.col("subroot").alias("whole"))
    top = stored(trees.select("i", F.col("lang").alias("_lang")).join(top, "i").drop("i"))
    # Stored: a row a tree, broadcast only where Spark finds it small.
    pieces = handed_down(log).join(top, F.col("tree").eqNullSafe(F.col("_lang")))
    return pieces.mapInArrow(_checked, _CHECKED)
