"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order, up to ORDER bytes deep:
every context holds the counts of the bytes seen after it. A byte unseen in a
context costs that context's escape probability (method C: distinct bytes
seen, over those plus all seen) and is then sought in the next shorter one,
without the bytes already excluded; below order 0 all 256 bytes are alike. The
statistics are counted over all learned texts and then frozen, so a byte's code
length depends on the bytes before it only, and a text's exact code length is a
sum of table entries.

All byte values are kept; A-Z count as a-z. A context is a node of the tree if it
stands for at least one in NODES of its language's bytes (all of order 0 and 1
are), so a tree has at most NODES nodes of any order. Children of a node are
never more frequent than it, so the tree has no holes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.textbatch import LOWER, blocks, unpack
from siftwork.session import forget, ship, stored

ORDER, NODES = 4, 4096
#: Entries that a task sums up before it hands them on.
PENDING = 1 << 20
#: A text whose best language needs more bits a byte than this is in none of them.
FOREIGN = 6.0


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids], bool)


def _learnable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Bytes and offsets of learned texts, language by language."""
    for batch in batches:
        for part in blocks(batch, "text"):
            part = part.filter(pa.array(~held_out(part.column("doc_id").to_pylist())))
            lang = part.column("lang")
            for name in pc.unique(lang).to_pylist():
                if name is not None:
                    buf, off = unpack(part.filter(pc.equal(lang, name)).column("text"))
                    yield name, LOWER[buf], off


def _codes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each byte: the ORDER bytes before it and itself, the last in the low
    bits. What lies before a text counts as byte 0."""
    at = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
    code = buf.astype(np.int64)
    for k in range(1, ORDER + 1):
        back = np.zeros(len(buf), np.int64)
        back[k:] = buf[:-k]
        back[at < k] = 0
        code |= back << 8 * k
    return code


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, which = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(which, np.concatenate(counts), len(code)).astype(np.int64)


def _contexts_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}
    pending = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for name, (codes, counts) in held.items():
            code, n = _summed(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    for name, buf, off in _learnable(batches):
        code, n = np.unique(_codes(buf, off), return_counts=True)
        codes, counts = held.setdefault(name, ([], []))
        codes.append(code)
        counts.append(n)
        pending += len(code)
        if pending > PENDING:
            held = {name: tuple([x] for x in _summed(*lists)) for name, lists in held.items()}
            pending = sum(len(codes[0]) for codes, _ in held.values())
            if pending > PENDING // 2:
                yield from rows()
                held, pending = {}, 0
    yield from rows()


class Table:
    """Rows of numbers by 64-bit keys: open addressing in numpy."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows = rows
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] < 0
            _, one = np.unique(s[free], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], put
            left = left[self.keys[s] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


def _low(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes cut to a byte and the order bytes before it."""
    return codes & ((1 << 8 * (order + 1)) - 1)


class Languages:
    """Frozen trees of all languages. For each order: bits of a byte after a
    context by language, where some language has seen it, and bits of a context's
    escape. Of either at most NODES contexts a language and order."""

    def __init__(self, names: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """counts: by order, (language number, code, n) of all nodes' entries."""
        self.names = names
        uniform = np.full((256, len(names)), 8.0, np.float32)
        self.seen, self.escapes = [Table(np.arange(256), uniform)], []
        for order, (lang, code, n) in enumerate(counts):
            self._grow(order, lang, code, n.astype(np.float64))

    def _grow(self, order: int, lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        context = code >> 8
        keys, at = np.unique(code, return_inverse=True)
        nodes, node = np.unique(context, return_inverse=True)
        shape = (len(nodes), len(self.names))
        cell = node * len(self.names) + lang
        # The same bytes one order up; below order 0 every byte alone.
        upper = self._bits(_low(code, order - 1) if order else code, order - 1)[np.arange(len(code)), lang]
        sums = lambda w: np.bincount(cell, w, shape[0] * shape[1])
        total, kinds, taken = sums(n), sums(np.ones(len(n))), sums(np.exp2(-upper.astype(np.float64)))
        escape = kinds / np.maximum(total + kinds, 1)
        lost = np.where(total > 0, np.log2(np.maximum(1 - taken, 1e-9)) - np.log2(np.maximum(escape, 1e-30)), 0).reshape(shape)
        self.escapes.append(Table(nodes, lost.astype(np.float32)))
        # Languages that have not seen the byte there escape, or have no such node.
        rows = self._bits(_low(keys, order - 1) if order else keys, order - 1) + lost[np.searchsorted(nodes, keys >> 8)].astype(np.float32)
        rows[at, lang] = -np.log2(n / total[cell] * (1 - escape[cell]))
        self.seen.append(Table(keys, rows))

    def _bits(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each code in each language, by contexts up to order."""
        low = codes & 255
        out = self.seen[0].rows[low]
        for k in range(order + 1):
            own = _low(codes, k)
            at = self.seen[k + 1].find(own)
            hit = at >= 0
            out[hit] = self.seen[k + 1].rows[at[hit]]
            miss = np.flatnonzero(~hit)
            node = self.escapes[k].find(own[miss] >> 8)
            some = node >= 0
            out[miss[some]] += self.escapes[k].rows[node[some]]
        return out

    def bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(off) - 1, len(self.names)))
        full = np.flatnonzero(np.diff(off))
        if len(full):
            each = self._bits(_codes(LOWER[buf], off), len(self.seen) - 2)
            out[full] = np.add.reduceat(each, off[full], axis=0, dtype=np.float64)
        return out


def _predicted(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        for part in blocks(batch, "text", 1 << 19):
            buf, off = unpack(part.column("text"))
            n = part.num_rows
            letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score, rate = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan)
            if model.names:
                bits = model.bits(buf, off)
                best = bits.argmin(axis=1)
                least = bits[np.arange(n), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                lang = np.where(letters, np.array(model.names, object)[best], "und")
                score = np.where(letters, share, 0.0)
                rate = np.where(np.diff(off) > 0, least / np.maximum(np.diff(off), 1), np.nan)
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held_out(ids.to_pylist())), pa.array(lang, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )


def learn_languages(docs: DataFrame) -> Languages:
    """Context trees of every language over all learned texts of docs (doc_id, text, lang)."""
    seen = stored(docs.mapInArrow(_contexts_seen, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    total = seen.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r[0] for r in total.collect())  # a row a language
    number = {name: i for i, name in enumerate(names)}
    counts = []
    for order in range(ORDER + 1):
        own = seen.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("code")).agg(F.sum("n").alias("n"))
        if order > 1:
            context = F.shiftright("code", 8).alias("context")
            nodes = own.groupBy("lang", context).agg(F.sum("n").alias("in_all")).join(F.broadcast(total), "lang")  # a row a language
            nodes = nodes.where(F.col("in_all") * NODES >= F.col("total")).select("lang", "context")  # NODES rows a language at most
            own = own.withColumn("context", context).join(F.broadcast(nodes), ["lang", "context"]).drop("context")
        got = own.select("lang", "code", "n").toArrow()  # entries of NODES contexts a language at most
        lang = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
        counts.append((lang, got.column("code").to_numpy().astype(np.int64), got.column("n").to_numpy()))
    forget(seen)
    return Languages(names, counts)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, bits_per_byte.

    Learns from texts with a language whose crc32(id as text) mod 4 is not 2.
    score is the best language's share of 2**-bits over all; of languages that
    tie, the first by name wins. Null texts and texts without a letter get und
    and 0, as do all texts when there is nothing to learn from. Repeated rows
    count and are predicted each; bits_per_byte is null for empty texts.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sent = spark.sparkContext.broadcast(learn_languages(rows))
    return rows.select("doc_id", "text").mapInArrow(
        lambda it: _predicted(it, sent), "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double"
    )


def reject_foreign(docs: DataFrame, most_bits: float = FOREIGN) -> DataFrame:
    """docs without the rows whose text is in no learned language: those without a
    letter, and those that the best language codes in over most_bits a byte.

    Each row is judged by itself: null and repeated ids make no difference, rows
    that repeat go or stay alike, all columns stay as they are. Without any
    learned text every row goes; an empty table stays empty.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn_languages(docs.select(F.col("doc_id").cast("bigint"), "text", "lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1 << 19):
                judged = next(_predicted(iter([part]), sent))
                foreign = pc.greater(pc.fill_null(judged.column("bits_per_byte"), 99.0), most_bits)
                yield part.filter(pc.invert(pc.or_(pc.equal(judged.column("lang_pred"), "und"), foreign)))

    return docs.mapInArrow(run, docs.schema)
