"""Removing repeated byte strings with externally sorted suffixes.

Every string of LENGTH bytes that starts at two places or more, in one text or
in two, is repeated; each byte that a repeated string covers is removed.

1. Each LENGTH-byte string picks an anchor: its leftmost GRAM bytes of least
   hash. Equal strings pick equal anchors, so a string can only be repeated if
   its anchor occurs twice. Strings in a row that picked the same place are one
   piece. Equal pieces of one anchor are repeats as they are; equal pieces that
   follow each other in a text, as in periodic text, are one row from the start.
2. One piece of each kind, where an anchor has several kinds, is cut by the
   anchor's distance into PARTS smaller pieces. All strings of such a piece
   share most of their bytes, and pieces are grouped by these (a hash of 96
   bits). So a phrase that is common in the corpus doesn't make a large group,
   unless whole strings are common, and then its pieces are equal again.
3. What is left are groups of different pieces. Whole groups fill a shard, in
   which the shared bytes of a group count as one letter, and extsort sorts its
   suffixes by external induction. Neighbours in the order whose common prefix
   is a whole string are repeats.

Keys are counted by aggregates that combine before the shuffle, and met again by
sort-merge joins over stored tables, which the adaptive skew join splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.extsort import mapped, suffix_order
from siftwork.llm.textbatch import Block, blocks, mix, powers
from siftwork.session import forget, ship, stored

LENGTH, GRAM = 200, 32
#: Distances between a string's start and its anchor's, and how many of them a smaller piece spans.
DISTANCES = LENGTH - GRAM + 1
SPAN = 43
#: Letters of a shard, and those that a task gets, about. A group that is larger is a shard of its own, and sorted from disk all the same.
SHARD_LETTERS, TASK_LETTERS = 1 << 20, 1 << 19
#: Bytes of text looked at in one step.
BLOCK = 1 << 19
_KEY = ["key", "key2"]
_KIND = ["like", "like2"]
_rng = np.random.Generator(np.random.PCG64(811))
_SECOND = _rng.integers(0, 2**64, 256, dtype=np.uint64)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Of each run of width values: the place of the first least one."""
    n = len(h) - width + 1
    # Values and places in one key: the low bits give way to the place within two runs.
    bits = np.uint64((2 * width).bit_length())
    pad = -len(h) % width
    key = np.concatenate([h >> bits << bits, np.full(pad, 2**64 - 1, np.uint64)])
    place = np.arange(len(key), dtype=np.uint64) % np.uint64(2 * width)
    # Leftmost of equals needs places that rise within any window: one numbering for each parity of the block.
    out = np.empty(n, np.int64)
    block = np.arange(n) // width
    for odd in (0, 1):
        k = (key | (place + np.uint64(odd * width)) % np.uint64(2 * width)).reshape(-1, width)
        down = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
        up = np.minimum.accumulate(k, axis=1).ravel()
        best = np.minimum(down[:n], up[width - 1 : width - 1 + n])
        own = block % 2 == odd
        at = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        out[own] = (block * width + at)[own]
    return out


class _Hashes:
    """Two hashes of any byte string of a block: 64 bits, and 32 of another sum."""

    def __init__(self, block: Block):
        n = len(block.buf)
        up, self.down = powers(n)
        self.first = block.sums()
        self.second = np.zeros(n + 1, np.uint64)
        np.cumsum(_SECOND[block.buf] * up[:n], out=self.second[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        down = self.down[start]
        a = mix((self.first[end] - self.first[start]) * down)
        b = mix((self.second[end] - self.second[start]) * down)
        return a, (b >> np.uint64(32)).astype(np.uint32)


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


_PIECES = "key bigint, key2 int, like bigint, like2 int, id bigint, h bigint, start int, n int, total int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces: n strings from byte start on picked the anchor; total: strings of
    this piece and its equals right behind it."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            b = Block(part.column("text"), lower=False)
            size = np.diff(b.off)
            if len(b.buf) < LENGTH:
                continue
            sums = _Hashes(b)
            at = np.arange(len(b.buf) - GRAM + 1)
            h = mix((sums.first[at + GRAM] - sums.first[at]) * sums.down[at])
            doc = np.repeat(np.arange(len(size)), size)
            best = _least(h, DISTANCES)
            start = np.flatnonzero(np.arange(len(best)) <= (b.off[1:] - LENGTH)[doc[: len(best)]])
            if not len(start):
                continue
            first = _first_of_each(best[start], doc[start])
            n = np.diff(np.append(first, len(start)))
            start, anchor, d = start[first], h[best[start[first]]], doc[start[first]]
            like, like2 = sums.of(start, start + n + LENGTH - 1)
            again = _first_of_each(anchor, like, like2, d)
            total = np.add.reduceat(n, again)
            start, d = start[again], d[again]
            own = part.select(["id", "h"]).take(pa.array(d))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[again].view(np.int64)), pa.array(np.zeros(len(again), np.int32)), pa.array(like[again].view(np.int64)), pa.array(like2[again].view(np.int32)),
                    *own.columns, pa.array((start - b.off[d]).astype(np.int32)), pa.array(n[again].astype(np.int32)), pa.array(total.astype(np.int32)),
                ],
                ["key", "key2", "like", "like2", "id", "h", "start", "n", "total"],
            )


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of some of a text's pieces, with what surrounds the bytes
    that all strings of their group share. width: letters of a string, shared bytes as one."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            b = Block(part.column("text"), lower=False)
            sums = _Hashes(b)
            met = part.column("met")
            off = met.offsets.to_numpy()
            flat = met.values
            f = {k: flat.field(k).to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64) for k in ("start", "n", "known")}
            doc = np.repeat(np.arange(part.num_rows), np.diff(off))
            begin = f["start"] + b.off[doc]
            # The anchor of a piece: the leftmost least gram of its first string.
            gram = begin[:, None] + np.arange(DISTANCES)
            h = mix((sums.first[gram + GRAM] - sums.first[gram]) * sums.down[gram])
            bits = np.uint64((2 * DISTANCES).bit_length())
            far = (h >> bits).argmin(axis=1)
            many = far // SPAN - (far - f["n"] + 1) // SPAN + 1
            which = np.repeat(np.arange(len(begin)), many)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            k = (far // SPAN)[which] - nth  # from the greatest distance down: starts rise
            lo, hi = k * SPAN, np.minimum((k + 1) * SPAN, DISTANCES)
            most = np.minimum(far[which], hi - 1)
            least = np.maximum((far - f["n"] + 1)[which], lo)
            place = (begin + far)[which]
            start, n = place - most, most - least + 1
            shared, shared_end = place - lo, place - hi + 1 + LENGTH
            key, key2 = sums.of(shared, shared_end)
            end = start + n + LENGTH - 1
            like, like2 = sums.of(start, end)
            raw = b.buf.tobytes()
            left = [raw[i:j] for i, j in zip(start.tolist(), shared.tolist(), strict=True)]
            right = [raw[i:j] for i, j in zip(shared_end.tolist(), end.tolist(), strict=True)]
            d = doc[which]
            own = part.select(["id", "h"]).take(pa.array(d))
            n32 = pa.array(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(key + k.astype(np.uint64)).view(np.int64)), pa.array(key2.view(np.int32)), pa.array(like.view(np.int64)), pa.array(like2.view(np.int32)),
                    *own.columns, pa.array((start - b.off[d]).astype(np.int32)), n32, n32,
                    pa.array(f["known"][which] > 0), pa.array((hi - lo).astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
                ],
                ["key", "key2", "like", "like2", "id", "h", "start", "n", "total", "known", "width", "left", "right"],
            )


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], n: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """Of each piece, which of its n strings also start elsewhere among the pieces
    of its group. A string has width letters: bytes, and one for the shared bytes."""
    a, b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    size = a + b + 2  # the shared letter, and a mark at the end
    off = np.cumsum(size) - size
    t = mapped(int(size.sum()) + 1, np.uint32)
    t[off + a] = 258 + group
    t[off + size - 1] = 1
    for x, many, begin in ((left, a, off), (right, b, off + a + 1)):
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        t[at] = np.frombuffer(b"".join(x), np.uint8).astype(np.uint32) + 2
    need = mapped(len(t), np.int32)
    need[np.repeat(off - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = np.repeat(width, n)
    repeated = mapped(len(t), bool)
    last = 0
    for at, same in suffix_order(t, 259 + int(group.max())):
        hit = (need[at] > 0) & (same >= need[at])
        repeated[at[hit]] = True
        repeated[np.append(last, at[:-1])[hit]] = True
        last = int(at[-1])
    return [np.asarray(repeated[o : o + m]) for o, m in zip(off.tolist(), n.tolist(), strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of strings that start at the sorted starts."""
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > LENGTH]))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1] + LENGTH


def _sorted_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, h, a, b): covered runs of a shard's pieces, whole groups."""
    group = rows.groupby(_KEY, sort=False).ngroup().to_numpy()
    found = repeated_starts(group, rows["left"].tolist(), rows["right"].tolist(), rows["n"].to_numpy(np.int64), rows["width"].to_numpy(np.int64))
    out = []
    for hits, once, i, h, start in zip(found, rows["once"], rows["id"], rows["h"], rows["start"], strict=True):
        if once and hits.any():
            a, b = _runs(np.flatnonzero(hits) + start)
            out.append((np.full(len(a), i), np.full(len(a), h), a, b))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("id", "h", "a", "b"), cols, strict=True)))


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of whole groups from a partition that is sorted by key."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch["n"].sum() + batch["width"].sum()) + len(batch)
        if size >= SHARD_LETTERS:
            rows = pd.concat(held, ignore_index=True)
            last = rows.iloc[-1]
            whole = int(((rows["key"] != last["key"]) | (rows["key2"] != last["key2"])).sum())  # the last group may go on
            if whole:
                yield _sorted_shard(rows.iloc[:whole])
                rows = rows.iloc[whole:].reset_index(drop=True)
            held = [rows]
            size = int(rows["n"].sum() + rows["width"].sum()) + len(rows)
    if held:
        rows = pd.concat(held, ignore_index=True)
        if len(rows):
            yield _sorted_shard(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, kept = [], []
        for data, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            raw = data.as_py() or b""
            spans: list[list[int]] = []
            for r in sorted((r["a"], r["b"]) for r in runs or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append([*r])
            at, left = 0, []
            for a, b in spans:
                left.append(raw[at:a])
                at = b
            rest = b"".join([*left, raw[at:]])
            kept.append(rest)
            out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _met(pieces: DataFrame, told: list) -> tuple[DataFrame, DataFrame]:
    """Of pieces (stored; deleted here): those with equals elsewhere, and one of each
    kind (count: places) where a key has several kinds. told collects what is
    stored on the way."""
    places = F.sum((F.col("total") / F.col("n")).cast("bigint"))
    kinds = [F.min(c) != F.max(c) for c in _KIND]
    keys = stored(pieces.groupBy(*_KEY).agg(places.alias("places"), (kinds[0] | kinds[1]).alias("mixed")).where("places > 1").drop("places"))
    met = stored(pieces.join(keys.hint("merge"), _KEY))
    forget(keys)
    forget(pieces)
    mixed = met.where("mixed")
    rest = [F.first(c).alias(c) for c in ("known", "width", "left", "right") if c in pieces.columns]
    one = F.min(F.struct("id", "h", "start", "n")).alias("one")
    by_kind = stored(mixed.groupBy(*_KEY, *_KIND).agg(places.alias("places"), one, *rest))
    again = mixed.join(by_kind.where("places > 1").select(*_KEY, *_KIND).hint("merge"), [*_KEY, *_KIND])
    told += [met, by_kind]
    a, b = F.col("start").cast("bigint").alias("a"), (F.col("start") + F.col("total") - 1 + LENGTH).cast("bigint").alias("b")
    return met.where("not mixed").select("id", "h", a, b).union(again.select("id", "h", a, b)), by_kind


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and kept (the remaining bytes; a cut may fall inside a character).

    Ids are integers. Null texts count as empty; texts under LENGTH bytes stay
    whole. Rows with a null id are treated as all others. A row that repeats, id
    and all, is elsewhere too: both lose what they share. Other columns of docs
    are not read, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    told: list[DataFrame] = []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.cast("binary").alias("text"))
    # A row is known by its id and a hash of id and text: hashes need to differ within an id only.
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("h"))
    pieces = stored(rows.select("id", "h", "text").mapInArrow(_anchors, _PIECES))
    covered, kinds = _met(pieces, told)
    # One text of each kind brings the bytes; bounded by a text's length.
    wanted = kinds.groupBy("one.id", "one.h").agg(F.collect_list(F.struct("one.start", "one.n", (F.col("places") > 1).alias("known"))).alias("met"))
    small = stored(
        rows.select("id", "h", "text").join(wanted.hint("merge"), ["id", "h"]).mapInArrow(_parted, _PIECES + ", known boolean, width int, left binary, right binary")
    )
    # A row that repeats brings its pieces again; their kinds are known to occur twice already.
    more, kinds = _met(small, told)
    shards = kinds.select(*_KEY, "one.id", "one.h", "one.start", "one.n", (~F.col("known") & (F.col("places") == 1)).alias("once"), "width", "left", "right")
    letters = shards.agg(F.sum(F.col("n") + F.col("width"))).first()[0] or 0
    sorted_ = shards.repartition(1 + letters // TASK_LETTERS, *_KEY).sortWithinPartitions(*_KEY).mapInPandas(_sorted, "id bigint, h bigint, a bigint, b bigint")
    runs = stored(covered.union(more).union(sorted_).groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("runs")))
    for t in told:
        forget(t)
    whole = rows.join(runs.hint("merge"), ["id", "h"], "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
