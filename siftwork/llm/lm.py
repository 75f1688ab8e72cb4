"""Scoring texts with a causal self-attention model over subword ids.

What the corpus gives, over all its training texts: counts of every word,
counts of every subword and the byte profile of the texts it stands in, counts
of which class follows which subword, and training windows: every text is cut
through, so that each of its subwords is a goal of one window.

The model: a subword's class is predicted from the last ones by one causal
self-attention layer on top of the log frequency of the class after the last
subword (numpy; trained by local Adam steps in every partition, whose parameters
are averaged each round; a round takes every ROUNDS-th window, so each is used),
and the subword within its class by
its frequency after the last subword, smoothed by its own frequency. Frequent subwords are classes of
their own; the others are clustered by byte profile, which separates languages
and scripts. Both factors sum to one, so a score is a probability of the
text's subword sequence and its end.

Scoring cuts each text into windows of SPAN subwords that overlap by SPAN-STEP;
a window scores its last STEP subwords, so each is scored once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.subwords import DEFAULT, encoding, vocabulary, word_ids
from siftwork.llm.textbatch import Block, blocks
from siftwork.session import ship, stored

SPAN, STEP, DIM = 32, 16, 16
CLASSES, OWN, INPUTS = 128, 104, 1024
ROUNDS, BATCH, RATE = 4, 128, 0.02
#: Windows that one task trains on, about, and the steps it takes at least (with few windows it takes them again).
WINDOWS_A_TASK, LEAST_STEPS = 65_536, 100
#: Bytes of text encoded, and windows scored at once.
BLOCK, WINDOWS = 1 << 20, 128
PROFILE = 8
#: At most so many words are held as a table by every task: those that make
#: up at least one in HEAD of all tokens can't be more. Rarer ones are joined.
HEAD = 1 << 18

_project = np.random.Generator(np.random.PCG64(9)).normal(size=(256, PROFILE)).astype(np.float32)


def held_out(ids: np.ndarray | list) -> np.ndarray:
    """Whether crc32 of the id as text leaves 2 when divided by 7."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def _encoded(part: pa.RecordBatch, ranks: bytes):
    """A block, its words' hashes and codes, and the subword ids of each code (flat, with offsets)."""
    b = Block(part.column("text"))
    b.words()
    h = b.hashes(b.starts, b.ends)
    codes, distinct = pd.factorize(h)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    raw = b.buf.tobytes()
    flat, size = word_ids(ranks, [raw[i:j] for i, j in zip(b.starts[first].tolist(), b.ends[first].tolist())])
    return b, codes, distinct, flat, size


def _spread(codes: np.ndarray, flat: np.ndarray, size: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of whole texts, each between two end marks, and their offsets."""
    begin = np.cumsum(size) - size
    many = size[codes]
    upto = np.concatenate([[0], np.cumsum(many)])
    n_docs = len(first) - 1
    doc_of_word = np.repeat(np.arange(n_docs), np.diff(first))
    out = np.full(int(upto[-1]) + 2 * n_docs, end, np.int32)
    src = np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[codes], many)
    out[np.arange(upto[-1]) + np.repeat(2 * doc_of_word + 1, many)] = flat[src]
    return out, upto[first] + 2 * np.arange(n_docs + 1)


def _rows(kind: int, key, n, v=None) -> pa.RecordBatch:
    key = np.asarray(key)
    if v is None:
        values = pa.nulls(len(key), pa.list_(pa.float32()))
    else:
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.astype(np.int64)), pa.array(np.asarray(n, np.int64)), values], ["kind", "key", "n", "v"])


def _gather(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n, v): 0 words, 1 subwords with profile sums."""
    ranks = sent.value
    end = encoding(ranks).n_vocab
    many = np.zeros(end + 1, np.int64)
    profile = np.zeros((end + 1, PROFILE), np.float64)
    words: list[pd.Series] = []
    pending = 0

    def sums() -> pd.Series:
        x = pd.concat(words)
        words.clear()
        return x.groupby(level=0).sum()

    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            ids = part.column("doc_id").to_pylist()
            part = part.filter(pa.array(~held_out(ids)))
            if not part.num_rows:
                continue
            b, codes, distinct, flat, size = _encoded(part, ranks)
            n_docs = part.num_rows
            n = np.bincount(codes, minlength=len(distinct))
            words.append(pd.Series(n, distinct.view(np.int64)))
            pending += len(n)
            bytes_of = np.repeat(np.arange(n_docs), np.diff(b.off))
            seen = np.bincount(bytes_of * 256 + b.buf, minlength=256 * n_docs).reshape(n_docs, 256).astype(np.float32)
            p = seen @ _project / np.maximum(seen.sum(axis=1, keepdims=True), 1)
            # A subword stands where its word stands: sums by word, then by the words' subwords. Each text has an end.
            word = np.repeat(np.arange(len(distinct)), size)
            many += np.bincount(flat, n[word], end + 1).astype(np.int64)
            many[end] += n_docs
            doc = np.repeat(np.arange(n_docs), np.diff(b.first))
            for k in range(PROFILE):
                of_word = np.bincount(codes, p[doc, k], len(distinct))
                profile[:, k] += np.bincount(flat, of_word[word], end + 1)
            profile[end] += 2 * p.sum(0, dtype=np.float64)  # a mark before the text, too
            if pending > 500_000:
                x = sums()
                yield _rows(0, x.index, x)
                pending = 0
    if words:
        x = sums()
        yield _rows(0, x.index, x)
    at = np.flatnonzero(many)
    if len(at):
        yield _rows(1, at, many[at], profile[at])


def _sequences(batches: Iterator[pa.RecordBatch], sent, sent_model) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n, v): 0 counts of a class after an input, 1 windows,
    2 counts of a frequent subword after a frequent one."""
    ranks, model = sent.value, sent_model.value
    after = np.zeros((INPUTS + CLASSES) * CLASSES, np.int64)
    next_ = np.zeros(INPUTS * INPUTS, np.int64)
    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            part = part.filter(pa.array(~held_out(part.column("doc_id").to_pylist())))
            if not part.num_rows:
                continue
            b, codes, _, flat, size = _encoded(part, ranks)
            seq, off = _spread(codes, flat, size, b.first, model.end)
            n_docs = part.num_rows
            pair = model.inputs[seq[:-1]].astype(np.int64) * CLASSES + model.cls[seq[1:]]
            inside = np.ones(len(pair), bool)
            inside[off[1:-1] - 1] = False
            after += np.bincount(pair[inside], minlength=len(after))
            a, y = model.inputs[seq[:-1]], model.inputs[seq[1:]]
            inside &= (a < INPUTS) & (y < INPUTS)
            next_ += np.bincount(a[inside].astype(np.int64) * INPUTS + y[inside], minlength=len(next_))
            # Windows lie end to end; the last one of a text is filled up with -1.
            length = np.diff(off)
            wins = -(-(length - 1) // SPAN)
            of = np.repeat(np.arange(n_docs), wins)
            start = SPAN * (np.arange(len(of)) - np.repeat(np.cumsum(wins) - wins, wins))
            at = start[:, None] + np.arange(SPAN + 1)
            win = np.where(at < length[of][:, None], seq[np.minimum(off[of][:, None] + at, len(seq) - 1)], -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(win) + 1, dtype=np.int32) * (SPAN + 1)), pa.array(win.astype(np.int32).ravel()))
            none = np.zeros(len(win), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(win), 1, np.int8)), pa.array(none), pa.array(none), lists], ["kind", "key", "n", "w"])
    for kind, n in ((0, after), (2, next_)):
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array(at), pa.array(n[at]), pa.nulls(len(at), pa.list_(pa.int32()))], ["kind", "key", "n", "w"])


class Model:
    """Parameters, classes and tables; small and of fixed size (a few MB)."""

    def __init__(self, many: np.ndarray, profile: np.ndarray):
        self.end = len(many) - 1
        n = many.astype(np.float64) + 1
        order = np.argsort(-n, kind="stable")
        cls = np.full(len(n), -1, np.int64)
        own = [self.end, *[i for i in order[:OWN] if i != self.end][: OWN - 1]]
        cls[own] = np.arange(len(own))
        rest = np.flatnonzero(cls < 0)
        k = CLASSES - OWN
        x = profile[rest] / n[rest, None]
        at = np.linspace(0, len(rest) - 1, k).astype(int)
        centres = x[np.argsort(-n[rest], kind="stable")[at // max(len(rest) // (k * 4), 1)]] + np.arange(k)[:, None] * 1e-9
        for _ in range(12):
            near = np.argmin((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), axis=1)
            w = np.bincount(near, n[rest], k)
            for d in range(x.shape[1]):
                s = np.bincount(near, n[rest] * x[:, d], k)
                centres[:, d] = np.where(w > 0, s / np.maximum(w, 1e-9), centres[:, d])
        cls[rest] = OWN + near
        self.cls = cls.astype(np.int32)
        mass = np.bincount(cls, n, CLASSES)
        self.within = np.log(n / mass[cls]).astype(np.float32)
        # Inputs: the most frequent subwords, then a shared row per class.
        inputs = INPUTS + cls
        inputs[order[:INPUTS]] = np.arange(min(INPUTS, len(order)))
        self.inputs = inputs.astype(np.int32)
        rng = np.random.Generator(np.random.PCG64(1))
        rows = INPUTS + CLASSES + 1  # the last row fills windows up
        small = lambda *s: (rng.normal(size=s) * 0.2).astype(np.float32)
        self.p = {
            "E": small(rows, DIM), "Q": small(DIM, DIM), "K": small(DIM, DIM), "V": small(DIM, DIM),
            "O": small(DIM, CLASSES) * 0.1, "b": np.zeros(CLASSES, np.float32), "r": np.zeros(SPAN, np.float32),
        }
        self.share = np.maximum(mass, 1e-9) / mass.sum()  # a cluster may be empty
        self.follow(np.zeros((INPUTS + CLASSES, CLASSES)), np.zeros((INPUTS, INPUTS)))

    def follow(self, after: np.ndarray, next_: np.ndarray) -> None:
        """Log frequency of each class after each input, smoothed by the class's own,
        and of each subword within its class after a frequent subword."""
        p = (after + 4 * self.share) / (after.sum(1, keepdims=True) + 4)
        self.after = np.log(np.vstack([p, self.share])).astype(np.float32)
        ids = np.zeros(INPUTS, np.int64)
        frequent = np.flatnonzero(self.inputs < INPUTS)
        ids[self.inputs[frequent]] = frequent
        cls = self.cls[ids]
        of_class = np.zeros((INPUTS, CLASSES))
        for c in range(CLASSES):
            of_class[:, c] = next_[:, cls == c].sum(1)
        #: What all subwords of a class get, and what a frequent one gets beyond it: logs.
        self.left = np.log(2 / (of_class + 2)).astype(np.float32)
        own = 2 * np.exp(self.within[ids].astype(np.float64))
        self.gain = np.log((next_ + own) / own).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def _near(self) -> np.ndarray:
        """STEP by SPAN: exp of the distance's bias, 0 for what lies ahead."""
        back = (np.arange(STEP) + SPAN - STEP)[:, None] - np.arange(SPAN)
        return np.where(back >= 0, np.exp(np.clip(self.p["r"], -20, 20))[np.maximum(back, 0)], 0).astype(np.float32)

    def train(self, windows: np.ndarray, steps: int, seed: int) -> None:
        """Adam over windows of SPAN + 1 ids (-1: none), one order of all after the other."""
        p, rng = self.p, np.random.Generator(np.random.PCG64(seed))
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        back = np.arange(SPAN)[:, None] - np.arange(SPAN)
        gap, root = INPUTS + CLASSES, np.float32(1 / np.sqrt(DIM))
        ones, each = np.ones(CLASSES, np.float32), np.arange(BATCH * SPAN)
        # What is as wide as the classes is written in place: two of these are what a step's memory is.
        wide = np.empty((2, BATCH * SPAN, CLASSES), np.float32)
        order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-steps * BATCH // len(windows)))])
        for t in range(1, steps + 1):
            w = windows[order[(t - 1) * BATCH : t * BATCH]]
            real = w >= 0
            ids = np.where(real, self.inputs[np.maximum(w, 0)], gap)[:, :SPAN]
            goal = w[:, 1:].ravel()
            asked = (goal >= 0).astype(np.float32)
            n_asked, n = np.float32(asked.sum()), len(goal)
            if not n_asked:
                continue
            # Each place of a window is a query that sees the window's places up to its own.
            flat = p["E"].take(ids.ravel(), 0)
            x = flat.reshape(len(w), SPAN, DIM)
            q, key, val = ((flat @ p[k]).reshape(x.shape) for k in "QKV")
            q *= root
            a = q @ key.transpose(0, 2, 1)
            np.exp(np.clip(a, -30, 30, out=a), out=a)
            a *= np.where(back >= 0, np.exp(np.clip(p["r"], -20, 20))[np.maximum(back, 0)], 0).astype(np.float32)
            if (real[:, 1:] & ~real[:, :-1]).any():  # gaps at a window's end are ahead of all that asks
                a *= real[:, None, :SPAN]
            a *= (1 / (a.reshape(-1, SPAN) @ ones[:SPAN] + np.float32(1e-9))).reshape(len(w), SPAN, 1)
            seen = (a @ val).reshape(-1, DIM)
            h = flat + seen
            z = np.matmul(h, p["O"], out=wide[0, :n])
            z += (self.after + p["b"]).take(ids.ravel(), 0, out=wide[1, :n], mode="clip")
            top = z.max()
            if abs(top) > 60:
                z -= top
            np.exp(z, out=z)
            z *= (asked / ((z @ ones + np.float32(1e-30)) * n_asked))[:, None]
            z[each[:n], self.cls[np.maximum(goal, 0)]] -= asked / n_asked
            g = {"O": h.T @ z, "b": np.ones(n, np.float32) @ z}
            dflat = z @ p["O"].T
            dh = dflat.reshape(x.shape)
            da, dv = dh @ val.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dh
            da -= (dflat * seen).sum(1).reshape(len(w), SPAN, 1)
            da *= a
            of_place = (np.ones(len(w), np.float32) @ da.reshape(len(w), -1)).reshape(SPAN, SPAN)
            g["r"] = np.bincount(np.maximum(back, 0).ravel(), np.where(back >= 0, of_place, 0).ravel(), SPAN).astype(np.float32)
            dq, dk, dv = (d.reshape(-1, DIM) for d in (da @ key, da.transpose(0, 2, 1) @ q, dv))
            dq *= root
            g["Q"], g["K"], g["V"] = flat.T @ dq, flat.T @ dk, flat.T @ dv
            dx = dflat + dq @ p["Q"].T
            dx += dk @ p["K"].T
            dx += dv @ p["V"].T
            g["E"] = np.zeros_like(p["E"])
            short = ids.ravel().astype(np.int16)
            by_id = np.argsort(short, kind="stable")
            own = short[by_id]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            g["E"][own[first]] = np.add.reduceat(dx.take(by_id, 0), first)
            rate = RATE * min(1, t / 10) * (1 - 0.9 * t / steps)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.98 * v[k] + 0.02 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.98**t)) + 1e-7)).astype(np.float32)

    def tables(self) -> None:
        """Queries, keys and values of every input."""
        p = self.p
        gap = INPUTS + CLASSES
        e = p["E"]
        self.tq, self.tk, self.tv = e @ p["Q"] / np.float32(np.sqrt(DIM)), e @ p["K"], e @ p["V"]
        self.tk[gap] = 0
        self.tv[gap] = 0
        # A last column of ones, 0 for the gap: sums of weights come with the values, and gaps weigh nothing.
        ones = np.ones((len(self.tv), 1), np.float32)
        ones[gap] = 0
        self.tv = np.hstack([self.tv, ones])
        self.near = self._near()
        self.last = self.after + p["b"] + e @ p["O"]  # what the last subword alone says
        size = lambda x, axis: float(np.linalg.norm(x, axis=axis).max())
        # Where these bounds hold, no exp can overflow, and none needs its row's maximum.
        self.tame_scores = size(self.tq, 1) * size(self.tk, 1) <= 30
        self.tame = size(self.tv[:, :DIM], 1) * size(p["O"], 0) + float(self.last.max()) <= 60

    def score(self, seq: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Natural log probability of each text: seq holds its ids between two end marks."""
        n_docs, lead = len(off) - 1, SPAN - STEP
        asked = np.diff(off) - 1  # the last mark is a goal only
        # Every text stands behind lead gaps, so that no window looks into another text.
        doc = np.repeat(np.arange(n_docs), np.diff(off))
        place = np.arange(len(seq)) + lead * (doc + 1)
        given = np.full(len(seq) + lead * n_docs + 2 * SPAN, INPUTS + CLASSES, np.intp)
        goal = np.zeros(len(given), np.intp)
        given[place] = self.inputs[seq]
        goal[place - 1] = self.cls[seq]
        wins = -(-asked // STEP)
        of = np.repeat(np.arange(n_docs), wins)
        first = STEP * (np.arange(len(of)) - np.repeat(np.cumsum(wins) - wins, wins))
        start = place[off[:-1][of]] + first - lead
        left = asked[of] - first  # goals from here to the text's end
        total = np.zeros(n_docs)
        keys, ones = np.arange(SPAN), np.ones(CLASSES, np.float32)
        rows = np.arange(WINDOWS * STEP) * CLASSES
        for i in range(0, len(of), WINDOWS):
            at = start[i : i + WINDOWS, None] + keys
            ids = given.take(at)
            last = ids[:, lead:]
            a = np.matmul(self.tq.take(last, 0), self.tk.take(ids, 0).transpose(0, 2, 1))
            if not self.tame_scores:
                np.clip(a, -30, 30, out=a)
            np.exp(a, out=a)
            a *= self.near
            h = np.matmul(a, self.tv.take(ids, 0))
            h = (h[..., :DIM] / (h[..., DIM:] + np.float32(1e-9))).reshape(-1, DIM)
            logits = self.last.take(last.ravel(), 0)
            logits += h @ self.p["O"]
            if not self.tame:
                logits -= logits.max(1, keepdims=True)
            own = logits.ravel().take(rows[: len(logits)] + goal.take(at[:, lead:]).ravel())
            np.exp(logits, out=logits)
            got = (own - np.log(logits @ ones)).reshape(-1, STEP)
            got *= np.arange(STEP) < left[i : i + WINDOWS, None]
            total += np.bincount(of[i : i + WINDOWS], got.sum(1), n_docs)
        # Each subword within its class, after the last one.
        a, y = self.inputs[seq[:-1]], seq[1:]
        more = self.within[y]
        tracked = a < INPUTS
        more += np.where(tracked, self.left[np.minimum(a, INPUTS - 1), self.cls[y]], 0)
        z = self.inputs[y]
        both = np.flatnonzero(tracked & (z < INPUTS))
        more[both] += self.gain[a[both], z[both]]
        inside = np.ones(len(more), bool)
        inside[off[1:-1] - 1] = False
        return total + np.bincount(doc[1:][inside], more[inside], n_docs)


def _train(batches: Iterator[pa.RecordBatch], sent, round_: int) -> Iterator[pa.RecordBatch]:
    """One task's parameters after its steps, times its number of windows."""
    windows, seen = [], 0
    for b in batches:
        if b.num_rows:
            windows.append(b.column("w").flatten().to_numpy().reshape(-1, SPAN + 1)[(round_ - seen) % ROUNDS :: ROUNDS].copy())
            seen += b.num_rows
    w = np.concatenate(windows) if windows else np.zeros((0, SPAN + 1), np.int32)
    if not len(w):
        return
    model = sent.value
    before = model.flat()
    model.train(w, max(-(-len(w) // BATCH), LEAST_STEPS), 1000 * round_ + TaskContext.get().partitionId())
    flat = model.flat()
    model.load(before)
    rows = np.append(flat.astype(np.float64), 1.0) * len(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows)], ["i", "x"])


def _score(batches: Iterator[pa.RecordBatch], sent_ranks, sent_model, sent_head, divisor: float) -> Iterator[pa.RecordBatch]:
    ranks, model, (keys, counts, ends) = sent_ranks.value, sent_model.value, sent_head.value
    if not hasattr(model, "tq"):
        model.tables()
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in blocks(batch, "text", BLOCK):
            b, codes, distinct, flat, size = _encoded(part, ranks)
            n = part.num_rows
            seq, off = _spread(codes, flat, size, b.first, model.end)
            score = model.score(seq, off) / np.log(10)
            at = np.searchsorted(keys, distinct)
            at[at == len(keys)] = 0
            head = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
            c = np.where(head, counts[at], 0) if len(keys) else np.zeros(len(distinct), np.int64)
            word_log = np.log10((c + 1) / divisor)
            doc = np.repeat(np.arange(n), np.diff(b.first))
            common = head[codes]
            base = np.bincount(doc[common], word_log[codes[common]], n) + np.log10((ends + 1) / divisor)
            known = np.bincount(doc[common], minlength=n) + int(ends > 0)
            # Rare words: one row a text and word, to be joined with their counts.
            rare = np.flatnonzero(~common)
            key = doc[rare] * np.int64(len(distinct)) + codes[rare]
            key, tf = np.unique(key, return_counts=True)
            rdoc, rcode = (key // len(distinct), key % len(distinct)) if len(key) else (key, key)
            offsets = pa.array(np.searchsorted(rdoc, np.arange(n + 1)).astype(np.int32))
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    ids,
                    pa.array(held_out(ids.to_pylist())),
                    pa.array(np.diff(b.first) + 1),
                    pa.array(known.astype(np.int64)),
                    pa.array(base),
                    pa.array(score),
                    pa.ListArray.from_arrays(offsets, pa.array(distinct.view(np.int64)[rcode])),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "tfs"],
            )
            row += n


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram) and score (the attention model), log10.

    Texts whose crc32(id as text) mod 7 is 2 are held out of all learning; null
    ids are learned from. Null texts count as empty: their end is their one
    token. With no training text the unigram gives 0 and the model stays at its
    start. Repeated rows are scored each, and learned from each.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    ranks = vocabulary(spark, tokenizer)
    end = encoding(ranks).n_vocab
    sent_ranks = sc.broadcast(ranks)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    raw = rows.mapInArrow(lambda it: _gather(it, sent_ranks), "kind tinyint, key bigint, n bigint, v array<float>")
    cols = [F.sum(F.col("v")[k].cast("double")).alias(f"v{k}") for k in range(PROFILE)]
    facts = stored(raw.groupBy("kind", "key").agg(F.sum("n").alias("n"), *cols))
    sub = facts.where("kind = 1").select("key", "n", *[f"v{k}" for k in range(PROFILE)]).toArrow()  # a row a subword at most
    many, profile = np.zeros(end + 1, np.int64), np.zeros((end + 1, PROFILE))
    at = sub.column("key").to_numpy()
    many[at] = sub.column("n").to_numpy()
    for k in range(PROFILE):
        profile[at, k] = sub.column(f"v{k}").to_numpy()
    words = facts.where("kind = 0").select(F.col("key").alias("word"), "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = int(many[end])
    tokens, vocab = total + ends, distinct + int(ends > 0)
    divisor = float(tokens + vocab + 1)

    model = Model(many, profile)
    sent_model = sc.broadcast(model)
    raw = stored(rows.mapInArrow(lambda it: _sequences(it, sent_ranks, sent_model), "kind tinyint, key bigint, n bigint, w array<int>"))
    pairs = raw.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # a row an input and class at most
    after = np.zeros((INPUTS + CLASSES) * CLASSES)
    after[pairs.column("key").to_numpy()] = pairs.column("n").to_numpy()
    pairs = raw.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # a row a pair of frequent subwords at most
    next_ = np.zeros(INPUTS * INPUTS)
    next_[pairs.column("key").to_numpy()] = pairs.column("n").to_numpy()
    model.follow(after.reshape(-1, CLASSES), next_.reshape(INPUTS, INPUTS))
    windows = raw.where("kind = 1").select("w")
    windows = windows.coalesce(1 + windows.count() // WINDOWS_A_TASK)
    for r in range(ROUNDS):
        sent = sc.broadcast(model)
        summed = windows.mapInArrow(lambda it, s=sent, r=r: _train(it, s, r), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x"))
        got = summed.toArrow()  # a row a parameter
        if got.num_rows:
            x = np.zeros(got.num_rows)
            x[got.column("i").to_numpy()] = got.column("x").to_numpy()
            model.load(x[:-1] / x[-1])

    head = words.where(F.col("n") * HEAD >= max(tokens, 1)).toArrow()  # HEAD rows at most
    keys, counts = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(keys)
    sent_head, sent_model = sc.broadcast((keys[order], counts[order], ends)), sc.broadcast(model)
    scored = stored(
        rows.mapInArrow(
            lambda it: _score(it, sent_ranks, sent_model, sent_head, divisor),
            "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, words array<bigint>, tfs array<bigint>",
        )
    )
    rare = scored.select("row", F.explode(F.arrays_zip("words", "tfs")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.tfs").alias("tf"))
    rare = (
        rare.join(words.where(F.col("n") * HEAD < max(tokens, 1)), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(divisor))).alias("rare_base"),
        )
    )
    return scored.drop("words", "tfs").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
