"""External induced sorting of suffixes with their common prefixes.

A suffix is of type S if it is less than the one that starts one letter later,
else of type L. Seeds are the S suffixes that follow an L suffix. Once the
seeds are in order, one scan upwards induces the order of all L suffixes and
one scan downwards that of all S suffixes: the scan takes suffix tuples from a
priority queue and puts the tuple of the suffix one letter earlier back in.

A tuple is (code, place, common prefix). The code is the letter and whether the
scan began with the tuple or induced it; tuples of one code leave in the order
in which they came. The common prefix of two neighbours of one letter is one
more than the least common prefix between the suffixes they were induced from,
so each tuple carries that least value, and the order comes out with the common
prefixes of all neighbours.

The seeds' order comes from the same two scans over unordered seeds: these sort
the pieces between seeds, and their common prefixes tell which pieces are equal.
Pieces are named by rank, and the sequence of names is sorted by recursion, on
the same queues, until all names differ.

Queues keep what exceeds their budget in a scratch file, in buckets of codes,
and fetch one bucket at a time. Sequences and orders over a budget lie in
scratch files that are mapped into memory. So a task holds the same few
megabytes however large its shard is. Scratch files have no name and go with
the task; a task that is run again starts afresh.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np

#: Bytes of tuples that one queue or spool holds in memory; bytes from which an array is mapped from a file.
QUEUE_BYTES, MAP_BYTES = 2 << 20, 8 << 20
#: Tuples of a bucket of several codes, most tuples in one step of a scan, letters looked at in one step elsewhere.
BUCKET, STEP, PART = 2048, 16_384, 1 << 20
#: Tuples taken one by one where steps are short.
FEW = 256
FAR = np.iinfo(np.int32).max
TUPLE = np.dtype([("code", "<i4"), ("at", "<i4"), ("same", "<i4")])


def mapped(n: int, dtype) -> np.ndarray:
    """An array of zeros; a large one lies in a scratch file."""
    size = n * np.dtype(dtype).itemsize
    if size <= MAP_BYTES:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(size)
        return np.memmap(f, dtype, "r+", shape=(n,)).view(np.ndarray)


class Scratch:
    """Pieces of arrays in one nameless file, opened when first needed."""

    def __init__(self):
        self.file, self.written = None, 0

    def put(self, rows: np.ndarray) -> tuple[int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(rows.tobytes())
        self.written += rows.nbytes
        return at, len(rows)

    def get(self, piece: tuple[int, int], dtype: np.dtype) -> np.ndarray:
        self.file.seek(piece[0])
        return np.frombuffer(self.file.read(piece[1] * dtype.itemsize), dtype)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Spool:
    """Rows written once and read once, forwards or backwards."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.pieces, self.held, self.scratch, self.rows = dtype, [], 0, Scratch(), 0

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            self.rows += len(rows)
            if self.held + rows.nbytes > QUEUE_BYTES:
                self.pieces.append(self.scratch.put(rows))
            else:
                self.held += rows.nbytes
                self.pieces.append(rows)

    def read(self, backwards: bool = False) -> Iterator[np.ndarray]:
        for x in reversed(self.pieces) if backwards else self.pieces:
            x = self.scratch.get(x, self.dtype) if isinstance(x, tuple) else x
            yield x[::-1] if backwards else x
        self.pieces = []
        self.scratch.close()


class TupleQueue:
    """A priority queue of tuples by code, first in first out within a code.

    A tuple put in never has a lower code than the last one taken out. many:
    how many tuples each code will have. Codes are dealt into buckets: a code of
    over BUCKET tuples has its own, which is read piece by piece; others share
    one that is sorted when its turn comes.
    """

    def __init__(self, many: np.ndarray):
        alone = many > BUCKET
        upto = np.cumsum(np.where(alone, 0, many)) // BUCKET
        new = np.ones(len(many), bool)
        new[1:] = (upto[1:] != upto[:-1]) | alone[1:] | alone[:-1]
        self.bucket_of = (np.cumsum(new) - 1).astype(np.int32)
        self.alone = alone[new]
        self.pieces: list[list] = [[] for _ in range(len(self.alone))]
        self.scratch, self.held = Scratch(), 0
        self.late: list[np.ndarray] = []
        self.n_late = 0
        self.now, self.front, self.taken = -1, np.zeros(0, TUPLE), 0

    def push(self, rows: np.ndarray) -> None:
        """rows: tuples sorted by code."""
        if not len(rows):
            return
        own = int(np.searchsorted(self.bucket_of[rows["code"]], self.now, "right")) if self.now >= 0 else 0
        if own:
            mine, rows = rows[:own], rows[own:]
            if self.alone[self.now]:
                self._keep(self.now, mine)
            else:
                left = self.front[self.taken :]
                self.front = np.insert(left, np.searchsorted(left["code"], mine["code"], "right"), mine)
                self.taken = 0
        if len(rows):
            self.late.append(rows)
            self.n_late += len(rows)
            if self.n_late > 16 * BUCKET:
                self._deal()

    def _deal(self) -> None:
        if self.n_late:
            rows = np.concatenate(self.late)
            self.late, self.n_late = [], 0
            b = self.bucket_of[rows["code"]]
            order = np.argsort(b, kind="stable")
            b = b[order]
            cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self._keep(int(b[i]), rows[order[i:j]])

    def _keep(self, b: int, rows: np.ndarray) -> None:
        if self.held + rows.nbytes > QUEUE_BYTES:
            self.pieces[b].append(self.scratch.put(rows))
        else:
            self.held += rows.nbytes
            self.pieces[b].append(rows)

    def _fetch(self, piece) -> np.ndarray:
        if isinstance(piece, tuple):
            return self.scratch.get(piece, TUPLE)
        self.held -= piece.nbytes
        return piece

    def peek(self, most: int) -> np.ndarray:
        """The next tuples, sorted; none if the queue is empty."""
        while self.taken >= len(self.front):
            if self.now >= 0 and self.alone[self.now] and self.pieces[self.now]:
                self.front, self.taken = self._fetch(self.pieces[self.now].pop(0)), 0
                continue
            self._deal()
            b = self.now + 1
            while b < len(self.pieces) and not self.pieces[b]:
                b += 1
            if b >= len(self.pieces):
                return self.front[:0]
            self.now = b
            if not self.alone[b]:
                rows = np.concatenate([self._fetch(p) for p in self.pieces[b]])
                self.pieces[b] = []
                self.front, self.taken = rows[np.argsort(rows["code"], kind="stable")], 0
        return self.front[self.taken : self.taken + most]

    def take(self, k: int) -> None:
        self.taken += k


def _parts(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, PART):
        yield a, min(a + PART, n)


def rising(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last one is."""
    n = len(t)
    out = mapped(n, bool)
    out[n - 1] = True
    for a, b in reversed(list(_parts(n - 1))):
        x = np.asarray(t[a : b + 1])
        turn = x[1:] != x[:-1]
        i = np.arange(b - a)
        nxt = np.minimum.accumulate(np.where(turn, i, b - a)[::-1])[::-1]
        ends = np.append(x[:-1] < x[1:], out[b])
        out[a:b] = ends[nxt]
    return out


def runs(t: np.ndarray, at: np.ndarray, most: int = FAR) -> np.ndarray:
    """How many equal letters start at each place."""
    out = np.ones(len(at), np.int32)
    live, k = np.arange(len(at)), 1
    while len(live) and k < most:
        x = at[live].astype(np.int64)
        live = live[(x + k < len(t)) & (t[np.minimum(x + k, len(t) - 1)] == t[x])]
        out[live] += 1
        k += 1
    return out


class Least:
    """Least values of ranges of an array: minima of all runs of 1, 2, 4 ... values."""

    def __init__(self, x: np.ndarray):
        levels = max(len(x), 1).bit_length()
        self.table = np.empty((levels, len(x)), x.dtype)
        self.table[0] = x
        for k in range(1, levels):
            half = 1 << k - 1
            self.table[k, : len(x) - 2 * half + 1] = np.minimum(self.table[k - 1, : len(x) - 2 * half + 1], self.table[k - 1, half : len(x) - half + 1])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of x[low..high], both included; low <= high."""
        level = np.frexp(high - low + 1.0)[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level) + 1])


class Since:
    """Least values of a growing sequence since given times: its suffix minima."""

    def __init__(self):
        self.times, self.values, self.n = [-1], [-1], 0

    def add(self, value: int) -> None:
        values = self.values
        while values[-1] >= value:
            values.pop()
            self.times.pop()
        values.append(value)
        self.times.append(self.n)
        self.n += 1

    def extend(self, values: np.ndarray) -> None:
        after = np.append(np.minimum.accumulate(values[::-1])[::-1], FAR)
        least = int(after[0])
        while self.values[-1] >= least:
            self.values.pop()
            self.times.pop()
        new = np.flatnonzero(values < after[1:])
        self.values += values[new].tolist()
        self.times += (new + self.n).tolist()
        self.n += len(values)

    def least(self, time: int) -> int:
        """Of all values after that time; there is one at least."""
        return self.values[bisect_right(self.times, time)]

    def least_all(self, times: np.ndarray) -> np.ndarray:
        """The same for many times; FAR where no value came after."""
        return np.append(self.values, FAR)[np.searchsorted(self.times, times, "right")]


def _scan(t: np.ndarray, up: np.ndarray, letters: int, upwards: bool, first: Iterator[np.ndarray], many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, common prefix with the one before, whether induced) in the order
    of the scan. first: tuples (odd codes) in the order of the scan, with their
    common prefixes; many: tuples of each code.

    A step takes as many tuples as don't depend on each other and handles them as
    arrays; where that would be a few only, FEW tuples are taken one by one.
    """
    queue = TupleQueue(many)
    for rows in first:
        queue.push(rows)
    since, put = Since(), np.full(letters, -1, np.int64)  # when a tuple of each letter was last put in
    last_code, last_at, most = -9, 0, 1024
    while len(rows := queue.peek(most)):
        code, at = rows["code"], rows["at"].astype(np.int64)
        before = np.maximum(at - 1, 0)
        ok = (at > 0) & (up[before] != upwards)
        x = t[before].astype(np.int32)
        goal = np.where(ok, 2 * (x if upwards else letters - 1 - x), FAR)
        # What this step puts in has to wait for the next step: it ends before a higher code than any of these.
        wait = code[1:] > np.minimum.accumulate(goal)[:-1]
        k = int(wait.argmax()) + 1 if wait.any() else len(rows)
        most = min(max(4 * k, FEW), STEP)
        if k < len(rows) and k < FEW // 8:
            rows, goal = rows[:FEW], goal[:FEW].tolist()
            queue.take(len(rows))
            out, found = _one_by_one(t, up, letters, upwards, rows, goal, since, put, last_code, last_at)
            last_code, last_at = int(rows["code"][-1]), int(rows["at"][-1])
            queue.push(out)
            yield found
            continue
        queue.take(k)
        code, at, goal = code[:k], at[:k], goal[:k]
        prior = np.empty(k, np.int32)
        prior[0], prior[1:] = last_code, code[:-1]
        induced = code & 1 == 0
        same = np.where(code == prior, np.minimum(rows["same"][:k], FAR - 1) + induced, 0)
        seam = np.flatnonzero(~induced & (prior == code - 1))  # S and L suffixes of one letter share a run of it
        if len(seam):
            left = np.append(last_at, at[:-1])[seam]
            same[seam] = np.minimum(runs(t, left), runs(t, at[seam]))
        yield at, same, induced
        last_code, last_at = int(code[-1]), int(at[-1])
        who = np.flatnonzero(goal < FAR)
        if len(who):
            who = who[goal[who].argsort(kind="stable")]
            goal = goal[who]
            new = np.empty(len(who), bool)
            new[0], new[1:] = True, goal[1:] != goal[:-1]
            low = np.zeros(len(who), np.int64)
            low[1:] = np.where(new[1:], 0, who[:-1] + 1)
            if k <= 1024:
                pairs = np.empty(2 * len(who), np.int64)
                pairs[::2], pairs[1::2] = low, who + 1
                carried = np.minimum.reduceat(np.append(same, FAR), pairs)[::2]
            else:
                carried = Least(same).of(low, who)
            letter = goal[new] >> 1
            carried[new] = np.minimum(carried[new], since.least_all(put[letter]))
            out = np.empty(len(who), TUPLE)
            out["code"], out["at"], out["same"] = goal, at[who] - 1, carried
            end = np.empty(len(who), bool)
            end[-1], end[:-1] = True, new[1:]
            put[letter] = since.n + who[end]
            since.extend(same)
            queue.push(out)
        else:
            since.extend(same)
    queue.scratch.close()


def _one_by_one(t, up, letters: int, upwards: bool, rows: np.ndarray, goals: list[int], since: Since, put: np.ndarray, last_code: int, last_at: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Takes rows, and what they put in before the last of them, from a heap. Gives
    the other tuples put in, sorted, and what _scan() yields."""
    codes, ats, sames = rows["code"].tolist(), rows["at"].tolist(), rows["same"].tolist()
    end, i, seq = codes[-1], 0, 0
    heap: list[tuple[int, int, int, int]] = []
    rest, found = [], []
    while i < len(codes):
        if heap and heap[0][0] < codes[i]:
            code, _, at, same = heappop(heap)
            goal = FAR
            if at and bool(up[at - 1]) != upwards:
                x = int(t[at - 1])
                goal = 2 * (x if upwards else letters - 1 - x)
        else:
            code, at, same, goal = codes[i], ats[i], sames[i], goals[i]
            i += 1
        induced = not code & 1
        if code == last_code:
            same = min(same, FAR - 1) + induced
        elif not induced and last_code == code - 1:
            same = int(runs(t, np.array([last_at, at])).min())
        else:
            same = 0
        found.append((at, same, induced))
        since.add(same)
        last_code, last_at = code, at
        if goal < FAR:
            letter = goal >> 1
            carried = since.least(int(put[letter]))
            put[letter] = since.n - 1
            if goal < end:
                heappush(heap, (goal, seq, at - 1, carried))
                seq += 1
            else:
                rest.append((goal, at - 1, carried))
    out = np.array(rest, TUPLE)
    at, same, induced = zip(*found, strict=True)
    return out[out["code"].argsort(kind="stable")], (np.array(at, np.int64), np.array(same, np.int32), np.array(induced))


_SEED = np.dtype([("at", "<i4"), ("same", "<i4")])


def _induced(t: np.ndarray, up: np.ndarray, letters: int, seeds: Iterator[np.ndarray], n_seeds: np.ndarray, of_l: np.ndarray, of_s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the one before) of all suffixes but the last
    place's, from the greatest down. seeds: rows (at, same) in rising order."""

    def initial() -> Iterator[np.ndarray]:
        for rows in seeds:
            out = np.empty(len(rows), TUPLE)
            out["code"], out["at"], out["same"] = 2 * t[rows["at"]].astype(np.int32) + 1, rows["at"], rows["same"]
            yield out

    many = np.empty(2 * letters, np.int64)
    many[::2], many[1::2] = of_l, n_seeds
    falling = Spool(_SEED)
    for at, same, induced in _scan(t, up, letters, True, initial(), many):
        rows = np.empty(int(induced.sum()), _SEED)
        rows["at"], rows["same"] = at[induced], same[induced]
        falling.add(rows)

    def back() -> Iterator[np.ndarray]:
        held = 0  # backwards, the common prefix stands with the later one
        for rows in falling.read(backwards=True):
            out = np.empty(len(rows), TUPLE)
            out["code"], out["at"] = 2 * (letters - 1 - t[rows["at"]].astype(np.int32)) + 1, rows["at"]
            out["same"] = np.append(held, rows["same"][:-1])
            held = rows["same"][-1]
            yield out

    many[::2], many[1::2] = of_s[::-1], of_l[::-1]
    for at, same, _ in _scan(t, up, letters, False, back(), many):
        yield at, same


def suffix_order(t: np.ndarray, letters: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the one before) of all suffixes of t, from the
    greatest down; the last place comes at the end. t ends with its only 0."""
    n = len(t)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    up = rising(t)
    of_l, of_s = np.zeros(letters, np.int64), np.zeros(letters, np.int64)
    total = 0
    for a, b in _parts(n):
        x, s = np.asarray(t[a:b]), np.asarray(up[a:b])
        of_s += np.bincount(x[s], minlength=letters)
        of_l += np.bincount(x[~s], minlength=letters)
        total += int((s & ~np.append(a == 0 or up[a - 1], s[:-1])).sum())
    places = mapped(total, np.int32)
    i = 0
    for a, b in _parts(n):
        s = np.asarray(up[a:b])
        found = np.flatnonzero(s & ~np.append(a == 0 or up[a - 1], s[:-1])) + a
        places[i : i + len(found)] = found
        i += len(found)
    of_s[0] -= 1  # the last place is a seed, and never induced
    by_letter = np.zeros(letters, np.int64)
    run = mapped(total, np.int32)
    for a, b in _parts(total):
        by_letter += np.bincount(t[places[a:b]], minlength=letters)
        run[a:b] = runs(t, places[a:b])

    def unordered() -> Iterator[np.ndarray]:
        # Among seeds of a letter, those with longer runs of it are less.
        order = np.lexsort((-run, t[places])) if total * 12 <= MAP_BYTES else _by_run(t, places, run)
        last = -1
        for a, b in _parts(total):
            own = order[a:b]
            rows = np.empty(len(own), _SEED)
            rows["at"] = places[own]
            r = run[own]
            rows["same"] = np.minimum(r, np.append(run[last] if last >= 0 else 0, r[:-1]))
            last = int(own[-1])
            yield rows

    # Pieces from seed to seed, with the run that the next seed starts; from the greatest down.
    pieces = Spool(_SEED)
    gap = FAR
    for at, same in _induced(t, up, letters, unordered(), by_letter, of_l, of_s):
        seed = np.asarray(up[at]) & (at > 0) & ~np.asarray(up[np.maximum(at - 1, 0)])
        who = np.flatnonzero(seed)
        if len(who):
            least = np.minimum.reduceat(same[: who[-1] + 1], np.concatenate([[0], who[:-1] + 1]))
            least[0] = min(int(least[0]), gap)
            rows = np.empty(len(who), _SEED)
            rows["at"], rows["same"] = np.searchsorted(places, at[who]), least
            pieces.add(rows)
            gap = int(same[who[-1] + 1 :].min()) if who[-1] + 1 < len(same) else FAR
        else:
            gap = min(gap, int(same.min()))
    # Names, rising; between: common prefix of a name's pieces with those of the name before.
    names = mapped(total, np.int32)
    between: list[np.ndarray] = [np.zeros(1, np.int32)]
    name, size_before, nth_before, same_before = 0, -1, -1, 0
    for rows in pieces.read(backwards=True):
        nth = rows["at"].astype(np.int64)
        size = places[np.minimum(nth + 1, total - 1)].astype(np.int64) - places[nth] + run[np.minimum(nth + 1, total - 1)]
        # Read backwards, a row's common prefix is with the row that comes next.
        same = np.append(same_before, rows["same"][:-1])
        new = (size != np.append(size_before, size[:-1])) | (same < size)
        if nth_before < 0:
            new[0] = True
        ids = name + np.cumsum(new)
        names[nth] = ids
        between.append(np.minimum(same[new], FAR).astype(np.int32))
        name, size_before, nth_before, same_before = int(ids[-1]), int(size[-1]), int(nth[-1]), int(rows["same"][-1])
    names[total - 1] = 0
    kinds = name + 1
    gaps = np.concatenate(between)
    least = Least(gaps)

    def ordered() -> Iterator[np.ndarray]:
        """Seeds in rising order, from the order of the names."""
        if kinds == total:  # all differ: a seed's rank is its name
            by_name = mapped(total, np.int32)
            for a, b in _parts(total):
                by_name[names[a:b]] = places[a:b]
            for a, b in _parts(total):
                rows = np.empty(b - a, _SEED)
                rows["at"], rows["same"] = by_name[a:b], gaps[a:b]
                yield rows
            return
        reduced = Spool(_SEED)
        held = None  # a row waits for the one that follows: its common prefix is with that one
        for nth, same in suffix_order(names, kinds):
            nth, same = np.append([] if held is None else held, nth).astype(np.int64), same.astype(np.int64)
            if held is None:
                same = same[1:]
            high, low = nth[:-1], nth[1:]  # high comes before low on the way down
            # same names in common, then two names that differ.
            a, b = names[np.minimum(high + same, total - 1)], names[np.minimum(low + same, total - 1)]
            rows = np.empty(len(high), _SEED)
            rows["at"] = places[high]
            rows["same"] = np.minimum(places[np.minimum(high + same, total - 1)] - places[high] + least.of(np.minimum(a, b).astype(np.int64) + 1, np.maximum(a, b).astype(np.int64)), FAR - 1)
            reduced.add(rows)
            held = nth[-1:]
        rows = np.zeros(1, _SEED)
        rows["at"] = places[held]
        yield rows
        yield from reduced.read(backwards=True)

    yield from _induced(t, up, letters, ordered(), by_letter, of_l, of_s)
    yield np.array([n - 1]), np.zeros(1, np.int32)


def _by_run(t: np.ndarray, places: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Seeds by letter and falling run: counting sorts over mapped arrays."""
    out, again = mapped(len(places), np.int32), mapped(len(places), np.int32)
    most = int(run.max())

    def count_sort(source, key, kinds, to) -> None:
        begin = np.zeros(kinds + 1, np.int64)
        for a, b in _parts(len(places)):
            begin[1:] += np.bincount(key(source(a, b)), minlength=kinds)
        begin = np.cumsum(begin)
        for a, b in _parts(len(places)):
            x = source(a, b)
            k = key(x)
            order = np.argsort(k, kind="stable")
            k = k[order]
            new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            nth = np.arange(len(k)) - np.repeat(new, np.diff(np.append(new, len(k))))
            to[begin[k] + nth] = x[order]
            begin[: kinds] += np.bincount(k, minlength=kinds)[:kinds]

    count_sort(np.arange, lambda i: most - run[i], most + 1, again)
    count_sort(lambda a, b: np.asarray(again[a:b]), lambda i: t[places[i]].astype(np.int64), int(t.max()) + 1, out)
    return out
