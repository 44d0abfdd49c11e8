"""Suffix order of a text on disk by external induced sorting.

Suffixes are of type S (smaller than the next one) or L. The leftmost S suffixes of
each stretch ("stars") are ordered first, by naming the pieces between them and
sorting the names' suffixes the same way (recursion). Then two scans induce all
others: a scanned suffix puts its left neighbour into a priority queue, from which
it comes out in its own place, L types upward, S types downward. The queue holds
tuples (symbol, position, common prefix with the tuple before) ordered by symbol
and, within one, first in first out; it is kept on disk beyond ``memory`` tuples.

Common prefixes are carried along: two neighbours in a symbol's queue share one
symbol more than the least that the scanned suffixes between their origins share.
For naming the value is only whether two pieces are equal.

Files have no name and end with the task, as Spark's own spill files do.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MEMORY = 1 << 22      # tuples that a queue holds in memory
BUCKET = 1 << 12      # tuples of several symbols that are ordered at once
CHUNK = 1 << 16       # tuples read or handled at once


def spill_file():
    """An unnamed file where Spark spills."""
    dirs = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or ""
    known = [d for d in dirs.split(",") if os.path.isdir(d) and os.access(d, os.W_OK)]
    return tempfile.TemporaryFile(dir=known[0] if known else None)


def store(n: int, dtype, memory: int) -> np.ndarray:
    """An array of n values, on disk where it is long."""
    return np.zeros(n, dtype) if n <= 2 * memory else np.memmap(spill_file(), dtype, shape=n)


def tuples(kind, *cols) -> np.ndarray:
    """Rows of (key, position, common prefix)."""
    out = np.empty((len(cols[0]), 3), kind)
    for k, c in enumerate(cols):
        out[:, k] = c
    return out


def by_key(keys: np.ndarray) -> np.ndarray:
    """Stable order by key; small keys take the fast way."""
    if keys.dtype.itemsize > 2 and len(keys) and keys.max() < 1 << 16:
        keys = keys.astype(np.uint16)
    return np.argsort(keys, kind="stable")


def kind_for(text: np.ndarray):
    """Integers that hold any position and symbol of a text."""
    return np.int32 if len(text) < 1 << 31 else np.int64


class DiskQueue:
    """Tuples by ascending key and, within a key, in the order they came; on disk beyond ``memory`` tuples.

    A bucket holds one key, or several keys with few tuples. Buckets are emptied in
    order, and what is pushed belongs to the bucket being emptied or to a later one.
    """

    def __init__(self, bounds: np.ndarray, n_keys: int, kind, memory: int):
        self.bounds, self.kind, self.memory, self.held, self.file = bounds, kind, memory, 0, None
        self.pieces: list[list] = [[] for _ in bounds]
        self.single = len(bounds) == n_keys     # a bucket for every key

    def push(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        b = rows[:, 0] if self.single else np.searchsorted(self.bounds, rows[:, 0], side="right") - 1
        turn = np.flatnonzero(b[1:] != b[:-1]) + 1
        if (b[turn] < b[turn - 1]).any():
            order = by_key(b)
            b, rows = b[order], rows[order]
            turn = np.flatnonzero(b[1:] != b[:-1]) + 1
        cuts = [0, *turn.tolist(), len(b)]
        for x, lo, hi in zip(b[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
            self.pieces[x].append(rows[lo:hi])
        self.held += len(rows)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or spill_file()
        for pieces in self.pieces:
            here = [p for p in pieces if isinstance(p, np.ndarray)]
            if here:
                rows = np.concatenate(here)
                at = self.file.seek(0, 2)
                self.file.write(rows.tobytes())
                pieces[:] = [p for p in pieces if not isinstance(p, np.ndarray)] + [(at, len(rows))]
        self.held = 0

    def drain(self, bucket: int):
        """The bucket's tuples in the order they came, also those pushed meanwhile."""
        pieces = self.pieces[bucket]
        while pieces:
            here = 0
            while here < len(pieces) and isinstance(pieces[here], np.ndarray):
                here += 1
            if here:
                rows = np.concatenate(pieces[:here])
                del pieces[:here]
                self.held -= len(rows)
                yield rows
                continue
            at, n = pieces.pop(0)
            width = 3 * np.dtype(self.kind).itemsize
            for lo in range(0, n, CHUNK):
                self.file.seek(at + width * lo)
                yield np.frombuffer(self.file.read(width * min(CHUNK, n - lo)), self.kind).reshape(-1, 3)


class Log:
    """Tuples in the order they came, read backwards; on disk beyond ``memory`` tuples."""

    def __init__(self, kind, memory: int):
        self.kind, self.memory, self.held, self.file, self.pieces = kind, memory, 0, None, []

    def append(self, rows: np.ndarray) -> None:
        self.pieces.append(rows)
        self.held += len(rows)
        if self.held > self.memory:
            self.file = self.file or spill_file()
            for k, p in enumerate(self.pieces):
                if isinstance(p, np.ndarray):
                    self.pieces[k] = (self.file.seek(0, 2), len(p))
                    self.file.write(p.tobytes())
            self.held = 0

    def backwards(self):
        for p in reversed(self.pieces):
            if isinstance(p, tuple):
                self.file.seek(p[0])
                p = np.frombuffer(self.file.read(3 * np.dtype(self.kind).itemsize * p[1]), self.kind).reshape(-1, 3)
            yield p[::-1]


class Nothing:
    """No common prefixes are carried.

    ``step`` gets the values of the tuples scanned, and the places among them of those that
    induce one, with its key: by key and, within one, in the order scanned.
    """

    def seam(self, a: int, b: int) -> int:
        return 0

    def step(self, values: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.zeros(len(at), np.int64)


class Equal(Nothing):
    """Whether a tuple's piece equals that of the tuple before it in its queue."""

    def __init__(self, n_keys: int):
        self.zeros, self.last = 0, np.full(n_keys, -1, np.int64)      # zeros scanned: all, and up to the key's last tuple

    def step(self, values, at, keys):
        zeros = self.zeros + np.cumsum(values == 0)
        mine = zeros[at]
        out = np.empty(len(at), bool)
        if len(at):
            out[1:] = mine[1:] == mine[:-1]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            out[first] = self.last[keys[first]] == mine[first]
            end = np.append(first[1:], len(at)) - 1
            self.last[keys[end]] = mine[end]
        if len(zeros):
            self.zeros = int(zeros[-1])
        return out


class Common:
    """Length of the prefix shared with the tuple before it in its queue, ``most`` at most."""

    def __init__(self, text: np.ndarray, n_keys: int, most: int):
        self.text, self.most = text, most
        self.least = np.full(n_keys, -1, np.int64)      # since the key's last tuple; -1 before its first

    def seam(self, a, b):
        x, y = self.text[a:a + self.most], self.text[b:b + self.most]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def step(self, values, at, keys):
        if not len(values):
            return np.zeros(0, np.int64)
        upto = np.minimum.accumulate(values)
        after = np.append(np.minimum.accumulate(values[::-1])[::-1], self.most)
        k, a = keys, at
        least = np.empty(len(k), np.int64)
        known = self.least
        self.least = np.where(known < 0, -1, np.minimum(known, upto[-1]))
        if len(k):
            first = np.append(True, k[1:] != k[:-1])
            later, first = np.flatnonzero(~first), np.flatnonzero(first)
            known = known[k[first]]
            least[first] = np.where(known < 0, -1, np.minimum(known, upto[a[first]]))
            if len(later):
                edges = np.empty((len(later), 2), np.int64)
                edges[:, 0], edges[:, 1] = a[later - 1], a[later]
                edges += 1
                least[later] = np.minimum.reduceat(np.append(values, 0), edges.ravel())[::2]
            end = np.append(first[1:], len(k)) - 1
            self.least[k[end]] = after[a[end] + 1]
        least += 1                                       # 0 for a key's first tuple
        return np.minimum(least, self.most, out=least)


def _bounds(counts: np.ndarray) -> np.ndarray:
    """First key of every bucket: each key of many tuples by itself, others joined up to about ``BUCKET``."""
    if len(counts) <= 512:
        return np.arange(len(counts))
    share = np.cumsum(counts) // BUCKET
    heavy = counts >= BUCKET
    new = np.append(True, share[1:] != share[:-1]) | heavy
    new[1:] |= heavy[:-1]
    return np.flatnonzero(new)


class Scan:
    """One scan in key order over the tuples given and those that it induces.

    ``log`` gets the induced tuples in the order scanned. ``sink`` gets twice a tuple's key (and one
    more if it was given; one number where a chunk has one key), position, prefix and whether it induces one.
    """

    def __init__(self, text: np.ndarray, top: int, down: bool, counts: np.ndarray, prefix, memory: int, sink=None, log=None):
        self.text, self.top, self.down, self.prefix, self.sink, self.log = text, top, down, prefix, sink, log
        self.bounds = _bounds(counts[::-1] if down else counts)
        self.kind = kind_for(text)
        self.queue, self.given = (DiskQueue(self.bounds, top + 1, self.kind, memory) for _ in range(2))
        self.before = (-1, -1)      # the tuple scanned last: twice its key (and one more if it was given), position

    def keys(self, at: np.ndarray) -> np.ndarray:
        symbols = self.text[at].astype(np.int64)
        return self.top - symbols if self.down else symbols

    def run(self) -> None:
        ends = [*self.bounds[1:].tolist(), self.top + 1]
        for b, (lo, hi) in enumerate(zip(self.bounds.tolist(), ends)):
            if hi - lo == 1:
                for twice, source in ((2 * lo, self.queue), (2 * lo + 1, self.given)):
                    for rows in source.drain(b):
                        for x in range(0, len(rows), CHUNK):
                            self.queue.push(self._scan_key(twice, rows[x:x + CHUNK]))
            else:
                self._several(b, hi)

    def _scan_key(self, twice: int, rows: np.ndarray) -> np.ndarray:
        """Tuples induced by tuples of one key."""
        pos, value, given = rows[:, 1].astype(np.int64), np.ascontiguousarray(rows[:, 2]), twice & 1
        if given and self.before[0] == twice - 1:
            value = value.copy()
            value[0] = self.prefix.seam(self.before[1], int(pos[0]))
        self.before = (twice, int(pos[-1]))
        before = pos - 1
        left = self.text[before]        # the last symbol, 0, for the first position: it induces nothing
        if self.down:
            symbol = self.top - (twice >> 1)
            hit = left < symbol if given else left <= symbol
            hit &= left > 0
        else:
            symbol = twice >> 1
            hit = left > symbol if given else left >= symbol
        if self.log and not given:
            self.log.append(rows)
        if self.sink:
            self.sink(twice, pos, value, hit)
        at = np.flatnonzero(hit)
        key = self.top - left[at] if self.down else left[at]
        order = by_key(key)
        at, key = at[order], key[order]
        return tuples(self.kind, key, before[at], self.prefix.step(value, at, key))

    def _several(self, b: int, hi: int) -> None:
        queued, given = ([*q.drain(b)] for q in (self.queue, self.given))
        rows = np.concatenate([*queued, *given, np.zeros((0, 3), self.kind)])
        twice = 2 * rows[:, 0].astype(np.int64)
        twice[len(twice) - sum(map(len, given)):] += 1
        order = np.argsort(twice, kind="stable")
        rows, twice = rows[order], twice[order]
        ahead = 256
        while len(rows):
            new = self._scan_keys(twice[:ahead], rows[:ahead])
            ahead = 2 * self.done + 64
            rows, twice = rows[self.done:], twice[self.done:]
            here = new[:, 0] < hi
            self.queue.push(new[~here])
            if here.any():
                new = new[here]
                keys = 2 * new[:, 0].astype(np.int64)
                at = np.searchsorted(twice, keys, side="right")
                rows, twice = np.insert(rows, at, new, 0), np.insert(twice, at, keys)

    def _scan_keys(self, twice: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Tuples induced by the first tuples of several keys: those that nothing induced comes before."""
        pos = rows[:, 1].astype(np.int64)
        left = self.keys(np.maximum(pos - 1, 0))
        key, given = twice >> 1, twice & 1
        hit = (pos > 0) & ((left > key) | ((left == key) & (given == 0)))
        soonest = np.minimum.accumulate(np.where(hit, 2 * left, np.iinfo(np.int64).max))
        late = np.flatnonzero(twice[1:] > soonest[:-1])
        n = self.done = int(late[0]) + 1 if len(late) else len(rows)
        twice, given, pos, value, hit = twice[:n], given[:n], pos[:n], rows[:n, 2].astype(np.int64), hit[:n]
        for k in np.flatnonzero((given == 1) & (np.append(self.before[0], twice[:-1]) == twice - 1)).tolist():
            value[k] = self.prefix.seam(int(pos[k - 1]) if k else self.before[1], int(pos[k]))
        self.before = (int(twice[-1]), int(pos[-1]))
        if self.log:
            self.log.append(rows[:n][given == 0])
        if self.sink:
            self.sink(twice, pos, value, hit)
        at = np.flatnonzero(hit)
        at = at[by_key(left[at])]
        key = left[at]
        return tuples(self.kind, key, pos[at] - 1, self.prefix.step(value, at, key))


def stars(text: np.ndarray, memory: int) -> np.ndarray:
    """Ascending positions of S suffixes after an L suffix; the last symbol, a single 0, counts as one."""
    n, found, kind = len(text), [], True
    for lo in reversed(range(0, n, CHUNK)):
        hi = min(n, lo + CHUNK)
        x = text[lo:hi + 1].astype(np.int64)
        if hi == n:
            x = np.append(x, np.iinfo(np.int64).max)     # the last suffix is of type S
        d = np.diff(x)
        at = np.where(d != 0, np.arange(len(d)), len(d))
        at = np.minimum.accumulate(at[::-1])[::-1]
        small = np.append(d > 0, kind)[at]
        before = text[lo - 1:hi - 1] if lo else np.append(text[:1], text[:hi - 1])
        found.append(lo + np.flatnonzero(small & (before > x[:-1])))
        kind = bool(small[0])
    out = store(sum(map(len, found)), np.int64, memory)
    end = 0
    for x in reversed(found):
        out[end:end + len(x)] = x
        end += len(x)
    return out


def _counts(text: np.ndarray, top: int) -> np.ndarray:
    out = np.zeros(top + 1, np.int64)
    for lo in range(0, len(text), 1 << 22):
        out += np.bincount(text[lo:lo + (1 << 22)], minlength=top + 1)
    return out


def _induce(text, top, counts, seeds, prefixes, sink, memory) -> None:
    """Scan upward from the stars, then downward from the L suffixes; ``seeds`` fills the first scan's queue of given tuples."""
    kind = kind_for(text)
    log = Log(kind, memory)
    up = Scan(text, top, False, counts, prefixes[0], memory, log=log)
    seeds(up.given)
    up.run()
    down = Scan(text, top, True, counts, prefixes[1], memory, sink=sink)
    carried = 0
    for rows in log.backwards():
        if len(rows):
            # In this direction a tuple follows the one that it preceded.
            down.given.push(tuples(kind, top - rows[:, 0], rows[:, 1], np.append(carried, rows[:-1, 2])))
            carried = int(rows[-1, 2])
    down.run()


def star_order(text: np.ndarray, top: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The stars by ascending suffix, and the counts of symbols."""
    counts, at = _counts(text, top), stars(text, memory)
    n = len(at)
    if n <= 1:
        return at, counts

    def seeds(queue: DiskQueue) -> None:
        # In any order within a symbol: those with the same symbol count as equal.
        for lo in range(0, n, CHUNK):
            pos = np.asarray(at[lo:lo + CHUNK])
            key = text[pos]
            order = by_key(key)
            queue.push(tuples(kind_for(text), key[order], pos[order], np.ones(len(pos))))

    named = store(len(text) // 2 + 1, np.int32, memory)      # by half the position: stars are never neighbours
    state = {"names": 0, "equal": True}

    def name(twice, pos, value, hit):
        """Stars come out in descending order; one gets a new name where anything between it and the last one differs.

        Those are the induced tuples that induce none, but for the first position.
        """
        turn = np.cumsum(value == 0)
        here = np.flatnonzero(~hit & (twice & 1 == 0) & (pos > 0))
        if not len(here):
            state["equal"] &= not turn[-1]
            return
        t = turn[here]
        new = np.append(t[0] > 0 or not state["equal"] or not state["names"], t[1:] > t[:-1])
        number = state["names"] + np.cumsum(new)
        named[pos[here] >> 1] = number
        state["names"], state["equal"] = int(number[-1]), bool(turn[-1] == t[-1])

    _induce(text, top, counts, seeds, (Equal(top + 1), Equal(top + 1)), name, memory)
    total, names = state["names"], store(n, np.int32, memory)
    for lo in range(0, n - 1, CHUNK):
        hi = min(n - 1, lo + CHUNK)
        names[lo:hi] = total + 1 - named[at[lo:hi] >> 1]
    del named
    names[n - 1] = 0            # the end of the text
    if total == n - 1:
        order = store(n, np.int64, memory)
        for lo in range(0, n, CHUNK):
            order[names[lo:lo + CHUNK]] = at[lo:lo + CHUNK]
        return order, counts
    if n <= memory:
        return at[doubled(names)], counts
    order = store(n, np.int64, memory)
    left = [n]

    def place(twice, pos, value, hit):
        order[left[0] - len(pos):left[0]] = at[pos[::-1]]
        left[0] -= len(pos)

    _suffixes(names, total, lambda *_: Nothing(), place, memory)
    order[0] = at[n - 1]
    return order, counts


def order_of(keys: np.ndarray, most: int) -> np.ndarray:
    """Order of keys up to ``most``, equal ones in any order; sorted with their places where both fit in a number."""
    bits = max(1, len(keys) - 1).bit_length()
    if bits + most.bit_length() > 63:
        return np.argsort(keys)
    code = keys.astype(np.int64) << bits
    code |= np.arange(len(keys))
    code.sort()
    code &= (1 << bits) - 1
    return code


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a text that fits in memory: ends the recursion.

    Ranks of prefixes of twice the length each round, of the suffixes that aren't told apart yet.
    """
    n, size = len(names), 1
    order = order_of(names, n)
    sorted_names = names[order]
    first = np.append(True, sorted_names[1:] != sorted_names[:-1])
    rank = np.empty(n + 1, np.int64)          # a group's rank is the place of its first suffix; 0 for the end, so 1 and up
    rank[n] = 0
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    while True:
        open_ = np.flatnonzero(~(first & np.append(first[1:], True)))    # places in groups of several
        if not len(open_):
            return order
        own = order[open_]
        key = rank[own] * (n + 1) + rank[np.minimum(own + size, n)]
        by = order_of(key, (n + 1) ** 2)
        key, own = key[by], own[by]
        order[open_] = own
        new = np.append(True, key[1:] != key[:-1])
        first[open_] = new
        rank[own] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        size *= 2


def _suffixes(text, top, prefix, sink, memory) -> None:
    """All suffixes but the last symbol's, descending, as (twice, position, value) to ``sink``."""
    order, counts = star_order(text, top, memory)

    def seeds(queue: DiskQueue) -> None:
        last = -1
        for lo in range(0, len(order), CHUNK):
            pos = np.asarray(order[lo:lo + CHUNK])
            value = np.zeros(len(pos), np.int64)
            if isinstance(up, Common):
                value = shared_prefixes(text, np.append(last, pos), up.most)
            last = int(pos[-1])
            queue.push(tuples(kind_for(text), text[pos], pos, value))

    up, down = prefix(text, top + 1), prefix(text, top + 1)
    _induce(text, top, counts, seeds, (up, down), sink, memory)


def shared_prefixes(text: np.ndarray, pos: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each position's suffix and the one's before it in ``pos``; a position below 0 shares nothing."""
    out, n = np.zeros(len(pos) - 1, np.int64), len(text)
    live = np.flatnonzero((pos[:-1] >= 0) & (pos[1:] >= 0))
    if text.dtype.itemsize <= 2 and n * text.dtype.itemsize >= 8:       # eight bytes at a time
        each = 8 // text.dtype.itemsize
        eight = np.ndarray((n - each + 1,), "<u8", text, 0, (text.dtype.itemsize,))
        ends = []
        for k in range(0, most, each):
            a, b = pos[live] + k, pos[live + 1] + k
            near = np.maximum(a, b) > n - each
            if near.any():
                ends.append(live[near])
                live, a, b = live[~near], a[~near], b[~near]
            differ = eight[a] ^ eight[b]
            # The zero bytes before the first that differs; of 0 all are.
            out[live] += (np.bitwise_count(~differ & differ - np.uint64(1)) // (8 * text.dtype.itemsize)).astype(np.int64)
            live = live[differ == 0]
            if not len(live):
                break
        live = np.concatenate([live[:0], *ends])
    while len(live):
        a, b = pos[live] + out[live], pos[live + 1] + out[live]
        ok = (a < n) & (b < n) & (out[live] < most)
        ok[ok] = text[a[ok]] == text[b[ok]]
        live = live[ok]
        out[live] += 1
    return np.minimum(out, most, out=out)


def suffixes_with_prefixes(text: np.ndarray, top: int, most: int, sink, memory: int = MEMORY) -> None:
    """All suffixes of ``text`` but its last symbol's in descending order, with their common prefixes up to ``most``.

    Symbols are 0 to ``top``; the last one is 0 and no other. ``sink`` gets chunks of positions
    and of the length shared with the suffix reported before.
    """
    _suffixes(text, top, lambda t, n: Common(t, n, most), lambda twice, pos, value, hit: sink(pos, value), memory)
