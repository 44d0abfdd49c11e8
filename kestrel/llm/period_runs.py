"""Periodic runs of words, found on a Re-Pair grammar.

A text's word ids are compressed by Re-Pair: the most frequent pair of neighbouring
symbols becomes a new symbol, until no pair occurs twice; what is left is joined by
a balanced tree. Every run crosses the boundary between the two halves of the
smallest symbol that spans it. So each distinct symbol is searched once for runs
across its own boundary, the runs found are moved to all places that the symbol
derives, and intervals of one period that lie in a larger one are merged into it.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import take

MIN_WORDS, MIN_PERIODS = 6, 4   # fixed values: a run has 6 words and 4 periods at least
BATCH_TEXTS = 512
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repair(ids: list[int], alphabet: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(rules as (symbol, left, right) in the order made, what is left as (symbol, position)) of a sequence."""
    n = len(ids)
    sym, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    a = np.asarray(ids, np.int64)
    code = a[:-1] * alphabet + a[1:]
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
    places = {}
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo > 1:
            at = order[lo:hi].tolist()
            places[ids[at[0]], ids[at[0] + 1]] = at
    heap = [(-len(at), pair) for pair, at in places.items()]
    heapq.heapify(heap)
    rules, made = [], alphabet
    while heap:
        count, pair = heapq.heappop(heap)
        left, right = pair
        live, valid, taken = [], [], -1
        for i in places[pair]:
            j = after[i]
            if sym[i] == left and j < n and sym[j] == right:
                valid.append(i)
                if i != taken:       # of two that overlap the first counts
                    live.append(i)
                    taken = j
        if len(live) < 2:
            del places[pair]
            continue
        if heap and -len(live) > heap[0][0]:     # some of its places are gone: it waits for its turn
            places[pair] = valid
            heapq.heappush(heap, (-len(live), pair))
            continue
        del places[pair]
        fresh = {}
        for i in live:
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i] = made, -1, k
            if k < n:
                before[k] = i
                fresh.setdefault((made, sym[k]), []).append(i)
            p = before[i]
            if p >= 0:
                fresh.setdefault((sym[p], made), []).append(p)
        for new, at in fresh.items():
            if len(at) > 1:
                places[new] = at
                heapq.heappush(heap, (-len(at), new))
        rules.append((made, left, right))
        made += 1
    return rules, [(s, i) for i, s in enumerate(sym) if s >= 0]


class Words:
    """Word ids as bytes, four each, so that stretches compare as a whole."""

    def __init__(self, ids: list[int]):
        self.raw = array("i", ids).tobytes()

    def equal(self, i: int, j: int, size: int) -> bool:
        return self.raw[4 * i:4 * (i + size)] == self.raw[4 * j:4 * (j + size)]

    def reach(self, i: int, j: int, most: int, back: bool = False) -> int:
        """Number of equal words from i and j on, or before them, ``most`` at most."""
        same = (lambda lo, hi: self.equal(i - hi, j - hi, hi - lo)) if back else \
               (lambda lo, hi: self.equal(i + lo, j + lo, hi - lo))
        lo, step = 0, 8
        while lo < most and same(lo, min(lo + step, most)):
            lo, step = min(lo + step, most), 2 * step
        hi = min(lo + step, most)
        while lo < hi:
            x = (lo + hi + 1) // 2
            if same(lo, x):
                lo = x
            else:
                hi = x - 1
        return lo


def crossing(view: Words, ids: list[int], follows: list[int], precedes: list[int],
             lo: int, mid: int, hi: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, smallest period) inside lo..hi that hold the words on both sides of ``mid``.

    Such a run has two periods on one side of ``mid``. Their first two words repeat
    at the distance of a period, which ``follows`` and ``precedes`` list: the next
    and the previous place of the same two words.
    """
    found: list[tuple[int, int, int]] = []
    for q, right in _periods(ids, follows, precedes, lo, mid, hi):
        a, b = (mid, mid + 2 * q) if right else (mid - 2 * q, mid)
        if any(s <= a and b <= e for s, e, _ in found):     # inside a run of a smaller period
            continue
        if not view.equal(a, a + q, q):
            continue
        s = a - view.reach(a, a + q, a - lo, back=True)
        e = b + view.reach(b - q, b, hi - b)
        if s < mid < e and e - s >= max(MIN_WORDS, MIN_PERIODS * q):
            found.append((s, e, q))
    return found


def _periods(ids: list[int], follows: list[int], precedes: list[int], lo: int, mid: int, hi: int):
    """Candidate periods in ascending order, and on which side of ``mid`` two of them have to lie."""
    out = []
    if mid + 1 < hi and ids[mid] == ids[mid + 1]:
        out.append((1, True))
    if mid - 2 >= lo and ids[mid - 1] == ids[mid - 2]:
        out.append((1, False))
    at, most = follows[mid] if mid < len(follows) else -1, min(hi - mid >> 1, hi - lo >> 2)
    while at >= 0 and at - mid <= most:
        if at > mid + 1:
            out.append((at - mid, True))
        at = follows[at]
    end, most = mid - 2, min(mid - lo >> 1, hi - lo >> 2)
    at = precedes[end] if end >= 0 else -1
    while at >= 0 and end - at <= most:
        if at < end - 1:
            out.append((end - at, False))
        at = precedes[at]
    return sorted(out)


def _neighbours(ids: list[int], alphabet: int) -> tuple[list[int], list[int]]:
    """For every place of two words, the next and the previous place of the same two (or -1)."""
    a = np.asarray(ids, np.int64)
    code = a[:-1] * alphabet + a[1:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    follows, precedes = np.full(len(code), -1), np.full(len(code), -1)
    follows[order[:-1][same]] = order[1:][same]
    precedes[order[1:][same]] = order[:-1][same]
    return follows.tolist(), precedes.tolist()


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, smallest period) of a sequence of words, by start and period."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == n:
        return []
    rules, rest = repair(ids, len(number))
    if not rules:            # no two words repeat side by side, so no run has two periods of two words
        return []
    view = Words(ids)
    follows, precedes = _neighbours(ids, len(number))
    size = dict.fromkeys(range(len(number)), 1)
    for s, a, b in rules:
        size[s] = size[a] + size[b]
    # Where each symbol first stands: top down, from what is left to the oldest rule.
    first = {}
    for s, i in rest:
        first.setdefault(s, i)
    for s, a, b in reversed(rules):
        if s in first:
            for child, i in ((a, first[s]), (b, first[s] + size[a])):
                first[child] = min(i, first.get(child, n))
    inside = {}              # runs across a symbol's own boundary, relative to its start
    for s, a, b in rules:
        if size[s] >= MIN_WORDS:
            i = first[s]
            found = crossing(view, ids, follows, precedes, i, i + size[a], i + size[s])
            if found:
                inside[s] = [(x - i, y - i, q) for x, y, q in found]
    spans = set()
    if inside:
        places: dict = {}
        for s, i in rest:
            places.setdefault(s, []).append(i)
        for s, a, b in reversed(rules):
            for i in places.pop(s, ()):
                for x, y, q in inside.get(s, ()):
                    spans.add((i + x, i + y, q))
                if size[a] >= MIN_WORDS:
                    places.setdefault(a, []).append(i)
                if size[b] >= MIN_WORDS:
                    places.setdefault(b, []).append(i + size[a])
    # The balanced tree over the symbols that are left: its nodes are distinct.
    edges = [i for _, i in rest] + [n]
    step = 1
    while step < len(rest):
        for k in range(0, len(rest) - step, 2 * step):
            lo, mid, hi = edges[k], edges[k + step], edges[min(k + 2 * step, len(rest))]
            if hi - lo >= MIN_WORDS:
                spans.update(crossing(view, ids, follows, precedes, lo, mid, hi))
        step *= 2
    return merged(spans)


def merged(spans: set) -> list[tuple[int, int, int]]:
    """Maximal intervals: of those with one period, none inside another."""
    out, reach, period = [], -1, 0
    for q, s, negative in sorted((q, s, -e) for s, e, q in spans):
        if q != period:
            reach, period = -1, q
        if -negative > reach:
            out.append((s, -negative - s, q))
            reach = -negative
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    turn = np.zeros(len(words) + 1, np.int64)
    s, length, q = np.array(runs, np.int64).T
    np.add.at(turn, s + q, 1)
    np.add.at(turn, s + length, -1)
    return [w for w, c in zip(words, np.cumsum(turn).tolist()) if not c]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and the collapsed text, one row per row.

    Words end at U+0020 and U+0009 to U+000D; the collapsed text joins the words kept
    by one space. NULL, empty and blank texts have no words and no runs, and an empty
    collapsed text. Rows are judged by themselves, also where ids repeat or are NULL.
    Texts are read whole, however long.
    """
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(lo, BATCH_TEXTS)
                split = [(t or "").encode().split() for t in part.column(1).to_pylist()]
                runs = [runs_of(w) for w in split]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(w) for w in split], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(_RUN)),
                    pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(split, runs)], pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    d = take(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                             "collapsed string")


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text, where every tenth document (by a hash of its id) repeats a stretch of its words to its end.

    With h = crc32 of the id's decimal digits, g = h div 10 and n words, documents with
    h % 10 = 0 have word i >= a replaced by word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). Other documents, and those without id or words, keep their text.
    """
    from .text import words
    d = take(docs, doc_id=id_col, text=text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text")))).withColumn("n", F.size("w").cast("long"))
    d = d.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("flatten(transform(sequence(0L, (n - a) div p), k -> slice(w, int(a + 1), int(p))))")
    changed = F.concat(F.expr("slice(w, 1, int(a))"), F.slice(tail, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))
