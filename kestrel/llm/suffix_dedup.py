"""Substring dedup by suffix order: bytes of strings of 50 that begin in an earlier document go.

Documents are packed into groups of a few megabytes. Every string of ``length``
bytes has an anchor, its 16 bytes of smallest hash, so equal strings have equal
anchors wherever they stand. Groups send what they hold of anchors, with the bytes
before or after them, as 32-bit numbers to the part that counts them, and learn which
stand in several documents.
Only the stretches around those go on, each distinct one once a group, to the shard
that their anchor names: all strings with that anchor meet there. A shard puts its
stretches into one text on disk, sorts its suffixes by external induced sorting
(``induced_sort``), and reads the smallest document of each string off runs of
suffixes that share ``length`` bytes. Groups get these back and cut their texts.

Anchors of very many documents would make a shard large. Their strings are counted
one by one, and those that repeat go to shards by their own hash.

Hashes only choose where things meet; strings are compared as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

from . import induced_sort
from .groups import GROUP_BYTES, LAST, batch_of, by_group, grouped, opened, pack, per_group, unpack
from .hashing import mix
from .text import take

LENGTH = 50
GRAM = 16                 # bytes of an anchor
PART_BYTES = 8 << 20      # of texts for each part that counts, and each shard
SLICE = 1 << 16           # positions whose anchors are found at once
HOT = 200_000             # stretches of one anchor, 13 MB, beyond which its strings go by themselves
SEEN = 1 << 19            # stretches that a shard remembers, to take equal ones once
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# --- anchors -------------------------------------------------------------------

def hashes_at(raw: np.ndarray, at: np.ndarray, size: int, seed: np.ndarray | int = 0) -> np.ndarray:
    """Hash of the ``size`` (8 at least) bytes from the given positions on."""
    out = np.zeros(len(at), np.uint64)
    out += (size + (np.asarray(seed) << 32)).astype(np.uint64)
    if len(at):
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        for k in [*range(0, size - 8, 8), size - 8]:
            out = mix(out * _GOLD + eight[at + k])
    return out


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position on."""
    if len(raw) < GRAM:
        return np.zeros(0, np.uint64)
    x = mix(np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)) * _GOLD)
    out = x[:-8] * _GOLD
    out += x[8:]
    return out


def stretches(raw: np.ndarray, limits: np.ndarray, length: int):
    """Runs of strings with one anchor: (anchor's hash, wider hash, run, first start, number of starts, document) of their parts.

    A string's anchor is the leftmost of its grams with the smallest hash, so it depends on
    the string alone. The strings that begin well before their anchor hold as many bytes before
    it, the others as many after it: a wider gram each, which tells apart more than the anchor.
    """
    width, half = length - GRAM + 1, (length - GRAM) // 2
    owner = np.repeat(np.arange(len(limits) - 1, dtype=np.int32), np.diff(limits))
    out, low = [], np.uint64((1 << 22) - 1)
    for lo in range(0, len(raw), SLICE):
        hashes = anchor_hashes(raw[lo:lo + SLICE + length - 1])
        n = len(hashes) - width + 1
        if n <= 0:
            break
        key = hashes & ~low
        key |= np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        key = np.minimum(key[:n], key[width - size:width - size + n])
        whole = owner[lo:lo + n] == owner[lo + length - 1:lo + length - 1 + n]
        # Between whole strings of two documents there are others, so neighbours are of one.
        goes_on = key[1:] == key[:-1]
        goes_on &= whole[1:]
        goes_on &= whole[:-1]
        first = np.flatnonzero(whole & ~np.append(False, goes_on))
        end = np.flatnonzero(whole & ~np.append(goes_on, False))
        anchor = (key[first] & low).astype(np.int64)
        out.append((hashes[anchor], lo + anchor, lo + first, end - first + 1))
    if not out:
        return *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 4
    h, anchor, start, count = (np.concatenate(c) for c in zip(*out))
    before = np.clip(anchor - start - half + 1, 0, count)      # starts that are ``half`` bytes and more before the anchor
    n_of = np.stack([before, count - before], 1).ravel()
    first = np.stack([start, start + before], 1).ravel()
    pick = np.flatnonzero(n_of > 0)
    run, side = pick >> 1, pick & 1
    first = first[pick]
    wide = hashes_at(raw, anchor[run] - np.where(side == 0, half, 0), GRAM + half, side)
    return h[run], wide, run, first, n_of[pick], owner[first].astype(np.int64)


def _code(h: np.ndarray, parts: int) -> np.ndarray:
    """Part and low half of hashes."""
    return (h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _distinct(h: np.ndarray, doc: np.ndarray, parts: int):
    """Distinct hashes by part and low half, for each how many stretches hold it (1 if only one document does), and each stretch's among them."""
    code = _code(h, parts)
    order = np.argsort(code)
    c, d = code[order], doc[order]
    new = np.append(True, c[1:] != c[:-1])[:len(c)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(c)))
    number = np.cumsum(new) - 1
    several = np.zeros(len(first), bool)
    several[number[1:][~new[1:] & (d[1:] != d[:-1])]] = True
    which = np.empty(len(c), np.int64)
    which[order] = number
    return c[first], np.where(several, np.minimum(count, 255), 1).astype(np.uint8), which


_HELD = pa.schema([("part", pa.int32()), ("g", pa.int64()), ("low", pa.binary()), ("n", pa.binary())])
_REPLY = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("marks", pa.binary()), ("hot", pa.bool_())])


def _held(g: int, code: np.ndarray, count: np.ndarray):
    """One row a part of what a group holds."""
    part = (code >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for lo, hi in zip(cut, [*cut[1:], len(part)]):
        yield int(part[lo]), g, pack(code[lo:hi].astype(np.uint32)), pack(count[lo:hi])


def _count(held: DataFrame, hot: int) -> DataFrame:
    """What each group learns of a part: 0 for a hash in one document only, 1 in several, 2 in very many stretches."""
    def run(table: pa.Table) -> pa.Table:
        lows = [unpack(x.as_py(), np.uint32) for x in table.column("low")]
        counts = [unpack(x.as_py()) for x in table.column("n")]
        low = np.concatenate(lows)
        order = induced_sort.order_of(low, 0xFFFFFFFF)
        first = np.flatnonzero(np.append(True, low[order][1:] != low[order][:-1]))
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
        mark = np.where(total > hot, 2, total > 1).astype(np.uint8)
        marks = np.empty(len(low), np.uint8)
        marks[order] = np.repeat(mark, np.diff(np.append(first, len(low))))
        cut = np.cumsum([0, *map(len, lows)])
        out = [marks[a:b] for a, b in zip(cut[:-1], cut[1:])]
        return pa.Table.from_batches([batch_of(_REPLY, [
            (g, p, pack(m), bool((m == 2).any())) for g, p, m in
            zip(table.column("g").to_pylist(), table.column("part").to_pylist(), out)])])

    return held.groupBy("part").applyInArrow(run, "g long, part int, marks binary, hot boolean")


def _marks(replies: list, n: int) -> np.ndarray:
    """A group's marks in the order of its distinct hashes."""
    out = [unpack(m) for _, m in sorted((r["part"], r["marks"]) for r in replies or [])]
    marks = np.concatenate([*out, np.zeros(0, np.uint8)])
    if len(marks) != n:
        raise RuntimeError("a group got another number of marks than it sent hashes")
    return marks


def repeated(groups: DataFrame, length: int, parts: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Marks of each group's anchors; and of the single strings of anchors marked 2, where there are any."""
    def anchors(batch, k):
        g, ids, limits, raw = opened(batch, k)
        _, wide, _, _, _, doc = stretches(raw, limits, length)
        code, count, _ = _distinct(wide, ids[doc], parts)
        yield from _held(g, code, count)

    held_type = "part int, g long, low binary, n binary"
    marks = cut_lineage(_count(groups.mapInArrow(per_group(anchors, _HELD), held_type), hot))
    if not marks.where("hot").head(1):
        return by_group(marks, "part", "marks"), None

    def strings(batch, k):
        g, ids, limits, raw = opened(batch, k)
        _, wide, _, start, count, doc = stretches(raw, limits, length)
        known, _, number = _distinct(wide, ids[doc], parts)
        mark = _marks(batch.column(batch.schema.get_field_index("replies"))[k].as_py(), len(known))[number]
        at, doc = _singles(start, count, doc, mark == 2)
        code, count, _ = _distinct(hashes_at(raw, at, length), ids[doc], parts)
        yield from _held(g, code, count)

    mine = groups.join(by_group(marks, "part", "marks"), "g", "left")
    single = cut_lineage(_count(mine.mapInArrow(per_group(strings, _HELD), held_type), LAST))
    return by_group(marks, "part", "marks"), by_group(single, "part", "marks")


def _singles(start: np.ndarray, count: np.ndarray, doc: np.ndarray, pick: np.ndarray):
    """Every start of the picked stretches, and its document."""
    n = count[pick]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start[pick], n) + within, np.repeat(doc[pick], n)


# --- stretches to shards ---------------------------------------------------------

_SENT = pa.schema([("part", pa.int32()), ("g", pa.int64()), ("sizes", pa.binary()), ("owners", pa.binary()),
                   ("latest", pa.binary()), ("bytes", pa.binary())])
SENT = "part int, g long, sizes binary, owners binary, latest binary, bytes binary"


class Kept:
    """The stretches of a group that others may hold too, by shard: which, where, and the distinct ones of each shard."""

    def __init__(self, batch: pa.RecordBatch, k: int, length: int, parts: int):
        self.g, ids, limits, raw = opened(batch, k)
        self.ids, self.limits, self.raw, self.length = ids, limits, raw, length
        names = batch.schema.names
        col = lambda name: batch.column(names.index(name))[k].as_py()
        h, wide, run, start, count, doc = stretches(raw, limits, length)
        known, _, number = _distinct(wide, ids[doc], parts)
        mark = _marks(col("replies"), len(known))[number]
        pick = np.flatnonzero(mark == 1)
        # Both parts of a run go as one stretch.
        first = np.append(True, run[pick][1:] != run[pick][:-1]) if len(pick) else np.zeros(0, bool)
        total = np.add.reduceat(count[pick], np.flatnonzero(first)) if len(pick) else pick
        pick = pick[first]
        lists = [(_code(h[pick], parts), start[pick], total, doc[pick])]
        if "single" in names:
            at, own = _singles(start, count, doc, mark == 2)
            known, _, number = _distinct(hashes_at(raw, at, length), ids[own], parts)
            hit = _marks(col("single"), len(known))[number] > 0
            lists.append((known[number[hit]], at[hit], np.ones(hit.sum(), np.int64), own[hit]))
        code, start, count, doc = (np.concatenate(c) for c in zip(*lists))
        shard = (code >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        self.shard, self.start, self.count, self.owner = shard[order], start[order], count[order], ids[doc[order]]
        self.number = np.zeros(len(order), np.int64)      # among the distinct stretches of its shard, once these are found

    def distinct(self):
        """For blocks of shards: these, where the distinct stretches of each begin and end, the stretches, smallest and largest id that hold each.

        A stretch's bytes name its anchor and so its shard.
        """
        data, lo = self.raw.tobytes(), 0
        while lo < len(self.shard):
            hi = int(np.searchsorted(self.shard, self.shard[min(lo + SLICE, len(self.shard)) - 1], "right"))
            shard, start, owner, seen = self.shard[lo:hi], self.start[lo:hi], self.owner[lo:hi], {}
            end = start + self.count[lo:hi] + self.length - 1
            number = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist())])
            owners, latest = np.full(len(seen), LAST), np.full(len(seen), np.iinfo(np.int64).min)
            np.minimum.at(owners, number, owner)
            np.maximum.at(latest, number, owner)
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            begin = number[first]               # new in their shard
            self.number[lo:hi] = number - np.repeat(begin, np.diff(np.append(first, len(number))))
            yield shard[first].tolist(), [*begin.tolist(), len(seen)], list(seen), owners, latest
            lo = hi


def send(informed: DataFrame, length: int, parts: int) -> DataFrame:
    """Distinct stretches of every group, by shard, with the smallest and largest id that holds them."""
    def run(batch, k):
        kept = Kept(batch, k, length, parts)
        for shards, begin, found, owners, latest in kept.distinct():
            sizes = np.array([*map(len, found)], np.uint32)
            for shard, lo, hi in zip(shards, begin[:-1], begin[1:]):
                yield shard, kept.g, pack(sizes[lo:hi]), pack(owners[lo:hi]), pack(latest[lo:hi]), pack(b"".join(found[lo:hi]))

    return informed.mapInArrow(per_group(run, _SENT), SENT)


# --- shards ------------------------------------------------------------------------

_FOUND = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("number", pa.binary()), ("first", pa.binary()), ("n", pa.binary()),
                    ("owner", pa.binary())])
FOUND = "g long, part int, number binary, first binary, n binary, owner binary"


class Shard:
    """The stretches of one shard: their bytes on disk, and what each group asked."""

    def __init__(self, length: int, memory: int):
        self.length, self.memory, self.file = length, memory, induced_sort.spill_file()
        self.sizes, self.owners, self.asked, self.seen, self.count = [], [], [], {}, 0

    def add(self, g: int, sizes: np.ndarray, owners: np.ndarray, latest: np.ndarray, data: bytes) -> None:
        if len(self.seen) > SEEN:
            self.seen.clear()
        seen, known = self.seen, self.count - len(self.seen)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        found = [data[a:b] for a, b in zip([0, *ends], ends)]
        numbers = np.array([seen.setdefault(x, known + len(seen)) for x in found], np.int64)
        fresh = [found[k] for k in np.flatnonzero(numbers >= self.count).tolist()]      # a row holds a stretch once
        self.count += len(fresh)
        self.file.write(b"".join(x + b"\0" for x in fresh))
        self.sizes.append(np.array([*map(len, fresh)], np.int64))
        self.asked.append((g, numbers, owners, latest))

    def answers(self):
        """For every group: its stretch, where strings begin in it, how many, and the smallest document that holds them."""
        sizes = np.concatenate(self.sizes)
        starts = np.cumsum(sizes + 1) - sizes - 1
        owner = np.full(self.count, LAST, np.int64)
        for _, numbers, owners, _ in self.asked:
            np.minimum.at(owner, numbers, owners)
        n = int(sizes.sum()) + self.count
        self.file.flush()
        raw = np.memmap(self.file, np.uint8, "r", shape=n)
        text = induced_sort.store(n + 1, np.uint8, self.memory)
        for lo in range(0, n, SLICE):
            text[lo:min(n, lo + SLICE)] = raw[lo:lo + SLICE] + np.uint8(2)      # no byte of UTF-8 is above 244
        text[starts + sizes] = 1            # ends a stretch
        text[n] = 0
        n_starts = sizes - self.length + 1
        begin = np.cumsum(n_starts) - n_starts              # of a stretch's strings among all
        total = int(n_starts.sum())
        # By position: the stretch of the string that begins there, -1 where none does.
        stretch = induced_sort.store(n, np.int32, self.memory)
        for lo in range(0, self.count, SLICE):
            hi = min(self.count, lo + SLICE)
            kinds = np.stack([np.arange(lo, hi), np.full(hi - lo, -1)], 1).ravel()
            stretch[starts[lo]:starts[hi - 1] + sizes[hi - 1] + 1] = np.repeat(
                kinds, np.stack([n_starts[lo:hi], np.full(hi - lo, self.length)], 1).ravel())
        least = induced_sort.store(total, np.int64, self.memory)
        group = induced_sort.store(total, induced_sort.kind_for(text), self.memory)
        shift = begin - starts
        run, open_run, groups = 0, -1, 0        # runs of suffixes so far, the last one with a string, and how many had one

        def take_run(pos, shared):
            nonlocal run, groups, open_run
            number = run + np.cumsum(shared < self.length)
            run = int(number[-1])
            own = stretch[pos]
            here = np.flatnonzero(own >= 0)
            if not len(here):
                return
            own, number = own[here], number[here]
            new = np.append(number[0] != open_run, number[1:] != number[:-1])
            open_run = int(number[-1])
            number = groups - 1 + np.cumsum(new)
            group[pos[here] + shift[own]] = number
            first = np.flatnonzero(new) if new[0] else np.append(0, np.flatnonzero(new))
            low = np.minimum.reduceat(owner[own], first)
            if not new[0]:
                low[0] = min(low[0], least[groups - 1])
            least[number[first]] = low
            groups = int(number[-1]) + 1

        induced_sort.suffixes_with_prefixes(text, 247, self.length, take_run, self.memory)
        del text, stretch
        # Runs of strings of a stretch whose smallest document is the same.
        low, turn = induced_sort.store(total + 1, np.int64, self.memory), induced_sort.store(total + 1, bool, self.memory)
        for lo in range(0, total, SLICE):
            low[lo:min(total, lo + SLICE)] = least[group[lo:lo + SLICE]]
        del least, group
        for lo in range(0, total, SLICE):
            turn[lo + 1:lo + SLICE + 1] = low[lo + 1:lo + SLICE + 1] != low[lo:min(total, lo + SLICE)]
        turn[begin] = turn[total] = True
        at = induced_sort.store(int(np.count_nonzero(turn)), np.int64, self.memory)
        end = 0
        for lo in range(0, total + 1, SLICE):
            here = lo + np.flatnonzero(turn[lo:lo + SLICE])
            at[end:end + len(here)] = here
            end += len(here)
        runs = np.searchsorted(at, np.append(begin, total))         # where each stretch's runs begin
        for g, numbers, _, latest in self.asked:
            each = runs[numbers + 1] - runs[numbers]
            which = np.repeat(np.arange(len(numbers)), each)
            k = np.arange(len(which)) + np.repeat(runs[numbers] - np.cumsum(each) + each, each)
            first = at[k]
            owned = low[first]
            hit = np.flatnonzero(owned < latest[which])            # some document of the group holds it later
            which, k, first, owned = which[hit], k[hit], first[hit], owned[hit]
            if len(k):
                yield (g, pack(which.astype(np.int32)), pack((first - begin[numbers[which]]).astype(np.int32)),
                       pack((at[k + 1] - first).astype(np.int32)), pack(owned))


def _sort_shards(sent: DataFrame, length: int, parts: int, memory: int) -> DataFrame:
    def run(batches):
        shard, part = None, None

        def done():
            for g, *x in shard.answers():
                yield batch_of(_FOUND, [(g, part, *x)])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if shard:
                        yield from done()
                    shard, part = Shard(length, memory), r["part"]
                shard.add(r["g"], unpack(r["sizes"], np.uint32), unpack(r["owners"], np.int64),
                          unpack(r["latest"], np.int64), unpack(r["bytes"]).tobytes())
        if shard:
            yield from done()

    d = sent.repartition(parts, "part").sortWithinPartitions("part")
    return d.mapInArrow(run, FOUND)


# --- cutting -----------------------------------------------------------------------

_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _covered(kept: Kept, answers: list) -> np.ndarray:
    """Whether each byte of a group's texts goes."""
    turn = np.zeros(len(kept.raw) + 1, np.int32)
    if answers:
        for _ in kept.distinct():     # numbers the stretches as they were sent
            pass
        code = kept.shard << 32 | kept.number
        order = np.argsort(code)
        code, start, own = code[order], kept.start[order], kept.owner[order]
        numbers = [unpack(a["number"], np.int32) for a in answers]
        block = np.cumsum([*map(len, numbers)]) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(answers)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            some = answers[x:y]
            col = lambda name, kind: np.concatenate([unpack(a[name], kind) for a in some])  # noqa: B023, E731
            want = np.concatenate([a["part"] << 32 | n.astype(np.int64) for a, n in zip(some, numbers[x:y])])
            lo, hi = np.searchsorted(code, want, "left"), np.searchsorted(code, want, "right")
            each = hi - lo
            which = np.repeat(np.arange(len(want)), each)
            at = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each) + lo[which]
            hit = col("owner", np.int64)[which] < own[at]
            which, at = which[hit], at[hit]
            first = start[at] + col("first", np.int32)[which]
            np.add.at(turn, first, 1)
            np.add.at(turn, first + col("n", np.int32)[which] + kept.length - 1, -1)
    return np.cumsum(turn[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES, hot: int = HOT,
                     memory: int = induced_sort.MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (byte spans of the UTF-8 text, maximal) and the bytes kept, one row per row.

    A byte goes if a string of ``length`` bytes that covers it also begins in a
    document of smaller id. Strings are judged on the input and never cross rows.
    Rows that share an id are not earlier than each other; a NULL id comes after all
    others. NULL and empty texts have no bytes. Texts are read whole, however long.
    ``length`` is 24 at least.
    """
    if length < GRAM + 8:
        raise ValueError("length is 24 at least")
    groups = grouped(take(docs, doc_id=id_col, text=text_col), group_bytes)
    total = groups.agg(F.sum("size")).first()[0] or 0
    parts = int(total) // part_bytes + 1
    marks, single = repeated(groups, length, parts, hot)
    informed = groups.join(marks, "g", "left")
    if single is not None:
        informed = informed.join(single.withColumnRenamed("replies", "single"), "g", "left")
    found = _sort_shards(send(informed, length, parts), length, parts, memory)
    answers = found.groupBy("g").agg(F.collect_list(F.struct("part", "number", "first", "n", "owner")).alias("answers"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                kept = Kept(batch, k, length, parts)
                gone = _covered(kept, batch.column(batch.schema.get_field_index("answers"))[k].as_py())
                limits, edge = kept.limits, np.zeros(len(gone) + 1, bool)
                edge[limits] = True                                     # spans end with their document
                first = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone)[:-1]))
                end = np.flatnonzero(gone & (edge[1:] | ~np.append(gone, False)[1:])) + 1
                before = np.append(0, np.cumsum(gone))[limits]          # bytes that go before each document
                rest, cut = kept.raw[~gone].tobytes(), (limits - before).tolist()
                turns, rows = np.searchsorted(first, limits).tolist(), []
                n_removed, limits = np.diff(before).tolist(), limits.tolist()
                for j, i in enumerate(kept.ids.tolist()):
                    lo, hi = limits[j:j + 2]
                    spans = [{"start": a - lo, "end": b - lo} for a, b in
                             zip(first[turns[j]:turns[j + 1]].tolist(), end[turns[j]:turns[j + 1]].tolist())] if n_removed[j] else []
                    rows.append((None if i == LAST else i, hi - lo, n_removed[j], spans, rest[cut[j]:cut[j + 1]]))
                yield batch_of(_CUT, rows)

    return informed.join(answers, "g", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")
