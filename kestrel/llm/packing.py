"""Hierarchical multi-length packing of tokenised documents.

Every document's ids (with an end id) are routed by length: whole windows of the
longest context size stand alone, the rest goes to the smallest context size
(tier) that holds it. Tiers are packed from the longest down; the gap a window
leaves is filled from shorter tiers, the longest document that fits first, and
only where none fits is a document cut, so that every window is full. What is
left at the end of a partition is cut at powers of two, which need no padding.

Full sequences are dealt into step groups: a group holds sequences of one
context size and a fixed number of tokens, so all steps cost the same. The few
sequences left over at the end are balanced greedily over mixed groups.

Each input partition is packed on its own, in one pass without a shuffle. The
state is one open window and one open step group per tier, whatever the size of
the partition, and a retried task yields the same rows again.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import default_path, tokenizer
from .text import take

WINDOW = 1024
TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 16_384
BATCH_TEXTS = 512
END_ID = 0

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, context int, step_id long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("context", pa.int32()), ("step_id", pa.int64())])


class _Shelf:
    """Pieces by length; finds the longest one not above a bound."""

    def __init__(self):
        self._by: dict[int, list] = defaultdict(list)
        self._mask = 0

    def put(self, piece) -> None:
        n = piece[2]
        if n:
            self._by[n].append(piece)
            self._mask |= 1 << n

    def take(self, most: int):
        fit = self._mask & ((1 << (most + 1)) - 1)
        if not fit:
            return None
        n = fit.bit_length() - 1
        piece = self._by[n].pop()
        if not self._by[n]:
            self._mask ^= 1 << n
        return piece


class Packer:
    """Packs one partition. A piece is (document, start, length); a document is (id, ids, tokens)."""

    def __init__(self, tiers: tuple, step_tokens: int, base: int):
        self.tiers, self.step_tokens, self.base = tuple(sorted(tiers)), step_tokens, base
        self.window = self.tiers[-1]
        self.shelf = _Shelf()
        self.open: list = []       # pieces of the window that is not full yet
        self.context = self.room = 0
        self.groups: dict[int, list] = defaultdict(list)   # tier -> sequences of its open step group
        self.sequences = self.steps = 0
        self.rows: list = []

    def add(self, doc) -> None:
        n, at = doc[2], 0
        while n - at >= self.window:
            self._sequence([(doc, at, self.window)], self.window)
            at += self.window
        self.shelf.put((doc, at, n - at))

    def pack(self) -> None:
        """Use up the shelf; at most one window stays open."""
        while True:
            if not self.room:
                piece = self.shelf.take(self.window)
                if piece is None:
                    return
                self.context = next(t for t in self.tiers if t >= piece[2])
                self.open, self.room = [piece], self.context - piece[2]
            else:
                piece = self.shelf.take(self.room)
                if piece is None:
                    piece = self.shelf.take(self.window)
                    if piece is None:
                        return
                    doc, at, n = piece
                    piece = (doc, at, self.room)
                    self.shelf.put((doc, at + self.room, n - self.room))
                self.open.append(piece)
                self.room -= piece[2]
            if not self.room:
                self._sequence(self.open, self.context)
                self.open = []

    def finish(self) -> None:
        """Cut the last open window at powers of two; balance the open step groups."""
        left, self.open = self.open[::-1], []
        total = sum(p[2] for p in left)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            pieces = []
            while size:
                doc, at, n = left.pop()
                m = min(n, size)
                pieces.append((doc, at, m))
                if m < n:
                    left.append((doc, at + m, n - m))
                size -= m
            self._sequence(pieces, sum(p[2] for p in pieces))
        rest = sorted((s for g in self.groups.values() for s in g), key=lambda s: -s[1])
        self.groups.clear()
        count = -(-sum(s[1] for s in rest) // self.step_tokens)
        bins: list[list] = [[0, k, []] for k in range(count)]
        for s in rest:
            least = min(bins)
            least[0] += s[1]
            least[2].append(s)
        for _, _, group in bins:
            self._step(group)

    def _sequence(self, pieces: list, context: int) -> None:
        group = self.groups[context]
        group.append((pieces, context))
        if (len(group) + 1) * context > self.step_tokens:
            self._step(self.groups.pop(context))

    def _step(self, group: list) -> None:
        for pieces, context in group:
            at = 0
            for (doc_id, ids, tokens), start, n in pieces:
                self.rows.append((doc_id, start, n, ids[4 * start:4 * (start + n)], tokens,
                                  self.base + self.sequences, at, context, self.base + self.steps))
                at += n
            self.sequences += 1
        self.steps += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         tiers: tuple = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of documents in sequences: one row per piece, with its ids as little-endian 32-bit numbers.

    NULL and empty texts are the end id alone. A NULL id and repeated rows are
    ordinary documents. An empty table gives no rows. ``tiers`` are powers of two.
    """
    path, end = path or default_path(), np.asarray([END_ID], "<u4").tobytes()

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        packer = Packer(tiers, step_tokens, base)

        def out():
            rows, packer.rows = packer.rows, []
            cols = zip(*rows) if rows else [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                part = [t or "" for t in texts.slice(lo, BATCH_TEXTS).to_pylist()]
                for doc_id, b in zip(ids.slice(lo, BATCH_TEXTS).to_pylist(), tokenizer(path).encode(part)):
                    b += end
                    packer.add((doc_id, b, len(b) // 4))
                packer.pack()
                yield out()
        packer.finish()
        yield out()

    return take(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)
