"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that hold a word, compared without
white space at their ends. In every window of ``window`` consecutive lines the
smallest hash (of equal ones the last) is selected as a fingerprint, so any run
of ``window`` or more lines that two places share has a fingerprint at the same
line in both: nothing of that length can be missed. A line of ``long_words`` words
or more is a run by itself, and a fingerprint of its own.

Only fingerprints are sent, each with its position and the windows on both sides
that selected it. They are joined globally; most occur once and go no further. At
every other position the match is extended both ways, window by window: a window
whose lines (two 64-bit hashes of each) stood together at an earlier position, in
an earlier document or further up in the same one, goes. The next fingerprint takes
the match up where the windows of the last one end, so a long match is followed
line by line to both of its ends. The first occurrence stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

from .hashing import mix, span_hashes
from .text import SPACES, sealed

WINDOW = 2
LONG_WORDS = 20           # a shorter line goes only together with a neighbour
BATCH_TEXTS = 512
_WINDOW = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def line_hashes(texts: list[str], long_words: int = LONG_WORDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text (two rows of hashes, line number, whether it has ``long_words`` words) of the lines that hold a word.

    All texts are hashed at once.
    """
    starts, ends, numbers, long, cut, at = [], [], [], [], [0], 0
    space, encoded = SPACES.encode(), [t.encode() for t in texts]
    for raw in encoded:
        for k, line in enumerate(raw.split(b"\n")):
            body = line.strip(space)
            if body:
                lo = at + line.index(body[:1])
                starts.append(lo)
                ends.append(lo + len(body))
                numbers.append(k)
                long.append(0 < long_words <= (len(body) + 1) // 2 and len(body.split()) >= long_words)
            at += len(line) + 1
        cut.append(len(starts))
    spans = np.frombuffer(b"".join(x + b"\n" for x in encoded), np.uint8), np.array(starts, np.int64), np.array(ends, np.int64)
    h = np.stack([span_hashes(*spans), span_hashes(*spans, 1)])
    numbers, long = np.array(numbers, np.int32), np.array(long, bool)
    return [(h[:, lo:hi], numbers[lo:hi], long[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])]


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the fingerprint of every window: its smallest hash, the last of equal ones."""
    n = len(h) - window + 1
    best = np.arange(n) + window - 1
    for k in range(window - 2, -1, -1):
        at = np.arange(n) + k
        best = np.where(h[at] < h[best], at, best)
    return best


def _runs(h: np.ndarray, window: int) -> np.ndarray:
    """Two rows of hashes of all windows."""
    out = np.full((2, h.shape[1] - window + 1), window, np.uint64)
    for k in range(window):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[:, k:k + out.shape[1]])
    return out


def fingerprints(h: np.ndarray, numbers: np.ndarray, long: np.ndarray, window: int):
    """(mark, position, number of windows, and all windows' two hashes, first and last line) of a text's fingerprints."""
    mark, place, count, runs, first, last = [], [], [], [], [], []
    if window > 1 and long.any():
        own = _runs(h[:, long], 1)
        mark.append(own[0])
        place.append(np.flatnonzero(long))
        count.append(np.ones(own.shape[1], np.int64))
        runs.append(own)
        first.append(numbers[long])
        last.append(numbers[long])
    if h.shape[1] >= window:
        best = winnowed(h[0], window)       # ascending
        at = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        mark.append(h[0][best[at]])
        place.append(best[at])
        count.append(np.diff(np.append(at, len(best))))
        runs.append(_runs(h, window))
        first.append(numbers[:len(best)])
        last.append(numbers[window - 1:])
    if not mark:
        return None
    return (*(np.concatenate(x) for x in (mark, place, count)), np.concatenate(runs, 1), np.concatenate(first), np.concatenate(last))


def _marks(docs: DataFrame, window: int, long_words: int) -> DataFrame:
    """Fingerprints of every document (k1, k2, text), with their positions and windows."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(lo, BATCH_TEXTS)
                keys, found = [], []
                k1, k2, texts = (c.to_pylist() for c in part.columns)
                for k1, k2, lines in zip(k1, k2, line_hashes(texts, long_words)):
                    f = fingerprints(*lines, window)
                    if f:
                        keys.append((k1, k2, len(f[0])))
                        found.append(f)
                if not found:
                    continue
                mark, place, count, runs, first, last = (np.concatenate(x, -1) for x in zip(*found))
                k1, k2, n = (np.array(x, np.int64) for x in zip(*keys))
                windows = pa.StructArray.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((*runs.view(np.int64), first, last), _WINDOW)], fields=list(_WINDOW))
                ends = np.append(0, np.cumsum(count)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(k1, n)), pa.array(np.repeat(k2, n)), pa.array(mark.view(np.int64)),
                     pa.array(place.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), windows)],
                    names=["k1", "k2", "mark", "place", "windows"])

    return docs.mapInArrow(run, "k1 long, k2 long, mark long, place int, "
                                "windows array<struct<a:long,b:long,first:int,last:int>>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                keep: tuple = (), long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and ``clean``, the text without repeated runs of lines.

    Order is by id, then by a hash of the text, so rows that share an id are
    documents of their own; rows equal in id and text are one document and are cut
    alike. A NULL id stands after all others. Lines without a word between two
    removed lines of one run go with them. NULL texts stay NULL, with no lines.
    Texts of fewer than ``window`` lines are cut only where a line is long; with
    ``long_words`` 0 none is. ``keep`` names input columns to carry along as a struct ``row``.
    """
    d = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
        F.coalesce(F.col(f"`{id_col}`"), F.lit((1 << 63) - 1)).alias("k1"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("k2"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []))
    some = F.instr("text", "\n") > 0 if window > 1 else F.col("text").isNotNull()
    if long_words:
        some = some | (F.length("text") >= 2 * long_words - 1)
    texts = d.where(some).select("k1", "k2", "text")
    marks = _marks(texts, window, long_words)
    # Fingerprints that occur more than once, their positions, and then the windows around them.
    # Each step is materialised, which leaves both sides of the next join to exchanges of their
    # own: a line that a third of all documents share can then be split over tasks.
    again = cut_lineage(marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    places = marks.join(again, "mark").select("k1", "k2", F.explode("windows").alias("w"))
    around = cut_lineage(places.select("k1", "k2", "w.a", "w.b", "w.first", "w.last"))
    first = around.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first")).alias("o"))
    later = around.join(cut_lineage(first.where("n > 1")), ["a", "b"]).where(
        F.struct("k1", "k2", "first") > F.col("o")).select("k1", "k2", "first", "last")
    gone = later.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    d = d.join(gone, ["k1", "k2"], "left")
    d = d.withColumn("lines", F.split("text", "\n", -1))
    d = d.withColumn("out", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    clean = F.when(F.col("out").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return sealed(d.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                    F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_removed"), clean.alias("clean"),
                    *(["row"] if keep else [])))
