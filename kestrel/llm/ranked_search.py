"""Ranked lexical search with hashed max-sketches.

A document's terms are folded onto ``coords`` hashed coordinates, each holding the
largest impact of the terms that fall there. A query's weights, summed per
coordinate, times that sketch bound the document's score from above; a whole block
of queries is looked up in a batch of sketches by one product. Each query then
scores documents exactly in descending order of their bounds until a bound is below
its tenth best score. Tasks keep the best of their rows, and two rounds of ranking
merge them.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import take

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")   # fixed value: a term, in UTF-8 bytes
COORDS = 1024           # coordinates of a sketch, a power of two
ITEM_BLOCK = 4_096      # queries that one pass over the documents answers
BLOCK_BYTES = 16 << 20  # of the terms of such a block
BATCH_DOCS = 256        # sketches that are looked up at once
SALTS = 64              # groups that a query's candidates are first ranked in
_LAST = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text with A-Z lower-cased, repeats included; NULL has none."""
    return TERM.findall((text or "").encode().lower())


def impact(tf: np.ndarray, length_part: np.ndarray) -> np.ndarray:
    """Score of ``tf`` occurrences before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length_part)


def _blocks(queries: DataFrame):
    """Blocks of (id, distinct terms), bounded in number and bytes; rows that share an id are one query."""
    block, size = [], 0
    for r in queries.groupBy("id").agg(F.collect_list("text").alias("texts")).toLocalIterator():
        found = sorted({t for x in r.texts for t in terms(x)})
        nbytes = sum(map(len, found))
        if block and (len(block) == ITEM_BLOCK or size + nbytes > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r.id, found))
        size += nbytes
    if block:
        yield block


def statistics(docs: DataFrame, wanted: frozenset) -> tuple[int, int, dict]:
    """Number of documents with a term, number of all their terms, and in how many documents each wanted term is."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        n, total, df = 0, 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(text)
                n += bool(found)
                total += len(found)
                df.update(shared.value.intersection(found))
        keys = [None, *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n, *df.values()], pa.int64()),
                                          pa.array([total] + [0] * len(df), pa.int64())], names=["term", "n", "total"])

    rows = (docs.select("text").mapInArrow(run, "term binary, n long, total long")
            .groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    n, total = next(((r.n, r.total) for r in rows if r.term is None), (0, 0))
    return n, total, {bytes(r.term): r.n for r in rows if r.term is not None}


class BestOf:
    """The k best documents of every query among the rows seen so far."""

    def __init__(self, block: list, weights: dict, n: int, total: int, k: int, coords: int):
        self.n, self.total, self.k, self.coords = n, total, k, coords
        self.items = [[(t, weights[t]) for t in found if weights.get(t)] for _, found in block]
        self.lookup = np.zeros((len(block), coords))
        for row, item in zip(self.lookup, self.items):
            for t, w in item:
                row[zlib.crc32(t) % coords] += w
        self.best = [[] for _ in block]
        self.floor = np.zeros(len(block))
        self.scored = 0

    def add(self, ids: list, texts: list) -> None:
        counts = [Counter(terms(t)) for t in texts]
        size = np.array([c.total() for c in counts], np.int64)
        parts = 10 + (90 * size * self.n) // self.total
        rows = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        tf = np.fromiter((v for c in counts for v in c.values()), np.int64, len(rows))
        at = np.fromiter((zlib.crc32(t) for c in counts for t in c), np.int64, len(rows)) % self.coords
        sketch = np.zeros(len(counts) * self.coords)
        np.maximum.at(sketch, rows * self.coords + at, impact(tf, parts[rows]))
        # Sums of whole numbers in doubles: the margin keeps them bounds where they are too large to be exact.
        bounds = (self.lookup @ sketch.reshape(len(counts), -1).T) * (1 + 1e-9)
        for j in np.flatnonzero((bounds >= np.maximum(self.floor, 1)[:, None]).any(1)):
            self._rescore(j, bounds[j], ids, counts, parts)

    def _rescore(self, j: int, bounds: np.ndarray, ids: list, counts: list, parts: np.ndarray) -> None:
        best, item = self.best[j], self.items[j]
        near = np.flatnonzero(bounds >= max(self.floor[j], 1))
        for d in near[np.argsort(-bounds[near], kind="stable")].tolist():
            if bounds[d] < self.floor[j]:
                break
            self.scored += 1
            part, found, score = int(parts[d]), counts[d], 0
            for t, w in item:
                tf = found.get(t)
                if tf:
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * part))
            entry = (score, -(_LAST if ids[d] is None else ids[d]))
            if score and len(best) < self.k:
                heapq.heappush(best, entry)
            elif score and entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == self.k:
                self.floor[j] = best[0][0]


def search(queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text",
           doc_id: str = "doc_id", text_col: str = "text", k: int = 10, coords: int = COORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each query, all if fewer.

    Equal scores stand by ascending doc_id, a NULL id last. Each row of documents is
    one document, also where ids or texts repeat. Queries that share an id (or have
    none) are one query with the terms of all. NULL, blank and term-less texts on
    either side give no rows; texts are read whole, however long. Queries meet the
    documents in blocks of at most ``ITEM_BLOCK``, one pass over the documents each.
    """
    d = take(docs, doc_id=doc_id, text=text_col)
    q = take(queries, id=query_id, text=query_text)
    schema = f"item_id {q.schema['id'].dataType.simpleString()}, doc_id long, score long"
    found = None
    for block in _blocks(q):
        n, total, df = statistics(d, frozenset(t for _, x in block for t in x))
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
        part = _search_block(d, block, weights, n, total, k, coords, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for group in (["item_id", "salt"], ["item_id"]):
        if "salt" in group:
            found = found.withColumn("salt", F.spark_partition_id() % SALTS)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        found = found.where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _search_block(d: DataFrame, block: list, weights: dict, n: int, total: int, k: int, coords: int,
                  schema: str) -> DataFrame:
    shared = d.sparkSession.sparkContext.broadcast((block, weights))
    kind = d.sparkSession.createDataFrame([], schema).limit(0).toArrow().schema

    def run(batches):
        block, weights = shared.value
        top = BestOf(block, weights, n, max(total, 1), k, coords)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(lo, BATCH_DOCS)
                top.add(part.column(0).to_pylist(), part.column(1).to_pylist())
        rows = [(block[j][0], None if e[1] == -_LAST else -e[1], e[0]) for j, b in enumerate(top.best) for e in b]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind.field(i).type) for i, c in
                                          enumerate(zip(*rows) if rows else ([], [], []))], names=kind.names)

    return d.mapInArrow(run, schema)
