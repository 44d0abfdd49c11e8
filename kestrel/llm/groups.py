"""Groups of documents of a few megabytes, which ask other tasks about what they hold.

An operator that compares small pieces of all texts sends them by group and part
instead of one by one: a piece is in a group's rows once, however often the group
holds it, so a piece that all documents share costs a part one entry a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

GROUP_BYTES = 2 << 20     # of texts in a group; a longer text is a group by itself
LAST = (1 << 63) - 1      # stands for a NULL id
LEVEL = 9                 # of the texts' compression: they are written and read by several steps


def pack(x: np.ndarray | bytes, level: int = 1) -> bytes:
    """Bytes of an array, compressed where that saves some; the first four or eight say how many they are."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    small = pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True) if len(raw) > 64 else raw
    return len(raw).to_bytes(8, "little") + small if len(small) + 4 < len(raw) else b"\xff\xff\xff\xff" + raw


def unpack(x: bytes, dtype=np.uint8) -> np.ndarray:
    if x[:4] == b"\xff\xff\xff\xff":
        return np.frombuffer(x[4:], dtype)
    size = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype)


def batch_of(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows) if rows else [[]] * len(schema))],
                                      schema=schema)


_GROUP = pa.schema([("g", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("limits", pa.binary()),
                    ("known", pa.binary()), ("texts", pa.binary())])
GROUP = "g long, size long, ids binary, limits binary, known binary, texts binary"


def grouped(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Groups of documents (doc_id, text): number, bytes, ids, where texts end, which aren't NULL, and all texts.

    A NULL id stands after all others, as ``LAST``. Groups are kept in the shared
    folder, so that their numbers last.
    """
    def run(batches):
        first = TaskContext.get().partitionId() << 32
        ids, texts, known, size = [], [], [], 0

        def row():
            nonlocal first
            limits = np.cumsum([0, *map(len, texts)])
            first += 1
            return batch_of(_GROUP, [(first - 1, int(limits[-1]), pack(np.array(ids, np.int64)), pack(limits.astype(np.int64)),
                                       pack(np.array(known, np.uint8)), pack(b"".join(texts), LEVEL))])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                has, t = t is not None, (t or "").encode()
                if ids and size + len(t) > group_bytes:
                    yield row()
                    ids, texts, known, size = [], [], [], 0
                ids.append(LAST if i is None else i)
                texts.append(t)
                known.append(has)
                size += len(t)
        if ids:
            yield row()

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, GROUP))


def by_group(replies: DataFrame, *cols: str) -> DataFrame:
    return replies.groupBy("g").agg(F.collect_list(F.struct(*cols)).alias("replies"))


def opened(batch: pa.RecordBatch, k: int) -> tuple:
    col = lambda name: batch.column(batch.schema.get_field_index(name))[k].as_py()
    return col("g"), unpack(col("ids"), np.int64), unpack(col("limits"), np.int64), unpack(col("texts"))


def per_group(fn, schema: pa.Schema):
    """A function of (one group's row) that yields rows, as one for mapInArrow."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(fn(batch, k))
                if rows:
                    yield batch_of(schema, rows)
    return run
