"""Exact top-k search by integer inner product over a bit-sliced index.

Every component is quantised to floor(1024 * x). The index stores, per block of
rows, the exact integers and, for each attribute, the upper bits of
(value - block minimum) as one bitmap per bit. A query adds the slices of all
attributes, each weighted by the query's component, with bitmap arithmetic only
(carry-save adders over whole bitmaps): the result is again a set of slices, one
per bit of the approximate score. The k-th best score is found from the most
significant slice downward. The bits that the slices leave out bound how far a
score can be off, so every row within that bound of the k-th best (the boundary
rows) is scored exactly; no other row can be among the best k.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import cut_lineage, ensure_checkpoint_dir

from .text import take

SCALE = 1024          # fixed value
BLOCK_ROWS = 16_384   # rows of an index block: 4 MB of integers at 64 attributes
QUERY_BLOCK = 4_096   # queries that meet the index at once: 2 MB at 64 attributes
KEPT_BITS = 6         # slices per attribute
LARGEST = 1 << 26     # from here on a quantised component is wide: scored in whole numbers of any size
MOST = (1 << 63) - 1  # scores beyond 64 bits count as this, or as its negative

WIDE = -1             # in place of a shift: a block of rows with wide components, without slices

INDEX = "dims int, n int, shift int, ids binary, mins binary, widths binary, slices binary, rows binary"
_INDEX = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), *[
    (c, pa.binary()) for c in ("ids", "mins", "widths", "slices", "rows")]])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _quantised(ids: pa.Array, vectors: pa.Array):
    """(ids, integer matrix) per number of attributes; rows that take no part are left out.

    Rows with a wide component come apart from the others, as whole numbers of any size.
    """
    ok = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
    ids, vectors = ids.filter(ok), vectors.filter(ok)
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]):
        pick = pa.array(size == d)
        m = vectors.filter(pick).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        fit = np.isfinite(m).all(1)
        q = np.floor(SCALE * m[fit])
        own = ids.filter(pick).to_numpy(zero_copy_only=False)[fit].astype(np.int64)
        wide = (np.abs(q) >= LARGEST).any(1)
        yield int(d), own[~wide], q[~wide].astype(np.int64)
        if wide.any():
            yield int(d), own[wide], np.array([[int(x) for x in row] for row in q[wide].tolist()], object)


def _block(d: int, ids: np.ndarray, m: np.ndarray) -> tuple:
    if m.dtype == object:
        return d, len(ids), WIDE, ids.tobytes(), b"", b"", b"", ",".join(map(str, m.ravel())).encode()
    mins = m.min(0)
    a = m - mins
    shift = max(0, int(a.max()).bit_length() - KEPT_BITS)
    a >>= shift
    widths = np.array([int(x).bit_length() for x in a.max(0)], np.int32)
    words = -(-len(ids) // 64)
    bits = np.zeros((int(widths.sum()), words * 8), np.uint8)
    packed = -(-len(ids) // 8)
    k = 0
    for j in range(d):
        for b in range(widths[j]):
            bits[k, :packed] = np.packbits((a[:, j] >> b).astype(np.uint8) & 1, bitorder="little")
            k += 1
    return d, len(ids), shift, ids.tobytes(), mins.tobytes(), widths.tobytes(), bits.tobytes(), \
        m.astype(np.int32).tobytes()


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bit-sliced index of every row, one row per block.

    Rows with a NULL id, a NULL vector, or a NULL or non-finite component take no
    part. Vectors of different lengths go to different blocks, and so do those with
    a component of 2^26 or more, which are scored exactly without slices.
    """
    def run(batches):
        held: dict[tuple, list] = {}

        def full(d: tuple, least: int):
            ids, m = (np.concatenate(x) for x in zip(*held[d]))
            at = 0
            while len(ids) - at >= least and len(ids) > at:
                row = _block(d[0], ids[at:at + block_rows], m[at:at + block_rows])
                at += block_rows
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX)], schema=_INDEX)
            held[d] = [(ids[at:], m[at:])]

        for batch in batches:
            for d, ids, m in _quantised(batch.column(0), batch.column(1)):
                kind = d, m.dtype == object
                held.setdefault(kind, []).append((ids, m))
                if sum(len(x) for x, _ in held[kind]) >= block_rows:
                    yield from full(kind, block_rows)
        for d in held:
            yield from full(d, 1)

    return take(vectors, vec_id=id_col, v=vector_col).mapInArrow(run, INDEX)


class Block:
    """One index block, ready to be searched."""

    def __init__(self, row: dict):
        self.n, self.shift, d = row["n"], row["shift"], row["dims"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        if self.shift == WIDE:
            self.rows = np.array(list(map(int, row["rows"].split(b","))), object).reshape(self.n, d)
            return
        self.mins = np.frombuffer(row["mins"], np.int64)
        self.widths = np.frombuffer(row["widths"], np.int32)
        self.rows = np.frombuffer(row["rows"], np.int32).reshape(self.n, d)
        words = -(-self.n // 64)
        flat = np.frombuffer(row["slices"], np.uint64).reshape(-1, words)
        cut = np.concatenate([[0], np.cumsum(self.widths)])
        every = np.zeros(words * 8, np.uint8)
        every[:-(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.every = every.view(np.uint64)
        self.slices = [list(flat[cut[j]:cut[j + 1]]) for j in range(d)]
        self.flipped = [[~s for s in part] for part in self.slices]   # of (2^width - 1 - value)

    def add(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over attributes of |q| * a,
        where a counts down for negative q."""
        columns: list[list] = []
        for j, x in enumerate(q.tolist()):
            part, x, at = (self.flipped if x < 0 else self.slices)[j], abs(x), 0
            while x >> at:
                if x >> at & 1:
                    while len(columns) < at + len(part):
                        columns.append([])
                    for b, s in enumerate(part):
                        columns[at + b].append(s)
                at += 1
        out, c = [], 0
        while c < len(columns):
            col = columns[c]
            if len(col) > 1 and c + 1 == len(columns):
                columns.append([])
            at = 0
            while len(col) - at > 2:
                x, y, z = col[at:at + 3]
                at += 3
                t = x ^ y
                columns[c + 1].append((x & y) | (t & z))
                col.append(t ^ z)
            col = col[at:]
            if len(col) == 2:
                x, y = col
                columns[c + 1].append(x & y)
                col = [x ^ y]
            out.append(col[0] if col else np.zeros_like(self.every))
            c += 1
        return out

    def search(self, query_id: int, q: np.ndarray, k: int):
        """(ids, scores) of the block's best k rows, ties to smaller ids."""
        if self.shift == WIDE or q.dtype == object:
            rows = np.flatnonzero(self.ids != query_id)
            score = self.rows[rows].astype(object) @ q.astype(object)
            score = np.array([max(-MOST, min(MOST, x)) for x in score], np.int64)
            best = np.lexsort((self.ids[rows], -score))[:k]
            return self.ids[rows][best], score[best]
        alive = self.every.copy()
        for own in np.flatnonzero(self.ids == query_id):
            alive[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        total = self.add(q)
        left, pool, kth = k, alive, 0
        if int(np.bitwise_count(alive).sum()) > k:
            for s in reversed(total):
                ones = pool & s
                n = int(np.bitwise_count(ones).sum())
                if n >= left:
                    pool, kth = ones, kth * 2 + 1
                else:
                    left, pool, kth = left - n, pool & ~s, kth * 2
            slack = int(np.abs(q).sum()) * ((1 << self.shift) - 1)
            least = max(0, kth - (-(-slack >> self.shift)))
            above, equal = np.zeros_like(alive), alive
            for b in range(len(total) - 1, -1, -1):
                if least >> b & 1:
                    equal = equal & total[b]
                else:
                    above |= equal & total[b]
                    equal = equal & ~total[b]
            alive = above | equal
        rows = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[:self.n])
        score = self.rows[rows].astype(np.int64) @ q
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def _search(index: DataFrame, queries: list, k: int) -> DataFrame:
    """Best k of every index block for one bounded block of queries [(id, components)]."""
    by_dims: dict[int, list] = {}
    for qid, v in queries:
        wide = max(map(abs, v)) >= LARGEST
        by_dims.setdefault(len(v), []).append((qid, np.array(list(map(int, v)), object if wide else np.int64)))
    shared = index.sparkSession.sparkContext.broadcast(by_dims)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                out = [(qid, *block.search(qid, q, k)) for qid, q in shared.value.get(row["dims"], [])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.zeros(0, np.int64), *[np.full(len(i), qid, np.int64) for qid, i, _ in out]])),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *[i for _, i, _ in out]])),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in out]]))], schema=_FOUND)

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def quantised_queries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, q) of the rows that take part; of rows that share an id the smallest vector."""
    d = take(vectors, query_id=id_col, v=vector_col)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    d = d.where(F.col("query_id").isNotNull() & (F.size("v") > 0) & F.forall("v", ok))
    scaled = lambda x: F.lit(float(SCALE)) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < float(1 << 52), F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    q = F.transform("v", whole)     # whole numbers; from 2^52 on all doubles are
    return d.groupBy("query_id").agg(F.min(q).alias("q"))


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best rows of the index for every query (query_id, q): query_id, rank, vec_id, score.

    Rows with the query's own id are no candidates; only vectors of the query's
    length are. Ties go to the smaller id; scores beyond 64 bits count as the largest
    (or smallest) one. Queries meet the index in blocks of at
    most ``query_block`` rows, so what a task gets at once has a fixed bound.
    """
    spark = index.sparkSession
    found, last, many = [], None, queries.count() > query_block
    if many:
        index, queries = cut_lineage(index), cut_lineage(queries)
    while True:
        rest = queries if last is None else queries.where(F.col("query_id") > last)
        block = rest.orderBy("query_id").limit(query_block).collect()   # at most query_block rows
        if not block:
            break
        last = block[-1].query_id
        part = _search(index, [(r.query_id, r.q) for r in block], k)
        if many:
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/topk-{uuid.uuid4().hex}"
            part.write.parquet(path)
            part = spark.read.parquet(path)
        found.append(part)
        if len(block) < query_block:
            break
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
