"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set of five-word shingles is thrown into the sketch's bins in
rounds. In the first ``t`` rounds a hash places every shingle in a random bin
with the value round + fraction; in ``t`` more rounds round ``t + b`` places all
of them in bin ``b``. Each bin keeps its smallest value, and rounds stop as soon
as all bins are filled: every coordinate is sure to be filled, two sets agree in
a coordinate with probability equal to their Jaccard similarity, and the number
of agreeing coordinates is concentrated as for independent samples.

Coordinates are grouped into bands; documents that agree in a band share a
bucket. With 32 bands of 6 a pair at similarity 0.85 misses all of them with
probability 3e-7. Documents of one set are one class before banding.

What has to be found are the components, so pairs are first compared in rounds, at
most one for every class in each: with the hub of one of its buckets. Buckets whose
members have come to one component are closed, and a large group of copies costs
comparisons in proportion to its size. In the buckets that stay open all pairs
across components are compared: small buckets pair by pair, larger ones in blocks
of members, where the intersections of two blocks are one matrix product and only
links that join components come out. A pair is first looked up in the sketches
where that saves reading the sets: by their concentration, similar sets agree in
fewer coordinates than the bound with probability 1e-12. Links count on full sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.components import components
from kestrel.session import cut_lineage

from .hashing import mix, window_hashes, word_hashes
from .text import take

SHINGLE = 5
PERCENT = 85              # link if 100 * intersection >= PERCENT * union
BANDS, BAND_ROWS = 32, 6
BATCH_TEXTS = 256
HUB_ROUNDS = 2            # rounds with hubs, before the open buckets are compared whole
SMALL_BUCKET = 16         # members up to which a bucket's pairs are rows of their own
BLOCK = 256               # members of a larger bucket that are compared with as many others in one task
MISS = 1e-12              # probability that the sketches hide a link
BROADCAST_ROWS = 2_000_000   # ids of 8 bytes: 16 MB

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_seeds: dict[int, np.ndarray] = {}


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; of a shorter text its whole sequence, if any."""
    words, cut = word_hashes([(t or "").encode() for t in texts])
    grams = window_hashes(words, SHINGLE)
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        n = hi - lo
        if n >= SHINGLE:
            out.append(np.unique(grams[lo:hi - SHINGLE + 1]))
        else:
            out.append(window_hashes(words[lo:hi], int(n)) if n else words[:0])
    return out


def sketch(x: np.ndarray, t: int = BANDS * BAND_ROWS) -> np.ndarray:
    """Fast similarity sketch with ``t`` filled coordinates of a set that isn't empty."""
    if t not in _seeds:
        _seeds[t] = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    seeds, out = _seeds[t], np.full(t, _NONE, np.uint64)
    at, block = 0, max(1, 1024 // len(x))
    while at < t:
        rounds = np.arange(at, min(t, at + block), dtype=np.uint64)
        h = mix(x[None, :] ^ seeds[at:at + len(rounds), None])
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds << np.uint64(32))[:, None] | (h & _LOW)).ravel())
        at += len(rounds)
        if (out != _NONE).all():
            return out
    for b in np.flatnonzero(out == _NONE):
        out[b] = np.uint64((t + int(b)) << 32) | (mix(x ^ seeds[t + b]) & _LOW).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band."""
    rows = coordinates.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def least_agreement(percent: int, t: int = BANDS * BAND_ROWS) -> int:
    """Coordinates in which sets of the given similarity agree but with probability MISS (Chernoff)."""
    p = percent / 100
    for a in range(int(t * p), 0, -1):
        q = a / t
        if t * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if p < 1 else 0)) >= -math.log(MISS):
            return a
    return 0


def profiles(docs: DataFrame) -> DataFrame:
    """Of every document (doc_id, text): n_shingles, set identity (two 64-bit halves), a byte of
    every sketch coordinate, and band keys."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                sets = shingle_sets(batch.column(1).slice(lo, BATCH_TEXTS).to_pylist())
                prints = [np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets]
                sketches = [sketch(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, BATCH_TEXTS), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in sketches], pa.binary()),
                    _lists([np.zeros(0, np.int64) if x is None else band_keys(x) for x in sketches])],
                    names=["doc_id", "n_shingles", "p1", "p2", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, p1 long, p2 long, sig binary, bands array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, x) of the named documents, their sets as arrays."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                sets = shingle_sets(batch.column(1).slice(lo, BATCH_TEXTS).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, BATCH_TEXTS),
                                                  _lists([x.view(np.int64) for x in sets])], names=["doc_id", "x"])

    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, x array<long>")


def _plausible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose set sizes and sketches allow a link."""
    least = least_agreement(percent)
    of = lambda c: facts.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    both = both.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v", "su", "sv")

    def run(batches):
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8) for k in (2, 3)]
            agree = (bits[0] == bits[1]).reshape(batch.num_rows, -1).sum(1) if batch.num_rows else np.zeros(0)
            yield batch.select(["u", "v"]).filter(pa.array(agree >= least))

    return both.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links: 100 * intersection >= percent * union of the full sets."""
    pairs = cut_lineage(_plausible(pairs, facts, percent))
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = cut_lineage(_full_sets(docs, ids))
    a = sets.select(F.col("doc_id").alias("u"), F.col("x").alias("xu"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("x").alias("xv"))
    both = F.size(F.array_intersect("xu", "xv"))
    link = 100 * both >= percent * (F.size("xu") + F.size("xv") - both)
    return pairs.join(b, "v").join(a, "u").where(link).select("u", "v")


def block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of links between two lists of sorted distinct shingle hashes."""
    flat = np.concatenate([*left, *right])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1          # shingles of one member alone meet nothing
    sizes = np.array([len(x) for x in [*left, *right]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    held = count[code] > 1
    x = np.zeros((len(sizes), int((count > 1).sum())), np.float32)
    x[row[held], column[code[held]]] = 1
    n = len(left)
    both = (x[:n] @ x[n:].T).astype(np.int64)   # exact: counts are far below 2^24
    return 100 * both >= percent * (sizes[:n, None] + sizes[None, n:] - both)


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join components within large buckets (key, rep, c, n), block against block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    m = members.withColumn("b", F.pmod(F.xxhash64("rep", "key"), blocks).cast("int"))
    m = m.select("key", "rep", "c", "b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    m = m.select("key", "rep", "c", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    m = m.join(sets.select(F.col("doc_id").alias("rep"), "x"), "rep")

    def run(group):
        lo, hi, b = group["lo"].iloc[0], group["hi"].iloc[0], group["b"].to_numpy()
        reps, c = group["rep"].to_numpy(), group["c"].to_numpy()
        sets = [np.asarray(x).view(np.uint64) for x in group["x"]]
        i, j = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        if not len(i) or not len(j):
            return pd.DataFrame([], columns=["u", "v"], dtype="int64")
        p, q = np.nonzero(block_links([sets[k] for k in i], [sets[k] for k in j], percent))
        root = {x: x for x in c.tolist()}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        out = []
        for u, v in zip(i[p].tolist(), j[q].tolist()):
            a, z = top(c[u]), top(c[v])
            if a != z:
                root[a] = z
                out.append((reps[u], reps[v]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return m.groupBy("key", "lo", "hi").applyInPandas(run, "u long, v long")


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) within the components of all links between classes (rep, n, sig, bands)."""
    entries = classes.select("rep", F.explode("bands").alias("key"))
    # Only keys that two classes share go on. Both sides of the join are read from exchanges, so
    # that a hot key can be split.
    shared = cut_lineage(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    entries = cut_lineage(entries.join(shared, "key").select("key", "rep", F.col("rep").alias("c")))
    facts = cut_lineage(classes.join(entries.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "sig"))
    edges = None
    for k in range(HUB_ROUNDS + 1):
        # Per bucket: pairs across components that are left, and a hub.
        order = lambda c: F.col(c) if k == 0 else F.xxhash64(c, F.lit(k))  # noqa: E731, B023
        per = entries.groupBy("key", "c").agg(F.count("*").alias("n"), F.min_by("rep", order("rep")).alias("r"))
        per = per.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("open"),
                                     F.sum("n").alias("n"), F.min_by(F.struct("r", "c"), order("r")).alias("h"))
        per = cut_lineage(per.where("open > 0").select("key", "n", F.col("h.r").alias("hub"), F.col("h.c").alias("hc")))
        if per.isEmpty():
            break
        met = cut_lineage(entries.join(per, "key"))    # open buckets go on
        if k < HUB_ROUNDS:
            pairs = met.where("c <> hc").groupBy("rep").agg(F.min("hub").alias("u")).select("u", F.col("rep").alias("v"))
            found = _verified(pairs, facts, docs, percent)
        else:
            a = met.where(F.col("n") <= SMALL_BUCKET)
            pairs = a.select("key", F.col("rep").alias("u"), F.col("c").alias("cu")).join(
                a.select("key", F.col("rep").alias("v"), F.col("c").alias("cv")), "key")
            found = _verified(pairs.where("u < v AND cu <> cv").select("u", "v").distinct(), facts, docs, percent)
            large = met.where(F.col("n") > SMALL_BUCKET)
            sets = cut_lineage(_full_sets(docs, large.select(F.col("rep").alias("doc_id")).distinct()))
            found = found.unionByName(_block_links(large, sets, percent))
        labels = components(found if edges is None else edges.unionByName(found))
        edges = cut_lineage(labels.where("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v")))
        if k < HUB_ROUNDS:
            entries = cut_lineage(met.select("key", "rep").join(
                edges.select(F.col("v").alias("rep"), F.col("u").alias("c")), "rep", "left").select(
                "key", "rep", F.coalesce("c", "rep").alias("c")))
    return entries.select(F.col("rep").alias("u"), F.col("rep").alias("v")).where("false") if edges is None else edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row.

    Components are those of the links between all documents; ``component_id`` is
    the smallest id that is reachable. NULL, empty and blank texts have an empty
    set and are linked with nothing. Rows that share an id are one document and
    share its component. A row without an id can't be named by others: it is
    linked with nothing, its component_id is NULL and it is kept.
    """
    docs = take(docs, doc_id=id_col, text=text_col)
    seen = cut_lineage(profiles(docs))
    full = seen.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy("p1", "p2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                                           F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes)
    between = links(docs, classes.drop("p1", "p2"), percent)
    copies = full.join(classes.select("p1", "p2", "rep"), ["p1", "p2"]).where("doc_id <> rep")
    edges = between.unionByName(copies.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    labels = components(edges)
    out = seen.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
