"""Substring dedup by sliding sentence spans.

A sentence ends after a word with an end mark, and with its line. One of more than
``long_words`` words is no sentence to a reader (lists, tables, texts without marks);
it counts as several, cut before every pair of words whose hash is the only smallest
one of ``anchor_words`` neighbouring pairs, so that equal passages are cut alike
whatever stands before them. From every sentence on, and up to every sentence, the
shortest run of at least ``min_sentences`` sentences with at least ``min_words`` words
is hashed. A passage that repeats and holds such a run has all its whole sentences
inside runs of that kind: those from its first sentences on and those up to its last.
Runs are joined globally by 128-bit hashes, and sentences covered by any run that is
not the first of its kind are removed, whole sentences only.

Documents are packed into groups, which send each distinct run once to the part that
its hash names, with the smallest id that holds it, and get back the smallest id
anywhere where that is smaller than one of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import GROUP_BYTES, LAST, by_group, grouped, opened, pack, per_group, unpack
from .hashing import mix, span_hashes, word_spans
from .text import take

MIN_WORDS = 20
MIN_SENTENCES = 2
LONG_SENTENCE = 40        # words; a longer one counts as several, so a passage of 50 words is cut alike with or without marks
ANCHOR_WORDS = 8          # a power of two
PART_BYTES = 16 << 20     # of texts for each part that compares runs
_LONG = 256
_MARK, _CLOSER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".!?")] = True
_CLOSER[list(b"\"')]")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def anchors(words: np.ndarray, sentence: np.ndarray, size: int) -> np.ndarray:
    """Whether the pair of a word and its next has the only smallest hash of some ``size`` pairs of its sentence;
    ``size`` is a power of two."""
    out = np.zeros(len(words), bool)
    n = len(words) - size
    if n <= 0:
        return out
    best = mix(words[:-1] * _STEP + words[1:])
    at, once, width = np.arange(len(best), dtype=np.int32), np.ones(len(best), bool), 1
    while width < size:      # two neighbouring windows make one of twice the width
        left, right = best[:-width], best[width:]
        less = right < left
        once = np.where(less, once[width:], once[:-width] & (left != right))
        at = np.where(less, at[width:], at[:-width])
        best = np.minimum(left, right)
        width *= 2
    out[at[once & (sentence[:n] == sentence[size:])]] = True
    return out


def sentence_starts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, long_words: int,
                    anchor_words: int) -> np.ndarray:
    """Whether a word begins a sentence, or a further part of one with more than ``long_words`` words.

    A closing quote or bracket may follow the end mark.
    """
    if not len(starts):
        return np.zeros(0, bool)
    last = raw[ends - 1]
    quoted = _CLOSER[last] & _MARK[raw[np.maximum(ends - 2, starts)]]
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    over = (_MARK[last] | quoted)[:-1] | (feeds[starts[1:]] > feeds[ends[:-1]])
    begins = np.concatenate([[True], over])
    sentence = np.cumsum(begins) - 1
    long = np.bincount(sentence)[sentence] > long_words
    return begins | anchors(words, sentence, anchor_words) & long if long.any() else begins


def runs(counts: np.ndarray, min_words: int, min_sentences: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past the last of the hashed runs: shortest ones from every sentence on and up to every one."""
    n = len(counts)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    at = np.arange(n + 1)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), at[:-1] + min_sentences)
    start = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at[1:] - min_sentences)
    on, up = end <= n, start >= 0
    return np.concatenate([at[:-1][on], start[up]]), np.concatenate([end[on], at[1:][up]])


def chained(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of words[lo:hi] for every span, from the hashes of the words; spans beyond ``_LONG`` words are digested."""
    out = mix((hi - lo).astype(np.uint64))
    for k in np.flatnonzero(hi - lo > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(words[lo[k]:hi[k]].tobytes(), digest_size=8).digest(), "little")
    pick = np.flatnonzero((hi > lo) & (hi - lo <= _LONG))
    at = lo[pick]
    while len(pick):
        out[pick] = mix(out[pick] * _STEP + words[at])
        at = at + 1
        more = at < hi[pick]
        pick, at = pick[more], at[more]
    return out


class Sentences:
    """Sentences of a batch of texts and the hashed runs of them."""

    def __init__(self, texts: list[bytes], options: tuple):
        min_words, min_sentences, long_words, anchor_words = options
        raw, starts, ends, at = word_spans(texts)
        words = span_hashes(raw, starts, ends)
        begins = sentence_starts(raw, starts, ends, words, long_words, anchor_words)
        begins[at[:-1][at[:-1] < len(begins)]] = True       # texts are joined by line feeds
        first = np.flatnonzero(begins)
        edges = np.append(first, len(starts))
        counts = np.diff(edges)
        self.of = np.searchsorted(first, at)                # a text's first sentence (and one past the last)
        offset = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.begin = starts[first] if len(first) else np.zeros(0, np.int64)
        a, b, doc = [], [], []
        for k, (lo, hi) in enumerate(zip(self.of[:-1].tolist(), self.of[1:].tolist())):
            x, y = runs(counts[lo:hi], min_words, min_sentences)
            a.append(x + lo)
            b.append(y + lo)
            doc.append(np.full(len(x), k))
        a, b, doc = (np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64) for c in (a, b, doc))
        code = np.unique(a * (len(first) + 1) + b, return_index=True)[1]     # runs found from both ends
        self.a, self.b, self.doc, self.offset = a[code], b[code], doc[code], offset
        # Sentences are hashed once; a run is the chain of its sentences' words in two hashes of 64 bits.
        other = span_hashes(raw, starts, ends, 1)
        one, two = (chained(w, edges[:-1], edges[1:]) for w in (words, other))
        self.h1, self.h2 = (chained(w, self.a, self.b) for w in (one, two))


_HELD = pa.schema([("part", pa.int32()), ("g", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary())])
_REPLY = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("at", pa.binary()), ("owner", pa.binary())])


def _held(batch: pa.RecordBatch, k: int, options: tuple, parts: int):
    """A group's sentences, and its distinct runs: the place of each run among them, their part, hashes and least id."""
    g, ids, limits, raw = opened(batch, k)
    data = raw.tobytes()
    texts = [data[lo:hi] for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist())]
    s = Sentences(texts, options)
    own = ids[s.doc] if len(s.doc) else np.zeros(0, np.int64)
    part = ((s.h1 >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((own, s.h2, s.h1, part))
    p, x, y, o = part[order], s.h1[order], s.h2[order], own[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(x)) - 1 if len(at) else at
    return g, ids, texts, s, own, place, p[at], x[at], y[at], o[at], o[last]


def _answers(held: DataFrame) -> DataFrame:
    """For every group and part, the places of runs whose smallest id anywhere is below that of the group's last holder."""
    def run(table: pa.Table) -> pa.Table:
        hashes = [unpack(x.as_py(), np.uint64).reshape(2, -1) for x in table.column("hashes")]
        owners = [unpack(x.as_py(), np.int64).reshape(2, -1) for x in table.column("owners")]
        h1, h2 = np.concatenate(hashes, 1)
        least, latest = np.concatenate(owners, 1)
        order = np.lexsort((h2, h1))
        x, y = h1[order], h2[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        low = np.empty(len(h1), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(x))))
        hit = low < latest
        cut = np.cumsum([0, *[h.shape[1] for h in hashes]])
        rows = []
        for g, p, lo, hi in zip(table.column("g").to_pylist(), table.column("part").to_pylist(), cut[:-1], cut[1:]):
            at = np.flatnonzero(hit[lo:hi])
            if len(at):
                rows.append((g, p, pack(at.astype(np.int32)), pack(low[lo:hi][at])))
        return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_REPLY)})

    return held.groupBy("part").applyInArrow(run, "g long, part int, at binary, owner binary")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("text", pa.string())])


def _without(text: bytes, edges: list[int], gone: np.ndarray) -> tuple[str, list]:
    """The text without some of its sentences (each up to the next one), and the removed (start, end) in code points."""
    turns = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    spans, out, at, points = [], [], 0, 0
    for lo, hi in zip(turns[::2].tolist(), turns[1::2].tolist()):
        kept, cut = text[at:edges[lo]].decode(), text[edges[lo]:edges[hi]].decode()
        out.append(kept)
        points += len(kept)
        spans.append({"start": points, "end": points + len(cut)})
        points += len(cut)
        at = edges[hi]
    return "".join([*out, text[at:].decode()]), spans


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                min_sentences: int = MIN_SENTENCES, long_words: int = LONG_SENTENCE, anchor_words: int = ANCHOR_WORDS,
                group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_sentences, n_removed (characters), removed (spans in code points) and the text that is left.

    The first run is that of the smallest id, and within a text the first from its
    start; a NULL id stands after all others. Rows that share an id are one
    document: none is cut for what another of them holds. White space and A-Z case
    make no difference to a run. NULL texts stay NULL, and with empty ones have no
    sentences. Texts are read whole, however long.
    """
    options = (min_words, min_sentences, long_words, anchor_words)
    groups = grouped(take(docs, doc_id=id_col, text=text_col), group_bytes)
    parts = int(groups.agg(F.sum("size")).first()[0] or 0) // part_bytes + 1

    def ask(batch, k):
        g, *_, p, x, y, least, latest = _held(batch, k, options, parts)
        cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])).tolist() if len(p) else []
        for lo, hi in zip(cut, [*cut[1:], len(p)]):
            yield (int(p[lo]), g, pack(np.stack([x[lo:hi], y[lo:hi]])), pack(np.stack([least[lo:hi], latest[lo:hi]])))

    held = groups.mapInArrow(per_group(ask, _HELD), "part int, g long, hashes binary, owners binary")
    replies = by_group(_answers(held), "part", "at", "owner")

    def cut(batch, k):
        _, ids, texts, s, own, place, p, *_ = _held(batch, k, options, parts)
        least = np.full(len(p), LAST, np.int64)
        for r in batch.column(batch.schema.names.index("replies"))[k].as_py() or []:
            least[np.searchsorted(p, r["part"]) + unpack(r["at"], np.int32)] = unpack(r["owner"], np.int64)
        known = unpack(batch.column(batch.schema.names.index("known"))[k].as_py()).tolist()
        later = least[place] < own
        # Within a text all but the first run of a kind go.
        order = np.lexsort((s.a, place, s.doc))
        same = (place[order][1:] == place[order][:-1]) & (s.doc[order][1:] == s.doc[order][:-1])
        later[order[1:][same]] = True
        turn = np.zeros(len(s.begin) + 1, np.int64)
        np.add.at(turn, s.a[later], 1)
        np.add.at(turn, s.b[later], -1)
        gone = np.cumsum(turn[:-1]) > 0
        for j, (i, t) in enumerate(zip(ids.tolist(), texts)):
            lo, hi = int(s.of[j]), int(s.of[j + 1])
            left, spans = t.decode(), []
            if gone[lo:hi].any():
                left, spans = _without(t, [*(s.begin[lo:hi] - s.offset[j]).tolist(), len(t)], gone[lo:hi])
            yield (None if i == LAST else i, hi - lo, sum(x["end"] - x["start"] for x in spans), spans,
                   left if known[j] else None)

    return groups.join(replies, "g", "left").mapInArrow(
        per_group(cut, _OUT), "doc_id long, n_sentences long, n_removed long, "
                              "removed array<struct<start:int,end:int>>, text string")
