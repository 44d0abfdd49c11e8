"""Suffix-array dedup: the sort against plain sorting, the cuts against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from conftest import SF0001, SF001
from kestrel.llm import induced_sort, queries, suffix_dedup
from kestrel.llm.queries import table
from test_corpus_ops import LONG, awkward, empty, texts  # noqa: F401


def plain_suffixes(t, most):
    order = sorted(range(len(t) - 1), key=lambda i: t[i:], reverse=True)
    shared = [0] if order else []
    for a, b in zip(order, order[1:]):
        k = 0
        while k < most and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        shared.append(k)
    return order, shared


def induced(t, top, most, memory):
    pos, shared = [], []

    def sink(p, v):
        pos.extend(p.tolist())
        shared.extend(v.tolist())

    induced_sort.suffixes_with_prefixes(np.array(t, np.int32), top, most, sink, memory)
    return pos, shared


@pytest.mark.parametrize("memory", [4, 50, 10_000])
def test_induced_order_equals_plain_sorting(monkeypatch, memory):
    rnd = random.Random(memory)
    for _ in range(400):
        monkeypatch.setattr(induced_sort, "CHUNK", rnd.choice([3, 7, 64]))
        monkeypatch.setattr(induced_sort, "BUCKET", rnd.choice([2, 8, 64]))
        top = rnd.choice([1, 2, 3, 8, 700])
        t = [rnd.randint(1, top) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            if t:
                i = rnd.randrange(len(t))
                t[rnd.randrange(len(t)):0] = t[i:i + rnd.randint(1, 20)]
        most = rnd.choice([1, 3, 5, 50])
        assert induced([*t, 0], top, most, memory) == plain_suffixes([*t, 0], most), t


def test_sort_of_long_runs_and_large_alphabets_on_disk():
    rnd = np.random.default_rng(3)
    for t in ([1] * 3000, [1, 2] * 2000, rnd.integers(1, 5000, 6000).tolist(), np.repeat(rnd.integers(1, 9, 300), 12).tolist()):
        order, _ = induced([*t, 0], max(t), 50, 300)
        raw = np.array([*t, 0], ">i4").tobytes()
        assert order == sorted(range(len(t)), key=lambda i: raw[4 * i:4 * i + 800], reverse=True) if max(t) > 2 else True
        assert sorted(order) == list(range(len(t)))


def brute_cut(rows, length=suffix_dedup.LENGTH):
    """Every row's (id, bytes, removed spans, bytes kept), from a table of all strings of ``length`` bytes."""
    last, least = 1 << 63, {}
    data = [((last if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            least[x] = min(i, least.get(x, last))
    out = []
    for (i, b), (key, _) in zip(data, rows):
        gone = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - length + 1):
            if least[b[s:s + length]] < i:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        turns = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist() if len(b) else []
        out.append((repr(key), len(b), [tuple(x) for x in turns], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def got_cut(df):
    return sorted((repr(r.doc_id), r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"group_bytes": 5_000, "part_bytes": 60_000, "memory": 5_000}, {"group_bytes": 9_000, "hot": 3},
                                     {"length": 24, "hot": 20}])
def test_cuts_match_brute_force(spark, texts, options):  # noqa: F811
    rnd = random.Random(2)
    passage = "This passage of more than fifty bytes repeats in many of the documents, é漢字 included. "
    odd = [passage, "x" + passage, passage[:50], passage[:49], passage[1:51], "a" * 200, "b" + "a" * 120, "ab" * 90, "漢" * 60, "字" + "漢" * 40]
    odd += [f"{rnd.random()} {passage * rnd.randint(0, 3)}{rnd.random()}" for _ in range(40)]
    df, rows = awkward(spark, texts[:60] + odd)
    rows = [r for r in rows if r[1] != LONG] + [(5, LONG[:3000]), (900, LONG[1000:4000]), (900, LONG[1000:4000]), (None, LONG[500:900])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, g long").repartition(4)
    got = suffix_dedup.dedup_substrings(df, **options)
    assert got_cut(got) == brute_cut(rows, options.get("length", suffix_dedup.LENGTH))
    assert got.where("n_removed > 0").count() > 30


def test_very_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, LONG), (2, LONG), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(df).collect()}
    n = len(LONG.encode())
    assert got[1].n_removed == 0 and [tuple(x) for x in got[2].removed] == [(0, n)] and bytes(got[2].kept) == b""
    assert got[3].n_bytes == 0 and bytes(got[3].kept) == b""
    assert suffix_dedup.dedup_substrings(empty(spark)).count() == 0


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF0001, "documents").collect()]
    got = queries.QUERIES["op11_suffix_dedup"](spark, SF0001).collect()
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute_cut(rows)]
    assert sorted((repr(r.doc_id), *r[1:]) for r in got) == want
    assert sum(r.n_removed > 0 for r in got) > 10


def test_bytes_are_mixed_once_and_sorted_as_bytes(monkeypatch):
    rnd, mixed, sorted_ = random.Random(5), [], []
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(500)]
    data = [" ".join(rnd.choices(words, k=400)).encode() for _ in range(40)]
    raw, limits = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    mix, sort = suffix_dedup.mix, induced_sort.suffixes_with_prefixes
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: mixed.append(len(x)) or mix(x))
    _, _, _, start, count, doc = suffix_dedup.stretches(raw, limits, 50)
    assert sum(mixed) < 2 * len(raw)        # once each, and the wider grams of one position in ten
    each = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    assert each.tolist() == [s for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist()) for s in range(lo, hi - 49)]
    assert (np.searchsorted(limits, start, "right") - 1 == doc).all()

    monkeypatch.setattr(induced_sort, "suffixes_with_prefixes",
                        lambda text, *x: sorted_.append(text.dtype.itemsize) or sort(text, *x))
    shard = suffix_dedup.Shard(50, induced_sort.MEMORY)
    one, two = data[0][:90], data[0][20:80]
    for g, x in ((1, one), (2, two)):
        shard.add(g, np.array([len(x)]), np.array([g]), np.array([g]), x)
    got = [(g, *(suffix_dedup.unpack(x, kind).tolist() for x, kind in zip(a, (*[np.int32] * 3, np.int64)))) for g, *a in shard.answers()]
    assert got == [(2, [0], [0], [11], [1])] and sorted_ == [1]


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int32])
def test_shared_prefixes_of_every_width(kind):
    rnd = np.random.default_rng(1)
    for n in (1, 3, 7, 8, 9, 40, 300):
        text = np.append(rnd.integers(1, 3, n), 0).astype(kind)
        text[:n] = np.tile(text[:min(n, 13)], n)[:n]
        pos = np.append(-1, rnd.permutation(n + 1))
        for most in (1, 5, 50):
            got = induced_sort.shared_prefixes(text, pos, most).tolist()
            assert got[0] == 0
            for a, b, k in zip(pos[1:].tolist(), pos[2:].tolist(), got[1:]):
                x, y = text[a:a + most].tolist(), text[b:b + most].tolist()
                assert k == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_order_of_keys_of_any_size():
    rnd = np.random.default_rng(2)
    for n, most in ((0, 5), (1, 1), (1000, 30), (1000, 1 << 40), (1000, 1 << 62)):
        keys = rnd.integers(0, most, n, endpoint=True)
        order = induced_sort.order_of(keys, most)
        assert sorted(order.tolist()) == list(range(n)) and (np.diff(keys[order]) >= 0).all()
