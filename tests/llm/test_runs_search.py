"""Periodic runs and ranked search against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from conftest import SF0001, SF001
from kestrel.llm import period_runs, queries, ranked_search
from kestrel.llm.queries import table
from test_corpus_ops import LONG, awkward, empty, texts  # noqa: F401


def brute_runs(w):
    """Every maximal repetition by its definition, period by period."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q):
                best.setdefault((s, e + q - s), q)
            s = max(e, s) + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def periodic(rnd):
    w = [rnd.randrange(rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(0, 80))]
    for _ in range(rnd.randint(0, 3)):
        block = [rnd.randrange(5) for _ in range(rnd.randint(1, 9))]
        i = rnd.randint(0, len(w))
        w[i:i] = [block[k % len(block)] for k in range(rnd.randint(1, 50))]
    return w


def test_runs_match_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        w = periodic(rnd)
        got = period_runs.runs_of(w)
        assert got == brute_runs(w), w
        gone = {i for s, n, q in got for i in range(s + q, s + n)}
        assert period_runs.collapsed(w, got) == [x for i, x in enumerate(w) if i not in gone]


def test_repair_replaces_every_pair_that_repeats():
    rnd = random.Random(6)
    for _ in range(200):
        w = periodic(rnd)
        if len(w) < 2:
            continue
        rules, rest = period_runs.repair(w, 20)
        text = {s: [s] for s in range(20)}
        for s, a, b in rules:
            text[s] = text[a] + text[b]
        assert sum((text[s] for s, _ in rest), []) == w
        assert [i for _, i in rest] == [sum(len(text[s]) for s, _ in rest[:k]) for k in range(len(rest))]
        seen = {}
        for k, pair in enumerate(zip([s for s, _ in rest], [s for s, _ in rest[1:]])):
            assert k - seen.setdefault(pair, k) < 2      # again only where it overlaps itself


def test_long_periodic_texts_take_little_time():
    for w in ([0] * 200_000, [0, 1, 2] * 70_000):
        assert len(period_runs.runs_of(w)) == 1


def altered(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n = len(w)
    if i is None or not n:
        return w
    h = zlib.crc32(str(i).encode())
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return w if h % 10 else [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_runs_query_matches_brute_force(spark, tmp_path):
    docs = table(spark, SF001, "documents").where("length(text) < 6000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in docs.collect():
        w = altered(r.doc_id, r.text)
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want[r.doc_id] = (len(runs), s, n, q, None if n is None else 1000 * n // q,
                          sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
                          sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert sum(v[0] > 0 for v in want.values()) > 50


def test_runs_on_awkward_rows(spark):
    df, rows = awkward(spark, ["a a a a a a", "x " * 5, "é é  é é é é é", "a b " * 4])
    got = period_runs.find_runs(df).collect()
    assert sorted((repr(r.doc_id), r.n_words) for r in got) == sorted((repr(i), len((t or "").encode().split())) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[100].runs] == [(0, 6, 1)] and by[100].collapsed == "a"
    assert by[101].runs == [] and by[101].collapsed == "x x x x x"
    assert [tuple(x) for x in by[103].runs] == [(0, 8, 2)] and by[103].collapsed == "a b"
    assert by[2].runs == [] and by[2].collapsed == "" and by[5].collapsed == LONG
    assert period_runs.find_runs(empty(spark)).count() == 0
    tails = {repr(r.doc_id): r.text for r in period_runs.repeated_tails(df).collect()}
    assert tails["None"] in (None, "null id text here") and tails["2"] is None
    assert period_runs.repeated_tails(empty(spark)).count() == 0


def brute_search(items, docs, k=10):
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    counts = [(i, Counter(term(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries_ = {}
    for i, t in items:
        queries_.setdefault(i, set()).update(term(t))
    out = []
    for i, q in queries_.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in q if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def test_search_matches_brute_force(spark, texts):  # noqa: F811
    df, rows = awkward(spark, [*texts, "tie one", "tie one", "TIE one", "one\x7fone", "é1ñ é1ñ"])
    items = [(1, "tie ONE"), (1, "word7"), (2, None), (3, "  "), (4, "é1ñ"), (None, "漢字 nothing"), (None, "key"), (5, "unseenterm"),
             (6, texts[3]), (7, texts[5][:200]), (8, LONG)]
    q = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, score int")
    want = brute_search(items, rows)
    for coords in (ranked_search.COORDS, 4):
        got = ranked_search.search(q, df.repartition(5), coords=coords).collect()
        assert sorted(repr(tuple(r)) for r in got) == want
    assert ranked_search.search(q, empty(spark)).count() == 0
    assert ranked_search.search(q.limit(0), df).count() == 0


def test_search_in_several_blocks(spark, texts, monkeypatch):  # noqa: F811
    df, rows = awkward(spark, texts)
    items = [(k, t[:300]) for k, t in enumerate(texts[:9])]
    q = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(ranked_search, "ITEM_BLOCK", 4)
    got = ranked_search.search(q, df)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_search(items, rows)
    assert dict(got.dtypes)["item_id"] == "int"


def test_sketch_bounds_hold_and_spare_most_documents(spark):
    docs = [r.text for r in table(spark, SF001, "documents").collect()]
    items = [(r.item_id, sorted(set(ranked_search.terms(r.text)))) for r in table(spark, SF001, "benchmark").collect()]
    df = Counter(t for x in docs for t in set(ranked_search.terms(x)))
    n, total = len(docs), sum(len(ranked_search.terms(x)) for x in docs)
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    top = ranked_search.BestOf(items, weights, n, total, 10, ranked_search.COORDS)
    for lo in range(0, n, 256):
        top.add(list(range(lo, min(n, lo + 256))), docs[lo:lo + 256])
    assert 0 < top.scored < 0.5 * n * len(items)


def test_search_reads_small_tables(spark):
    got = queries.QUERIES["op13_ranked_search"](spark, SF0001)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert got.groupBy("item_id").count().where("count > 10").count() == 0
