"""Each corpus operator against a brute-force version, and on awkward rows."""

import base64
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF0001, SF001
from kestrel.llm import (line_dedup, near_dup, packing, pii, quality, secret_scan, sentencepiece_codec,
                         substring_dedup, topk, url_filter)
from kestrel.llm.queries import table

LONG = " ".join(f"word{k % 977} Tail{k % 89}." for k in range(30_000))
SCHEMA = ("doc_id long, text string, w int, h string, key string, lines string, ids string, row string, "
          "k1 string, score double, kept string, hits string, u int, v int")


def awkward(spark, texts=()):
    """Documents with NULLs, blanks, ties, repeats, a very long text and columns with clashing names."""
    rows = [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (2, None), (None, "null id text here"),
            (3, ""), (4, " \n\t "), (5, LONG), (6, "é漢字 🎉 ▁x  y\r\n\x0b"), (None, None), (7, "one"),
            *[(100 + k, t) for k, t in enumerate(texts)]]
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows], SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in table(spark, SF0001, "documents").orderBy("doc_id").collect()]


# --- 1 packing ----------------------------------------------------------------

def test_packing_is_exact_and_full(spark, texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df, rows = awkward(spark, [*texts, "<|endoftext|> is text", "a\x1cb\x85c  d"])
    got = packing.pack(df.repartition(3)).collect()
    want = sorted((i if i is not None else -1, np.asarray(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
                  for i, t in rows)
    docs, seqs, steps = {}, {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert len(r.ids) == 4 * r.length
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        total = sum(r.length for r in s)
        assert total == s[0].context and total & (total - 1) == 0 and total <= 1024
        steps.setdefault(s[0].step_id, []).append(total)
    assert max(map(sum, steps.values())) <= packing.STEP_TOKENS + 1024
    assert sum(r.length for r in got) == sum(len(b) // 4 for _, b in want)
    whole = [(i, b) for i, b in want if i > 99]
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, b in whole:
        parts = sorted(by_id[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == b and [r.start for r in parts] == [
            sum(x.length for x in parts[:k]) for k in range(len(parts))]
    assert packing.pack(empty(spark)).count() == 0


def test_packing_fills_gaps_from_shorter_tiers():
    rng, p = random.Random(3), packing.Packer(packing.TIERS, 4096, 0)
    n = 0
    for k in range(3000):
        size = rng.choice([1, 5, 60, 130, 300, 700, 1500, 4000])
        p.add((k, b"\0" * 4 * size, size))
        n += size
        if k % 100 == 0:
            p.pack()
    p.pack()
    p.finish()
    assert sum(r[2] for r in p.rows) == n
    used = {}
    for r in p.rows:
        used[r[5]] = used.get(r[5], 0) + r[2]
    context = {r[5]: r[7] for r in p.rows}
    assert used == context
    cost = {}
    for s, c in context.items():
        cost.setdefault(next(r[8] for r in p.rows if r[5] == s), []).append(c)
    full = [g for g in cost.values() if sum(g) == 4096]
    assert len(full) >= len(cost) - 2 and all(len(set(g)) == 1 for g in full[:-2])


# --- 2 URL filters ------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "x://example.org/en/12", "x://org", "x://org/",
        "ftp://b.org/?a://c", "http://notexample.org/es/1", "http://shop.com/fr/a/de/", "http://shop.com/de/",
        "http://com/de/1#/", "http://spam.net/x", "http://a.spam.net/", "http://nospam.net/", "http://a..org/",
        "://h.com/fr", "http://h.com/FR/", "http://x.org" + "/a" * 5000, "a\nb://k.com/fr/\n"]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _judged(url):
    m = re.match("(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).translate(brute.LOWER), m.group(2)) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, *max(fit)[1:]
    listed = host == "spam.net" or host.endswith(".spam.net")
    return host, path, None, "block" if listed else "allow"


@pytest.mark.parametrize("max_bits", [url_filter.MAX_BITS, 128])
def test_url_filter_matches_brute_force(spark, max_bits):
    urls = URLS * 2 + [f"http://h{k}.{t}/{p}{k}" for k in range(150) for t in ("org", "com", "example.org") for p in ("es/", "fr/", "en/")]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, key string, hits string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("spam.net",), ("spam.net",), ("never-seen.io",)], "key string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, rules, listed, max_bits=max_bits).collect()}
    assert got == {k: _judged(u) for k, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), rules, listed).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 37 == 0).alias("listed"))
    levels = url_filter.build(keys)
    assert len(levels) >= 2
    wrong = keys.where(url_filter.member(F.col("key"), levels) != F.col("listed"))
    assert wrong.count() == 0
    assert url_filter.build(keys.where("not listed")) == []


def test_url_filter_on_odd_and_deep_hosts(spark):
    deep = ".".join(["d"] * 5000)
    urls = ["http://spam.Äx.net/a", "http://SPAM.äX.net/a", f"http://{deep}.net/", f"http://{deep}.spam.net/x", "http://A.spam.Äx.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("spam.Äx.net",), (f"{deep}.net",), ("spam.net",)], "key string")
    got = [r.verdict for r in url_filter.judge_urls(pages, rules, listed).orderBy("page_id").collect()]
    assert got == ["block", "allow", "block", "block", "block"]


# --- 3 near-duplicates --------------------------------------------------------

def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_match_brute_force(spark, texts):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    made = [_edited(rng, base, k % 9) for k in range(60)] + [" ".join(base)] * 10 + ["Short One", "short  one", "short two"]
    chain = [f"c{k}" for k in range(400)]
    made += [" ".join(chain[8 * k:8 * k + 200]) for k in range(20)]
    df, rows = awkward(spark, [*texts, *made])
    known = [(i, t) for i, t in rows if i is not None]
    want = brute.near_components(known)
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert {(r.doc_id, r.n_shingles) for r in got if r.doc_id is not None} == {(i, len(brute.shingles(t))) for i, t in known}
    assert near_dup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("small, block", [(2, 8), (1000, 256)])
def test_open_buckets_are_compared_whole(spark, monkeypatch, small, block):
    """Hubs that link to few members: the comparison of open buckets finds the rest, by pairs and by blocks."""
    monkeypatch.setattr(near_dup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(9)
    docs = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(260)]
        docs += [_edited(rng, base, rng.randrange(1, 9)) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(docs)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)


def test_block_links_are_exact(texts):
    sets = [x for x in near_dup.shingle_sets(texts) if len(x)]
    got = near_dup.block_links(sets[:90], sets[60:], 85)
    for i, a in enumerate(sets[:90]):
        for j, b in enumerate(sets[60:]):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 85 * (len(a) + len(b) - both))


def test_sketch_fills_all_coordinates_and_estimates_similarity():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 50, 400, 5000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        s = near_dup.sketch(x)
        assert len(s) == 192 and (s != near_dup._NONE).all() and (s == near_dup.sketch(x[::-1])).all()
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    agree = (near_dup.sketch(x[:2000]) == near_dup.sketch(x[1000:])).mean()
    assert abs(agree - 1 / 3) < 0.12


# --- 4 secrets ----------------------------------------------------------------

def _tlv(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def _base_spans(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [("assign", *m.span())] * (len(m.group(2)) >= 12)
    for m in re.finditer("AKIA[A-Z0-9]+", t):
        out += [("access", *m.span())] * (len(m.group()) >= 18)
    for m in re.finditer("[0-9a-f]+", t):
        out += [("hex", *m.span())] * (len(m.group()) >= 16)
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


KEY = _tlv(0x30, _tlv(2, b"\0") + _tlv(0x30, _tlv(6, b"\x2a\x86\x48") + _tlv(5, b"")) + _tlv(4, bytes(range(60))))
FIELD = lambda b: len(b).to_bytes(4, "big") + b
WIRE = FIELD(b"ssh-ed25519") + FIELD(bytes(range(32)))
OPENSSH = b"openssh-key-v1\0" + FIELD(b"none") * 2 + FIELD(b"") + (1).to_bytes(4, "big") + FIELD(WIRE) + FIELD(b"x" * 40)
B64 = lambda b: base64.b64encode(b).decode()
URL64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
JWT = ".".join([URL64(json.dumps({"alg": "HS256"}).encode()), URL64(b'{"sub":"1234567890"}'), URL64(b"s" * 32)])


@pytest.mark.parametrize("kind, text", [
    ("der", B64(KEY)), ("der", KEY.hex()), ("der", KEY.hex().upper()), ("sshwire", B64(WIRE)), ("openssh", B64(OPENSSH)), ("jwt", JWT),
    ("pem", "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,24}", B64(KEY))) + "\n-----END PRIVATE KEY-----")])
def test_secret_structures_are_confirmed(kind, text):
    found = secret_scan.find(f"é see {text} end")
    assert (kind, 6, 6 + len(text)) in found


PKCS8 = [_tlv(0x30, _tlv(2, b"\0") + _tlv(0x30, _tlv(6, b"\x2a\x86\x48\x86\xf7\r\1\1\1") + _tlv(5, b"")) + _tlv(4, random.Random(k).randbytes(1190)))
         for k in range(50)]


def test_url_safe_keys_are_found_whole():
    for key in PKCS8:
        for text in (URL64(key), B64(key), "key-" + B64(key), "key_" + URL64(key), "id/" + URL64(key)):
            start = 6 + (len(text) - len(URL64(key)) - text.count("=") if text[-len(URL64(key)):] != text else 0)
            spans = [s for s in secret_scan.find(f"é see {text} end") if s[0] == "der"]
            assert spans == [("der", start, 6 + len(text))]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\n    "])
def test_keys_over_several_lines_are_found(end):
    for key, width in zip(PKCS8, [64, 76, 40, 64, 76]):
        for encode in (B64, URL64):
            body = end.join(re.findall(f".{{1,{width}}}", encode(key)))
            for text in (f"é see {body} end", f"é see {body}{end}end", f"é key={body}", f"é key={body}{end}{'z' * 50}"):
                at = text.index(body)
                spans = [s for s in secret_scan.find(text) if s[0] == "der"]
                assert spans == [("der", at, at + len(body))]
        pem = f"-----BEGIN PRIVATE KEY-----{end}{body if encode is B64 else end.join(re.findall('.{1,64}', B64(key)))}{end}-----END PRIVATE KEY-----"
        assert [s for s in secret_scan.find(f"é {pem} end") if s[0] in ("pem", "der")] == [("pem", 2, 2 + len(pem))]


@pytest.mark.parametrize("text", [
    B64(KEY[:-1]), B64(b"\x30" + bytes(70)), B64(bytes(range(90))), B64(WIRE[:-1]), "A" * 64, JWT.replace(JWT[:4], "AAAA"),
    URL64(b'{"typ":"x"}') + ".e30." + "s" * 40, "-----BEGIN KEY-----\n" + "QUJD" * 12 + "\n-----END KEY-----"])
def test_secret_lookalikes_are_not_reported(text):
    assert not [s for s in secret_scan.find(text) if s[0] not in secret_scan.BASE_KINDS]


def test_secret_base_spans_and_edges(spark, texts):
    odd = ["TOKEN = 'abcdefghijkl'", "token=short token=abcdefghijklmn", "ſecret=abcdefghijklmnop", "AKIA" + "A" * 13, "AKIA" + "Z9" * 8,
           "0" * 15 + " " + "f" * 16 + "g", "Api_Key: \"a=b=c=d=e=f=g\"", f"password={'x' * 50_000}", f"secret: {JWT}"]
    df, rows = awkward(spark, texts + odd)
    got = sorted((repr(r.doc_id), [tuple(s) for s in r.spans if s.kind in secret_scan.BASE_KINDS]) for r in secret_scan.scan(df).collect())
    assert got == sorted((repr(i), _base_spans(t or "")) for i, t in rows)
    assert secret_scan.scan(empty(spark)).count() == 0
    red = {r.doc_id: r for r in secret_scan.redact(df.withColumn("n_chars", F.length("text").cast("long")), ("doc_id", "text", "n_chars")).collect()}
    assert len(red) == len({i for i, _ in rows}) and red[2].text is None
    for i, t in rows:
        if i and i >= 100:
            assert not _base_spans(red[i].text) and red[i].n_chars == len(red[i].text)
            assert red[i].text == t or _base_spans(t) or secret_scan.find(t)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "password" * 120_000, "a.b" * 300_000, "_-" * 500_000, "ab" * 500_000 + ".",
                                  "\n".join(["AAAA" + "B" * 60] * 20_000), "\n".join(["MIIB" + "A" * 60] * 20_000)])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    secret_scan.find(text)
    assert time.process_time() - began < 10


# --- 5 top-k ------------------------------------------------------------------

def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(700, 8)).round(2) / 3
    rows = [(k, [float(x) for x in v], "x") for k, v in enumerate(vec)]
    rows += [(700 + k, rows[k][1], "tie") for k in range(100)] + [(5, rows[5][1], "again"), (None, rows[1][1], ""), (900, None, ""),
             (901, [None] * 8, ""), (902, [float("nan")] + [0.1] * 7, ""), (903, [float("inf")] + [0.1] * 7, ""),
             (904, [0.5, 0.25], "short"), (905, [], ""), (906, [0.0] * 8, "zero"), (907, [-0.3] * 8, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string").repartition(3)
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows
          if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in {i: q for i, q in ok if i % 7 == 0 or i in (904, 906)}.items():
        score = sorted((-int(q @ x), j) for j, x in ok if j != i and len(x) == len(q))[:10]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(score)]
    queries = topk.quantised_queries(df.where("vec_id % 7 = 0 OR vec_id IN (904, 906)"))
    index = topk.build_index(df, block_rows=128)
    for block in (4096, 50):
        assert sorted(map(tuple, topk.top_k(index, queries, query_block=block).collect())) == sorted(want)
    assert topk.top_k(topk.build_index(df.limit(0)), queries).count() == 0
    assert topk.top_k(index, queries.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    rows = [(k, [float(k), 1.0, -0.5]) for k in range(40)] + [(100, [70000.0, 1.0, 2.0]), (101, [1e30, -3.0, 0.0]),
            (102, [-1e30, 5.0, 1.0]), (103, [3e38, 3e38, 3e38]), (104, [65536.0, 65536.0, -65536.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = {i: [int(np.floor(1024 * x)) if abs(x) < 1e12 else int(1024 * x) for x in v] for i, v in rows}
    most = (1 << 63) - 1
    want = []
    for i in q:
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q[i], v)))), j) for j, v in q.items() if j != i)[:10]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    got = topk.top_k(topk.build_index(df, block_rows=16), topk.quantised_queries(df))
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- 6 sentence spans ---------------------------------------------------------

def test_sentence_spans_match_brute_force(spark, texts):
    passage = " ".join(f"Passage{k} holds five words here." for k in range(14))
    odd = [f"Clean start here. {passage} Unique end one.", f"Other words first! {passage} Unique end two.", f"{passage} {passage}",
           "A clean text that nobody repeats. It stays as it is.", "x" * 100_000, "no marks " * 60, "no marks " * 60,
           'He said "stop." Then (he went.) ' * 9, " ".join(f"w{k % 97}" for k in range(300)), " ".join(f"w{k % 97}" for k in range(50, 200))]
    df, rows = awkward(spark, texts + odd)
    opts = (substring_dedup.MIN_WORDS, substring_dedup.MIN_SENTENCES, substring_dedup.LONG_SENTENCE,
            substring_dedup.ANCHOR_WORDS)
    known = [(i, t) for i, t in dict((r for r in rows if r[0] is not None and r[0] != 5)).items()]
    got = {r.doc_id: r for r in substring_dedup.dedup_spans(df.where("doc_id <> 5")).collect()}
    want = brute.dedup_sentences(known, *opts)
    assert {i: got[i].text for i in want} == want
    for i, t in known:
        cut = [t[s.start:s.end] for s in got[i].removed] if t else []
        assert got[i].n_removed == sum(map(len, cut))
    base = 100 + len(texts)
    assert passage in got[base].text and "Passage7" not in got[base + 1].text and got[base + 3].text == odd[3]
    assert substring_dedup.dedup_spans(empty(spark)).count() == 0
    assert substring_dedup.dedup_spans(df).count() == len(rows)
    small = substring_dedup.dedup_spans(df.where("doc_id <> 5").repartition(5), group_bytes=4_000, part_bytes=30_000)
    assert {r.doc_id: r.text for r in small.collect() if r.doc_id in want} == want


def test_removed_spans_are_whole_sentences(spark):
    """As registered: no span begins or ends inside a sentence of up to LONG_SENTENCE words."""
    for r, i, text in spans_of(spark):
        edges = {u[0] for u in brute.sentence_units(text, substring_dedup.LONG_SENTENCE, substring_dedup.ANCHOR_WORDS)} | {len(text)}
        assert {r.start, r.end} <= edges, i


def spans_of(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF001, "documents").collect()}
    from kestrel.llm import queries
    got = queries.QUERIES["op6_sentence_span_dedup"](spark, SF001).collect()
    out = [(s, r.doc_id, docs[r.doc_id]) for r in got for s in r.removed]
    assert len(out) > 50
    return out


def test_texts_that_collide_in_simple_hashes_stay_apart(spark):
    """The two complementary Thue-Morse strings over a and b, as one word, as a line and as sentences."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert all(r.kept for r in near_dup.near_duplicates(df).collect())
    words_ = [" ".join(x) for x in (a, b)]
    lines = [f"{x}\n{x}q" for x in words_]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(df).collect()] == [0, 0]
    df = spark.createDataFrame([(k, f"{x}. {x}z.") for k, x in enumerate(words_)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.dedup_spans(df).collect()] == [0, 0]


def test_long_passage_is_found_at_every_offset(spark):
    """60 words without end marks, after a different number of words each time, and with a word put in."""
    passage = [f"shared{k}" for k in range(60)]
    rows = [(0, " ".join(["start", *passage, "tail"]))]
    rows += [(1 + k, " ".join([*[f"own{k}x{j}" for j in range(k)], *passage, f"end{k}"])) for k in range(25)]
    rows += [(50, " ".join([*passage[:5], "inserted", *passage[5:]]))]
    got = {r.doc_id: r.text.split() for r in substring_dedup.dedup_spans(
        spark.createDataFrame(rows, "doc_id long, text string"), anchor_words=substring_dedup.ANCHOR_WORDS).collect()}
    assert got[0] == rows[0][1].split()
    for i, t in rows[1:]:
        own = [w for w in t.split() if not w.startswith("shared")]
        assert len(got[i]) - len(own) <= 28 and len(set(got[i]) & set(own)) >= len(own) - 8


# --- 7 personal data ----------------------------------------------------------

def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


PRIVATE = {"card": ["4539578763621486", "4539 5787 6362 1486", "6011-0009-9013-9424"], "email": ["Jo.Doe7+x@mail.example.com", "a@b.co"],
           "phone": ["+1 (212) 555-0147", "212-555-0147", "+1 (152) 555-8590"], "ip": ["10.0.255.1", "8.8.8.8"],
           "ssn": ["123-45-6789", "899-01-0001"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
           "date": ["2024-02-29", "31/12/1999", "12/31/1999", "3.7.2024", "1850-01-01"]}
PUBLIC = ["4539578763621487", "2024-02-30", "99/99/2020", "300.1.1.1", "666-12-3456", "000-12-3456", "DE89370400440532013001",
          "1.2.3.4.5", "a4539578763621486b", "12345", "@nobody", "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"]


def test_pseudonyms_keep_format_and_link(spark):
    values = [(k, v) for k, vs in PRIVATE.items() for v in vs]
    rows = [(i, f"see {v}, {v} é") for i, (_, v) in enumerate(values)] + [(1000 + i, f"({v}).") for i, (_, v) in enumerate(values)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    news = []
    for i, (kind, v) in enumerate(values):
        a, b = got[i], got[1000 + i]
        assert a[f"n_{kind}"] == 2 and b[f"n_{kind}"] == 1 and [f.kind for f in a.found] == [kind] * 2
        new = b.found[0].new
        assert b.text == f"({new})." and a.text == f"see {new}, {new} é" and new != v
        news.append(new)
        if kind not in ("ip", "date"):
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", new.split("@")[0]))) == re.sub(
                "[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v.split("@")[0])))
        if kind == "card":
            assert _luhn(new)
        if kind == "iban":
            s = new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert news[0].replace(" ", "") == news[1].replace(" ", "")
    again = pii.pseudonymise(spark.createDataFrame([(k, v) for k, v in enumerate(news)], "doc_id long, text string"), "k").collect()
    assert all(len(r.found) == 1 for r in again)


def test_pseudonyms_are_a_permutation_and_leave_the_rest(spark):
    days = spark.range(3000).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymise(days, "k").select("text").distinct().count() == 3000
    nets = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(".", F.lit("10"), F.lit("7"), F.floor(F.col("id") / 256), F.col("id") % 256).alias("text"))
    assert pii.pseudonymise(nets, "k").select("text").distinct().count() == 3000
    df, rows = awkward(spark, PUBLIC)
    got = pii.pseudonymise(df, "k").collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in got) == sorted((repr(i), repr(t)) for i, t in rows)
    assert pii.pseudonymise(empty(spark), "k").count() == 0


def test_pseudonyms_of_long_domains_and_of_dates_at_both_ends(spark):
    rows = [(1, "x@" + "abc." * 10_000 + "com"), (2, "x@" + "a." * 20 + "com"), (3, "x@" + "a" * 100_000)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[2].n_email == 1 and got[3].text == rows[2][1] and len(got[1].text) == len(rows[0][1])
    days = spark.range(730_485).select(F.col("id").alias("doc_id"),
                                       F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymise(days, "k").select("n_date", "text").agg(
        F.sum("n_date"), F.count_distinct("text"), F.min("text"), F.max("text"), F.max(F.length("text"))).first()
    assert tuple(out) == (730_485, 730_485, "1000-01-01", "2999-12-31", 10)


# --- 8 SentencePiece ----------------------------------------------------------

def test_sentencepiece_matches_the_library(spark, texts):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    df, rows = awkward(spark, [*texts, " ", "  a  b ", "\n\nx\n y", "▁a▁", "<s></s><unk>", "a\x00b", "\u3000ﬁ①"])
    got = sorted((repr(r.doc_id), r.ids, r.decoded) for r in sentencepiece_codec.encode(df).collect())
    assert got == sorted((repr(i), sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in rows)
    for r in sentencepiece_codec.encode(df).where("doc_id > 99").collect():
        raw = dict(rows)[r.doc_id].encode()
        assert not r.ids or (r.begins[0] == 0 and r.ends[-1] == len(raw) and r.begins[1:] == r.ends[:-1])
        for i, b, e in zip(r.ids, r.begins, r.ends):
            piece = sp.id_to_piece(i).replace("▁", " ")
            assert sp.is_byte(i) or raw[b:e].decode().replace("▁", " ") in (piece, piece[1:])
    assert sentencepiece_codec.encode(empty(spark)).count() == 0


def _trie(pairs):
    """A double array for {bytes: bytes}, placed slot by slot."""
    texts, node = b"", {}
    for k, v in pairs.items():
        at = node
        for c in k:
            at = at.setdefault(c, {})
        at[None] = len(texts)
        texts += v + b"\0"
    units, used = {0: 0}, {0}

    def place(at, children):
        base = next(b for b in range(1, 10_000) if not any((b ^ (c or 0)) in used for c in children)
                    and (None not in children or b not in used))
        for c in children:
            used.add(base ^ (c or 0))
        units[at] = units.get(at, 0) | (base ^ at) << 10
        for c, sub in children.items():
            if c is None:
                units[at] |= 256
                units[base] = sub | 1 << 31
            else:
                units[base ^ c] = c
                place(base ^ c, sub)
    place(0, node)
    size = (max(units) // 256 + 2) * 256
    blob = b"".join(units.get(k, 0x7F).to_bytes(4, "little") for k in range(size))
    return len(blob).to_bytes(4, "little") + blob + texts


def _with_normaliser(squeeze, charmap=b""):
    model = open(sentencepiece_codec.default_path(), "rb").read()
    n, head = len(charmap), b""
    while n > 127:
        head += bytes([n & 127 | 128])
        n >>= 7
    spec = b"\x12" + head + bytes([n]) + charmap + b"\x20" + bytes([squeeze])
    n, head = len(spec), b""
    while n > 127:
        head += bytes([n & 127 | 128])
        n >>= 7
    return model + b"\x1a" + head + bytes([n]) + spec


def test_sentencepiece_character_map_and_space_rules():
    texts = ["", "  ", " a  b\tc ", "ﬁx ①② ﬁ", "a\u3000b", "\u3000 x \u3000", "ab é ﬁ\n ", "①"]
    cmap = _trie({"ﬁ".encode(): b"fi", "①".encode(): b"1", "①②".encode(): b"12", "\u3000".encode(): b" ", b"\t": b" ", b"ab": b""})
    for squeeze in (0, 1):
        for charmap in (b"", cmap):
            c = sentencepiece_codec.Codec(_with_normaliser(squeeze, charmap))
            for t, ids in zip(texts, c.encode(texts)):
                assert ids.tolist() == c.full.encode(t), (squeeze, bool(charmap), t)
                b, e = c.spans(t, ids)
                assert (b <= e).all() and (len(ids) == 0 or e[-1] <= len(t.encode()))
    c = sentencepiece_codec.Codec(_with_normaliser(0, cmap))
    out, align = c.normalise("①②x")
    assert out == "▁12x" and align.tolist() == [0, 0, 0, 0, 0, 6, 7]


# --- 9 line dedup -------------------------------------------------------------

@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup_matches_brute_force(spark, window):
    rng = random.Random(window)
    docs = [(k, "\n".join(rng.choice(["", " ", *[f"line {x}" for x in range(12)], " line 3\t", f"own {k}"]) for _ in range(rng.randrange(14))))
            for k in range(150)] + [(200, None), (201, ""), (202, "\n"), (203, "line 1\r\nline 2\r\nline 3")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, runs string, k2 int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, window=window).collect()}
    assert {i: r.clean for i, r in got.items()} == brute.dedup_lines(docs, window)
    for i, t in docs:
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)
        kept = got[i].n_lines - got[i].n_removed
        assert (got[i].clean or "").count("\n") == max(0, kept - 1)


def test_long_line_is_a_run_by_itself(spark):
    long = " ".join(f"w{k}" for k in range(line_dedup.LONG_WORDS))
    short = " ".join(f"w{k}" for k in range(line_dedup.LONG_WORDS - 1))
    docs = [(1, f"own one\n {long}\t\nown two"), (2, f"other\n{long}\nlines"), (3, long), (4, f"{short}\nx\n{short}"),
            (5, short), (6, f"{long} more"), (7, f"a\n{long} z\nb\n{long} z\nc")]
    got = {r.doc_id: r.clean for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**dict(docs), 2: "other\nlines", 3: "", 7: f"a\n{long} z\nb\nc"}


def test_winnowing_guarantee_and_edges(spark, texts):
    h = np.random.default_rng(1).integers(0, 50, 300, dtype=np.uint64)
    for w in (1, 2, 5):
        best = line_dedup.winnowed(h, w)
        for k in range(len(best)):
            win = h[k:k + w]
            assert k <= best[k] < k + w and h[best[k]] == win.min() and (win[best[k] - k + 1:] > win.min()).all()
    df, rows = awkward(spark, texts)
    got = line_dedup.dedup_lines(df, keep=("w", "text")).collect()
    assert len(got) == len(rows)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "x\na\nb"), (None, "a\nb\nz")], "doc_id long, text string")
    out = sorted((repr(r.doc_id), r.clean) for r in line_dedup.dedup_lines(same).collect())
    assert out == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("1", "x"), ("None", "z")]     # of one id the text of the smaller hash is first


def test_line_query_matches_brute_force_with_fewer_marks_than_windows(spark):
    from kestrel.llm import queries
    docs = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = {r.doc_id: r.clean for r in queries.QUERIES["op9_line_dedup"](spark, SF001).collect()}
    assert got == brute.dedup_lines(docs, line_dedup.WINDOW, line_dedup.LONG_WORDS)
    assert sum(got[i] != t for i, t in docs) > 50
    marks = windows = 0
    for _, t in docs:
        f = line_dedup.fingerprints(*line_dedup.line_hashes([t], 0)[0], line_dedup.WINDOW)
        marks, windows = marks + (len(f[0]) if f else 0), windows + (len(f[4]) if f else 0)
    assert 0 < marks < 0.8 * windows


# --- 10 quality ---------------------------------------------------------------

def test_quality_matches_brute_force(spark, texts):
    odd = ["a b c d e a b c d e", "x " * 12, "same line\nsame line\n\n \n", "# * $ % & | < >", "one two three four five six seven eight nine ten",
           "a b c d e f a b c d e f g h i j k l m n o p q r s t u v w x y z"]
    df, rows = awkward(spark, texts + odd)
    labels = spark.createDataFrame([(100 + k, int(k % 3 > 0), int(k % 7 == 0) if k % 5 else None) for k in range(len(texts))],
                                   "doc_id long, quality int, toxic int")
    good = {100 + k for k in range(len(texts)) if k % 3 > 0 and not (k % 7 == 0 and k % 5)}
    got = quality.judge(df, quality.fit_weights(df, labels)).collect()
    scores = brute.quality_scores(rows, good, quality.BUCKETS, quality.SMOOTHING)
    want = {}
    for (i, t), s in zip(rows, scores):
        n = brute.base_counts(t)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want.setdefault((repr(i), n[0]), (*n, failed, s))
    assert len(got) == len(rows)
    for r in got:
        w = want[repr(r.doc_id), r.n_words]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == w[:6]
        assert abs(r.score - w[6]) < 1e-9 and r.kept == (not w[5] and r.score >= quality.THRESHOLD)
    none = quality.fit_weights(df, labels.limit(0))
    assert set(none) == {0.0}
    assert quality.judge(empty(spark), quality.fit_weights(empty(spark), labels)).count() == 0
    kept = quality.judge(df, none, keep=("doc_id", "text", "w")).where("kept").select("row.*")
    assert kept.columns == ["doc_id", "text", "w"] and kept.count() == sum(r.kept for r in quality.judge(df, none).collect())


def test_quality_threshold_separates_labelled_junk(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    weights, threshold = quality.fit(docs, labels)
    assert weights == quality.fit_weights(docs, labels)
    rows = quality.judge(docs, weights, threshold=threshold).join(labels, "doc_id").where("NOT base_failed").collect()
    junk = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and not r.toxic]
    assert len(junk) > 20 and sum(junk) <= 0.1 * len(junk)
    assert len(good) > 200 and sum(good) >= 0.99 * len(good)
    assert quality.fit(docs, labels.limit(0)) == ([0.0] * (2 * quality.BUCKETS), quality.THRESHOLD)


def test_crc_column_is_unsigned(spark):
    df = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    r = packing.pack(df).select("ids", F.crc32("ids").alias("c")).collect()
    assert all(x.c == zlib.crc32(bytes(x.ids)) for x in r)
