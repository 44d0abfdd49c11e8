"""Plain-Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from kestrel.llm.hashing import mix, span_hashes

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


# --- quality -----------------------------------------------------------------

def base_counts(text):
    t, w = text or "", words(text)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(k, k + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash_long(value, seed):
    return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)


def features(text, buckets):
    h = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(text)]
    uni = [x % buckets for x in h]
    bi = [_signed(_hash_long(b, _hash_long(a, 42))) % buckets + buckets for a, b in zip(h, h[1:])]
    return uni + bi


def quality_scores(docs, good, buckets, smoothing):
    """{row: score} of [(id, text)] with the trusted ids ``good``."""
    raw, target = Counter(), Counter()
    for i, t in docs:
        f = features(t, buckets)
        raw.update(f)
        if i in good:
            target.update(f)
    out = []
    sums = [(sum(v for k, v in c.items() if (k >= buckets) == hi)) for hi in (False, True) for c in (raw, target)]
    for _, t in docs:
        total, f = 0.0, features(t, buckets)
        for b in f:
            n, m = sums[2 * (b >= buckets):2 * (b >= buckets) + 2]
            if m:
                p = raw[b] / n
                total += math.log(((1 - smoothing) * target[b] / m + smoothing * p) / p)
        out.append(total / len(f) if f else 0.0)
    return out


def quality_threshold(docs, good, buckets, smoothing, folds, loss, min_words):
    """The ``loss`` quantile of the trusted documents' scores, each under the weights of the other folds."""
    fold = {i: _signed(xxhash.xxh64_intdigest((1).to_bytes(4, "little"), _hash_long(i, 42))) % folds for i in good}
    held = []
    for f in range(folds):
        scores = quality_scores(docs, {i for i in good if fold[i] != f}, buckets, smoothing)
        held += [s for (i, t), s in zip(docs, scores) if i in good and fold[i] == f and len(words(t)) >= min_words]
    return float(np.quantile(held, loss))


# --- near-duplicates ---------------------------------------------------------

def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(docs, percent=85):
    """{id: smallest reachable id}; rows that share an id are one document."""
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    sets, where = [shingles(t) for _, t in docs], defaultdict(list)
    for k, s in enumerate(sets):
        both = Counter(j for g in s for j in where[g])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(docs[k][0]), root(docs[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(k)
    return {i: root(i) for i in parent}


# --- line dedup --------------------------------------------------------------

def dedup_lines(docs, window=2, long_words=20):
    """[text or None] for [(id, text)] with distinct ids, in the order of ids; a line of ``long_words`` words is a run too."""
    seen, out = set(), {}
    for i, t in sorted((d for d in docs), key=lambda d: d[0]):
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if WORD.search(x)]
        body = [lines[k].strip(" \t\n\x0b\f\r") for k in at]
        gone = set()
        for k in range(len(at)):
            for size in {1, window} if len(words(body[k])) >= long_words else {window}:
                run = tuple(body[k:k + size])
                if len(run) < size:
                    continue
                if run in seen:
                    gone.update(range(at[k], at[k + size - 1] + 1))
                seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


# --- sentence spans ----------------------------------------------------------

def sentence_units(text, long_words, anchor_words):
    """[(start, words)] of a text's sentences, long ones cut before pairs of words with the only smallest hash of
    ``anchor_words`` neighbouring pairs; hashes are those of the library, the choice is made window by window."""
    out = []
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    for k, (lo, hi) in enumerate(spans):
        new = k == 0 or "\n" in text[spans[k - 1][1]:lo]
        if k:
            last = text[spans[k - 1][0]:spans[k - 1][1]]
            new |= last[-1] in ".!?" or (last[-1] in "\"')]" and len(last) > 1 and last[-2] in ".!?")
        if new:
            out.append([])
        out[-1].append((lo, text[lo:hi].translate(LOWER)))
    units = []
    for sentence in out:
        cuts = {0}
        if len(sentence) > long_words:
            raw = [w.encode() for _, w in sentence]
            ends = np.cumsum([len(x) for x in raw])
            h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
            pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).tolist()
            for k in range(len(pair) - anchor_words + 1):
                win = pair[k:k + anchor_words]
                if win.count(min(win)) == 1:
                    cuts.add(k + win.index(min(win)))
        edges = sorted(cuts) + [len(sentence)]
        units += [(sentence[a][0], [w for _, w in sentence[a:b]]) for a, b in zip(edges, edges[1:])]
    return units


def dedup_sentences(docs, min_words, min_sentences, long_words, anchor_words):
    first, cut = {}, {}
    for i, t in docs:
        u = sentence_units(t or "", long_words, anchor_words)
        runs = set()
        for a in range(len(u)):
            for b in range(a + 1, len(u) + 1):
                if b - a >= min_sentences and sum(len(x[1]) for x in u[a:b]) >= min_words:
                    runs.add((a, b))
                    break
        for b in range(len(u), 0, -1):
            for a in range(b - 1, -1, -1):
                if b - a >= min_sentences and sum(len(x[1]) for x in u[a:b]) >= min_words:
                    runs.add((a, b))
                    break
        cut[i] = u, [(a, b, tuple(w for x in u[a:b] for w in x[1])) for a, b in sorted(runs)]
        for _, _, key in cut[i][1]:
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = None
            continue
        u, runs = cut[i]
        seen, gone = set(), set()
        for a, b, key in runs:
            if first[key] < i or key in seen:
                gone.update(range(a, b))
            seen.add(key)
        edges = [x[0] for x in u] + [len(t)]
        out[i] = t[:edges[0]] + "".join(t[edges[k]:edges[k + 1]] for k in range(len(u)) if k not in gone)
    return out
