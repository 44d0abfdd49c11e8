"""Vectorised 64-bit hashes of words, lines and word windows, a batch of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_LONG = 1024             # bytes
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of raw[start:end] for every span; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time go through the finaliser, so no structure of a text makes
    two spans meet. Spans beyond ``_LONG`` bytes are digested one by one.
    """
    size = np.asarray(ends, np.int64) - starts
    out = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    for k in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(raw[starts[k]:ends[k]].tobytes(), digest_size=8, key=b"%d" % seed).digest()
        out[k] = int.from_bytes(digest, "little")
    pick = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = np.asarray(starts, np.int64)[pick], size[pick]
    while len(pick):
        out[pick] = mix(out[pick] * np.uint64(_BASE) + (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        pick, at, left = pick[more], at[more] + 8, left[more] - 8
    return out


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by line feeds with A-Z lower-cased, where words start and end in it, and the
    number of each text's first word (and of one past the last)."""
    raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    limits = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return raw, starts, ends, np.searchsorted(starts, limits)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, with A-Z lower-cased, and where each text's words begin (and end)."""
    raw, starts, ends, cut = word_spans(texts)
    return span_hashes(raw, starts, ends), cut


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + words[k:k + n])
    return out
