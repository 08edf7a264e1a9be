"""Vectorised word hashing over Arrow string batches (runs inside Spark tasks).

Words are the maximal runs of bytes other than ASCII white space; the rule
is byte-wise, so UTF-8 needs no decoding.  A word's hash is a polynomial in
its bytes (A-Z folded to a-z) mod 2^64, finished with a bit mixer; a
shingle's hash combines the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19          # bytes handled at once (a longer text is its own chunk)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
_SHORT = np.uint64(0x589965CC75374CC3)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """1, B, B^2, ... (at least ``n`` of them), kept for the worker's life."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of consecutive row ranges of a string array; nulls are empty."""
    arr = arr.fill_null("").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, off[i:j + 1] - off[i], data[off[i]:off[j]]
        i = j


def word_hashes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (plus the total)."""
    return placed_hashes(off, data, _SPACE)[:2]


def placed_hashes(off: np.ndarray, data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() with the bytes that part words given as flags, and each word's first byte."""
    n = len(data)
    first = np.zeros(len(off), dtype=np.int64)
    none = np.zeros(0, np.uint64), first, np.zeros(0, np.int64)
    if not n:
        return none
    inside = ~space[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return none
    first = np.searchsorted(starts, off)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) if starts[0] == 0 else \
        np.concatenate([np.zeros(starts[0], np.int64),
                        np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))])
    terms = _FOLD[data] * powers(int(at.max()) + 1)[at]
    terms[~inside] = 0
    return mix(np.add.reduceat(terms, starts)), first, starts


def shingle_hashes(w: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows; a text of 1..k-1 words is one shingle.  Also each text's start."""
    n_words = np.diff(first)
    n_sh = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    start = np.concatenate([[0], np.cumsum(n_sh)])
    total = int(start[-1])
    if not total:
        return np.zeros(0, np.uint64), start
    at = np.arange(total) - np.repeat(start[:-1], n_sh) + np.repeat(first[:-1], n_sh)
    padded = np.concatenate([w, np.zeros(k, np.uint64)])
    h = np.zeros(total, dtype=np.uint64)
    for j in range(k):
        h += padded[at + j] * _MULT[j % len(_MULT)] * powers(j + 1)[j // len(_MULT)]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):     # the whole sequence as one
        seq = w[first[d]:first[d + 1]]
        h[start[d]:start[d] + 1] = (np.array([len(seq)], np.uint64) * _SHORT
                                    + (seq * np.resize(_MULT, len(seq))).sum(dtype=np.uint64, keepdims=True))
    return mix(h), start


def sequence_hashes(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each text's whole word sequence (0, 0 without words)."""
    n_words = np.diff(first)
    out = []
    for salt in (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5)):
        if len(w):
            at = np.arange(len(w)) - np.repeat(first[:-1], n_words)
            terms = mix(w ^ salt) * powers(int(n_words.max()))[at]
            ends = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            h = mix(ends[first[1:]] - ends[first[:-1]] + n_words.astype(np.uint64))
        else:
            h = np.zeros(len(n_words), np.uint64)
        out.append(np.where(n_words > 0, h, np.uint64(0)).view(np.int64))
    return out[0], out[1]


def distinct_sets(h: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    return [np.unique(h[a:b]) for a, b in zip(start[:-1], start[1:])]
