"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines with words (``[A-Za-z0-9]+``, case folded), so a notice that is
wrapped, or prefixed as a comment, is read whole.  It is read in overlapping windows of 32, 12 and 6 words, so a notice
inside a long paragraph, or beside another one, is seen too.  Features are hashed words and word pairs; a multinomial
logistic regression with a class for unknown text gives family probabilities, calibrated by one temperature on
held-back samples.  A clause of a family's templates counts where a window around it has that family as its best, not
``unknown``, with ``MIN_PROB`` or more, and the words there hold at least ``MIN_SHARED`` of the clause's word triples, and
of those triples that no other family's clauses have.  Every occurrence counts that does not overlap an earlier one
of its family.  GNU licences share their wording over versions: they are named with a version only where it is
written near the clause ("version 3", "v2").

Training samples are the template clauses, whole, shortened and with words replaced, set into ordinary text.  Unknown are
windows of a bounded sample of the corpus that share no word triple with any template, and clauses with their words
in random order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import kernel
from wayline.llm.common import arrow_map, hash_share

# Wording of common public licence notices, in clauses of at most 20 words.
TEMPLATES = {
    "AGPL": (
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "Licensed under the GNU Affero General Public License",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice",
        "Licensed under the BSD License",
        "This software is released under the 3-Clause BSD License",
        "Use of this source code is governed by a BSD-style license",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under CC BY 4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "This work is licensed under CC BY-NC 4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "This work is licensed under CC BY-SA 4.0",
    ),
    "CC0-1.0": (
        "dedicated to the public domain under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "released under the Creative Commons CC0 1.0 Universal Public Domain Dedication",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License",
    ),
    "LGPL": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "Licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, Version 2.0",
    ),
    "Proprietary": (
        "All rights reserved",
        "No part of this publication may be reproduced without the prior written permission of the publisher",
        "Unauthorized copying of this file, via any medium, is strictly prohibited",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    ),
}
#: Families whose wording does not tell the version, and how a version is written near it.
VERSIONED = ("AGPL", "GPL", "LGPL")
VERSIONS = {"version 2 1": "2.1", "version 2": "2.0", "version 3": "3.0", "v2 1": "2.1", "v2": "2.0", "v3": "3.0"}
NEAR = 24                      # words after (and half as many before) a clause in which its version is looked for
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))
WINDOW = 32
WINDOWS = ((WINDOW, 16), (12, 4), (6, 3))      # words of a window, and between the starts of two
BUCKETS = 2**18
MIN_PROB, MIN_SHARED = 0.5, 0.6
SAMPLE_DOCS = 1000             # documents whose windows are the ordinary text (smallest hashes of the text)
PLAIN = 6000                   # of these windows, the most that are fitted (drawn at random)
COPIES, MIXED = 60, 12         # training samples of each clause, and of its words in random order
EPOCHS, RATE, RIDGE = 120, 0.5, 1e-4
SEED = 20240617
_PAIR, _TRIPLE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _pairs(w: np.ndarray) -> np.ndarray:
    """Hash of each word with the next (the last has none)."""
    return kernel.mix(w[:-1] * _PAIR + w[1:])


def _triples(w: np.ndarray) -> np.ndarray:
    return kernel.mix((w[:-2] * _PAIR + w[1:-1]) * _TRIPLE + w[2:]) if len(w) > 2 else np.zeros(0, np.uint64)


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return kernel.placed_hashes(np.array([0, len(raw)]), raw, _APART)[0]


def _features(w: np.ndarray) -> np.ndarray:
    return (np.concatenate([w, _pairs(w)]) % np.uint64(BUCKETS)).astype(np.int64)


class Clause:
    """Words of a clause, its different word triples, and those that no other family has."""

    def __init__(self, family: int, number: int, text: str):
        w = _words(text)
        self.family, self.number, self.words = family, number, len(w)
        self.triples = frozenset(_triples(w).tolist())
        self.own = self.triples


def clauses() -> list[Clause]:
    out = [Clause(FAMILIES.index(f), i, c) for f, texts in TEMPLATES.items() for i, c in enumerate(texts)]
    for c in out:
        c.own = c.triples.difference(*(o.triples for o in out if o.family != c.family))
    return out


class Classifier:
    """Weights (buckets, families), bias and temperature."""

    def __init__(self, samples: list[np.ndarray], labels: np.ndarray):
        held = np.arange(len(samples)) % 5 == 4
        fit = [s for s, h in zip(samples, held) if not h]
        self.weights = np.zeros((BUCKETS, len(FAMILIES)), dtype=np.float32)
        self.bias = np.zeros(len(FAMILIES))
        self.temperature = 1.0
        flat, rows = np.concatenate(fit), np.repeat(np.arange(len(fit)), [len(s) for s in fit])
        used, at = np.unique(flat, return_inverse=True)
        y = np.eye(len(FAMILIES))[labels[~held]]
        share = y.mean(axis=0)
        scale = np.where(share > 0, 1 / np.maximum(share, 1e-9), 0)      # every class weighs the same
        weight = (y @ scale)[:, None] / len(FAMILIES)
        w, seen = np.zeros((len(used), len(FAMILIES))), np.full((len(used), len(FAMILIES)), 1e-8)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in fit])[:-1]])
        for _ in range(EPOCHS):                                          # full gradients, steps scaled by their history
            z = np.add.reduceat(w[at], starts, axis=0) + self.bias
            g = weight * (_softmax(z) - y) / len(fit)
            grad = np.stack([np.bincount(at, g[rows, k], len(used)) for k in range(len(FAMILIES))], axis=1) + RIDGE * w / len(fit)
            seen += grad * grad
            w -= RATE * grad / np.sqrt(seen)
            self.bias -= RATE * g.sum(axis=0)
        self.weights[used] = w
        kept = [s for s, h in zip(samples, held) if h]
        if kept:
            z = np.array([self.weights[s].sum(axis=0) + self.bias for s in kept])
            loss = {t: -np.log(_softmax(z / t)[np.arange(len(kept)), labels[held]] + 1e-12).mean()
                    for t in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(loss, key=loss.get))

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        return _softmax((z + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Fit on template clauses and on a bounded sample of the texts of ``docs`` (whole texts, null ones left out)."""
    h = F.xxhash64("text")
    some = docs.where(F.col("text").isNotNull())
    different = some.select(h.alias("h")).distinct().count()            # copies count once
    share = min(1.0, 4.0 * sample_docs / max(1, different))             # thinned first: the sort meets few rows
    texts = [r.text for r in some.where(hash_share(h, share)).select("text").distinct()
             .orderBy(h, "text").limit(sample_docs).collect()]
    known = np.array(sorted(frozenset().union(*(c.triples for c in clauses()))), np.uint64)
    plain = []
    rng = np.random.default_rng(SEED)
    for text in texts:
        w = _words(text)
        for a in range(0, len(w), WINDOW):
            part = w[a:a + (WINDOW if rng.random() < 0.7 else int(rng.integers(1, WINDOW)))]
            if not np.isin(_triples(part), known).any():
                plain.append(part)
    plain = [plain[i] for i in sorted(rng.permutation(len(plain))[:PLAIN])]
    samples, labels = [_features(p) for p in plain if len(p)], [0] * sum(len(p) > 0 for p in plain)
    filler = np.concatenate(plain) if plain else np.zeros(0, np.uint64)
    for family, texts in TEMPLATES.items():
        for clause in texts:
            w = _words(clause)
            samples += [_features(rng.permutation(w)) for _ in range(MIXED)]
            labels += [0] * MIXED
            for _ in range(COPIES):
                keep = w[:max(3, len(w) - int(rng.integers(0, 3)))].copy()
                if len(keep) > 4 and rng.random() < 0.3:                 # one word replaced
                    keep[rng.integers(0, len(keep))] = rng.integers(0, 2**63, dtype=np.uint64)
                room = int(rng.integers(0, WINDOW - min(len(keep), WINDOW) + 1))
                around = np.zeros(0, np.uint64)
                if len(filler) > WINDOW and rng.random() < 0.7:
                    at = int(rng.integers(0, len(filler) - room)) if len(filler) > room else 0
                    around = filler[at:at + room]
                cut = int(rng.integers(0, len(around) + 1))
                samples.append(_features(np.concatenate([around[:cut], keep, around[cut:]])))
                labels.append(FAMILIES.index(family))
    order = rng.permutation(len(samples))
    return Classifier([samples[i] for i in order], np.array(labels)[order])


_FOUND = "line long, word long, family string, prob double, clause int, shared double"
_KIND = pa.list_(pa.struct([("line", pa.int64()), ("word", pa.int64()), ("family", pa.string()), ("prob", pa.float64()),
                            ("clause", pa.int32()), ("shared", pa.float64())]))


def _windows(begin: np.ndarray, size: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of paragraphs."""
    n = np.maximum(1, -(-(size - width) // step) + 1)
    at = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
    return at, np.minimum(at + width, np.repeat(begin + size, n))


def occurrences(known: list[Clause], place: np.ndarray, triple: np.ndarray) -> Iterator[tuple[Clause, int, int, float]]:
    """(clause, first word, word after, share of its triples) of clauses in word triples found at ascending places."""
    for c in known:
        mine = [(int(p), t) for p, t in zip(place.tolist(), triple.tolist()) if t in c.triples]
        i = 0
        while i < len(mine):
            start = mine[i][0]
            j = i
            while j < len(mine) and mine[j][0] < start + c.words:
                j += 1
            have = {t for _, t in mine[i:j]}
            share, own = len(have) / len(c.triples), len(have & c.own) / max(1, len(c.own))
            if share >= MIN_SHARED and own >= MIN_SHARED:
                yield c, start, mine[j - 1][0] + 3, share
                i = j
            else:
                i += 1


def _scan(shared):
    known = clauses()
    triples = np.array(sorted(frozenset().union(*(c.triples for c in known))), np.uint64)
    versions = [(_words(k), v) for k, v in VERSIONS.items()]

    def named(family: str, w: np.ndarray, first: int, start: int, end: int, last: int) -> str:
        if family not in VERSIONED:
            return family
        low, high = max(first, start - NEAR // 2), min(last, end + NEAR)
        for p in [*range(start, high), *range(low, start)]:              # after the clause's start first
            for k, v in versions:
                if np.array_equal(w[p:min(p + len(k), high)], k):
                    return f"{family}-{v}"
        return family

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wide = np.concatenate([model.weights, np.zeros((1, len(FAMILIES)))])
        for batch in batches:
            for row, off, data in kernel.chunks(batch.column(1)):
                w, first, starts = kernel.placed_hashes(off, data, _APART)
                breaks = np.flatnonzero(data == 10)
                text = np.searchsorted(off[1:-1], starts, side="right")
                line = np.searchsorted(breaks, starts)
                base = np.searchsorted(breaks, off[:-1])
                found: dict[int, list[dict]] = {}
                t = _triples(w)
                # Paragraphs end at a line without words and with their text.
                cut = np.flatnonzero((line[1:] - line[:-1] > 1) | (text[1:] != text[:-1])) + 1 if len(w) else np.zeros(0, np.int64)
                begin = np.r_[0, cut] if len(w) else cut
                size = np.diff(np.r_[begin, len(w)])
                owner = np.repeat(np.arange(len(begin)), size)
                sure, at, end = np.zeros(0, np.int64), begin, begin
                if len(w):
                    pair = np.append((_pairs(w) % np.uint64(BUCKETS)).astype(np.int64), BUCKETS)
                    pair[np.append(owner[1:] != owner[:-1], True)] = BUCKETS      # no pair across paragraphs
                    one, two = np.zeros((len(w) + 1, len(FAMILIES))), np.zeros((len(w) + 1, len(FAMILIES)))
                    np.cumsum(wide[(w % np.uint64(BUCKETS)).astype(np.int64)], axis=0, out=one[1:])
                    np.cumsum(wide[pair], axis=0, out=two[1:])
                    at, end = (np.concatenate(x) for x in zip(*(_windows(begin, size, n, step) for n, step in WINDOWS)))
                    p = model.probabilities(one[end] - one[at] + two[np.maximum(end - 1, at)] - two[at])
                    best, top = p.argmax(axis=1), p.max(axis=1)
                    sure = np.flatnonzero((best > 0) & (top >= MIN_PROB))
                hit = np.flatnonzero(np.isin(t, triples) & (owner[:-2] == owner[2:])) if len(sure) and len(t) else sure[:0]
                for g in np.unique(owner[at[sure]]) if len(sure) else ():
                    a, b = int(begin[g]), int(begin[g] + size[g])
                    near = sure[(at[sure] >= a) & (at[sure] < b)]
                    mine = hit[(hit >= a) & (hit < b)]
                    last_end: dict[int, int] = {}
                    seen = sorted(occurrences(known, mine, t[mine]), key=lambda o: (o[1], -(o[2] - o[1]), o[0].number))
                    for c, s, e, share in seen:
                        around = top[near[(best[near] == c.family) & (at[near] <= s) & (end[near] >= min(e, s + 12))]]
                        if len(around) and s >= last_end.get(c.family, 0):
                            last_end[c.family] = e
                            x = int(text[s])
                            found.setdefault(x, []).append({
                                "line": int(line[s] - base[x]), "word": s - a, "family": named(FAMILIES[c.family], w, a, s, e, b),
                                "prob": float(around.max()), "clause": c.number, "shared": share})
                lists = [sorted(found.get(x, []), key=lambda f: (f["line"], f["word"], f["family"], f["clause"]))
                         for x in range(len(off) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(lists)), pa.array(lists, _KIND)],
                                                 names=["doc_id", "found"])
    return run


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and found: array of (line, word of the paragraph, family, prob, clause, shared), in order.

    ``prob`` is that of the most probable window around the clause.  Null and empty texts
    have none.  Repeated rows give the same result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)           # BUCKETS * families numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _scan(shared), f"doc_id long, found array<struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>>")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, families (sorted, comma-joined), n_notices and best_prob (null without notices)."""
    return scanned.select("doc_id", F.array_join(F.array_sort(F.array_distinct("found.family")), ",").alias("families"),
                          F.size("found").cast("long").alias("n_notices"),
                          F.array_max("found.prob").alias("best_prob"))
