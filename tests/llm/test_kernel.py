"""The word-hash kernel against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wayline.llm import kernel

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBzé \n\t\x0b中", max_size=40)), min_size=1, max_size=8)


def lowered(w):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in w)


def sets_of(texts, k):
    out = []
    for _, off, data in kernel.chunks(pa.array(texts, pa.string())):
        out += kernel.distinct_sets(*kernel.shingle_hashes(*kernel.word_hashes(off, data), k))
    return out


def plain(text, k):
    ws = [lowered(w) for w in WORDS.findall(text or "")]
    if not ws:
        return set()
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)}


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([2, 5]))
def test_sets_match(texts, k):
    got, want = sets_of(texts, k), [plain(t, k) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_sequence_hash_tells_word_sequences_apart():
    texts = ["a b", "a  B\n", "b a", "a", "ab", "", None, " \n"]
    (_, off, data), = kernel.chunks(pa.array(texts, pa.string()))
    c1, c2 = kernel.sequence_hashes(*kernel.word_hashes(off, data))
    keys = list(zip(c1.tolist(), c2.tolist()))
    assert keys[0] == keys[1] and len(set(keys[1:5])) == 4 and set(keys[5:]) == {(0, 0)}


def test_long_text_in_one_chunk():
    text = "word " * 600_000
    (_, off, data), = kernel.chunks(pa.array([text]))
    assert len(kernel.word_hashes(off, data)[0]) == 600_000
