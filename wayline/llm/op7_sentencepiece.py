"""Exact encoding and decoding with a merge-type (BPE) sentencepiece model.

A segmentation is the merge encoding exactly when every piece and every two
adjacent pieces re-merge to themselves.  So encoding needs no merge queue:
Aho-Corasick gives the longest piece at each position; a piece is accepted when
it is compatible with its predecessor (checked by re-merging the two, and
remembered); otherwise the next shorter prefix piece is tried, and when none is
left the position is marked in a bitfield as failed and the encoder steps back.

Texts are cut first where no merge can cross, that is between characters that
stand together in no piece of the model: a pattern derived from the pieces cuts
words, and a word not seen lately is cut further.  Encoded words are remembered
in tables of bounded size.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import arrow_map

SPACE = "▁"
LETTERS = "a-zA-Z\u00c0-\u024f"   # letters of the coarse cut (any other letters are cut on a second look)
REMEMBER_WORDS = 250_000       # words of one generation; two are held, the older one goes when the newer is full
REMEMBER_PAIRS = 300_000     # a full table is emptied
REMEMBER_CHARS = 64
MODEL_LIMIT = 64 * 2**20                               # bytes of a model file sent to the workers
OUT_BYTES = 2**21                                      # text bytes of one output batch


class PieceModel:
    """Pieces, scores and byte pieces of a model; encodes and decodes with its own code."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        if sp.normalize("Ａ  ﬁ a ") != f"{SPACE}Ａ{SPACE}{SPACE}ﬁ{SPACE}a{SPACE}":
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        self.unk = sp.unk_id()
        self.byte_ids = {}
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode() if i == self.unk else b"")
            else:
                self.rank[piece], self.ids[piece] = sp.get_score(i), i
                self.surface.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.starts_space = np.array([s[:1] == b" " and not self.is_byte[i] and i != self.unk
                                      for i, s in enumerate(self.surface)])
        self.machine = ahocorasick.Automaton()
        for piece in self.ids:
            self.machine.add_word(piece, len(piece))
        self.machine.make_automaton()
        self.chars = {p for p in self.ids if len(p) == 1}
        longer = [p for p in self.ids if len(p) > 1]
        self.inside = {p[i:i + 2] for p in longer for i in range(len(p) - 1)}
        self.word = self._cutter()
        self.prefix: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cutter(self) -> re.Pattern:
        """Pattern of the first, coarse cut: only between characters that stand together in no piece."""
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inside):
            return re.compile("(?s).+")
        line = "\n" if not any("\n" in pair for pair in self.inside) else ""
        letter = re.compile(f"[{LETTERS}]")
        glued = {b for a, b in self.inside if letter.match(a)}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in glued)   # never follow a letter in a piece
        other, bound = f"[^{LETTERS}{SPACE}{line}]", f"[^{LETTERS}{SPACE}{line}{marks}]"
        word = f"{SPACE}*{other}*(?:[{LETTERS}]+(?:{bound}{other}*)?)*"
        return re.compile(rf"\n|(?=[^\n]){word}" if line else f"(?=(?s:.)){word}")

    def _merge(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` (or nothing) and ``right`` re-merge to themselves."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._merge(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= REMEMBER_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _shorter(self, piece: str) -> str | None:
        """Longest proper prefix of a piece that is a piece."""
        try:
            return self.prefix[piece]
        except KeyError:
            self.prefix[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), None)
            return self.prefix[piece]

    def _backtrack(self, text: str) -> list[str]:
        """Encode characters that are all pieces."""
        n = len(text)
        longest = [1] * n
        for end, size in self.machine.iter(text):      # the last match to start at a place is its longest
            longest[end + 1 - size] = size
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        pairs, left, pos, piece = self.pairs, "", 0, text[:longest[0]]
        while True:
            end = pos + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = pairs.get((left, piece))
                if fits or fits is None and self._compatible(left, piece):
                    out.append(piece)
                    if end == n:
                        return out
                    left, pos, piece = piece, end, text[end:end + longest[end]]
                    continue
            shorter = self._shorter(piece)
            while shorter is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                left = out[-1] if out else ""
                pos -= len(piece)
                shorter = self._shorter(piece)
            piece = shorter

    def _segment(self, word: str) -> bytes:
        """Ids of a text that may hold characters without a piece: those become their bytes."""
        if self.chars.issuperset(word):
            return array("i", [self.ids[p] for p in self._backtrack(word)]).tobytes()
        ids: list[int] = []
        i = 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] in self.chars:
                j += 1
            if j > i:
                ids += [self.ids[p] for p in self._backtrack(word[i:j])]
            if j < len(word):
                ids += [self.byte_ids[b] for b in word[j].encode()]
            i = j + 1
        return array("i", ids).tobytes()

    def _remember(self, word: str, coded: bytes) -> bytes:
        if len(word) <= REMEMBER_CHARS:
            if len(self.words) >= REMEMBER_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = coded
        return coded

    def _word(self, word: str) -> bytes:
        """Ids of a coarse word: cut on wherever no merge can cross, parts looked up before they are encoded."""
        inside, cuts = self.inside, [0]
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in inside:
                cuts.append(i)
        if len(cuts) == 1:
            return self._segment(word)
        out = []
        for a, b in zip(cuts, cuts[1:] + [len(word)]):
            part = word[a:b]
            got = self.words.get(part) or self.older.get(part)
            out.append(got or self._remember(part, self._segment(part)))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (no begin or end ids)."""
        if not text:
            return np.zeros(0, np.int32)
        parts = []
        for w in self.word.findall(SPACE + text.replace(" ", SPACE)):
            parts.append(self.words.get(w) or self._remember(w, self.older.get(w) or self._word(w)))
        return np.frombuffer(b"".join(parts), dtype=np.intc)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces joined (a byte of no character becomes U+FFFD), one leading space off."""
        listed = np.asarray(ids, dtype=np.int64).tolist()
        runs: list[list[int]] = [[]]           # control ids are empty and end a run of bytes
        for i in listed if not self.control.isdisjoint(listed) else ():
            if i in self.control:
                runs.append([])
            else:
                runs[-1].append(i)
        if len(runs) == 1:
            runs = [listed]
        out, first = [], True
        for run in runs:
            raw = b"".join(map(self.surface.__getitem__, run))
            if run and first:
                raw, first = raw[1:] if self.starts_space[run[0]] else raw, False
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(_lenient(raw))
        return "".join(out)


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_loaded: dict[int, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    """One model a worker, kept between tasks."""
    key = hash(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(proto)
    return _loaded[key]


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            row, ids, texts, size = 0, [], [], 0
            for i, text in enumerate(batch.column(1)):
                coded = model.encode(text.as_py() or "")
                ids.append(coded)
                texts.append(model.decode(coded))
                size += 4 * len(coded) + 4 * len(texts[-1])
                if size >= OUT_BYTES or i == len(batch) - 1:
                    off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, len(ids)),
                         pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(ids))),
                         pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                    row, ids, texts, size = i + 1, [], [], 0
    return run


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, decoded for every row of ``docs`` (doc_id, text).

    Null text is empty: no ids, empty decoded text.  Null or repeated doc_ids
    pass through; other columns are not read.  ``model_path`` is a file of the
    driver; its bytes (at most MODEL_LIMIT) go to the workers as a broadcast.
    """
    with open(model_path, "rb") as f:
        proto = f.read(MODEL_LIMIT + 1)
    if len(proto) > MODEL_LIMIT:
        raise ValueError("model file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(texts, _code(shared), "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of coded rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.encode(joined, "UTF-8"), 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
