"""Language identification by interpolated Kneser-Ney character models.

Training text is lowered; letters stay, every run of other characters is one
blank.  Character n-grams up to ``ORDER`` are counted per language in Spark.
Each language's model is interpolated Kneser-Ney: the highest order uses
counts, lower orders the number of distinct left neighbours, with one absolute
discount per order.  The models of all languages share one sorted array of
n-gram hashes per order with a row of log-probabilities (and back-off weights)
per language, so scoring is a binary search per character.

A text's language is the one with the lowest cross-entropy per character.  The
gap to the second-best language goes through a logistic curve fitted on
training snippets (the score), and a text whose best cross-entropy lies far
above that of training snippets of the language is flagged as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import arrow_map, hash_share
from wayline.llm.kernel import mix

ORDER = 4
SAMPLE_DOCS = 1500             # documents of a language whose whole texts train its model (smallest hashes first)
SNIPPETS = (20, 80, 320)       # characters of the calibration snippets
CALIBRATE_EVERY = 10           # each so many-th document of the sample is held back for calibration
MAX_LANGS = 500                # more learned languages raise an error
REJECT_SIGMAS = 6.0            # cross-entropy above mean + this many deviations of the snippets: rejected
CHUNK_CHARS = 1 << 19
UNKNOWN = "und"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """Code point -> code point of its lower-case letter; 32 for everything else."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_table: np.ndarray | None = None


def fold(text: str) -> np.ndarray:
    """Folded code points of a text with one blank for every run of non-letters and at both ends."""
    global _table
    if _table is None:
        _table = _fold_table()
    c = _table[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    return c[~((c == 32) & (np.concatenate([[0], c[:-1]]) == 32))]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position n-1, n, ... of folded code points."""
    h = np.zeros(max(0, len(c) - n + 1), dtype=np.uint64)
    for j in range(n):
        h = h * _MULT + c[j:len(c) - n + 1 + j].astype(np.uint64) + np.uint64(1)
    return mix(h ^ np.uint64(n))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count) of each batch: top-order n-grams of whole texts as strings."""
    for batch in batches:
        held: dict[tuple[str, str], int] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            c = fold(text)
            if len(c) < 3:
                continue
            s = " " * (ORDER - 2) + "".join(map(chr, c.tolist()))   # left padding: one blank is there already
            for i in range(ORDER - 1, len(s)):
                g = s[i - ORDER + 1:i + 1]
                held[lang, g] = held.get((lang, g), 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in held], pa.string()),
                                          "gram": pa.array([k[1] for k in held], pa.string()),
                                          "n": pa.array(list(held.values()), pa.int64())})


class KneserNey:
    """Sorted n-gram hashes per order, with log2-probabilities and back-off weights per language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        tables = [self._language(counts[lang]) for lang in self.langs]
        self.keys, self.logp, self.ctx, self.back = [], [], [], []
        self.floor = np.array([t[2] for t in tables])             # log2-probability of an unseen character
        width = len(self.langs)
        for n in range(1, ORDER + 1):
            names = sorted({g for t in tables for g in t[0][n]})
            ctxs = sorted({g for t in tables for g in t[1][n]})
            logp = np.array([[self._prob(t, g) for t in tables] for g in names]).reshape(-1, width)
            back = np.array([[math.log2(t[1][n].get(g, 1.0)) for t in tables] for g in ctxs]).reshape(-1, width)
            for names_, values, keys_, rows in ((names, logp, self.keys, self.logp), (ctxs, back, self.ctx, self.back)):
                size = n if keys_ is self.keys else n - 1
                h = np.array([grams(np.array([ord(x) for x in g], np.uint32), size)[0] if size else 0 for g in names_],
                             dtype=np.uint64)
                order = np.argsort(h)
                keys_.append(h[order])
                rows.append(np.log2(values)[order] if keys_ is self.keys else values[order])

    @staticmethod
    def _language(top: dict[str, int]):
        """(probabilities, back-off weights) per order and the probability of an unseen character."""
        counts = {ORDER: top}
        for n in range(ORDER - 1, 0, -1):                         # continuation counts: distinct left neighbours
            low: dict[str, int] = {}
            for g in counts[n + 1]:
                low[g[1:]] = low.get(g[1:], 0) + 1
            counts[n] = low
        probs, backs = {}, {}
        alphabet = len(counts[1]) + 1                             # one more for characters never seen
        for n in range(1, ORDER + 1):
            c = counts[n]
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, v in c.items():
                total[g[:-1]] = total.get(g[:-1], 0) + v
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            backs[n] = {h: d * kinds[h] / total[h] for h in total}
            probs[n] = {g: (v - d) / total[g[:-1]] + backs[n][g[:-1]] * (probs[n - 1][g[1:]] if n > 1 else 1 / alphabet)
                        for g, v in c.items()}
        return probs, backs, math.log2(backs[1].get("", 1.0) / alphabet)

    @staticmethod
    def _prob(t, g: str) -> float:
        """Interpolated probability of an n-gram's last character in one language."""
        weight = 1.0
        while g:
            got = t[0][len(g)].get(g)
            if got is not None:
                return weight * got
            if len(g) > 1:
                weight *= t[1][len(g)].get(g[:-1], 1.0)
            g = g[1:]
        return weight * 2 ** t[2]

    def score(self, c: np.ndarray) -> np.ndarray:
        """(positions, languages) log2-probabilities of folded code points from position 1 on."""
        c = np.concatenate([np.full(ORDER - 2, 32, np.uint32), c])
        n_pos = len(c) - ORDER + 1
        out = np.zeros((n_pos, len(self.langs)))
        left = np.arange(n_pos)
        for n in range(ORDER, 0, -1):
            h = grams(c[ORDER - n:], n)[left]
            at = np.minimum(np.searchsorted(self.keys[n - 1], h), max(len(self.keys[n - 1]) - 1, 0))
            hit = self.keys[n - 1][at] == h if len(self.keys[n - 1]) else np.zeros(len(h), bool)
            out[left[hit]] += self.logp[n - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            # Missed: the back-off weight of the context, where the order knows the context.
            if n == 1:
                out[left] += self.floor
                return out
            ctx = grams(c[ORDER - n:len(c) - 1], n - 1)[left]
            at = np.minimum(np.searchsorted(self.ctx[n - 1], ctx), len(self.ctx[n - 1]) - 1)
            known = self.ctx[n - 1][at] == ctx
            out[left[known]] += self.back[n - 1][at[known]]
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) bits per character; every text has at least two positions."""
        out = np.zeros((len(texts), len(self.langs)))
        for i, c in enumerate(texts):
            total = np.zeros(len(self.langs))
            for a in range(0, len(c) - 1, CHUNK_CHARS):           # very long texts in parts that overlap by the context
                lo = max(0, a - ORDER + 2)
                total += self.score(c[lo:a + CHUNK_CHARS + 1])[a - lo:].sum(axis=0)
            out[i] = -total / (len(c) - 1)
        return out


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(right) = 1 / (1 + exp(-(a x + b))), by Newton steps with a small ridge."""
    a = np.zeros(2)
    m = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -30, 30)))
        grad = m.T @ (y - p) - 1e-3 * a
        hess = (m * (p * (1 - p) + 1e-9)[:, None]).T @ m + 1e-3 * np.eye(2)
        a = a + np.linalg.solve(hess, grad)
    return float(a[0]), float(a[1])


def calibrate(model: KneserNey, snippets: list[tuple[str, np.ndarray]]):
    """(slope, offset) of the score and per language the cross-entropy above which a text is rejected."""
    gaps, right, own = [], [], {lang: [] for lang in model.langs}
    for lang, e in zip((s[0] for s in snippets), model.entropies([s[1] for s in snippets])):
        best = np.sort(e)
        gaps.append(best[1] - best[0] if len(best) > 1 else 1.0)
        right.append(model.langs[int(np.argmin(e))] == lang)
        own[lang].append(e[model.langs.index(lang)])
    limits = np.array([np.mean(v) + REJECT_SIGMAS * np.std(v) if v else np.inf for v in own.values()])
    slope, offset = _fit_logistic(np.array(gaps), np.array(right, dtype=float)) if gaps else (0.0, 0.0)
    return slope, offset, limits


def snippet(text: Column, size: int) -> Column:
    """4 * size characters of a text from a hashed place on, without the word that the place cuts (a whole text if shorter)."""
    at = F.pmod(F.xxhash64(text, F.lit(size)), F.greatest(F.lit(1), F.length(text) - 4 * size + 1)).cast("int")
    part = F.substring(text, at + 1, F.lit(4 * size))
    return F.when(at > 0, F.regexp_replace(part, r"^\S{1,40}\s+", "")).otherwise(part)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS):
    """(model, slope, offset, limits) from rows (text, lang), or None without any usable row.

    Rows with null text or language are left out.  At most ``sample_docs``
    different texts of a language train (smallest hashes of the text first); the
    n-gram tables that reach the driver are bounded by that sample.
    """
    from pyspark.sql import Window

    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    langs = [r.lang for r in rows.groupBy("lang").count().select("lang").limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    # Hash ranges thin the rows before the ranking: no language is ranked as a whole, no copy twice.
    # The share follows the different texts: copies are counted once, by their hash.
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_docs) / F.col("n"))
    thin = (rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang")      # <= MAX_LANGS rows
            .where(hash_share(F.col("h"), F.col("share"))).select("lang", "text", "h").distinct())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = thin.withColumn("r", rank).where(F.col("r") <= sample_docs).select("lang", "text", "r")
    back = F.col("r") % CALIBRATE_EVERY == 0
    counted = (arrow_map(sample.where(~back).select("lang", "text"), _count,
                         "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts_by: dict[str, dict[str, int]] = {}
    for r in counted.toLocalIterator():
        counts_by.setdefault(r.lang, {})[r.gram] = r.n
    # At most langs * sample_docs / CALIBRATE_EVERY short rows:
    held = sample.where(back).select("lang", *(snippet(F.col("text"), n).alias(f"s{n}") for n in SNIPPETS)).collect()
    if not counts_by:
        return None
    model = KneserNey(counts_by)
    snippets = [(r.lang, c) for r in held if r.lang in counts_by
                for size in SNIPPETS for c in [fold(r[f"s{size}"])[:size]] if len(c) > 2]
    return (model, *calibrate(model, snippets))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slope, offset, limits = shared.value
        for batch in batches:
            texts = [fold(t.as_py() or "") for t in batch.column(1)]
            some = [i for i, c in enumerate(texts) if len(c) > 2]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            bits, rejected = np.zeros(len(texts)), np.zeros(len(texts), bool)
            if some:
                e = model.entropies([texts[i] for i in some])
                best = np.argmin(e, axis=1)
                low = np.sort(e, axis=1)
                gap = low[:, 1] - low[:, 0] if e.shape[1] > 1 else np.ones(len(some))
                score[some] = 1 / (1 + np.exp(-np.clip(slope * gap + offset, -30, 30)))
                bits[some], rejected[some] = low[:, 0], low[:, 0] > limits[best]
                for i, k in zip(some, best):
                    lang[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "bits", "rejected"])
    return run


def identify(docs: DataFrame, trained) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), bits (per character) and rejected for every row of ``docs``.

    Texts that are null or hold no letter are ``und`` with score 0 and not
    rejected; so is every text when there is no model.  Equal cross-entropies
    go to the language first in alphabetical order.  Other columns are not
    read; repeated rows are predicted alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if trained is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("bits"), F.lit(False).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    return arrow_map(rows, _predict(shared),
                     "doc_id long, lang_pred string, score double, bits double, rejected boolean")
