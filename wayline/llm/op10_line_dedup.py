"""Lines that repeat across documents, found with two Bloom filters.

Pass 1 hashes every line key.  Each partition sets, per document, the bits of
its distinct keys in a *once* filter, and in a *twice* filter where a bit was
set before.  Filters of two partitions merge to ``once = o1 | o2`` and
``twice = t1 | t2 | (o1 & o2)``, an order-free rule, so segments merge in
parallel.  A key of two or more documents has all its bits in *twice*; chance
hits only add suspects.

Pass 2 sends only lines that *twice* suspects into a shuffle: exact document
counts per 128-bit key, and the choice of the first occurrence where one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import WS, arrow_map, free_name, hash128, ship, stored

MIN_DOCS = 10
BITS_PER_ROW = 64                  # filter bits for each document row
LEAST_BITS, MOST_BITS = 2**20, 2**30   # 128 KB to 128 MB a filter: the bound of what is broadcast
HASHES = 2
WS_BYTES = WS.encode()
SEGMENT = 2**19                    # bits of one merge unit (64 KB)


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, 128-bit hashes as two columns) of every line with a non-empty key of binary texts."""
    row, pos, digests = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        for j, line in enumerate((text or b"").split(b"\n")):
            key = line.strip(WS_BYTES)
            if key:
                row.append(i)
                pos.append(j)
                digests.append(xxhash.xxh3_128_digest(key.lower()))   # bytes: only A-Z change
    return (np.array(row, np.int64), np.array(pos, np.int64),
            np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2))


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    u = h.view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return [((u + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    """Set bits at ascending places."""
    byte, mask = at >> 3, (0x80 >> (at & 7)).astype(np.uint8)
    if len(at):
        start = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        packed[byte[start]] |= np.bitwise_or.reduceat(mask, start)


def _get(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _local_filters(bits: int):
    """Both filters of a partition, packed: bits / 4 bytes (256 MB at MOST_BITS) while it is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            row, _, hashes = line_keys(batch.column(0))
            for at in _bits(hashes[:, 0], bits):
                # a document counts once for each bit, however many of its keys meet there
                pairs = np.unique(at * np.int64(len(batch)) + row) // np.int64(max(len(batch), 1))
                hit, n = np.unique(pairs, return_counts=True)
                _set(twice, hit[(n > 1) | _get(once, hit)])
                _set(once, hit)
        size = SEGMENT // 8
        for s in range(0, len(once), size):
            if once[s:s + size].any():
                yield pa.RecordBatch.from_pydict({"seg": pa.array([s // size], pa.int64()),
                                                  "once": [once[s:s + size].tobytes()],
                                                  "twice": [twice[s:s + size].tobytes()]})
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for seg, o, t in zip(*(c.to_pylist() for c in batch.columns)):
            o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
            if seg in held:
                a, b = held[seg]
                b |= t | (a & o)
                a |= o
            else:
                held[seg] = [o.copy(), t.copy()]
    for seg, (_, t) in held.items():
        yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int64()), "twice": [t.tobytes()]})


def filter_bits(rows: int) -> int:
    """Power of two, at least BITS_PER_ROW a row, between the stated bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def twice_filter(texts: DataFrame, bits: int) -> np.ndarray:
    """Packed *twice* filter of the lines of a column of binary texts."""
    n = max(1, bits // SEGMENT)
    merged = arrow_map(arrow_map(texts, _local_filters(bits), "seg long, once binary, twice binary")
                       .repartition(min(n, 256), "seg"), _merge, "seg long, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():           # at most MOST_BITS / 8 bytes in all
        out[r.seg * (SEGMENT // 8):][:len(r.twice)] = np.frombuffer(r.twice, np.uint8)
    return out


def _suspects(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            row, pos, hashes = line_keys(batch.column(3))
            known = np.ones(len(row), bool)
            for at in _bits(hashes[:, 0], bits):
                known &= _get(packed, at)
            row_at = pa.array(row[known])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row_at) for c in range(3)), pa.array(pos[known]),
                 pa.array(np.ascontiguousarray(hashes[known, 0])), pa.array(np.ascontiguousarray(hashes[known, 1]))],
                names=["doc_id", "t1", "t2", "pos", "h1", "h2"])
    return run


def _without(text: pd.Series, positions: pd.Series) -> pd.Series:
    def one(t, gone):
        if t is None or gone is None:
            return t
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return pd.Series([one(t, g) for t, g in zip(text, positions)], dtype=object)


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, t1, t2, gone): sorted positions of lines to drop; only documents that lose any.

    t1, t2 are ``hash128`` of the text.  A key counts once for each row of
    ``docs``: repeated rows are documents of their own.  With ``keep_first`` the
    occurrence with the smallest (doc_id, nulls last; then position) stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = hash128(text)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"),
                        text.cast("binary").alias("text"))
    bits = filter_bits(docs.count())
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(keyed.select("text"), bits))
    found = arrow_map(keyed, _suspects(shared, bits), "doc_id long, t1 long, t2 long, pos long, h1 long, h2 long")
    found = stored(found.groupBy("doc_id", "t1", "t2", "pos", "h1", "h2").agg(F.count("*").alias("n")), "suspects")
    row = ["doc_id", "t1", "t2"]
    keys = (found.groupBy(*row, "h1", "h2").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
            .groupBy("h1", "h2")
            .agg(F.sum("n").alias("docs"),
                 F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "pos", "t1", "t2")).alias("first"))
            .where(F.col("docs") >= min_docs))
    gone = found.join(keys, ["h1", "h2"])
    if keep_first:
        here = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "pos", "t1", "t2")
        gone = gone.where(~here.eqNullSafe(F.col("first")))
    return gone.groupBy(*row).agg(F.sort_array(F.collect_list("pos")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus n_lines and n_dropped (names free of clashes).

    A line's key is the line stripped of ASCII white space with A-Z lowered;
    empty keys are never dropped.  Null text counts as one empty line and stays
    null.  Keys found in ``min_docs`` or more rows lose all their lines in every
    document (or all but the first occurrence, with ``keep_first``).
    """
    ship(docs.sparkSession)
    gone = stored(repeated_lines(docs, min_docs, keep_first), "gone-lines")
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    text = docs["text"].cast("string")
    t1, t2 = hash128(F.coalesce(text, F.lit("")))
    names = {c: free_name(docs, f"_{c}") for c in gone.columns}
    gone = gone.select(*(F.col(c).alias(n) for c, n in names.items()))
    met = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[names["doc_id"]])
                    & (t1 == gone[names["t1"]]) & (t2 == gone[names["t2"]]), "left")
    lost = F.col(names["gone"])
    rewritten = F.when(lost.isNull(), text).otherwise(
        F.pandas_udf(_without, "string")(F.when(lost.isNotNull(), text), lost))
    counts = [F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long").alias(n_lines),
              F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(n_dropped)]
    return met.select(*(rewritten.alias(c) if c.lower() == "text" else docs[c] for c in docs.columns), *counts)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines[i] AS line, i
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))),
bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM bad)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM bad)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""
