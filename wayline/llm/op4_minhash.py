"""Near-duplicate groups by b-bit MinHash, bands and exact confirmation.

Texts become sets of distinct word 5-grams.  Texts with the same word
sequence are one class.  Each class gets ``BANDS * ROWS`` minima; bands of
full minima propose candidates, and only the low ``BITS`` bits of each minimum
are kept, packed into 64-bit words.  Packed signatures are compared by xor and
bit counts; the estimate is corrected for chance matches (2^-BITS) and serves
only to skip candidates that are ``SIGMAS`` standard deviations below the
threshold.  Every link is confirmed on the full sets.

A bucket never emits all its pairs.  First each member meets only the
leaders of its buckets (their most central members) and is confirmed against
its best one, then against others that are still apart from it.  Components of
those links settle most buckets; in buckets that still hold several
components, only pairs *across* components are confirmed.  Members of buckets
too crowded for that (many texts around one common passage) are paired through
their rarest shingles instead, which loses no pair at the threshold.  A pair inside one component cannot change the result, so no link
that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm import kernel
from wayline.llm.common import arrow_map, free_name, stored
from wayline.llm.components import components

SHINGLE = 5
PERCENT = 75                   # a link: 100 * intersection >= PERCENT * union
BANDS, ROWS, BITS = 48, 5, 4   # a pair at 0.75 shares no band with probability 2e-6
SIGMAS = 5.0
COUNTERS, SEGMENT = 2**20, 2**16   # frequency counters of crowded members (8 MB), and those of one merge unit
CROWD = 32                     # members of a bucket that may meet one another directly
_K = BANDS * ROWS
_PER_WORD = 64 // BITS
_WORDS = -(-_K // _PER_WORD)
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**64, _K, dtype=np.uint64)
_MUL = _rng.integers(0, 2**64, _K, dtype=np.uint64) | np.uint64(1)
_BAND_MUL = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

_SIG_SCHEMA = pa.schema([("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()),
                         ("n_shingles", pa.int64()), ("sig", pa.list_(pa.int64())),
                         ("bands", pa.list_(pa.int64()))])
_SIG_DDL = ("doc_id long, c1 long, c2 long, n_shingles long, sig array<long>, bands array<long>")
_BLOCK = 1 << 15               # shingles per minima block: stays in the CPU cache


def _minima(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(texts, K) minima of each text's hashes; every text has at least one."""
    n = len(start) - 1
    out = np.full((n, _K), np.uint64(2**64 - 1))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(start, start[i] + _BLOCK, side="right")) - 1)
        for a in range(start[i], start[j], _BLOCK):             # a longer text in several blocks
            part = h[a:min(a + _BLOCK, start[j])] if j == i + 1 else h[start[i]:start[j]]
            at = np.zeros(1, np.int64) if j == i + 1 else start[i:j] - start[i]
            for k in range(_K):
                low = np.minimum.reduceat((part ^ _XOR[k]) * _MUL[k], at)
                np.minimum(out[i:j, k], low, out=out[i:j, k])
            if j > i + 1:
                break
        i = j
    return out


def _pack(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima, taken after mixing, packed into 64-bit words."""
    low = kernel.mix(minima) & np.uint64(2**BITS - 1)
    low = np.pad(low, ((0, 0), (0, _WORDS * _PER_WORD - _K))).reshape(len(minima), _WORDS, _PER_WORD)
    return (low << (np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    m = kernel.mix(minima).reshape(len(minima), BANDS, ROWS)
    return kernel.mix((m * _BAND_MUL).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _lists(rows: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Arrow list column of equal-length rows; rows flagged empty are empty lists."""
    sizes = np.where(empty, 0, rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                    pa.array(rows[~empty].reshape(-1).view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, off, data in kernel.chunks(batch.column(1)):
            n = len(off) - 1
            w, first = kernel.word_hashes(off, data)
            c1, c2 = kernel.sequence_hashes(w, first)
            h, start = kernel.shingle_hashes(w, first, SHINGLE)
            sizes = np.array([len(s) for s in kernel.distinct_sets(h, start)], dtype=np.int64)
            empty = sizes == 0
            sig, bands = np.zeros((n, _WORDS), np.uint64), np.zeros((n, BANDS), np.uint64)
            if not empty.all():
                minima = _minima(h, np.concatenate([[0], np.cumsum(np.diff(start)[~empty])]))
                sig[~empty], bands[~empty] = _pack(minima), _band_keys(minima)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, n), pa.array(c1), pa.array(c2), pa.array(sizes),
                 _lists(sig, empty), _lists(bands, empty)], schema=_SIG_SCHEMA)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, class key (c1, c2), set size, packed b-bit signature and band keys of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(texts, _sign, _SIG_DDL)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures: matching fields by bit counts, corrected for chance."""
    step = int("".join(["0" * (BITS - 1) + "1"] * _PER_WORD), 2)
    step -= 2**64 if step >= 2**63 else 0

    def differing(x: Column, y: Column) -> Column:
        d, width = x.bitwiseXOR(y), 1
        while width < BITS:
            d, width = d.bitwiseOR(F.shiftrightunsigned(d, width)), 2 * width
        return F.bit_count(d.bitwiseAND(F.lit(step)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, d: s + d)
    chance = 2.0**-BITS
    return (F.lit(1.0) - off / F.lit(float(_K)) - F.lit(chance)) / F.lit(1.0 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    """Estimates below this are SIGMAS standard deviations under the threshold."""
    j, chance = percent / 100, 2.0**-BITS
    p = j + (1 - j) * chance
    return j - SIGMAS * (p * (1 - p) / _K) ** 0.5 / (1 - chance)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                sets: list[np.ndarray] = []
                for _, off, data in kernel.chunks(batch.column(c)):
                    sets += kernel.distinct_sets(*kernel.shingle_hashes(*kernel.word_hashes(off, data), SHINGLE))
                sides.append(sets)
            linked = []
            for x, y in zip(*sides):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))
    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return arrow_map(both.select("a", "b", "ta", "tb"), _confirm(percent), "a long, b long")


def _across(placed: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs (a < b) of rows (key, rep, comp, n, most) under one key, of different components, where the sizes
    and ``most`` (elements that can still be common) allow a link."""
    x = placed.select(key, *(F.col(c).alias(n) for c, n in (("rep", "a"), ("comp", "ca"), ("n", "na"), ("most", "ma"))))
    y = placed.select(key, *(F.col(c).alias(n) for c, n in (("rep", "b"), ("comp", "cb"), ("n", "nb"), ("most", "mb"))))
    # similar enough: intersection >= percent / (100 + percent) * (na + nb)
    fits = (100 + percent) * F.least("ma", "mb") >= percent * (F.col("na") + F.col("nb"))
    return (x.join(y, key).where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & fits).select("a", "b"))


def _each_set(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, distinct shingle hashes) of a batch (doc_id, text)."""
    for row, off, data in kernel.chunks(batch.column(1)):
        sets = kernel.distinct_sets(*kernel.shingle_hashes(*kernel.word_hashes(off, data), SHINGLE))
        yield from zip(batch.column(0).slice(row, len(sets)).to_pylist(), sets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a partition's counters: in how many texts a shingle with that low hash stands."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for _, h in _each_set(batch):
            counts[np.unique(h & np.uint64(COUNTERS - 1)).astype(np.int64)] += 1
    for s in range(0, COUNTERS, SEGMENT):
        if counts[s:s + SEGMENT].any():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([s // SEGMENT], pa.int64()),
                                              "counts": [counts[s:s + SEGMENT].tobytes()]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for seg, c in zip(*(x.to_pylist() for x in batch.columns)):
            c = np.frombuffer(c, np.int64)
            held[seg] = held[seg] + c if seg in held else c
    for seg, c in held.items():
        yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int64()), "counts": [c.tobytes()]})


def _prefixes(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            reps, keys, most = [], [], []
            for rep, h in _each_set(batch):
                n, f = len(h), counts[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.lexsort((h, f))[:n - -(-n * percent // 100) + 1]
                at = np.flatnonzero(f[first] > 1)                # a count of one: no other text has it
                reps.append(np.full(len(at), rep, np.int64))
                keys.append(h[first[at]].view(np.int64))
                most.append(n - at)
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (reps, keys, most)],
                                                 names=["rep", "key", "most"])
    return run


def _rare_prefixes(crowded: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Rows (key, rep, comp, n, most) that pair the members of crowded buckets without loss by their rarest shingles.

    With all sets in one order, two sets that are similar enough share an element
    among the first ``n - ceil(n * percent / 100) + 1`` of each.  The order is by
    frequency among these members, so what many of them share (a passage, say)
    comes last and brings no two of them together.  At their first common element
    two sets have in common at most what each has from there on (``most``).
    Frequencies come from COUNTERS shared counters: any one order is exact, and
    counters that several shingles share only make it less sharp.
    """
    who = stored(crowded.select("rep", "comp", "n").distinct(), "crowd")
    mine = stored(texts.join(who.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "crowd-texts")
    sums = arrow_map(arrow_map(mine, _count, "seg long, counts binary").repartition(COUNTERS // SEGMENT, "seg"),
                     _add, "seg long, counts binary")
    counts = np.zeros(COUNTERS, np.int64)
    for r in sums.toLocalIterator():                             # 8 * COUNTERS bytes in all
        counts[r.seg * SEGMENT:][:SEGMENT] = np.frombuffer(r.counts, np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    return arrow_map(mine, _prefixes(shared, percent), "rep long, key long, most long").join(who, "rep") \
        .select("key", "rep", "comp", "n", "most")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    A document is its doc_id: rows that repeat a doc_id are one document, which
    is linked with whatever any of its rows is linked with.  Texts without
    words (null, empty, only white space) have an empty set and link with
    nothing.  Rows with null doc_id link with nothing either; their
    component_id is null and they are kept.  Other columns are not read.
    """
    signed = stored(signatures(docs), "signatures")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"))
    member = stored(named.select("doc_id", "c1", "c2").join(classes, ["c1", "c2"])
                    .select("doc_id", "rep", "c1", "c2").distinct(), "members")
    # Representatives' signatures, and repeated doc_ids as links between classes.
    reps = stored(named.join(member.where("doc_id = rep").select("doc_id", "c1", "c2"), ["doc_id", "c1", "c2"])
                  .dropDuplicates(["doc_id", "c1", "c2"])
                  .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig", "bands"), "reps")
    several = (member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
               .select("doc_id", "a").join(member.select("doc_id", F.col("rep").alias("b")), "doc_id")
               .where("a < b").select("a", "b"))

    banded = reps.select("rep", F.explode(F.array_distinct("bands")).alias("key"))
    # A bucket's leader is its most central member: the one with the most neighbours over all its
    # buckets (the text that the others were copied from meets them in nearly every band).
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    crowded = stored(banded.join(shared, "key"), "buckets")
    central = crowded.groupBy("rep").agg(F.sum("size").alias("score"))
    ranked = crowded.select("key", "rep").join(central, "rep")
    leads = (ranked.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("rep"))).alias("m"))
             .select("key", (-F.col("m.rep")).alias("lead")))
    bucketed = crowded.select("key", "rep")
    sigs, least = reps.select("rep", "sig"), least_estimate(percent)

    def estimated(pairs: DataFrame) -> DataFrame:
        a = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
        b = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
        return (pairs.join(a, "a").join(b, "b")
                .select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("est")).where(F.col("est") >= least))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    led = stored(estimated(bucketed.join(leads, "key").where("lead <> rep")
                           .select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()), "led")
    best = (led.groupBy("b").agg(F.max_by(F.struct("a"), F.struct("est", -F.col("a"))).alias("p"))
            .select(F.col("p.a").alias("a"), "b"))
    links = stored(_confirmed(best, texts, percent).union(several).distinct(), "links")
    comp = components(links, "a", "b")

    # The other leaders that a member met, where the first links left them apart.
    def apart(pairs: DataFrame) -> DataFrame:
        ca, cb = (comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        return (pairs.join(ca, "a", "left").join(cb, "b", "left")
                .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))

    rest = apart(led.select("a", "b").exceptAll(best))
    links = stored(links.union(_confirmed(rest, texts, percent)).distinct(), "links")
    comp = components(links, "a", "b")

    # Buckets that still hold several components: pairs across them, never inside one.
    sized = reps.select("rep", "n")
    placed = (bucketed.join(comp, bucketed.rep == comp.node, "left")
              .select("key", "rep", F.coalesce("comp", "rep").alias("comp")).join(sized, "rep"))
    open_keys = (placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"))
                 .where("x < y").select("key", "size"))
    placed = stored(placed.join(open_keys, "key"), "open")
    few = _across(placed.where(F.col("size") <= CROWD).withColumn("most", F.col("n")), "key", percent)
    many = _across(_rare_prefixes(placed.where(F.col("size") > CROWD), texts, percent), "key", percent)
    pairs = stored(few.union(many).distinct(), "pairs")
    last = _confirmed(estimated(pairs).select("a", "b"), texts, percent)
    comp = components(links.union(last), "a", "b")

    label = (member.join(comp, member.rep == comp.node, "left")
             .groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("component_id")))
    return (signed.select("doc_id", "n_shingles").join(label, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of documents that are not the smallest id of their group.

    Rows without a doc_id and texts without words stay; repeated rows of a kept
    document stay; an empty table stays empty; other columns, whatever their names,
    come along.
    """
    gone = free_name(docs, "_gone")
    dropped = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
           ELSE array_to_string(ws[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ws) AS rep FROM w WHERE len(ws) > 0),
rsh AS (SELECT sh.* FROM sh JOIN cls USING (doc_id) WHERE doc_id = rep),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM rsh x JOIN rsh y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))
  UNION SELECT rep, doc_id FROM cls WHERE rep < doc_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(node, seen) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT r.node, e.b FROM r JOIN both_ways e ON e.a = r.seen)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, reach.component_id, d.doc_id = reach.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = d.doc_id
"""
