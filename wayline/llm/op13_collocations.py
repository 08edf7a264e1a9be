"""Phrase collocations by stripes.

A stripe is the counter of the words that follow one prefix of 0 to 4 words in
a language; the empty prefix counts the words themselves.  Tasks count the
stripes of bounded blocks of text, the shuffle moves a stripe as one row, and
stripes of a prefix are merged element by element.  The merged counters give
everything: an entry is the count of an extension (prefix + next word), the
totals of the two sides of a cut are entries of shorter prefixes, and the
largest entries of a phrase and of its left neighbours tell whether a longer
phrase subsumes it.

* A phrase can be frequent only if its parts are.  Before stripes are sent, 48-bit hashes of the phrases are counted
  (6 bytes each, in segments whose number follows the corpus) and those that may reach the threshold go into a
  Bloom filter; pairs are hashed where both words are frequent, longer phrases where every pair may be.  Hash
  collisions and filter errors only send more stripes, thresholds are applied to exact merged counts.  A filter
  holds 16 bits a key up to 32 MB; a corpus with more frequent phrases has few rare ones left to hold back.
* Stripes of prefixes that end in a very common word (at least one in ``COMMON`` words of its language), and of the
  empty prefix, are cut into ``SHARDS`` by the next word, so they are merged in several tasks; merging is
  Spark's hash aggregation, which spills.
* A phrase is inside a longer one of the same count only if it is inside one
  with one word more on either side: every phrase between the two has that count
  too.  So two maxima per phrase decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import arrow_map, ship, stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
UNKNOWN = "und"
SHARDS, COMMON = 8, 512
#: Bytes of text that a task counts at a time (one longer text is a block of its own).
BLOCK = 8 * 2**20
KEY_BITS, MAX_BITS = 16, 2**28

#: Entries of merged stripes that a task holds before it sends them.
HELD = 500_000
#: Hashed phrases, by words of the corpus, that a segment should hold.
SEGMENT = 2**21

STRIPE = "lang string, prefix string, shard int, words string, counts array<int>"

#: One pass over bytes: A-Z lower-cased, white space between words a blank, ends of pieces a full stop.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
_PIECE, _TEXT = b".", b","
#: Keys are the upper 48 bits of a phrase's hash.
_CUT = np.uint64(16)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hash(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a key in a filter of ``bits`` (a power of two)."""
    mask = np.uint64(bits - 1)
    return h & mask, h * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(29) & mask


def _holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter (64-bit words) may hold each key."""
    out = np.ones(len(h), bool)
    for p in _places(h, 64 * len(words)):
        out &= (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, texts) of blocks of about ``BLOCK`` bytes."""
    langs, texts, size = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            langs.append(lang)
            texts.append(text)
            size += len(text)
            if size >= BLOCK:
                yield langs, texts
                langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _number(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes (below ``bound``), ascending, and the number of each code among them."""
    if bound > 8 * len(codes) + 2**16:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(bound, bool)
    seen[codes] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]


class _Block:
    """Words of a block as numbers: ``word`` (-1 between pieces), ``key`` the number of (language, word)."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        text = b" , ".join(t.translate(_TABLE).replace(_PIECE, b" . ") for t in texts)
        tokens = pc.split_pattern(pa.array([text], pa.large_binary()), pattern=" ").values
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy()
        number = {w: i for i, w in enumerate(words)}
        if b"" in number:
            at = at[at != number[b""]]
        names = sorted(set(langs))
        place = {x: i for i, x in enumerate(names)}
        own = np.array([place[x] for x in langs], np.int64)[np.cumsum(at == number.get(_TEXT, -1))]
        gap = (at == number.get(_PIECE, -1)) | (at == number.get(_TEXT, -1))
        self.names, self.text = pa.array(names, pa.string()), coded.dictionary.cast(pa.string(), safe=False)
        self.word = np.where(gap, -1, at).astype(np.int64)
        keys, key = _number((own * len(words) + at)[~gap], len(names) * len(words))
        self.key = np.full(len(at), -1, np.int64)
        self.key[~gap] = key
        self.key_lang, self.key_word = np.divmod(keys, len(words))
        self.n_keys = len(keys)
        word_hash = _hash(words)
        self.shard = (word_hash % np.uint64(SHARDS)).astype(np.int32)
        lang_hash = _hash([x.encode() for x in names])
        self.hash = _mix(lang_hash[self.key_lang], word_hash[self.key_word])

    def phrases(self, longest: int, may) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, place, code, count, hash) of the phrases of 2 words and more that ``may(length, hashes)`` keeps.

        A phrase is looked at where its first and its last words but one were kept; its code is (number of
        the phrase without the last word, key of that word).
        """
        if not self.n_keys:
            return
        ok = may(1, self.hash)
        rank, hashes = np.where((self.key >= 0) & ok[self.key], self.key, -1), self.hash
        for length in range(2, longest + 1):
            here = np.zeros(len(rank), bool)
            here[:-1] = (rank[:-1] >= 0) & (rank[1:] >= 0)
            at = np.flatnonzero(here)
            codes, first, inverse, counts = np.unique(
                rank[at] * self.n_keys + self.key[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
            if not len(codes):
                return
            before, last = np.divmod(codes, self.n_keys)
            hashes = _mix(hashes[before], self.hash[last])
            ok = may(length, hashes)
            rank = np.full(len(rank), -1, np.int64)
            rank[at] = np.where(ok, np.arange(len(codes)), -1)[inverse]
            yield length, at[first][ok], codes[ok], counts[ok], hashes[ok]

    def stripes(self, length: int, place: np.ndarray, code: np.ndarray, count: np.ndarray, common=None) -> pa.RecordBatch:
        """Stripes of the phrases of ``length`` words at ``place``, from their codes (prefix, next).

        ``common`` marks the keys of very common words; without it every stripe is cut into shards.
        """
        prefix, key = np.divmod(code, self.n_keys)
        if length == 1:
            prefix = self.key_lang[key]
        word = self.key_word[key]
        shard = self.shard[word]
        if common is not None and length > 1:
            shard = np.where(common[self.key[place + length - 2]], shard, 0).astype(np.int32)
        order = np.lexsort((shard, prefix))
        prefix, shard, word = prefix[order], shard[order], word[order]
        start = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (shard[1:] != shard[:-1])][:len(prefix)])
        head = place[order][start]
        offsets = pa.array(np.r_[start, len(prefix)].astype(np.int32))
        parts = [self.text.take(pa.array(self.word[head + i])) for i in range(length - 1)]
        text = pc.binary_join_element_wise(*parts, " ") if parts else pa.array([""] * len(start), pa.string())
        return pa.RecordBatch.from_arrays(
            [self.names.take(pa.array(self.key_lang[self.key[head]])), text, pa.array(shard[start]),
             pa.ListArray.from_arrays(offsets, self.text.take(pa.array(word))),
             pa.ListArray.from_arrays(offsets, pa.array(count[order].astype(np.int32)))],
            ["lang", "prefix", "shard", "words", "counts"])


def _sent(b: pa.RecordBatch) -> pa.RecordBatch:
    """Stripes as they travel: the words of one joined by blanks."""
    return b.set_column(3, "words", pc.binary_join(b.column(3), " "))


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Stripes of several blocks, merged element by element."""
    entries = []
    for b in parts:
        own = pc.list_parent_indices(b.column(3))
        entries.append(pa.table({"lang": b.column(0).take(own), "prefix": b.column(1).take(own), "shard": b.column(2).take(own),
                                 "word": b.column(3).flatten(), "count": b.column(4).flatten()}))
    keys = ["lang", "prefix", "shard"]
    t = pa.concat_tables(entries).group_by([*keys, "word"], use_threads=False).aggregate([("count", "sum")])
    t = t.sort_by([(k, "ascending") for k in keys]).combine_chunks()
    col = {c: t.column(c).chunk(0) for c in t.column_names}
    new = np.zeros(len(t) - 1, bool)
    for k in keys:
        new |= pc.not_equal(col[k].slice(1), col[k].slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, new])
    offsets = pa.array(np.r_[start, len(t)].astype(np.int32))
    heads = [col[k].take(pa.array(start)) for k in keys]
    return pa.RecordBatch.from_arrays([*heads, pa.ListArray.from_arrays(offsets, col["word"]), pa.ListArray.from_arrays(
        offsets, col["count_sum"].cast(pa.int32()))], ["lang", "prefix", "shard", "words", "counts"])


def _words(batches):
    """Stripes of the empty prefix."""
    for block in _texts(batches):
        b = _Block(*block)
        place = np.flatnonzero(b.key >= 0)
        if len(place):
            first = np.zeros(b.n_keys, np.int64)
            first[b.key[place[::-1]]] = place[::-1]
            yield _sent(b.stripes(1, first, np.arange(b.n_keys), np.bincount(b.key[place])))


def _keep(filters: dict):
    """``may`` of ``_Block.phrases``: phrases of a length without a filter are kept."""
    return lambda length, h: _holds(filters[length].value, h >> _CUT) if length in filters else np.ones(len(h), bool)


def _longer(filters: dict, longest: int, common=None):
    """Stripes of prefixes of one word and more, of the phrases that may be frequent.

    Stripes of the blocks of a task are merged before they are sent; a task holds about ``HELD`` entries.
    """
    def run(batches):
        parts, size = [], 0
        for block in _texts(batches):
            b = _Block(*block)
            often = None if common is None else np.isin(b.hash >> _CUT, common.value)
            for length, place, codes, counts, _ in b.phrases(longest, _keep(filters)):
                if len(codes):
                    parts.append(b.stripes(length, place, codes, counts, often))
                    size += len(codes)
            del b
            if size >= HELD:
                parts = [_merged(parts)]
                size = len(parts[0].column(3).flatten())
                if 2 * size >= HELD:
                    yield _sent(parts[0])
                    parts, size = [], 0
        if parts:
            yield _sent(_merged(parts))
    return run


def _hashed(filters: dict, shortest: int, longest: int, segment_bits: int, least: int):
    """(segment, keys: 5 bytes each, counts) of the phrases of these lengths; counts stop at ``least``."""
    small = np.uint8 if least < 256 else np.uint32

    def run(batches):
        for block in _texts(batches):
            for length, _, _, counts, h in _Block(*block).phrases(longest, _keep(filters)):
                if length < shortest or not len(h):
                    continue
                key = h >> _CUT
                order = np.argsort(key)
                key, counts = key[order], np.minimum(counts[order], least).astype(small)
                segment = (key >> np.uint64(48 - segment_bits)).astype(np.int64)
                start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
                ends = np.r_[start[1:], len(key)]
                low = (key & np.uint64(2**40 - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment[start]), pa.array([low[i:j].tobytes() for i, j in zip(start, ends)], pa.binary()),
                     pa.array([counts[i:j].tobytes() for i, j in zip(start, ends)], pa.binary())], ["segment", "keys", "counts"])
    return run


def _frequent_keys(least: int, segment_bits: int):
    """Keys of a segment (at least 2^8 of them, so 40 bits and its number make a key) whose counts reach ``least``."""
    small = np.uint8 if least < 256 else np.uint32

    def run(group: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :5] = low
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), small)
        keys, number = np.unique(wide.view("<u8").ravel(), return_inverse=True)
        keys = keys[np.bincount(number, counts) >= least].astype(np.int64)
        top = group.column("segment")[0].as_py() << 48 - segment_bits
        return pa.table({"key": pa.array((keys & (1 << 48 - segment_bits) - 1) | top)})
    return run


def merge_stripes(stripes: DataFrame) -> DataFrame:
    """lang, prefix, word, f: the entries of the stripes, merged element by element where the rows of a prefix meet."""
    entries = stripes.repartition("lang", "prefix", "shard").select(
        "lang", "prefix", "shard", F.explode(F.arrays_zip(F.split("words", " ").alias("words"), "counts")).alias("e"))
    return (entries.groupBy("lang", "prefix", "shard", F.col("e.words").alias("word"))
            .agg(F.sum("e.counts").alias("f")).drop("shard"))


def _word_keys(batches):
    for b in batches:
        h = _mix(_hash([x.encode() for x in b.column(0).to_pylist()]), _hash([x.encode() for x in b.column(1).to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array((h >> _CUT).astype(np.int64))], ["key"])


def _key_places(bits: int):
    def run(batches):
        for b in batches:
            places = np.concatenate(_places(b.column(0).to_numpy().astype(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)),
                                              pa.array((places & np.uint64(63)).astype(np.int32))], ["word", "bit"])
    return run


def _filter_of(spark: SparkSession, keys: DataFrame):
    """Broadcast Bloom filter of the keys: 64-bit words, at most 32 MB."""
    bits = 2**12
    n = keys.count()
    while bits < min(n * KEY_BITS, MAX_BITS):
        bits *= 2
    rows = (arrow_map(keys, _key_places(bits), "word bigint, bit int")
            .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("v")).toPandas())
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["v"].to_numpy().astype(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(words)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                  max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, n: all word occurrences) and (lang, prefix, word, phrase, f) of phrases that occur ``min_count`` times."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        F.col(text).cast("string").alias("text")).where(F.length("text") > 0)

    def frequent(entries: DataFrame) -> DataFrame:
        phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
        return entries.where(F.col("f") >= min_count).select("lang", "prefix", "word", phrase.alias("phrase"), "f")

    words = stored(merge_stripes(arrow_map(given, _words, STRIPE)), "stripes-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = frequent(words)
    if max_words > 1:
        size = totals.agg(F.sum("n")).first()[0] or 0
        segment_bits = min(40, max(8, (size // SEGMENT).bit_length()))

        def candidates(filters: dict, shortest: int, longest: int):
            """Filter of the phrases of these lengths that may be frequent."""
            hashed = arrow_map(given, _hashed(filters, shortest, longest, segment_bits, min_count),
                               "segment bigint, keys binary, counts binary")
            keys = hashed.groupBy("segment").applyInArrow(_frequent_keys(min_count, segment_bits), "key bigint")
            return _filter_of(spark, stored(keys, "phrase-keys"))

        filters = {1: _filter_of(spark, arrow_map(counts.select("lang", "word"), _word_keys, "key bigint"))}
        filters[2] = candidates(filters, 2, 2)
        if max_words > 2:
            filters |= dict.fromkeys(range(3, max_words + 1), candidates(filters, 3, max_words))
        # At most COMMON words a language.
        often = counts.join(totals, "lang").where(F.col("f") * COMMON >= F.col("n")).select("lang", "word")
        keys = arrow_map(often, _word_keys, "key bigint").toPandas()["key"].to_numpy().astype(np.uint64)
        common = spark.sparkContext.broadcast(keys)
        longer = merge_stripes(arrow_map(given, _longer(filters, max_words, common), STRIPE))
        counts = counts.unionByName(stored(frequent(longer), "stripes-longer"))
    return totals, counts


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, a, l, r, n, score: every phrase of 2 to ``max_words`` words that occurs ``min_count`` times
    within pieces of its language and is not inside a longer one of the same count.

    ``score`` is floor(1000 a n / (l r)) at the lowest-scoring cut (the first of equal ones), in decimal
    arithmetic.  A null language counts as ``und``; null and empty texts have no words; repeated rows count as often as
    they stand; an empty table gives no rows.  Other columns are not read.
    """
    totals, counts = phrase_counts(docs, text, lang, min_count, max_words)
    longer = counts.where(F.col("prefix") != "")
    rest = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    maxima = (longer.select("lang", F.col("prefix").alias("phrase"), "f")
              .unionByName(longer.select("lang", rest.alias("phrase"), "f"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (longer.select("lang", "phrase", F.col("f").alias("a")).join(maxima, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer"))
    parts = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", parts.alias("p")).select(
        "lang", "phrase", "a", "p", F.explode(F.expr("sequence(1, size(p) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(p, 1, k), ' ')").alias("first"),
        F.expr("array_join(slice(p, k + 1, size(p)), ' ')").alias("rest"))
    sides = counts.select("lang", "phrase", "f")
    cuts = (cuts.join(sides.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(sides.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(totals, "lang"))
    wide = "decimal(38,0)"
    cuts = cuts.withColumn("score", F.expr(
        f"CAST(CAST(a AS {wide}) * n * 1000 div (CAST(l AS {wide}) * r) AS bigint)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    return best.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def report(scored: DataFrame, limit: int = TOP) -> DataFrame:
    """The first ``limit`` phrases of each language by score, count (both descending) and phrase."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), grams AS (SELECT lang, w[i:i + j - 1] AS p FROM spots, range(1, 6) t(j) WHERE i + j - 1 <= len(w)
), f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100
), n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), inside AS (
  SELECT DISTINCT lang, p[i:i + j - 1] AS p, f FROM f, range(1, 5) a(i), range(2, 5) b(j)
  WHERE i + j - 1 <= len(p) AND j < len(p)
), kept AS (
  SELECT f.lang, f.p, f.f FROM f WHERE len(p) > 1
    AND NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = f.lang AND x.p = f.p AND x.f >= f.f)
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, n.n,
    (1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM kept c JOIN range(1, 5) t(k) ON k < len(c.p)
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)]
  JOIN n ON n.lang = c.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS b FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM best WHERE b = 1
)
SELECT lang, rank, array_to_string(p, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked
WHERE rank <= 2000
"""
