"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the ``k`` smallest different hashes of a text's shingles (five
words; a shorter text is one shingle), ascending.  A sketch of fewer than ``k``
hashes is the whole set.  Sketches of parts merge into the sketch of the union,
and two sketches estimate resemblance, containment and the number of different
shingles.  Everything is built-in functions.

Words are lower-cased runs of characters other than ASCII white space.  A
fingerprint is the sketch as text: 16 hex digits a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import free_name, sha_hex, stored, words
from wayline.operators.sequence import ordered_position

K = 128
WINDOW = 5
#: Copies of a row that one task writes out.
RUN = 1024


def sketch(text: Column, k: int = K) -> Column:
    """Sketch of a text, an ascending array of 64-bit hashes; empty for null, empty and blank texts."""
    def shingles(h: Column) -> Column:
        n = F.size(h)
        five = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        return F.when(n >= WINDOW, five).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    # An array of one binds the hashes to a name; a column used at each place would be computed at each place.
    all_of = F.get(F.transform(F.array(hashed), shingles), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(all_of)), 1, k)


def to_text(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def from_text(fingerprint: Column) -> Column:
    """The sketch of a fingerprint."""
    def read(i: Column) -> Column:
        low = F.conv(F.substring(fingerprint, i * 16 + 9, F.lit(8)), 16, 10).cast("bigint")
        high = F.conv(F.substring(fingerprint, i * 16 + 1, F.lit(8)), 16, 10).cast("bigint")
        return F.shiftleft(high, 32).bitwiseOR(low)

    n = F.floor(F.length(fingerprint) / 16).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), read)).otherwise(F.array().cast("array<bigint>"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common hashes among the ``k`` smallest of both (all of them if both sketches are whole sets): an
    estimate of the Jaccard similarity.  Two empty sketches are alike (1.0)."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    both = F.array_intersect(a, b)

    def share(union: Column) -> Column:
        last = F.element_at(union, F.when(whole, F.size(union)).otherwise(F.least(F.lit(k), F.size(union))))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
            F.size(F.filter(both, lambda h: h <= last)) / F.when(whole, F.size(union)).otherwise(
                F.least(F.lit(k), F.size(union))))

    return F.get(F.transform(F.array(F.sort_array(F.array_union(a, b))), share), F.lit(0))


def distinct_count(sk: Column, k: int = K) -> Column:
    """Number of different shingles: exact below ``k``, else from the ``k``-th smallest hash."""
    share = (F.element_at(sk, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(sk) < k, F.size(sk).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has (1.0 for an empty ``a``)."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def merge(parts: DataFrame, keys: list[str], sk: str, k: int = K) -> DataFrame:
    """``keys`` and ``sk``: the sketch of the union of each group's sketches.

    Equal hashes meet first, spread by (group, hash); then every task keeps a group's ``k`` smallest before the groups
    meet, so a group of any size sends at most ``k`` rows a task.
    """
    h = free_name(parts.select(*keys), "_h")
    at = free_name(parts.select(*keys), "_at")
    order = Window.partitionBy(*keys).orderBy(h)
    least = (parts.select(*keys, F.explode(sk).alias(h)).distinct()
             .withColumn(at, F.row_number().over(order)).where(F.col(at) <= k))
    # Groups of empty sketches only have no hash at all; they come back from their keys.
    found = least.groupBy(*keys).agg(F.sort_array(F.collect_list(h)).alias(sk))
    empty = parts.groupBy(*keys).agg(F.max(F.size(sk)).alias(h)).where(F.col(h) == 0).select(
        *keys, F.array().cast("array<bigint>").alias(sk))
    return found.unionByName(empty)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, text, k1, k2: a 128-bit name of (key, text) that is never null."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    parts = [F.col(key).isNull(), F.col(key), body]
    return docs.select(F.col(key).alias("doc"), body.alias("text"), F.xxhash64(*parts).alias("k1"),
                       F.xxhash64(F.lit(7919), *parts).alias("k2"))


def _links(keyed: DataFrame) -> tuple[DataFrame, int]:
    """Per different (key, text): key, copies, and the name of the one that reads it as its next with the characters it needs.

    The next of a document is the next in descending (key, name) order, the first for the last.  Only names and
    lengths are ordered; positions come from range partitions.  Also returns the largest number of copies.
    """
    rows = keyed.select("doc", "k1", "k2", F.length("text").alias("n")).groupBy("doc", "k1", "k2").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    placed = stored(ordered_position(rows, [], ["doc", "k1", "k2"]), "bottomk-order")
    last, most = placed.agg(F.coalesce(F.max("pos"), F.lit(1)), F.coalesce(F.max("copies"), F.lit(0))).first()
    reader = placed.select(F.col("pos").alias("reader"), F.col("k1").alias("to1"), F.col("k2").alias("to2"),
                           F.floor(F.col("n") / 3).cast("int").alias("need"))
    return placed.join(reader.hint("merge"), F.col("pos") % last + 1 == F.col("reader")).select(
        "k1", "k2", "doc", "copies", "to1", "to2", "need"), most


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc, text, edited, sk, next_sk, one row per row of ``docs``.

    ``edited`` is the text with its last floor(n/3) code points replaced by the first as many (or all) of the next
    document.  A text travels once, to the task of its name; from there it sends its sketch and the part that
    its reader needs.  Of equal rows (key and text) one is read and the others are its copies: the next of a copy
    is a copy, of the last one the next document.  Null texts are empty; null keys come last; an empty table gives
    no rows; other columns are not read.
    """
    keyed = _keyed(docs, key, text)
    links, most = _links(keyed)
    # Both readers of this table use the same columns, so its shuffle is planned once.
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    held = texts.join(links.hint("merge"), ["k1", "k2"])
    sent = held.select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.expr("left(text, need)").alias("part"),
                       sketch(F.col("text"), k).alias("next_sk"))
    met = held.select("k1", "k2", "doc", "text", "copies").join(sent.hint("merge"), ["k1", "k2"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    met = met.withColumn("sk", sketch(F.col("text"), k)).withColumn("kept", F.left("text", n - third))
    own = F.struct(F.left("text", third).alias("part"), F.col("sk").alias("next_sk"), (F.col("copies") - 1).alias("times"))
    following = F.struct("part", "next_sk", F.lit(1).cast("long").alias("times"))
    versions = F.when(F.col("copies") > 1, F.array(own, following)).otherwise(F.array(following))

    def written(rows: DataFrame, dealt: bool) -> DataFrame:
        """A row per copy; ``dealt``: in runs that go to different tasks."""
        out = rows.select("doc", "text", "sk", "kept", F.explode(versions).alias("v"))
        out = out.select("doc", "text", "sk", F.concat("kept", "v.part").alias("edited"), "v.next_sk",
                         F.explode(F.expr(f"sequence(v.times, 1L, -{RUN}L)")).alias("left"))
        out = out.repartition("doc", "left") if dealt else out
        return out.select("doc", "text", "sk", "edited", "next_sk", F.explode(
            F.expr(f"sequence(1L, least({RUN}L, left))")).alias("copy")).drop("copy")

    out = written(met.where(F.col("copies") <= RUN), False)
    return out.unionByName(written(met.where(F.col("copies") > RUN), True)) if most > RUN else out


def digests(edits: DataFrame, k: int = K) -> DataFrame:
    """The contract's columns, and the estimated number of different shingles."""
    df = edits.withColumn("edited_sk", sketch(F.col("edited"), k))
    return df.select(
        F.col("doc").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), sha_hex(F.col("edited")).alias("edited_sha256"),
        to_text(F.col("sk")).alias("fingerprint"), to_text(F.col("edited_sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
        distinct_count(F.col("sk"), k).alias("distinct_shingles"))
