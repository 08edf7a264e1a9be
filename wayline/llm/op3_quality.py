"""Quality rules: line frequency across the documents of a host, then depleted documents.

Every line's normalised key (white space stripped, lower case) is hashed to
128 bits.  A line is boilerplate of a host when at least ``MIN_DOCS`` distinct
documents of the host hold it and they are at least ``MIN_SHARE_PERCENT`` of
the host's distinct documents; exact copies of a text are one document.
Boilerplate lines are removed, and a document that thereby loses more than
``MAX_LOST_PERCENT`` of its words is rejected.  A share, not a count, decides, so
more data of the same kind gives the same verdicts.

DataFrame functions only.  The lists of a host's boilerplate hashes are short:
every document holds, on average, at most its mean number of distinct lines, so
at most ``mean / share`` lines can reach the share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import WORD, free_name, hash128, stored, strip_ws, words

MIN_DOCS = 10
MIN_SHARE_PERCENT = 10
MAX_LOST_PERCENT = 50
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"


def _key(line: Column) -> Column:
    h1, h2 = hash128(F.lower(strip_ws(line)))
    return F.struct(h1.alias("h1"), h2.alias("h2"))


def _with_word(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(HAS_WORD))


def boilerplate(docs: DataFrame, host: str) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines; hosts without any are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = hash128(text)
    keys = F.array_distinct(F.transform(_with_word(F.split(text, "\n")), _key))
    contents = docs.select(F.col(host).cast("string").alias("host"), t1.alias("t1"), t2.alias("t2"), keys.alias("keys"))
    totals = contents.groupBy("host", "t1", "t2").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("all_docs"))
    held = (contents.select("host", "t1", "t2", F.explode("keys").alias("k")).select("host", "t1", "t2", "k.h1", "k.h2")
            .distinct().groupBy("host", "h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS))
    common = held.join(totals.withColumnRenamed("host", "total_host"), F.col("host").eqNullSafe(F.col("total_host")))
    return (common.where(F.col("docs") * 100 >= F.col("all_docs") * MIN_SHARE_PERCENT)
            .groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("lines")))


def _repeated_words(hashes: str, ordered: str) -> Column:
    """Words covered by windows whose hash stands at two or more places (``ordered``: hashes with places, sorted)."""
    st = F.col(ordered)
    twice = F.filter(st, lambda e, j: (F.get(st, j - 1)["h"] == e["h"]) | (F.get(st, j + 1)["h"] == e["h"]))
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(places, zero, lambda a, p: F.struct(
        (p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    return F.when(st.isNull(), F.lit(0)).otherwise(covered)


def assess(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
    base_failed, kept and clean_text (names get trailing underscores where they clash).

    Null text has no words, so it fails the base rules; so do empty texts.  A
    null host is a host of its own.  Repeated rows are assessed alike, and
    their common text counts once in line frequencies.  An empty table gives
    no rows.  clean_text is the text without boilerplate lines (null for null).
    """
    flagged = stored(boilerplate(docs, host), "boilerplate")
    own = {c: free_name(docs, c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept",
        "clean_text")}
    tmp = {c: free_name(docs, f"_{c}") for c in ("t", "ws", "h", "st", "lines", "bad", "left", "bh")}
    col = {k: F.col(v) for k, v in (own | tmp).items()}
    place = F.sequence(F.lit(0), F.size(col["ws"]) - WINDOW)
    n = F.size(col["ws"]).cast("long")
    bad = flagged.select(F.col("host").alias(tmp["bh"]), F.col("lines").alias(tmp["bad"]))
    # The word rule needs the words only here; each step below names its input once.
    df = (docs.withColumn(tmp["t"], F.coalesce(docs["text"].cast("string"), F.lit("")))
          .withColumn(tmp["ws"], words(col["t"]))
          .withColumn(tmp["h"], F.when(F.size(col["ws"]) >= WINDOW, F.transform(
              place, lambda i: F.xxhash64(F.slice(col["ws"], i + 1, WINDOW)))))
          .withColumn(tmp["st"], F.when(F.size(F.array_distinct(col["h"])) < F.size(col["h"]), F.array_sort(
              F.transform(col["h"], lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
          .withColumn(own["n_words"], n)
          .withColumn(own["word_chars"], F.length(F.array_join(col["ws"], "")).cast("long"))
          .withColumn(own["n_repeat_words"], _repeated_words(tmp["h"], tmp["st"]).cast("long"))
          .drop(tmp["ws"], tmp["h"], tmp["st"])
          .withColumn(tmp["lines"], F.split(col["t"], "\n")))
    df = df.join(bad, F.col(host).cast("string").eqNullSafe(col["bh"]), "left")
    left = F.when(col["bad"].isNull(), col["lines"]).otherwise(F.filter(
        col["lines"], lambda x: ~x.rlike(HAS_WORD) | ~F.array_contains(col["bad"], _key(x))))
    whole = _with_word(col["lines"])
    failed = (col["n_words"] < MIN_WORDS) | (100 * col["n_repeat_words"] > MAX_REPEATED_PERCENT * col["n_words"])
    df = (df.withColumn(tmp["left"], left)
          .withColumn(own["n_symbols"], F.regexp_count(col["t"], F.lit(SYMBOLS)).cast("long"))
          .withColumn(own["n_dup_lines"], (F.size(whole) - F.size(F.array_distinct(whole))).cast("long"))
          .withColumn(own["clean_text"], F.when(docs["text"].isNotNull(), F.array_join(col["left"], "\n")))
          .withColumn(own["n_lost_words"], F.when(F.size(col["left"]) == F.size(col["lines"]), F.lit(0).cast("long"))
                      .otherwise(col["n_words"] - F.regexp_count(F.array_join(col["left"], "\n"), F.lit(WORD))))
          .withColumn(own["base_failed"], failed)
          .withColumn(own["kept"], ~col["base_failed"]
                      & (100 * col["n_lost_words"] <= MAX_LOST_PERCENT * col["n_words"])))
    return df.select(*docs.columns, *own.values())


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The kept documents with boilerplate lines taken out; columns of ``docs`` (n_chars follows the text)."""
    df = assess(docs, host)
    kept, clean = df.columns[-2], df.columns[-1]
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(F.col(clean).alias(c))
        elif c.lower() == "n_chars":
            out.append(F.length(clean).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    # inline() of one row or none: a plain filter would be pushed below the columns that it is
    # computed from, and every one of them would be computed anew within it.
    return df.select(F.inline(F.when(F.col(kept), F.array(F.struct(*out)))))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
g2 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g2, range(5) r(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, x, lower(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))) AS k
      FROM (SELECT doc_id, source, t, unnest(ls) AS x FROM w)),
tot AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
bad AS (SELECT l.source, l.k FROM l JOIN tot ON l.source IS NOT DISTINCT FROM tot.source WHERE k <> ''
        GROUP BY l.source, l.k, tot.n HAVING count(DISTINCT l.t) >= 10 AND 100 * count(DISTINCT l.t) >= 10 * tot.n),
lines AS (SELECT doc_id, count(*) FILTER (WHERE k <> '') - count(DISTINCT x) FILTER (WHERE k <> '') AS dup,
            coalesce(sum(len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))
                     FILTER (WHERE EXISTS (SELECT 1 FROM bad WHERE bad.k = l.k
                                           AND bad.source IS NOT DISTINCT FROM l.source)), 0) AS lost
          FROM l GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(translate(t, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        lines.dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, lines.lost::BIGINT AS n_lost_words
      FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM b
"""
