"""Secret scans: fixed patterns, and tokens that look random under character Markov models.

Patterns (kinds ``assign``, ``access``, ``hex``) give base spans.  The method adds
spans of kind ``markov``: maximal runs of ``TOKEN_CLASS`` with at least ``MIN_TOKEN``
characters, which hold a digit and a letter and no base span overlaps, whose
log-likelihood under a model of random strings exceeds that under a model of
ordinary identifiers by ``MIN_GAIN`` a character pair or more.

Both models are first-order chains over characters, smoothed by their character counts,
trained from samples that the corpus itself labels: values of base spans
(random) and words of the same kind of characters in documents without any base
span (ordinary).  The random strings come from all documents, the ordinary ones from
about ``SAMPLE_DOCS`` documents (a hash range); at most ``SAMPLE`` distinct strings of
each train, in hash order.
Log-ratios are rounded to millionths and added as integers, so a score does not
depend on the order of addition.

DataFrame functions only.  Positions are code points; ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import free_name, hash_share, stored

# Fixed patterns.  Letters of the first stand in either case; spelled out, since
# case-insensitive matching differs between engines beyond ASCII.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_CASED = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
ASSIGN = f"({_CASED})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"       # runs of 18 or more: maximal runs, so the count may stand in the pattern
HEX = "[0-9a-f]{16,}"
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "markov")

TOKEN_CLASS = "[A-Za-z0-9+/_=-]"
MIN_TOKEN = 16
MIN_GAIN = 0.35                    # nats a character pair
PRIOR = 5.0                        # pseudo-counts of a chain's character distribution behind each context
MIN_SAMPLE = 50                    # fewer random samples than this: no model, no added spans
SAMPLE_DOCS, SAMPLE = 40_000, 20_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "struct<start:int,kind:int,end:int,hit:string>"
BLOCK = 128                        # spans of a text that are put into one array at a time


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Array of (start, kind, end, hit) of a pattern's leftmost matches that ``keep`` accepts.

    Starts come from the lengths of the pieces between the matches.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["b"])
        end = start + F.length(pair["h"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), pair["h"].alias("hit"))
        return F.struct(end.alias("at"), F.when(keep(pair["h"]), F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    def moved(at: Column, span: Column) -> Column:
        return F.struct((span["start"] + at).alias("start"), span["kind"].alias("kind"), (span["end"] + at).alias("end"),
                        span["hit"].alias("hit"))

    pairs = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda b, h: F.struct(b.alias("b"), h.alias("h")))
    return _in_blocks(pairs, SPAN, step, lambda before, at: before + at, moved)


def _in_blocks(items: Column, kind: str, step, joined, moved) -> Column:
    """Running results over an array, in time linear in its length.

    ``step`` folds an item into struct(at, out: array of ``kind``).  Growing one array copies it at every item, so blocks of
    ``BLOCK`` items are folded apart, each from at = 0; ``joined(before, at)`` carries ``at`` over the blocks, and
    ``moved(before, x)`` corrects the results of a block by what stood before it.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    none = F.array().cast(f"array<struct<at:int,out:array<{kind}>>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("parts"))

    def blocks(a: Column) -> Column:
        n = F.floor((F.size(a) - 1) / BLOCK).cast("int")
        return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), n), lambda b: F.aggregate(
            F.slice(a, b * BLOCK + 1, BLOCK), zero, step))).otherwise(none)

    def put(acc: Column, b: Column) -> Column:
        part = F.struct(acc["at"].alias("at"), b["out"].alias("out"))
        return F.struct(joined(acc["at"], b["at"]).alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    def whole(acc: Column) -> Column:
        return F.flatten(F.transform(acc["parts"], lambda p: F.transform(p["out"], lambda x: moved(p["at"], x))))

    # An array of one binds the items to a name, so that they are computed once.
    return F.get(F.transform(F.array(items), lambda a: F.aggregate(blocks(a), start, put, whole)), F.lit(0))


def base_spans(text: Column) -> Column:
    """All base spans of a non-null text, by start, then kind."""
    def value_long(hit: Column) -> Column:
        return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_ASSIGN

    def any_hit(hit: Column) -> Column:
        return F.lit(True)

    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", value_long), _spans(text, ACCESS, "access", any_hit),
                                 _spans(text, HEX, "hex", any_hit)))


def _candidates(text: Column, base: Column) -> Column:
    """Token runs that a base span does not touch, with a digit and a letter."""
    def mixed(hit: Column) -> Column:
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")

    found = _spans(text, f"{TOKEN_CLASS}{{{MIN_TOKEN},}}", "markov", mixed)
    base_kind = KINDS.index("markov")

    def ahead(a: Column) -> Column:
        """Spans by start, each with whether the next is a base span that begins inside it (candidates do not overlap)."""
        def one(x: Column, i: Column) -> Column:
            after = F.get(a, i + 1)
            return F.struct(x.alias("x"), F.coalesce((after["kind"] < base_kind) & (after["start"] < x["end"]), F.lit(False)).alias("cut"))
        return F.transform(a, one)

    def step(acc: Column, e: Column) -> Column:
        x = e["x"]
        seen = F.struct(x.alias("x"), e["cut"].alias("cut"), acc["at"].alias("upto"))
        return F.struct(F.when(x["kind"] < base_kind, F.greatest(acc["at"], x["end"])).otherwise(acc["at"]).alias("at"),
                        F.when(x["kind"] == base_kind, F.concat(acc["out"], F.array(seen))).otherwise(acc["out"]).alias("out"))

    def moved(at: Column, e: Column) -> Column:
        return F.struct(e["x"].alias("x"), e["cut"].alias("cut"), F.greatest(at, e["upto"]).alias("upto"))

    spans = F.get(F.transform(F.array(F.array_sort(F.concat(base, found))), ahead), F.lit(0))
    swept = _in_blocks(spans, f"struct<x:{SPAN},cut:boolean,upto:int>", step, F.greatest, moved)
    return F.transform(F.filter(swept, lambda e: ~e["cut"] & (e["upto"] <= e["x"]["start"])), lambda e: e["x"])


def _labelled(text: Column) -> Column:
    """Values of all base spans of a non-null text, as ``base_spans`` finds them."""
    def every(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    return F.concat(F.filter(every(ASSIGN, 2), lambda v: F.length(v) >= MIN_ASSIGN), every(ACCESS, 0), every(HEX, 0))


def _sample(strings: DataFrame) -> DataFrame:
    """SAMPLE distinct strings with the smallest (unsigned) hashes."""
    distinct = stored(strings.distinct(), "strings")
    h = F.xxhash64("s")
    thin = distinct.where(hash_share(h, min(1.0, 4.0 * SAMPLE / max(1, distinct.count()))))   # the sort meets few rows
    return thin.orderBy(F.shiftrightunsigned(h, 1), "s").limit(SAMPLE)


def _pair_counts(sample: DataFrame) -> dict[tuple[str, str], int]:
    """Character-pair counts of a bounded sample: at most len(ALPHABET)^2 rows reach the driver."""
    place = F.sequence(F.lit(1), F.length("s") - 1)
    pairs = sample.where(F.length("s") > 1).select(F.explode(F.transform(place, lambda i: F.substring("s", i, F.lit(2)))).alias("p"))
    return {(r.p[0], r.p[1]): r.n for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()
            if r.p[0] in ALPHABET and r.p[1] in ALPHABET}


def _chain(counts: dict) -> dict[tuple[str, str], float]:
    """P(b | a): pair counts backed by PRIOR pseudo-counts spread as the characters (add-one smoothed) are."""
    k, total = len(ALPHABET), sum(counts.values())
    after = {b: (sum(counts.get((a, b), 0) for a in ALPHABET) + 1) / (total + k) for b in ALPHABET}
    out = {}
    for a in ALPHABET:
        n = sum(counts.get((a, b), 0) for b in ALPHABET)
        out |= {(a, b): (counts.get((a, b), 0) + PRIOR * after[b]) / (n + PRIOR) for b in ALPHABET}
    return out


def log_ratios(random: dict, ordinary: dict) -> list[int]:
    """Millionths of log(P(b | a; random) / P(b | a; ordinary)) at a * len(ALPHABET) + b."""
    r, o = _chain(random), _chain(ordinary)
    return [round(1e6 * math.log(r[a, b] / o[a, b])) for a in ALPHABET for b in ALPHABET]


def train(texts: DataFrame, sampled: DataFrame) -> list[int] | None:
    """Log-ratios from all ``texts`` (text) and the ``sampled`` rows (text, base) of ordinary words.

    None when the whole corpus labels too few random strings.
    """
    counts = _pair_counts(_sample(texts.select(F.explode(_labelled(F.col("text"))).alias("s"))))
    if sum(counts.values()) < MIN_SAMPLE * MIN_TOKEN:
        return None
    # Words of documents without any base span, cut to the alphabet's runs: no base span can touch them.
    clean = sampled.where(F.size("base") == 0).select(F.explode(
        F.regexp_extract_all("text", F.lit(f"{TOKEN_CLASS}{{6,}}"), F.lit(0))).alias("s"))
    ordinary = _sample(clean.where(~F.col("s").rlike("[0-9]")))
    return log_ratios(counts, _pair_counts(ordinary))


def _gain(hit: Column, ratios: Column) -> Column:
    """Sum of the log-ratios of a string's character pairs."""
    k = len(ALPHABET)
    codes = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, code: Column) -> Column:
        add = F.when(acc["last"] >= 0, F.get(ratios, acc["last"] * k + code)).otherwise(F.lit(0))
        return F.struct(code.alias("last"), (acc["sum"] + add).alias("sum"))

    return F.aggregate(F.filter(codes, lambda c: c >= 0), start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``spans``: array of (start, kind, end, hit), by start then kind (name free of clashes).

    Null and empty texts have no spans.  Repeated rows give the same spans.
    Base spans always stay; a corpus with too few labelled random strings
    (see MIN_SAMPLE) gets base spans only.
    """
    text, base, spans = free_name(docs, "_text"), free_name(docs, "_base"), free_name(docs, "spans")
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    whole = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    slim = docs.where(hash_share(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), share)).select(whole)
    ratios = train(docs.select(whole), slim.withColumn("base", base_spans(F.col("text"))))
    df = (docs.withColumn(text, F.coalesce(docs["text"].cast("string"), F.lit("")))
          .withColumn(base, base_spans(F.col(text))))
    if ratios is None:
        return df.select(*docs.columns, F.col(base).alias(spans))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<long>")
    odd = F.filter(_candidates(F.col(text), F.col(base)), lambda c: _gain(c["hit"], table)
                   >= F.lit(round(MIN_GAIN * 1e6)) * (F.length(c["hit"]) - 1))
    return df.select(*docs.columns, F.array_sort(F.concat(F.col(base), odd)).alias(spans))


def listing(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and the list of all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("markov"))
    return scanned.select("doc_id", *(count(k) for k in KINDS[:-1]),
                          F.sha2(F.encode(listing(base), "UTF-8"), 256).alias("base_sha256"),
                          listing(F.col("spans")).alias("spans"), count(KINDS[-1]))
