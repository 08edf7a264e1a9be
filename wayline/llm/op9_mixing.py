"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power ``a`` (normalised): a = 1
keeps the natural shares, a = 0 makes them equal.  ``a`` is bisected to the
largest value that reaches a target entropy, or to the smallest that keeps
every source's repetition under a limit.  A budget of tokens times the weight
is a source's quota; without a budget it is the least one that shows every
source whole at least once.

A source's documents are dealt in a keyed pseudo-random order, a fresh one for
each pass: whole passes first, then the documents of one more order until the
rest of the quota is full.  Each copy gets an output block by its place in its
source's stream, so every block holds the mixture.

Nothing sorts a whole source: its order is cut into at most ``MAX_CUTS``
slices by hash, slice totals say which slice the quota ends in, and only that
slice's documents are summed one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import WORD, free_name, hash128

MAX_REPEAT = 2.0
BLOCK_TOKENS = 2**20
MAX_SOURCES = 100_000          # rows of source totals that the driver reads; more raise an error
SLICE_TOKENS, MAX_CUTS = 2**18, 4096
SEED = 20240611
_STEPS = 60


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised powers of the token shares (sources without tokens weigh nothing)."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()} if norm else raw


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def least_budget(tokens: dict, w: dict) -> float:
    """Tokens that show every source whole at least once under weights ``w``."""
    return max((n / w[s] for s, n in tokens.items() if n), default=0.0)


def most_repeated(tokens: dict, w: dict, budget: float | None) -> float:
    """Passes over the most repeated source."""
    b = least_budget(tokens, w) if budget is None else budget
    return max((w[s] * b / n for s, n in tokens.items() if n), default=0.0)


def find_exponent(tokens: dict, budget: float | None = None, max_repeat: float | None = MAX_REPEAT,
                  target_entropy: float | None = None) -> float:
    """Bisect the exponent in [0, 1].

    With ``target_entropy``: the largest exponent whose entropy reaches it (0 if
    none does).  Else the smallest exponent that keeps repetition within
    ``max_repeat`` (1 if none does).
    """
    if target_entropy is not None:
        def high(a):
            return entropy(weights(tokens, a)) < target_entropy
    else:
        def high(a):
            return most_repeated(tokens, weights(tokens, a), budget) <= max_repeat
    lo, hi = 0.0, 1.0           # high() turns from false to true as the exponent grows
    if high(lo):
        return lo
    if not high(hi):
        return hi
    for _ in range(_STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if high(mid) else (mid, hi)
    return lo if target_entropy is not None else hi


def plan(tokens: dict, budget: float | None = None, max_repeat: float | None = MAX_REPEAT,
         target_entropy: float | None = None) -> dict:
    """source -> (tokens, weight, quota, whole passes, tokens of the last pass)."""
    w = weights(tokens, find_exponent(tokens, budget, max_repeat, target_entropy))
    b = least_budget(tokens, w) if budget is None else budget
    out = {}
    for s, n in tokens.items():
        if not n:
            out[s] = (0, 0.0, 0, 1, 0)          # free rows: shown once
            continue
        quota = round(w[s] * b)
        out[s] = (n, w[s], quota, quota // n, quota % n)
    return out


def _fraction(row: Column, epoch: Column) -> Column:
    """Pseudo-random place in [0, 1) of a row in the order of one pass."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), epoch, row), 11) / F.lit(float(2**53))


def mix(docs: DataFrame, source: str = "source", budget: float | None = None,
        max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None,
        block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` once per shown copy, plus n_tokens, epoch, mix_block and mix_place (names free of clashes).

    Tokens are words.  A null source is a source of its own.  Rows of a source
    without any token (null or blank texts only) are shown once.  Identical
    rows are taken together or not at all.  An empty table gives no rows.
    mix_place orders the copies of a block.
    """
    spark = docs.sparkSession
    names = {c: free_name(docs, c) for c in ("n_tokens", "epoch", "mix_block", "mix_place")}
    tmp = {c: free_name(docs, f"_{c}") for c in ("src", "row", "slice", "f", "cut", "room", "whole", "passes", "fill")}
    tok, epoch = F.col(names["n_tokens"]), F.col(names["epoch"])
    text = docs["text"].cast("string")
    t1, t2 = hash128(F.coalesce(text, F.lit("")))
    df = (docs.withColumn(names["n_tokens"], F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long"))
          .withColumn(tmp["src"], docs[source].cast("string"))
          .withColumn(tmp["row"], F.xxhash64(F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)), t1, t2)))
    slim = df.select(F.col(tmp["src"]).alias("src"), F.col(tmp["row"]).alias("row"), tok.alias("tok"))
    sums = slim.groupBy("src").agg(F.sum("tok").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    chosen = plan({r.src: r.n for r in sums}, budget, max_repeat, target_entropy)
    blocks = max(1, math.ceil(sum(q for _, _, q, _, _ in chosen.values()) / block_tokens))
    schema = T.StructType([T.StructField("p_src", T.StringType()), T.StructField("whole", T.LongType()),
                           T.StructField("rest", T.LongType()), T.StructField("passes", T.DoubleType()),
                           T.StructField("cuts", T.LongType())])
    rows = [(s, whole, rest, max(quota / n, 1e-12) if n else 1.0, max(1, min(MAX_CUTS, n // SLICE_TOKENS)))
            for s, (n, _, quota, whole, rest) in chosen.items()]
    plans = spark.createDataFrame(rows, schema)

    # Where the last pass of each source ends: totals of the slices of its order.
    def placed(frame: DataFrame, src: str, row: str) -> DataFrame:
        met = frame.join(F.broadcast(plans), F.col(src).eqNullSafe(F.col("p_src")))   # <= MAX_SOURCES rows
        last = _fraction(F.col(row), F.col("whole"))
        return met.withColumn("last_f", last).withColumn("slice", F.floor(last * F.col("cuts")))

    totals = placed(slim, "src", "row").groupBy("src", "slice", "rest").agg(F.sum("tok").alias("n"))
    run = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = (totals.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") > F.col("rest"))
            .groupBy("src").agg(F.min(F.struct("slice", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")))
                                .alias("e"))
            .select(F.col("src").alias("e_src"), F.col("e.slice").alias("cut"), F.col("e.room").alias("room")))
    # Inside that slice: documents in order while they fit.
    inside = (placed(slim, "src", "row").join(F.broadcast(ends), F.col("src").eqNullSafe(F.col("e_src")))
              .where(F.col("slice") == F.col("cut")))
    order = Window.partitionBy("src").orderBy("last_f", "row").rangeBetween(Window.unboundedPreceding, 0)
    limit = (inside.withColumn("upto", F.sum("tok").over(order)).where(F.col("upto") <= F.col("room"))
             .groupBy("src").agg(F.max(F.struct("last_f", "row")).alias("m"))
             .select(F.col("src").alias("l_src"), F.col("m.last_f").alias("l_f"), F.col("m.row").alias("l_row")))
    bounds = (plans.join(F.broadcast(ends), F.col("p_src").eqNullSafe(F.col("e_src")), "left")
              .join(F.broadcast(limit), F.col("p_src").eqNullSafe(F.col("l_src")), "left")
              .select("p_src", "whole", "passes", "cuts", "cut", "l_f", "l_row"))

    met = df.join(F.broadcast(bounds.select(*(F.col(c).alias(free_name(docs, f"_b_{c}")) for c in bounds.columns))),
                  F.col(tmp["src"]).eqNullSafe(F.col(free_name(docs, "_b_p_src"))))
    b = {c: F.col(free_name(docs, f"_b_{c}")) for c in bounds.columns}
    row, f = F.col(tmp["row"]), F.col(tmp["f"])
    met = met.withColumn(tmp["f"], _fraction(row, b["whole"]))
    before = F.floor(f * b["cuts"]) < b["cut"]
    within = (F.floor(f * b["cuts"]) == b["cut"]) & ((f < b["l_f"]) | ((f == b["l_f"]) & (row <= b["l_row"])))
    extra = F.when(F.coalesce(before | within, F.lit(False)), 1).otherwise(0)
    copies = (b["whole"] + extra).cast("int")
    met = (met.withColumn(names["epoch"], F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))
                                                    .otherwise(F.array().cast("array<int>"))))
           .withColumn(names["mix_place"], (epoch + _fraction(row, epoch.cast("long"))) / b["passes"])
           .withColumn(names["mix_block"], F.least(F.floor(F.col(names["mix_place"]) * blocks), F.lit(blocks - 1))
                       .cast("long")))
    return met.select(*docs.columns, *names.values())
