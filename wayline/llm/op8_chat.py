"""Chat formatting with a prefix tree: shared turns are emitted once, depth first.

A node is a turn together with all turns before it (a 128-bit running hash),
so conversations that start alike share nodes.  A chain without branching is a
segment; a segment's name is the path of branch hashes that leads to it, so sorting
by (path, depth) is a depth-first walk.  The walk is cut into ranges; range totals
give every node its place (``start``, ``end``) in the emitted stream of code points.

Every node carries its formatted text, the loss mask span within it, the
position id of its first code point (its distance from the root along its own
conversation) and attention intervals: the stream ranges of its ancestor segments
and of its own segment up to itself.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``.  In texts and roles a
backslash becomes two, and backslash-i is put after the first character of any
control string, so the output parses back to exactly the input.  In roles a line
feed becomes backslash-n.  Only assistant texts are under the loss mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import arrow_map, hash128, stored

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of this and other public templates (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_META = set("\\[](){}<>|/.*+?^$")
_BREAK = "([<\\[])(?=" + "|".join("".join(f"\\{c}" if c in _META - set("<>/") else c for c in x[1:])
                                 for x in CONTROL) + ")"
MASKED_ROLE = "assistant"
RANGES = 64                    # least number of ranges of the walk


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, "$1\\\\i")


def unescape(text: Column) -> Column:
    # backslash-i goes, two backslashes become one: left to right, so by splitting at doubled ones
    parts = F.split(text, "\\\\\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\i"), F.lit(""))), "\\")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text (nulls empty), t1, t2 (running hash) and p1 (the parent's first half).

    Rows of a conversation stand by turn (nulls first), then role, then text, so ties
    have one order; repeated rows are repeated turns.  A null conv_id is one conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h1, h2 = hash128(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))
    # Only hashes are gathered per conversation; the running hash follows from them in order.
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("depth", F.row_number().over(order)).withColumn("h1", h1).withColumn("h2", h2)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running hashes over rows sorted by (conv_id, depth) within a partition."""
    import hashlib

    conv, state, parent = object(), b"", 0
    for batch in batches:
        t = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        c1, c2, p1 = [], [], []
        for i, (c, d, a, b) in enumerate(zip(t["conv_id"], t["depth"], t["h1"], t["h2"])):
            if d == 1 or c != conv:
                conv, state, parent = c, b"", 0
            state = hashlib.blake2b(state + a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True),
                                    digest_size=16).digest()
            p1.append(parent)
            parent = int.from_bytes(state[:8], "big", signed=True)
            c1.append(parent)
            c2.append(int.from_bytes(state[8:], "big", signed=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("depth"), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
             pa.array(p1, pa.int64())], names=["conv_id", "depth", "n1", "n2", "p1"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Branch path of each row of conversations sorted by (conv_id, depth): a hash is added where the parent branches."""
    conv, path = object(), ""
    for batch in batches:
        t = batch.to_pydict()
        out = []
        for c, d, a, b, branches in zip(t["conv_id"], t["depth"], t["n1"], t["n2"], t["branches"]):
            if d == 1 or c != conv:
                conv, path = c, ""
            if branches or d == 1:
                path += f"{a & (2**64 - 1):016x}{b & (2**64 - 1):016x}"
            out.append(path)
        yield pa.RecordBatch.from_arrays([batch.column("n1"), batch.column("n2"), pa.array(out, pa.string())],
                                         names=["n1", "n2", "path"])


def format_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of conversations (conv_id, turn, role, text).

    nodes: n1, n2, path, depth, formatted, masked (start, end; null if none), start, end, position, intervals.
    leaves: conv_id, n1, n2 of each conversation's last turn.
    """
    rows = stored(turns(conversations), "turns")
    near = ["conv_id", "depth"]
    hashed = rows.select("conv_id", "depth", "h1", "h2").repartition("conv_id").sortWithinPartitions(*near)
    chained = stored(arrow_map(hashed, _chain, "conv_id long, depth int, n1 long, n2 long, p1 long"), "chain")

    # Distinct turns and their parents; a parent with several children branches.
    node = (chained.groupBy("n1", "n2").agg(F.min(F.struct("conv_id", "depth", "p1")).alias("m"))
            .select("n1", "n2", F.col("m.conv_id").alias("conv_id"), F.col("m.depth").alias("depth"), F.col("m.p1").alias("p1")))
    node = stored(node, "node")
    forks = node.where("depth > 1").groupBy("p1", "depth").agg(F.count("*").alias("k")).where("k > 1") \
        .select(F.col("p1").alias("f1"), F.col("depth").alias("fd"))
    flagged = (chained.join(forks, (F.col("p1") == F.col("f1")) & (F.col("depth") == F.col("fd")), "left")
               .select("conv_id", "depth", "n1", "n2", F.col("f1").isNotNull().alias("branches"))
               .repartition("conv_id").sortWithinPartitions(*near))
    paths = arrow_map(flagged, _paths, "n1 long, n2 long, path string").distinct()
    body = rows.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "role", "text")
    full = (node.join(body, node.conv_id.eqNullSafe(body.c) & (node.depth == body.d)).drop("c", "d")
            .join(paths, ["n1", "n2"]))
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head, text = F.concat(F.lit(START), role, F.lit("\n")), escape(F.col("text"))
    made = (full.withColumn("formatted", F.concat(head, text, F.lit(END))).withColumn("len", F.length("formatted"))
            .withColumn("masked", F.when(F.col("role") == MASKED_ROLE, F.struct(
                F.length(head).alias("start"), (F.length(head) + F.length(text)).alias("end"))))
            .select("n1", "n2", "path", "depth", "formatted", "masked", F.col("len").cast("long").alias("len")))
    # Depth-first walk: ranges of (path, depth), totals per range, places within the range.
    ranges = max(RANGES, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    walk = stored(made.repartitionByRange(ranges, "path", "depth").withColumn("range", F.spark_partition_id()), "walk")
    totals = walk.groupBy("range").agg(F.sum("len").alias("total"))
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("range").orderBy("path", "depth")
    placed = stored(walk.join(F.broadcast(before), "range")          # one row a range
                    .withColumn("end", F.col("before") + F.sum("len").over(inside))
                    .withColumn("start", F.col("end") - F.col("len")).drop("before", "range"), "placed")
    # Segments, their ancestors by path prefix, and from these intervals and positions.
    segments = placed.groupBy("path").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min("depth").alias("top"))
    segments = stored(segments, "segments")
    levels = F.sequence(F.lit(1), (F.length("path") / 32).cast("int") - 1)
    up = (segments.where(F.length("path") > 32)
          .select("path", F.explode(levels).alias("level"))
          .withColumn("above", F.substring("path", F.lit(1), F.col("level") * 32)))
    above = (up.join(segments.select(F.col("path").alias("above"), "s", "e"), "above")
             .groupBy("path").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("above"),
                                  F.sum(F.col("e") - F.col("s")).alias("lead")))
    own = segments.select("path", F.col("s").alias("seg_start")).join(above, "path", "left")
    nodes = (placed.join(own, "path")
             .withColumn("position", F.coalesce("lead", F.lit(0)) + F.col("start") - F.col("seg_start"))
             .withColumn("intervals", F.concat(F.coalesce("above", F.array().cast("array<struct<s:bigint,e:bigint>>")),
                                               F.array(F.struct(F.col("seg_start").alias("s"), F.col("end").alias("e")))))
             .select("n1", "n2", "path", "depth", "formatted", "masked", "start", "end", "position", "intervals"))
    leaves = chained.groupBy("conv_id").agg(F.max(F.struct("depth", "n1", "n2")).alias("m")) \
        .select("conv_id", "m.n1", "m.n2")
    return stored(nodes, "tree"), leaves


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """n1, n2, start, formatted, role, text, masked_text of every turn of every distinct conversation, parsed from
    the output.

    A conversation is what its last turn (n1, n2) attends to: the nodes whose start lies
    in one of its intervals, in order.  Equal conversations are read once.
    """
    seen = (leaves.select("n1", "n2").distinct().join(nodes.select("n1", "n2", "path", "intervals"), ["n1", "n2"])
            .select("n1", "n2", F.posexplode("intervals").alias("level", "at"), "path")
            .select("n1", "n2", F.substring("path", F.lit(1), (F.col("level") + 1) * 32).alias("seg"), "at.s", "at.e"))
    piece = nodes.select(F.col("path").alias("seg"), "start", "formatted", "masked")
    got = (seen.join(piece, "seg").where("start >= s and start < e").select("n1", "n2", "start", "formatted", "masked"))
    role = F.substring_index(F.substr("formatted", F.lit(len(START) + 1)), "\n", 1)
    at = F.lit(len(START)) + F.length(role) + 1
    text = F.substr("formatted", at + 1, F.length("formatted") - at - len(END))
    masked = F.when(F.col("masked").isNotNull(), unescape(F.substr(
        "formatted", F.col("masked.start") + 1, F.col("masked.end") - F.col("masked.start"))))
    return got.select("n1", "n2", "start", "formatted", _role_back(role).alias("role"), unescape(text).alias("text"),
                      masked.alias("masked_text"))


def _role_back(role: Column) -> Column:
    """Undo escape() and the line feeds of roles."""
    parts = F.split(role, "\\\\\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(
        F.replace(p, F.lit("\\i"), F.lit("")), F.lit("\\n"), F.lit("\n"))), "\\")


def digests(read: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per conversation: turns, their digest, masked text and formatted length, all from ``read_back`` rows."""
    rows = read.groupBy("n1", "n2").agg(F.sort_array(F.collect_list(F.struct(
        "start", "role", "text", "masked_text", F.length("formatted").alias("len")))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda x: x["masked_text"].isNotNull()), lambda x: x["masked_text"]), "")
    out = rows.select("n1", "n2", F.size("t").cast("long").alias("n_turns"),
                       F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
                       F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["len"]).alias("formatted_chars"))
    return leaves.join(out, ["n1", "n2"]).drop("n1", "n2")


_COUNT = " + ".join(f"(length(X) - length(replace(X, '{c}', ''))) // {len(c)}" for c in CONTROL)
_ESCAPED = f"(length(X) + length(X) - length(replace(X, chr(92), '')) + 2 * ({_COUNT}))"
ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END)} + {_ESCAPED.replace('X', 'role')} + {_ESCAPED.replace('X', 'text')}
      + length(role) - length(replace(role, chr(10), '')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
