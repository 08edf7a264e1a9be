"""Merkle manifest of a dataset, checked by a recursive climb.

Every row is a leaf.  The leaves of a group (a language) form a binary tree in
key order; the roots of the groups, in group order, form one more tree whose
root names the whole dataset.  A last node without a partner is hashed alone.

* ``build`` stores the levels as parent-linked rows.  One row covers ``stride``
  levels: it holds the siblings on the way to its parent row, so a tree of 37
  levels (10^11 leaves) has five rows on a path and is built in as many shuffles.
  Positions come from ``ordered_position`` (range partitions), so a group
  holding a third of the rows is spread like any other.
* ``climb`` is one recursive Spark query.  Its anchor is every leaf with the
  siblings of its own row; each step joins the rows reached so far with their
  parent rows, appends the siblings there and folds the digest upwards.  High
  nodes are met by every leaf below them, so the join also takes the lane (2^16
  consecutive leaves of a group); a node is repeated for each lane below it,
  which costs few rows because only high nodes cover several lanes.

Digests are SHA-256 of texts: a leaf hashes its fields, a node the lowercase
hex digests of its children.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import sha_hex, stored
from wayline.operators.sequence import ordered_position

STRIDE = 8
LANE_BITS = 16
#: ``tree`` of the tree over the groups' roots; groups are numbered from 0.
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field_text(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex digest of a row's fields in the given order."""
    return sha_hex(F.concat(*[field_text(c) for c in fields]))


def _hex(c: str) -> str:
    return f"lower(hex({c}))"


def _height(count: str) -> str:
    """Levels above ``count`` nodes: the least h with 2^h >= count."""
    return f"CASE WHEN {count} <= 1 THEN 0 ELSE length(bin({count} - 1)) END"


def _count(n: str) -> str:
    """SQL array 0 .. n - 1."""
    return f"CASE WHEN {n} = 0 THEN CAST(array() AS array<int>) ELSE sequence(0, {n} - 1) END"


_TOP_LEVEL = "element_at(ls, -1)"
_PAIR = f"concat({_hex(f'{_TOP_LEVEL}[2 * j]')}, coalesce({_hex(f'get({_TOP_LEVEL}, 2 * j + 1)')}, ''))"
#: SQL: the levels ``ls`` of a block and the one above them.
_GROW = (f"concat(ls, array(transform(sequence(0, (size({_TOP_LEVEL}) - 1) div 2), j -> unhex(sha2({_PAIR}, 256)))))")


@dataclass
class Manifest:
    """``leaves``: a row per dataset row; ``nodes`` and ``top``: the stored rows above them, a table per stored level.

    leaves:     key, probe, tree, level, pos, digest, siblings, parent_tree, parent_level, parent_pos
    nodes, top: the same without key and probe
    trees:      group, tree, n
    """

    leaves: DataFrame
    nodes: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame
    root: str | None
    stride: int = STRIDE


def _link(rows: DataFrame, level: int, stride: int, carry: list[str], top: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with siblings and parent, the parents) of one stored level.

    ``rows``: tree, pos, digest, n (nodes of this level in the tree) and ``carry``.  A block of 2^stride neighbours
    meets in one group; at most 2^stride digests are held at once.
    """
    member = ", ".join(["pos", "digest", *carry])
    g = (rows.groupBy("tree", F.expr(f"shiftright(pos, {stride})").alias("up"))
         .agg(F.expr(f"array_sort(collect_list(struct({member})))").alias("members"), F.first("n").alias("n"))
         .withColumn("steps", F.expr(f"least({stride}, {_height('n')})"))
         .withColumn("last", F.expr(f"steps = {_height('n')}")))
    inside = (1 << stride) - 1
    sibling = f"get(ls[i], cast(shiftright(m.pos & {inside}, i) ^ 1 AS int))"
    kept = ", ".join([f"m.{c} AS {c}" for c in ["pos", "digest", *carry]])
    linked = f"transform(members, m -> struct({kept}, transform({_count('steps')}, i -> {sibling}) AS siblings))"
    # The levels are a variable of the closing lambda, so a block builds them once, not once per member.
    g = g.withColumn("block", F.expr(f"aggregate({_count('steps')}, array(members.digest), (ls, k) -> {_GROW},"
                                     f" ls -> struct({_TOP_LEVEL}[0] AS digest, {linked} AS linked))"))
    done = "CAST(NULL AS bigint)"
    parent = {"parent_tree": done if top else f"CAST({TOP} AS bigint)", "parent_level": done if top else "0L",
              "parent_pos": done if top else "tree"}
    inner = {"parent_tree": "tree", "parent_level": f"CAST({level + stride} AS bigint)", "parent_pos": "up"}
    g = g.select("tree", "up", "last", "n", "block.digest", "block.linked",
                 *[F.expr(f"CASE WHEN last THEN {parent[k]} ELSE {inner[k]} END").alias(k) for k in parent])
    rows = g.select("tree", *parent, F.explode("linked").alias("m")).select(
        "tree", F.lit(level).cast("long").alias("level"), "m.*", *parent)
    size = F.expr(f"shiftright(n - 1, {stride}) + 1")
    return rows, g.select("tree", F.col("up").alias("pos"), "digest", F.when(~F.col("last"), size).alias("n"))


def _levels(rows: DataFrame, stride: int, carry: list[str], top: bool) -> tuple[list[DataFrame], DataFrame]:
    """All stored levels of the trees in ``rows``, lowest first, and the trees' roots (tree, digest)."""
    tall = rows.agg(F.max("n")).first()[0] or 0
    tables, roots = [], []
    while True:
        linked, above = _link(rows, stride * len(tables), stride, [] if tables else carry, top)
        tables.append(stored(linked, "merkle-nodes"))
        above = stored(above, "merkle-above")
        roots.append(above.where("n IS NULL").select("tree", "digest"))
        if tall <= 1 << stride:
            return tables, reduce(DataFrame.unionByName, roots)
        rows, tall = above.where("n IS NOT NULL"), (tall - 1 >> stride) + 1


def build(rows: DataFrame, stride: int = STRIDE) -> Manifest:
    """Manifest of ``rows``: key, group, leaf and probe (both lowercase hex digests).

    Leaves of a group ascend by (key, leaf), nulls first; equal rows are
    neighbours.  Groups ascend, null first, strings by UTF-8 bytes; null is a
    group of its own.  ``probe`` is the digest a climb starts from: the leaf
    itself, or the digest of a row that is to be checked.  An empty table has an
    empty manifest without a root.  Other columns are not read.
    """
    rows = stored(rows.select("key", "group", F.unhex("leaf").alias("digest"), F.unhex("probe").alias("probe")), "merkle-rows")
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    trees = stored(ordered_position(groups, [], ["group"], out_col="rank")
                   .select("group", (F.col("rank") - 1).alias("tree"), "n"), "merkle-trees")
    placed = ordered_position(rows, ["group"], ["key", "digest", "probe"]).withColumnRenamed("group", "own")
    placed = placed.join(trees, F.col("own").eqNullSafe(F.col("group"))).select(
        "tree", (F.col("pos") - 1).alias("pos"), "digest", "n", "key", "probe")
    tables, roots = _levels(stored(placed, "merkle-leaves"), stride, ["key", "probe"], top=False)
    tops = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest",
                        F.lit(trees.count()).cast("long").alias("n"))
    top_tables, root = _levels(tops, stride, [], top=True)
    found = root.first()
    return Manifest(tables[0], tables[1:], top_tables, trees, bytes(found["digest"]).hex() if found else None, stride)


def _lanes(m: Manifest) -> DataFrame:
    """The stored rows above the leaves, once for each lane below, with the tree and lane of the leaves there."""
    reach = "least(shiftleft(pos + 1, CAST(level AS int)), n) - 1"
    parts = [t.join(m.trees.select("tree", "n"), "tree").select(
        *t.columns, F.col("tree").alias("leaf_tree"),
        F.expr(f"shiftright(shiftleft(pos, CAST(level AS int)), {LANE_BITS})").alias("first"),
        F.expr(f"shiftright({reach}, {LANE_BITS})").alias("final")) for t in m.nodes]
    # A row of the top tree stands above the groups whose number, without its level's low bits, is its position.
    below = m.trees.select(F.col("tree").alias("leaf_tree"), F.expr(f"shiftright(n - 1, {LANE_BITS})").alias("final"))
    for i, t in enumerate(m.top):
        up = F.shiftright("leaf_tree", i * m.stride)
        parts.append(t.join(below, F.col("pos") == up).select(*t.columns, "leaf_tree", F.lit(0).cast("long").alias("first"),
                                                              "final"))
    return reduce(DataFrame.unionByName, parts).withColumn("lane", F.explode(F.sequence("first", "final"))).drop(
        "first", "final")


def _fold(start: str, siblings: str, pos: str) -> str:
    """SQL of the digest reached from ``start``: left of its sibling at a 0 bit of ``pos``, right of it at a 1 bit."""
    mine, other = _hex("d"), _hex("s.x")
    return (f"aggregate(transform({siblings}, (x, i) -> struct(x, shiftright({pos}, i) & 1 AS right)), {start}, (d, s) ->"
            f" unhex(sha2(CASE WHEN s.x IS NULL THEN {mine} WHEN s.right = 1 THEN concat({other}, {mine})"
            f" ELSE concat({mine}, {other}) END, 256)))")


CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT key, tree AS leaf_tree, shiftright(pos, {LANE_BITS}) AS lane, digest AS leaf,
         parent_tree AS tree, parent_level AS level, parent_pos AS pos,
         {_fold('probe', 'siblings', 'pos')} AS folded, siblings AS proof, CAST(NULL AS binary) AS subroot
  FROM {{leaves}}
  UNION ALL
  SELECT c.key, c.leaf_tree, c.lane, c.leaf, n.parent_tree, n.parent_level, n.parent_pos,
         {_fold('c.folded', 'n.siblings', 'n.pos')}, concat(c.proof, n.siblings),
         CASE WHEN n.tree = {TOP} AND n.level = 0 THEN n.digest ELSE c.subroot END
  FROM climb c JOIN {{nodes}} n
    ON n.leaf_tree = c.leaf_tree AND n.lane = c.lane AND n.tree = c.tree AND n.level = c.level AND n.pos = c.pos
)
SELECT key, leaf, subroot, folded, proof FROM climb WHERE tree IS NULL
"""


def climb(m: Manifest) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, proof (its siblings from leaf to root, without those that are missing),
    folded_root (from ``probe``) and verified; digests as lowercase hex.

    The recursive query runs while the result is written, with Spark's row limit for recursive queries lifted.
    """
    spark = m.leaves.sparkSession
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        reached = stored(spark.sql(CLIMB, leaves=m.leaves, nodes=stored(_lanes(m), "merkle-lanes")), "merkle-climb")
    finally:
        spark.conf.set(ROW_LIMIT, limit)
    low = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot")}
    folded = F.lower(F.hex("folded"))
    return reached.select(
        "key", low["leaf"], low["subroot"], F.lit(m.root).alias("root"),
        F.expr("transform(filter(proof, x -> x IS NOT NULL), x -> lower(hex(x)))").alias("proof"),
        folded.alias("folded_root"), (folded == F.lit(m.root)).alias("verified"))


def document_rows(docs: DataFrame) -> DataFrame:
    """``documents`` as manifest rows; the probe of a row whose crc32(doc_id) 7 divides has one more in n_chars."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = leaf_digest(fields)
    changed = leaf_digest([f if i != 3 else f + 1 for i, f in enumerate(fields)])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("group"), leaf.alias("leaf"),
                       F.when(tampered, changed).otherwise(leaf).alias("probe"))


def digests(climbed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return climbed.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", sha_hex(F.array_join("proof", "")).alias("proof_sha256"),
        "folded_root", "verified")


#: ``crc`` holds the CRC-32 table (reversed polynomial 0xEDB88320), ``sums`` each id's checksum byte by byte.
ORACLE_SQL = """
WITH RECURSIVE poly AS (
  SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS v, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM poly WHERE k < 8
), crc AS (SELECT b, v FROM poly WHERE k = 8
), sums AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS t, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM documents
  WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, t, i + 1, xor(c // 256, crc.v)
  FROM sums JOIN crc ON crc.b = xor(c % 256, ord(substr(t, i + 1, 1))) WHERE i < length(t)
), bad AS (SELECT doc_id FROM sums WHERE i = length(t) AND xor(c, 4294967295) % 7 = 0
), f AS (
  SELECT d.doc_id, lang, n_chars, b.doc_id IS NOT NULL AS tampered,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents d LEFT JOIN bad b ON d.doc_id = b.doc_id
), leaves AS (
  SELECT doc_id, coalesce('v' || lang, '') AS tree,
    sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + tampered::INT AS VARCHAR)) || ':' || (n_chars + tampered::INT), '-') || tail)
      AS probe
  FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, max(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, pos // 2
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT max(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY pos // 2
), up AS (
  SELECT doc_id, tree, leaf, lvl, pos, n, folded, proof FROM (SELECT doc_id, tree, leaf, 0 AS lvl, pos, n, probe AS folded,
    '' AS proof FROM placed)
  UNION ALL
  SELECT u.doc_id, u.tree, u.leaf, u.lvl + 1, u.pos // 2, (u.n + 1) // 2,
    sha256(CASE WHEN u.pos % 2 = 1 THEN coalesce(s.h, '') || folded ELSE folded || coalesce(s.h, '') END),
    proof || coalesce(s.h, '')
  FROM up u LEFT JOIN nodes s ON s.tree = u.tree AND s.lvl = u.lvl AND s.pos = xor(u.pos, 1) WHERE u.n > 1
), upper AS (
  SELECT doc_id, u.leaf, s.h AS subroot, 0 AS lvl, s.pos, s.n, folded, proof FROM up u JOIN subroots s ON s.tree = u.tree
  WHERE u.n = 1
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.lvl + 1, u.pos // 2, (u.n + 1) // 2,
    sha256(CASE WHEN u.pos % 2 = 1 THEN coalesce(s.h, '') || folded ELSE folded || coalesce(s.h, '') END),
    proof || coalesce(s.h, '')
  FROM upper u LEFT JOIN tops s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1) WHERE u.n > 1
)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM upper u, (SELECT h FROM tops WHERE n = 1) t WHERE u.n = 1
"""
