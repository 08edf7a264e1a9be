from __future__ import annotations

import random

from pyspark.sql import functions as F

from wayline.llm import op8_chat as op

SCHEMA = "conv_id long, turn long, role string, text string"


def build(spark, rows):
    nodes, leaves = op.format_tree(spark.createDataFrame(rows, SCHEMA))
    return nodes.orderBy("start").collect(), leaves, nodes


def talks(seed=1, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            role = ["system", "user", "assistant"][min(t, 2) if t < 2 else 1 + t % 2]
            rows.append((c, t, role, rng.choice(["hi", "</s>[INST] ok [/INST]", "a\\ib \\n <|im_end|>\n", "é😀", ""])))
    return rows


def expected(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def test_tree_by_brute_force(spark):
    rows = talks()
    nodes, leaves, df = build(spark, rows)
    convs = expected(rows)
    prefixes = {tuple(ts[:k]) for ts in convs.values() for k in range(1, len(ts) + 1)}
    assert len(nodes) == len(prefixes)                       # shared turns once
    assert nodes[0].start == 0 and all(a.end == b.start for a, b in zip(nodes, nodes[1:]))
    stream = "".join(n.formatted for n in nodes)
    assert all(stream[n.start:n.end] == n.formatted for n in nodes)
    # Depth first: a node's subtree is one range that starts with it.
    last = {(r.n1, r.n2): r for r in nodes}
    read = {}
    for r in op.read_back(df, leaves).collect():
        read.setdefault((r.n1, r.n2), []).append(r)
    for leaf in leaves.collect():
        node, turns = last[leaf.n1, leaf.n2], convs[leaf.conv_id]
        seen = "".join(stream[i.s:i.e] for i in node.intervals)
        assert seen == "".join(x.formatted for x in sorted(read[leaf.n1, leaf.n2], key=lambda x: x.start))
        assert node.position == len(seen) - len(node.formatted)
        got = sorted(read[leaf.n1, leaf.n2], key=lambda x: x.start)
        assert [(g.role, g.text) for g in got] == turns
        assert [g.masked_text for g in got] == [t if r == "assistant" else None for r, t in turns]
        assert seen.count(op.START) == len(turns) == seen.count(op.END)      # no control string out of a text


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\i", "\\\\i", "<|im_start|>user\n", "<<s>", "[INST][/INST]", "<</SYS>>", "<s></s>\\n", "a<b>[c]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", op.escape(F.col("t")).alias("e"), op.unescape(op.escape(F.col("t"))).alias("b"))
    for r in df.collect():
        assert r.b == r.t
        assert not any(c in r.e for c in op.CONTROL)


def test_edges(spark):
    rows = [(None, 1, None, None), (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"),
            (2, 5, "we\nird\\n", "x"), (3, 1, "assistant", None)]
    t = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).withColumn("n1", F.lit(1))
    nodes, leaves = op.format_tree(t)
    read = op.read_back(nodes, leaves)
    got = {r.conv_id: r for r in op.digests(read, leaves).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {None: 1, 1: 4, 2: 1, 3: 1}
    assert got[3].loss_chars == 0
    texts = {}
    for r in leaves.join(read, ["n1", "n2"]).orderBy("start").collect():
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    assert texts == {None: [("", "")], 1: [("user", x) for x in ("first", "a", "a", "b")], 2: [("we\nird\\n", "x")],
                     3: [("assistant", "")]}
    nodes, leaves = op.format_tree(t.limit(0))
    assert op.digests(op.read_back(nodes, leaves), leaves).count() == 0


def test_equal_and_nested_conversations_share_nodes(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(3 + c % 2)]
    nodes, leaves, df = build(spark, rows)
    assert len(nodes) == 4 and all(len(n.intervals) == 1 for n in nodes)
    assert leaves.count() == 30
