"""Approximate nearest neighbours (cosine) from stable projections in kd-trees.

Unit vectors are projected on ``DIMS`` Gaussian (2-stable) directions: the squared
projected distance over the squared true distance is chi-square with DIMS degrees of
freedom.  Projected points are visited in order of projected distance through a
kd-tree and verified on the original vectors; once the next projected distance
is so large that a nearer neighbour would have shown up earlier with
probability ``STOP`` (chi-square test against the k-th verified distance), the
search ends.

The tree's top levels, fitted on a bounded sample, deal the rows into cells; each
cell is cut into blocks of bounded size with a kd-tree each.  A query searches its home
cell first.  The distance found there tells, by the same test against the cells'
boxes, which other cells to search.  Equal vectors are indexed once with their
smallest ids, and equal query vectors are searched once, so a hot vector costs
one point.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import arrow_map, ship, stored

DIMS = 8                       # projections (even: the chi-square distribution has a closed form)
STOP = 0.97                    # probability of the stopping test
SAMPLE = 20_000                # vectors that fit the top levels
CELL_ROWS, MAX_DEPTH = 4096, 12   # at most 2^12 cells: 0.5 MB of boxes
BLOCK_ROWS, QUERY_ROWS = 16_384, 4096   # rows of an index block, queries that meet it in one task
LEAF = 256
SEED = 20240613


def chi_square_cdf(x: float, m: int = DIMS) -> float:
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - np.exp(-x / 2) * total


def stop_ratio(p: float = STOP, m: int = DIMS) -> float:
    """Squared projected over squared true distance at which the test holds."""
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if chi_square_cdf(mid, m) >= p else (mid, hi)
    return hi


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, DIMS))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two (exact), so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def cosines(rows: np.ndarray, row_lengths: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of every (scaled) row with q, summed in the same order for every row."""
    return (rows * q).sum(axis=1) / (row_lengths * np.sqrt((q * q).sum()))


def project(v: np.ndarray) -> np.ndarray:
    s = scaled(v)
    return (s / np.sqrt((s * s).sum(axis=1, keepdims=True))) @ directions(v.shape[1])


class Cells:
    """Top levels of the tree: split dimension and value per inner node (heap order)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(2**depth, dtype=np.int64)
        self.at = np.zeros(2**depth)
        parts = {1: sample}
        for node in range(1, 2**depth):
            p = parts.pop(node, sample[:0])
            if len(p):
                self.dim[node] = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                self.at[node] = np.median(p[:, self.dim[node]])
            right = p[:, self.dim[node]] > self.at[node]
            parts[2 * node], parts[2 * node + 1] = p[~right], p[right]

    def of(self, proj: np.ndarray) -> np.ndarray:
        node = np.ones(len(proj), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (proj[np.arange(len(proj)), self.dim[node]] > self.at[node])
        return node - 2**self.depth


class Tree:
    """kd-tree of projected points with tight boxes; leaves hold at most LEAF points unless all are equal."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []          # (low, high, left, right) or (low, high, rows)
        self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        p = self.points[rows]
        low, high = p.min(axis=0), p.max(axis=0)
        me = len(self.nodes)
        self.nodes.append((low, high, rows))
        d = int(np.argmax(high - low))
        if len(rows) > LEAF and high[d] > low[d]:
            order = rows[np.argsort(p[:, d], kind="stable")]
            half = len(order) // 2
            self.nodes[me] = (low, high, self._build(order[:half]), self._build(order[half:]))
        return me

    def gap(self, node: int, q: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        out = np.maximum(np.maximum(low - q, q - high), 0.0)
        return float(out @ out)

    def batches(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """(rows, next squared distance): rows in ascending projected distance; all later rows are at least that far."""
        heap = [(self.gap(0, q), 0)]
        waiting, far = np.zeros(0, np.int64), np.zeros(0)
        while heap:
            node = self.nodes[heapq.heappop(heap)[1]]
            if len(node) == 4:
                for child in node[2:]:
                    heapq.heappush(heap, (self.gap(child, q), child))
            else:
                d = ((self.points[node[2]] - q) ** 2).sum(axis=1)
                waiting, far = np.concatenate([waiting, node[2]]), np.concatenate([far, d])
            bound = heap[0][0] if heap else np.inf
            ready = far <= bound
            if ready.any():
                order = np.argsort(far[ready], kind="stable")
                yield waiting[ready][order], min(bound, float(far[~ready].min()) if (~ready).any() else np.inf)
                waiting, far = waiting[~ready], far[~ready]


def search_block(ids: list, vectors: np.ndarray, norms: np.ndarray, tree: Tree, q: np.ndarray, q_proj: np.ndarray,
                 k: int, best: float, ratio: float) -> list[tuple[float, int]]:
    """Up to k (score, id) of one block, best first, ties to the smaller id.

    ``best``: k-th score known before (-inf: none); it only helps to stop early.
    """
    found: list[tuple[float, int]] = []
    for rows, ahead in tree.batches(q_proj):
        scores = cosines(vectors[rows], norms[rows], q)
        if len(scores) > k:                       # k points hold at least k ids: the rest cannot enter
            near = scores >= max(np.partition(scores, -k)[-k], -found[-1][0] if len(found) == k else -np.inf)
            scores, rows = scores[near], rows[near]
        found = sorted(found + [(-s, int(x)) for s, i in zip(scores.tolist(), rows.tolist()) for x in ids[i]])[:k]
        worst = max(best, -found[-1][0] if len(found) == k else -np.inf)
        # squared distance of unit vectors: 2 - 2 cos
        if worst > -np.inf and ahead > 0 and ahead >= ratio * max(0.0, 2 - 2 * worst):
            break
    return [(-s, i) for s, i in found]


def _usable(vec: Column) -> Column:
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            proj = project(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shared.value.of(proj)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * DIMS, pa.int32()), pa.array(proj.reshape(-1)))],
                names=[*batch.schema.names, "cell", "proj"])
    return run


def _search(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            vectors, tree = scaled(_matrix(index.vec)), Tree(_matrix(index.proj))
            ids, norms, ratio = index.ids.tolist(), lengths(vectors), stop_ratio()
            for qid, q, q_proj, best in zip(queries.qid, scaled(_matrix(queries.vec)), _matrix(queries.proj), queries.best):
                out += [(qid, i, s) for s, i in search_block(ids, vectors, norms, tree, q, q_proj, k, best,
                                                                 ratio)]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"]).astype(
            {"qid": "int64", "vec_id": "int64", "score": "float64"})
    return run


def _far_cells(shared):
    """(qid, vec, proj, best, cell) for every other cell that the test does not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, low, high = shared.value
        ratio = stop_ratio()
        for batch in batches:
            t = batch.to_pandas()
            rows, to = [], []
            for i, (q, best, home) in enumerate(zip(t.proj, t.best, t.cell)):
                gap = np.maximum(np.maximum(low - q, q - high), 0.0)
                gap = (gap * gap).sum(axis=1)
                limit = ratio * max(0.0, 2 - 2 * best) if best > -np.inf else np.inf
                go = cells[((gap < limit) | (gap == 0)) & (cells != home)]
                rows += [i] * len(go)
                to += go.tolist()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("qid", "vec", "proj", "best")), pa.array(to, pa.int64())],
                names=["qid", "vec", "proj", "best", "cell"])
    return run


def _visit(index: DataFrame, blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score) of queries (qid, vec, proj, best, cell) in their cells, k for each block."""
    load = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
    dealt = (queries.join(F.broadcast(load), "cell")                       # <= 2^MAX_DEPTH rows
             .withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
             .join(F.broadcast(blocks), "cell")                            # <= 2^MAX_DEPTH rows
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", "block", "part", "qid", "vec", "proj", "best"))
    copied = (index.join(F.broadcast(load), "cell")
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
              .select("cell", "block", "part", "ids", "vec", "proj"))
    key = ["cell", "block", "part"]
    return copied.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(
        _search(k), "qid long, vec_id long, score double")


def _top(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows found, ties to the smaller id.

    ``queries``: condition on ``vectors`` that selects the query rows.  Rows whose
    vector is null, empty, zero or holds a null or non-finite component, or
    whose length is not the table's most common one (the smaller of equals),
    or whose id is null, take no part.  Rows that repeat an id and vector
    count once; fewer than k others give fewer rows; an empty table none.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                           F.coalesce(queries, F.lit(False)).alias("asks"))
            .where(_usable(F.col("vec")) & F.col("id").isNotNull()))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("vec") == sizes.d).distinct()
    # One point for equal vectors: their k + 1 smallest ids (the planner limits groups before the shuffle).
    order = Window.partitionBy("vec").orderBy("id")
    points = stored(rows.select("id", "vec").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
                    .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    n = points.count()
    share = F.shiftrightunsigned(F.xxhash64("vec"), 11) / F.lit(float(2**53)) < F.lit(min(1.0, SAMPLE / n))
    fit = points.where(share).limit(2 * SAMPLE).select("vec").toPandas()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(n / CELL_ROWS)))))
    cells = Cells(project(_matrix(fit.vec)) if len(fit) else np.zeros((0, DIMS)), depth)
    shared = spark.sparkContext.broadcast(cells)
    ddl = "vec array<double>, cell long, proj array<double>"
    placed = arrow_map(points.select(F.col("ids"), "vec"), _place(shared), f"ids array<long>, {ddl}")
    held = placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    blocks = stored(held.select("cell", "blocks"), "blocks")
    index = stored(placed.join(F.broadcast(blocks), "cell")
                   .withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int"))
                   .select("cell", "block", "ids", "vec", "proj"), "index")
    box = index.groupBy("cell").agg(*(f(F.get("proj", F.lit(i))).alias(f"{m}{i}") for m, f in (("a", F.min), ("z", F.max))
                                      for i in range(DIMS))).toPandas()       # <= 2^MAX_DEPTH rows
    boxes = spark.sparkContext.broadcast((box.cell.to_numpy(), box[[f"a{i}" for i in range(DIMS)]].to_numpy(),
                                          box[[f"z{i}" for i in range(DIMS)]].to_numpy()))

    # Equal query vectors are one search, named by their smallest query id.
    asking = rows.where("asks").select("id", "vec")
    asked = stored(asking.join(asking.groupBy("vec").agg(F.min("id").alias("qid")), "vec").select("id", "qid", "vec"), "asked")
    search = stored(arrow_map(asked.where("id = qid").select(F.col("id").alias("qid"), "vec").distinct(), _place(shared),
                              f"qid long, {ddl}"), "queries")
    none = F.lit(float("-inf"))
    near = stored(_top(_visit(index, blocks, search.withColumn("best", none), k + 1), "qid", k + 1), "near")
    bound = near.where(F.col("rank") == k + 1).select("qid", F.col("score").alias("best"))
    again = arrow_map(search.join(bound, "qid", "left").withColumn("best", F.coalesce("best", none)),
                      _far_cells(boxes), "qid long, vec array<double>, proj array<double>, best double, cell long")
    far = _visit(index, blocks, stored(again, "far-cells"), k + 1)
    found = _top(near.select("qid", "vec_id", "score").union(far), "qid", k + 1).drop("rank")
    mine = (asked.select(F.col("id").alias("query_id"), "qid").distinct().join(found, "qid")
            .where("query_id <> vec_id").select("query_id", "vec_id", "score"))
    return _top(mine, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
