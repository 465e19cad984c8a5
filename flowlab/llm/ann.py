"""Nearest vectors through a hierarchical k-means tree, searched best bin first.

Inner products become distances by one more component that brings every vector
to the same length (queries have 0 there).  A tree of k-means splits is fitted on
a bounded sample; every vector of the table is then sent down the tree to a leaf.
A query walks the tree with a priority queue of branches, nearest first, and so
orders its leaves.  How many it visits is calibrated: for sampled queries the
exact neighbours are found by comparing them with all rows, and visits widen
until the wanted share of these neighbours lies in the visited leaves.

Searching joins queries to the vectors of their leaves.  A leaf is dealt into
blocks of a bounded size, so a crowded leaf is many tasks; scores are computed on
the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.scratch import materialize

SAMPLE_ROWS = 10_000
CALIBRATION_QUERIES = 200
BRANCHES = 8
LEAF_SAMPLE = 400
BLOCK_ROWS = 4_096


class Tree:
    """Nodes of k-means centres; a child below 0 is the leaf ``-1 - child``."""

    def __init__(self, points: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.branches, self.leaf_rows = branches, leaf_rows
        self.root = self._grow(points)

    def _grow(self, points: np.ndarray) -> int:
        owner = None
        if len(points) > self.leaf_rows:
            centres, owner = kmeans(points, self.branches)
        if owner is None or len(centres) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        self.children[node] = [self._grow(points[owner == k]) for k in range(len(centres))]
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf each point reaches by going to the nearest centre at every node."""
        out, stack = np.zeros(len(points), dtype=np.int64), [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            nearest = np.argmin(distances(points[rows], self.centres[node]), axis=1)
            for k, child in enumerate(self.children[node]):
                if (nearest == k).any():
                    stack.append((child, rows[nearest == k]))
        return out

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves in best-bin-first order."""
        queue, out = [(0.0, self.root)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            while node >= 0:
                far = distances(query[None, :], self.centres[node])[0]
                near = int(np.argmin(far))
                for k, child in enumerate(self.children[node]):
                    if k != near:
                        heapq.heappush(queue, (float(far[k]), child))
                node = self.children[node][near]
            out.append(-1 - node)
        return out


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to a term that is equal along a row."""
    return (centres * centres).sum(axis=1) - 2 * points @ centres.T


def kmeans(points: np.ndarray, number: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds from evenly spaced points of the longest direction; empty centres go."""
    spread = points - points.mean(axis=0)
    axis = spread.T @ (spread @ spread[np.argmax((spread * spread).sum(axis=1))])
    order = np.argsort(spread @ axis, kind="stable")
    centres = np.unique(points[order[np.linspace(0, len(points) - 1, number).astype(int)]], axis=0)
    owner = np.zeros(len(points), dtype=np.int64)
    for _ in range(rounds):
        owner = np.argmin(distances(points, centres), axis=1)
        used = np.unique(owner)
        centres = np.array([points[owner == k].mean(axis=0) for k in used])
        owner = np.searchsorted(used, owner)
    return centres, owner


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that brings them to the length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest - (vectors * vectors).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _top(query: np.ndarray, scores: np.ndarray, points: np.ndarray, keys: np.ndarray, own: int,
         number: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``number`` keys but ``own`` and their scores, ties to smaller keys.

    ``scores`` may differ in the last digits for equal vectors, so all rows about
    as good as the last one are scored again, each in the same order of sums.
    """
    take = np.flatnonzero(keys != own)
    if len(take) > number:
        bar = np.partition(scores[take], len(take) - number)[len(take) - number]
        take = take[scores[take] >= bar - 1e-9 * (1 + np.abs(scores[take]).max())]
    exact = np.add.reduce(points[take] * query, axis=1)
    order = np.lexsort((keys[take], -exact))[:number]
    return keys[take][order], exact[order]


def _distinct(keys: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeats of the same id and vector."""
    if len(np.unique(keys)) == len(keys):
        return keys, points
    seen = {(k, p.tobytes()): i for i, (k, p) in reversed(list(enumerate(zip(keys.tolist(), points))))}
    rows = np.array(sorted(seen.values()))
    return keys[rows], points[rows]


def _hashed_rows(df: DataFrame, number: int) -> list:
    """About ``number`` rows, never more, whose hash is lowest; all if there are fewer."""
    total = df.count()
    share = min(1.0, number / max(1, total))
    rows = df.withColumn("h", F.xxhash64("vec_id", "v")).where(
        F.shiftrightunsigned("h", 33) < int(share * (1 << 31)) + (share == 1.0)).collect()
    return sorted(rows, key=lambda r: r["h"])[:number]


def nearest_vectors(vectors: DataFrame, is_query: Column, number: int = 20, recall: float = 0.95, key: str = "vec_id",
                    vector: str = "embedding", sample_rows: int = SAMPLE_ROWS,
                    calibration_queries: int = CALIBRATION_QUERIES) -> DataFrame:
    """For each query row, the ``number`` rows of largest inner product that are found.

    ``is_query`` is a condition on the columns of ``vectors``.  Returns query_id,
    rank (from 1), vec_id and score, nearest first, ties to the smaller id; a row
    is no candidate for its own id.  Vectors that are null, zero, hold null or
    non-finite components, or have another length than most take no part, nor do
    rows with a null id.  Of rows that repeat an id all are candidates and each id
    is returned once per query, with its best score.  An empty table, or one
    without queries, gives no rows.  The tree is fitted on ``sample_rows`` rows
    and calibrated on ``calibration_queries`` queries, the first by hash.
    """
    source = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("query"), F.size(vector).alias("dim"))
    widths = source.groupBy("dim").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return vectors.sparkSession.createDataFrame([], schema)
    source = source.where(F.col("dim") == widths[0]["dim"]).select("vec_id", "v", "query")
    longest = source.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0]
    sample = [r["v"] for r in _hashed_rows(source, sample_rows)]
    tree = Tree(_lifted(np.array(sample, dtype=np.float64), longest))
    model = vectors.sparkSession.sparkContext.broadcast((tree, longest))  # bounded by the sample

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, length = model.value
        for batch in batches:
            leaf = fitted.leaf_of(_lifted(_matrix(batch.column("v")), length)) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())],
                                             names=["vec_id", "v", "query", "leaf"])

    indexed = materialize(source.mapInArrow(to_leaf, source.withColumn("leaf", F.lit(0).cast("long")).schema), "leaves")
    visits = _calibrated(indexed, number, recall, tree, calibration_queries)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, _ = model.value
        for batch in batches:
            for i, point in enumerate(_matrix(batch.column("q")) if len(batch) else ()):
                bins = fitted.best_bins(np.append(point, 0.0), visits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1).take(pa.array([0] * len(bins))),
                     batch.column(1).slice(i, 1).take(pa.array([0] * len(bins))), pa.array(bins, pa.int64())],
                    names=["query_id", "q", "leaf"])

    queries = indexed.where("query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    bins = queries.mapInArrow(to_bins, queries.withColumn("leaf", F.lit(0).cast("long")).schema)
    return _merged(_scored(indexed, bins, number), number)


def _calibrated(indexed: DataFrame, number: int, recall: float, tree: Tree, queries: int) -> int:
    """The least number of leaves that hold the share ``recall`` of the sampled queries' neighbours."""
    asked = _hashed_rows(indexed.where("query").select("vec_id", "v"), queries)
    if not asked:
        return 1
    ids, points = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked], dtype=np.float64)
    held = indexed.sparkSession.sparkContext.broadcast((ids, points))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = held.value
        for batch in batches:
            if not len(batch):
                continue
            keys, leaves = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            scores = block @ _matrix(batch.column("v")).T
            out = []
            for q in range(len(own)):
                rows = np.flatnonzero(keys != own[q])
                for i in rows[np.argsort(-scores[q, rows], kind="stable")[:number]]:
                    out.append((q, float(scores[q, i]), int(leaves[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["q", "score", "leaf"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    found = indexed.select("vec_id", "v", "leaf").mapInArrow(compare, "q long, score double, leaf long").withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= number).select("q", "leaf").collect()
    places = [{leaf: i for i, leaf in enumerate(tree.best_bins(np.append(p, 0.0), tree.leaves))} for p in points]
    needed = sorted(places[r["q"]][r["leaf"]] + 1 for r in found)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def _scored(indexed: DataFrame, bins: DataFrame, number: int) -> DataFrame:
    """The best rows of each query within each block of a leaf."""
    sizes = materialize(indexed.groupBy("leaf").agg(F.count("*").alias("rows")).select(
        "leaf", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "leaf_sizes")
    rows = indexed.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")
    wide = bins.join(sizes, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "q")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            keys, points = _distinct(left.column("vec_id").to_numpy(), _matrix(left.column("v")))
            own, block = _distinct(right.column("query_id").to_numpy(), _matrix(right.column("q")))
            for at in range(0, len(own), 256):
                scores = block[at:at + 256] @ points.T
                for q, query, line in zip(own[at:at + 256], block[at:at + 256], scores):
                    found, exact = _top(query, line, points, keys, q, number)
                    out[0].append(np.full(len(found), q))
                    out[1].append(found)
                    out[2].append(exact)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], t) for n, c, t in zip(
            ("query_id", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.float64()))})

    return rows.groupBy("leaf", "block").cogroup(wide.groupBy("leaf", "block")).applyInArrow(
        best, "query_id long, vec_id long, score double")


def _merged(scored: DataFrame, number: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= number)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
