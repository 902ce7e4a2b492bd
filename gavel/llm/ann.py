"""Largest inner products through a tree of k-means splits, searched best bin first.

Rows get one more component, the root of (largest norm^2 - norm^2); queries get 0 there.
The nearest rows by Euclidean distance are then those of largest inner product, so an
ordinary k-means tree serves. It is fitted on a bounded sample and indexes every row by
walking it down the tree. A query visits leaves through a priority queue of branches,
nearest centre first. How many leaves is calibrated: for a bounded set of queries the
exact neighbours are found by brute force, and visits widen until enough of them lie in
visited leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import ready, staged, thinned

NEIGHBOURS = 20
#: Rows the tree is fitted on, chosen by hash, and queries the visits are calibrated on.
SAMPLE_ROWS, CALIBRATION_QUERIES = 20_000, 100
RECALL = 0.97
BRANCHES = 8
#: Sampled rows in a leaf below which it isn't split.
LEAF_SAMPLE = 48
#: Rows and queries that meet in one task at most; fuller leaves are cut into blocks.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048

_FOUND = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Centres of all nodes, children of each (none for a leaf), the largest norm."""

    centres: np.ndarray
    children: list[list[int]]
    norm: float

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.norm ** 2 - np.einsum("ij,ij->i", vectors, vectors)
        return np.column_stack([vectors, np.sqrt(np.maximum(rest, 0))])

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest child at every level."""
        points, found = self.lift(vectors), np.zeros(len(vectors), dtype=np.int64)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            below = self.children[node]
            if not below:
                found[rows] = node
                continue
            nearest = np.argmin(_distances(points[rows], self.centres[below]), axis=1)
            waiting += [(child, rows[nearest == k]) for k, child in enumerate(below)
                        if (nearest == k).any()]
        return found

    def visits(self, query: np.ndarray, leaves: int, rows: int,
               sizes: dict[int, int]) -> list[int]:
        """Leaves in the order of a best-bin-first walk: ``leaves`` of them, and on until
        they hold ``rows`` rows."""
        point = np.append(query, 0.0)[None, :]
        gap = _distances(point, self.centres)[0]
        queue, order, seen = [(gap[0], 0)], [], 0
        while queue and (len(order) < leaves or seen < rows):
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if below:
                for child in below:
                    heapq.heappush(queue, (gap[child], child))
            elif node in sizes:
                order.append(node)
                seen += sizes[node]
        return order


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", points, points)[:, None] - 2 * points @ centres.T
            + np.einsum("ij,ij->i", centres, centres)[None, :])


def _k_means(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Group of each point; fewer groups than ``k`` if points coincide."""
    centres = points[[random.integers(len(points))]]
    gap = _distances(points, centres)[:, 0]
    while len(centres) < k and gap.max() > 1e-12:
        far = random.choice(len(points), p=np.maximum(gap, 0) / np.maximum(gap, 0).sum())
        centres = np.vstack([centres, points[far]])
        gap = np.minimum(gap, _distances(points, centres[-1:])[:, 0])
    group = np.zeros(len(points), dtype=np.int64)
    for _ in range(8):
        group = np.argmin(_distances(points, centres), axis=1)
        centres = np.vstack([points[group == g].mean(axis=0) for g in np.unique(group)])
        if len(centres) == 1:
            break
    return np.argmin(_distances(points, centres), axis=1)


def fit_tree(sample: np.ndarray, norm: float) -> Tree:
    """A tree over sampled rows whose norms are at most ``norm``."""
    random = np.random.default_rng(5)
    tree = Tree(np.zeros((0, sample.shape[1] + 1)), [[]], norm)
    points = tree.lift(sample)
    centres = [points.mean(axis=0)]
    waiting = [(0, points)]
    while waiting:
        node, inside = waiting.pop()
        if len(inside) < 2 * LEAF_SAMPLE:
            continue
        group = _k_means(inside, min(BRANCHES, len(inside) // LEAF_SAMPLE), random)
        groups = np.unique(group)
        if len(groups) < 2:
            continue
        for g in groups:
            part = inside[group == g]
            tree.children[node].append(len(centres))
            tree.children.append([])
            waiting.append((len(centres), part))
            centres.append(part.mean(axis=0))
    tree.centres = np.array(centres)
    return tree


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), -1)


def usable_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector): rows with an id and a vector of finite numbers that isn't zero.

    Vectors must have the length that most of them have. Of rows that repeat an id one
    counts, that with the smallest vector.
    """
    vector = F.col("vector")
    fine = (F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector, lambda x: x != 0))
    given = F.col(vector_column)
    if rows.select(given).dtypes[0][1] != "array<float>":
        given = given.cast("array<double>")
    good = (rows.select(F.col(id_column).cast("long").alias("vec_id"), given.alias("vector"))
            .where(F.col("vec_id").isNotNull() & vector.isNotNull() & fine))
    usual = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("vector") == (usual["n"] if usual else 0))
    return good.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _assign(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            leaf = tree.leaves_of(_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)],
                                             names=["vec_id", "vector", "leaf"])


def _top(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray,
         rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows for a query, by exact score and then id.

    ``rough`` scores come from a matrix product, whose rounding depends on the place in
    the matrix. All rows that may tie with the last place are scored again alike.
    """
    rough = np.where(ids == query_id, -np.inf, rough)
    if len(rough) > k:
        last = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= last - 1e-9 * max(1.0, abs(last)))
    else:
        at = np.arange(len(rough))
    at = at[np.isfinite(rough[at])]
    exact = (vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def _search(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray,
            k: int) -> pa.RecordBatch:
    found, rough = [], vectors @ queries[1].T
    for j, query_id in enumerate(queries[0]):
        near, score = _top(ids, vectors, query_id, queries[1][j], rough[:, j], k)
        found.append((np.full(len(near), query_id), near, score))
    columns = [np.concatenate(x) for x in zip(*found)]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
         pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _brute(batches: Iterator[pa.RecordBatch], queries: tuple[np.ndarray, np.ndarray],
           k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield _search(queries, part.column("vec_id").to_numpy(),
                          _matrix(part.column("vector")), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray],
                k: int = NEIGHBOURS) -> DataFrame:
    """Exact neighbours of a bounded set of queries, over all rows in blocks."""
    return best(vectors.mapInArrow(partial(_brute, queries=queries, k=k), _FOUND), k)


def _visit(batches: Iterator[pa.RecordBatch], tree: Tree, leaves: int, rows: int,
           sizes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            visited = [tree.visits(q, leaves, rows, sizes) for q in _matrix(batch.column("vector"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"),
                 pa.array(visited, pa.list_(pa.int64()))], names=["query_id", "vector", "leaves"])


def _meet(key, rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    if not rows.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64())})
    rows, queries = rows.combine_chunks(), queries.combine_chunks()
    asked = (queries.column("query_id").to_numpy(),
             _matrix(queries.column("vector").combine_chunks()))
    return pa.Table.from_batches([_search(asked, rows.column("vec_id").to_numpy(), _matrix(
        rows.column("vector").combine_chunks()), k)])


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.select("vec_id", "vector").toArrow()
    return (table.column("vec_id").to_numpy(),
            _matrix(table.column("vector").combine_chunks()) if table.num_rows else np.zeros((0, 1)))


def calibrated_visits(indexed: DataFrame, queries: DataFrame, tree: Tree, sizes: dict[int, int],
                      k: int, recall: float) -> int:
    """Fewest leaves to visit that reach ``recall`` over the calibration queries."""
    order = F.xxhash64("vec_id")
    asked = _collected(thinned(queries, order, CALIBRATION_QUERIES).orderBy(order, "vec_id")
                       .limit(CALIBRATION_QUERIES))
    truth = brute_force(indexed, asked, k).join(
        indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    if not truth:
        return 1
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.visits(q, len(sizes), 0, sizes))}
             for i, q in zip(*asked)}
    needed = np.array([order[r["query_id"]][r["leaf"]] for r in truth])
    leaves = 1
    while (needed < leaves).mean() < recall:
        leaves += 1
    return leaves


def nearest(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
            query_step: int = 20, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """Per query its ``k`` nearest rows found: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``query_step``; candidates are all rows
    with another id. The score is the inner product in double precision; ties go to the
    smaller id. See ``usable_vectors`` for the rows that take part: null, zero, broken or
    odd-sized vectors don't. With fewer than ``k`` candidates all are returned; an empty
    table gives an empty result. Equal vectors share a leaf, which blocks then divide.
    """
    spark = ready(rows.sparkSession)
    vectors = staged(usable_vectors(rows, id_column, vector_column))
    kind = vectors.schema["vector"].dataType.simpleString()
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    bounds = vectors.agg(F.sqrt(F.max(squares)), F.count(F.lit(1))).first()
    if not bounds[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Thinned out first, so that what the tasks send doesn't grow with their number.
    order = F.xxhash64("vec_id", F.lit("fit"))
    sample = _collected(thinned(vectors, order, SAMPLE_ROWS).orderBy(order, "vec_id").limit(SAMPLE_ROWS))
    tree = fit_tree(sample[1], bounds[0])

    indexed = staged(vectors.mapInArrow(
        partial(_assign, tree=tree), f"vec_id long, vector {kind}, leaf long"))
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    asked = indexed.where(F.col("vec_id") % query_step == 0).select("vec_id", "vector")
    leaves = calibrated_visits(indexed, asked, tree, sizes, k, recall)
    visits = staged(asked.mapInArrow(
        partial(_visit, tree=tree, leaves=leaves, rows=k + 1, sizes=sizes),
        f"query_id long, vector {kind}, leaves array<long>"))
    pairs = visits.select("query_id", "vector", F.explode("leaves").alias("leaf"))
    loads = {r["leaf"]: r["count"] for r in pairs.groupBy("leaf").count().collect()}

    # A row meets each block of queries of its leaf, and a query each block of rows.
    grid = spark.createDataFrame(
        [(leaf, -(-n // BLOCK_ROWS), -(-loads.get(leaf, 0) // BLOCK_QUERIES))
         for leaf, n in sizes.items()], "leaf long, row_blocks long, query_blocks long")
    grid = F.broadcast(grid.where("query_blocks > 0"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    blocked_rows = (indexed.join(grid, "leaf").withColumn(
        "row_block", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")))
        .withColumn("query_block", every("query_blocks")))
    blocked_queries = (pairs.join(grid, "leaf").withColumn(
        "query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")))
        .withColumn("row_block", every("row_blocks")))
    block = ["leaf", "row_block", "query_block"]
    met = (blocked_rows.select(*block, "vec_id", "vector").groupBy(*block)
           .cogroup(blocked_queries.select(*block, "query_id", "vector").groupBy(*block))
           .applyInArrow(partial(_meet, k=k), _FOUND))
    return best(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
