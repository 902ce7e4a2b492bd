"""Near copies among vectors through navigable small-world graphs, one per shard.

Equal vectors of a label count as one class, which is linked once however many copies it
has. The classes of a label are dealt into shards of bounded size, and each shard gets a
hierarchical graph. Every two shards of a label meet in a task of their own, where each
class of the one searches the other's graph: down the upper layers, then with a beam over
the lowest, in which whatever is near enough is always walked on from. What is found is
verified by its cosine in double precision. A task sends back one row per class, with the
number of its links and one root for what they connect, never the pairs. How wide the
beam must be is found by audits: a bounded sample of classes is compared with all others,
and the beam widens until enough of their links are found.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import is_small, staged, stored, thinned
from gavel.llm.simhash_dedup import components

THRESHOLD = 0.93
#: Classes in a shard, more or less; what meets in a task is two shards.
SHARD_ROWS = 4096
#: Links of a node in an upper layer, and in the lowest.
LINKS, BASE_LINKS = 16, 32
#: Beam while a graph is built, and the first one that is audited.
BUILD_BEAM, FIRST_BEAM = 48, 16
#: Sampled classes whose links are compared with brute force, and the share to be found.
AUDITED, RECALL = 400, 0.98
#: Rows that walk a graph together.
BLOCK = 256
#: Partitions a job of meetings is dealt to at most.
MOST_TASKS = 20_000

_KEY = ["label", "dim"]


# Graphs


@dataclass
class Graph:
    """Unit vectors, and per layer each node's links (-1: none); layer 0 holds all nodes."""

    unit: np.ndarray
    layers: list[np.ndarray]
    entry: int

    def __post_init__(self) -> None:
        self.rough = self.unit.astype(np.float32)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _climb(graph: Graph, links: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Best node that each query reaches in a layer by always taking the best neighbour."""
    at, waiting = at.copy(), np.arange(len(at))
    best = np.einsum("ij,ij->i", queries, graph.rough[at])
    while len(waiting):
        near = links[at[waiting]]
        score = np.einsum("id,ikd->ik", queries[waiting], graph.rough[near])
        score[near < 0] = -2
        pick = score.argmax(axis=1)
        score, near = score[np.arange(len(pick)), pick], near[np.arange(len(pick)), pick]
        better = score > best[waiting]
        waiting = waiting[better]
        at[waiting], best[waiting] = near[better], score[better]
    return at


def _beam(graph: Graph, links: np.ndarray, queries: np.ndarray, at: np.ndarray, width: int,
          near_enough: float) -> np.ndarray:
    """Scores of the nodes each query has seen in a layer, -inf for the others.

    A query walks on from its best node not yet walked on from, as long as that is among
    its ``width`` best or at least ``near_enough``.
    """
    n, every = len(queries), np.arange(len(queries))
    seen = np.full((n, len(graph.rough)), -np.inf, dtype=np.float32)
    first = np.einsum("ij,ij->i", queries, graph.rough[at])
    seen[every, at] = first
    ahead = seen.copy()
    top = np.full((n, width), -np.inf, dtype=np.float32)
    top[:, 0] = first
    active = every
    while True:
        node = ahead[active].argmax(axis=1) if len(active) < n else ahead.argmax(axis=1)
        score = ahead[active, node]
        go = (score > -np.inf) & ((score >= top[active].min(axis=1)) | (score >= near_enough))
        active, node = active[go], node[go]
        if not len(active):
            return seen
        ahead[active, node] = -np.inf
        near = links[node]
        fresh = (near >= 0) & (seen[active[:, None], near] == -np.inf)
        i, j = np.nonzero(fresh)
        rows, found = active[i], near[i, j]
        score = np.einsum("ij,ij->i", queries[rows], graph.rough[found])
        seen[rows, found] = ahead[rows, found] = score
        merged = np.full((len(active), width + near.shape[1]), -np.inf, dtype=np.float32)
        merged[:, :width] = top[active]
        merged[i, width + j] = score
        top[active] = np.partition(merged, near.shape[1], axis=1)[:, near.shape[1]:]


def _select(graph: Graph, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links per row out of its candidates (-1: none) with their scores.

    The best first; one that is nearer to a chosen one than to the row itself only if
    there is room left, so that links point into different directions.
    """
    order = np.argsort(-scores, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, axis=1)
    scores = np.take_along_axis(scores, order, axis=1)
    fine = candidates >= 0
    vectors = graph.rough[candidates]
    between = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros(candidates.shape, dtype=bool)
    covered = np.full(candidates.shape, -np.inf, dtype=np.float32)
    for j in range(candidates.shape[1]):
        take = fine[:, j] & (scores[:, j] > covered[:, j]) & (chosen.sum(axis=1) < most)
        chosen[:, j] = take
        covered[take] = np.maximum(covered[take], between[take, j])
    rank = np.argsort(np.where(chosen, 0, np.where(fine, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(fine, rank, axis=1), np.take_along_axis(candidates, rank, axis=1), -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best per row, -1 where there are fewer."""
    if scores.shape[1] > most:
        at = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    score = np.take_along_axis(scores, at, axis=1)
    return np.where(score > -np.inf, np.take_along_axis(ids, at, axis=1), -1), score


def _link_back(graph: Graph, links: np.ndarray, new: np.ndarray) -> None:
    """Let the neighbours of new nodes link to them, too, keeping their best links."""
    most = links.shape[1]
    i, j = np.nonzero(links[new] >= 0)
    source, target = new[i], links[new[i], j]
    score = np.einsum("ij,ij->i", graph.rough[source], graph.rough[target])
    order = np.lexsort((-score, target))
    source, target, score = source[order], target[order], score[order]
    start = np.r_[0, np.flatnonzero(np.diff(target)) + 1]
    nth = np.arange(len(target)) - np.repeat(start, np.diff(np.r_[start, len(target)]))
    keep = nth < most
    source, target, nth = source[keep], target[keep], nth[keep]
    nodes = np.unique(target)
    for at in range(0, len(nodes), BLOCK):
        part = nodes[at:at + BLOCK]
        mine = np.isin(target, part)
        wide = np.full((len(part), 2 * most), -1, dtype=np.int64)
        wide[:, :most] = links[part]
        rows = np.searchsorted(part, target[mine])
        again = (wide[rows, :most] == source[mine][:, None]).any(axis=1)
        wide[rows, most + nth[mine]] = np.where(again, -1, source[mine])
        scores = np.einsum("id,ikd->ik", graph.rough[part], graph.rough[wide])
        scores[wide < 0] = -np.inf
        links[part] = _select(graph, wide, scores, most)


def build_graph(unit: np.ndarray, seed: int) -> Graph:
    """The graph over unit vectors. Layers are built from the highest down; nodes come in
    growing batches, each of which searches the layer as it is and then itself."""
    random = np.random.default_rng(seed)
    level = np.minimum(-np.log(1 - random.random(len(unit))) / np.log(LINKS), 8).astype(int)
    order = np.argsort(-level, kind="stable")
    graph = Graph(unit, [], int(order[0]))
    for height in range(level.max(), -1, -1):
        links = np.full((len(unit), LINKS if height else BASE_LINKS), -1, dtype=np.int64)
        members = order[level[order] >= height]
        there = np.zeros(len(unit), dtype=bool)
        there[members[0]] = True
        done = 1
        while done < len(members):
            new = members[done:done + min(done, BLOCK)]
            queries = graph.rough[new]
            start = _descend(graph, queries)
            start = np.where(there[start], start, graph.entry)
            seen = _beam(graph, links, queries, start, BUILD_BEAM, np.inf)
            ids, scores = _best(seen, np.broadcast_to(np.arange(len(unit)), seen.shape), BUILD_BEAM)
            mates = queries @ queries.T
            np.fill_diagonal(mates, -np.inf)
            more, more_scores = _best(mates, np.broadcast_to(new, mates.shape), BUILD_BEAM)
            ids, scores = _best(np.hstack([scores, more_scores]), np.hstack([ids, more]), BUILD_BEAM)
            links[new, :LINKS] = _select(graph, ids, scores, LINKS)
            _link_back(graph, links, new)
            there[new] = True
            done += len(new)
        graph.layers.insert(0, links)
    return graph


def _descend(graph: Graph, queries: np.ndarray) -> np.ndarray:
    """Where each query arrives after climbing in every layer built so far but layer 0."""
    at = np.full(len(queries), graph.entry)
    for links in reversed(graph.layers):
        at = _climb(graph, links, queries, at)
    return at


def search(graph: Graph, unit: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Which nodes (columns) are found and verified to be near each row of ``unit``."""
    near = np.zeros((len(unit), len(graph.unit)), dtype=bool)
    upper = Graph(graph.unit, graph.layers[1:], graph.entry)
    rough = threshold - 1e-4
    for at in range(0, len(unit), BLOCK):
        queries = unit[at:at + BLOCK].astype(np.float32)
        if width >= len(graph.unit):  # a beam over everything
            seen = queries @ graph.rough.T
        else:
            seen = _beam(graph, graph.layers[0], queries, _descend(upper, queries), width, rough)
        i, j = np.nonzero(seen >= rough)
        for k in range(0, len(i), 1 << 16):
            rows, found = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            exact = np.einsum("ij,ij->i", unit[at + rows], graph.unit[found])
            near[at + rows, found] = exact >= threshold
    return near


# Shards as rows


def _packed(**arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def _opened(payload: bytes) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph, ids of its classes, their sizes)."""
    kept = np.load(io.BytesIO(payload))
    layers = [kept[f"links{i}"].astype(np.int64) for i in range(int(kept["layers"]))]
    return Graph(kept["unit"], layers, int(kept["entry"])), kept["node"], kept["rows"]


def _build(key, table):
    """The graph of one shard as one row."""
    table = table.combine_chunks().sort_by("node")
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    graph = build_graph(unit_vectors(flat.astype(np.float64).reshape(table.num_rows, -1)), seed=11)
    payload = _packed(unit=graph.unit, entry=np.array(graph.entry), layers=np.array(len(graph.layers)),
                      node=table.column("node").to_numpy(), rows=table.column("rows").to_numpy(),
                      **{f"links{i}": x.astype(np.int32) for i, x in enumerate(graph.layers)})
    kept = table.slice(0, 1).select([*_KEY, "shard", "shards"])
    return kept.append_column("graph", pa.array([payload], pa.binary()))


def _roots(near: np.ndarray, offset: int) -> np.ndarray:
    """Least connected node of each row, and of each column as node number ``offset`` and up."""
    root = np.arange(max(len(near), offset + near.shape[1]))
    for at in range(0, len(near), BLOCK):
        i, j = np.nonzero(near[at:at + BLOCK])
        i, j = i + at, j + offset
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


def _meet(key, table, width, threshold):
    """Links between the classes of two shards, or within one: per class how many rows it
    is linked to, and the least class it is connected with."""
    sides = [_opened(x) for x in table.sort_by("shard").column("graph").to_pylist()]
    (one, nodes, rows), (other, nodes2, rows2) = sides[0], sides[-1]
    near = search(other, one.unit, width, threshold)
    if len(sides) == 1:
        near |= near.T
        np.fill_diagonal(near, False)
        links = np.concatenate([near[i:i + BLOCK] @ rows for i in range(0, len(near), BLOCK)])
        root = _roots(near, 0)
    else:
        near |= search(one, other.unit, width, threshold).T
        links = np.concatenate([*[near[i:i + BLOCK] @ rows2 for i in range(0, len(near), BLOCK)],
                                sum(rows[i:i + BLOCK] @ near[i:i + BLOCK] for i in range(0, len(near), BLOCK))])
        root = _roots(near, len(nodes))
        nodes = np.concatenate([nodes, nodes2])
    linked = links > 0
    return pa.table({"node": nodes[linked], "links": links[linked].astype(np.int64),
                     "root": nodes[root][linked]})


def _audit(batches: Iterator[pa.RecordBatch], sample: list, width: int,
           threshold: float) -> Iterator[pa.RecordBatch]:
    """Per shard: how many links the sampled classes have in it, and how many are found."""
    by_key: dict = {}
    for label, dim, node, vector in sample:
        by_key.setdefault((label, dim), []).append((node, vector))
    for batch in batches:
        for row in batch.to_pylist():
            asked = by_key.get((row["label"], row["dim"]))
            if not asked:
                continue
            graph, nodes, _ = _opened(row["graph"])
            unit = unit_vectors(np.array([v for _, v in asked], dtype=np.float64))
            others = np.array([n for n, _ in asked])[:, None] != nodes[None, :]
            truth = (unit @ graph.unit.T >= threshold) & others
            found = search(graph, unit, width, threshold) & others
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(truth.sum())]), pa.array([int((truth & found).sum())])], names=["links", "found"])


def audited_beam(graphs: DataFrame, classes: DataFrame, threshold: float, recall: float,
                 most: int, first: int = FIRST_BEAM) -> tuple[int, float]:
    """(width, recall) of the first beam, each twice the last, that finds enough links.

    The sample's links are counted by brute force over all rows. A beam as wide as a shard
    sees all of it.
    """
    order = F.xxhash64("node", F.lit("audit"))
    picked = thinned(classes, order, AUDITED).orderBy(order, "node").limit(AUDITED)
    sample = [(r["label"], r["dim"], r["node"], r["vector"])
              for r in picked.select(*_KEY, "node", "vector").collect()]
    width = first
    while True:
        check = partial(_audit, sample=sample, width=width, threshold=threshold)
        links, found = graphs.mapInArrow(check, "links long, found long").agg(
            F.sum("links"), F.sum("found")).first()
        reached = found / links if links else 1.0
        if reached >= recall or width >= most:
            return width, reached
        width *= 2


def _spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """One task for about each key, where a small table would otherwise become one task."""
    return df.repartition(max(1, min(2 * tasks, MOST_TASKS)), *keys)


def _linkable() -> Column:
    """Whether a row can have links at all."""
    vector = F.col("vector")
    return F.coalesce(
        F.col("label").isNotNull() & vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def _same(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which any number of rows may share one: classes with a thousandth
    of all rows or more, a thousand at most, are broadcast, the others are shuffled."""
    total = classes.agg(F.sum("rows")).first()[0] or 0
    large = F.col("rows") * 1000 > total
    few = F.broadcast(classes.where(large))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(classes.where(~large), keys)
    return rows.join(few, keys).unionByName(rest)


def near_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                 label_column: str = "label", threshold: float = THRESHOLD,
                 shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> DataFrame:
    """Per row: the id, ``n_links``, ``component_id`` and ``kept``.

    Two rows are linked if their labels are equal and their vectors, of one length, have a
    cosine of ``threshold`` or more; no link below it is ever made, and audits see to it
    that a share of ``recall`` of all is found. Rows with a null label and vectors that are
    null, zero or hold null or non-finite entries link with nothing. Equal vectors are always
    linked. ``component_id`` is the smallest id reachable, the row itself included, and
    ``kept`` says that it is the row's own. Null ids can't name a component: a row whose
    component has no other has a null one, and rows without an id are never kept. Repeated
    rows are linked like any equal vectors. Other columns are left out; an empty table gives
    an empty one.
    """
    read = stored(rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"),
                              F.col(label_column).alias("label")))
    members = read.where(_linkable()).withColumn("dim", F.size("vector"))
    classes = stored(members.groupBy(*_KEY, "vector").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("rows")).withColumn(
            "node", F.monotonically_increasing_id()))
    sizes = staged(classes.groupBy(*_KEY).agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")))
    tasks, meetings = sizes.agg(F.sum("shards"), F.sum(F.col("shards") * (F.col("shards") + 1) / 2)).first()
    dealt = classes.join(F.broadcast(sizes) if is_small(sizes) else sizes, _KEY).withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards")))
    kind = classes.schema["label"].dataType.simpleString()
    graphs = stored(_spread(dealt.select(*_KEY, "shard", "shards", "node", "rows", "vector"),
                            tasks or 1, *_KEY, "shard").groupBy(*_KEY, "shard").applyInArrow(
        _build, f"label {kind}, dim int, shard long, shards long, graph binary"))
    width, _ = audited_beam(graphs, classes, threshold, recall, 2 * shard_rows)

    pairs = graphs.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    pairs = pairs.withColumns({"low": F.least("shard", "with"), "high": F.greatest("shard", "with")})
    met = staged(_spread(pairs.select(*_KEY, "low", "high", "shard", "graph"), int(meetings or 1),
                         *_KEY, "low", "high").groupBy(*_KEY, "low", "high").applyInArrow(
        partial(_meet, width=width, threshold=threshold), "node long, links long, root long"))

    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = staged(classes.select(*_KEY, "vector", "first", "rows", "node").join(links, "node", "left").join(
        roots.withColumnRenamed("root", "_root"), "node", "left").withColumn(
            "_root", F.coalesce("_root", "node")))
    named = rooted.groupBy("_root").agg(F.min("first").alias("component_id"))
    judged = staged(rooted.join(named, "_root").select(
        *_KEY, "vector", "rows", "component_id",
        (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    linked = _same(members, judged, [*_KEY, "vector"]).select("vec_id", "n_links", "component_id")
    # Whatever can't be linked stays alone.
    alone = read.where(~_linkable()).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                       F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("vec_id").alias(id_column), "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
