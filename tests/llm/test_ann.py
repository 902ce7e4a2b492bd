import math
import random

import numpy as np
import pytest

from gavel.llm import ann

SCHEMA = "vec_id long, embedding array<float>, vector int, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, k=20):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    for i in ids[ids % 20 == 0]:
        score = (x * x[ids == i][0]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        near = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(near) + 1
        near.append((r["vec_id"], r["score"]))
    return out


def recall(got, expected):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in expected.items())
    return hits / sum(map(len, expected.values()))


def clustered(seed, n, scale=1.0):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(12, 16))
    x = centres[random_.integers(12, size=n)] + random_.normal(size=(n, 16)) * 0.7
    return (x * random_.uniform(0.2, scale, (n, 1))).astype(np.float32)


def test_recall_and_scores(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1, 3000, 3.0))]
    got, expected = found(ann.nearest(frame(spark, rows))), brute(rows)
    assert set(got) == set(expected) and recall(got, expected) >= 0.9
    exact = {(q, i): s for q, near in brute(rows, 3000).items() for i, s in near}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12, abs_tol=1e-12)
               for q, near in got.items() for i, s in near)
    assert all(near == sorted(near, key=lambda x: (-x[1], x[0])) for near in got.values())


def test_tree_visits_only_a_part():
    x = clustered(2, 4000).astype(np.float64)
    tree = ann.fit_tree(x, float(np.sqrt((x ** 2).sum(1).max())))
    leaves = tree.leaves_of(x)
    sizes = {int(a): int(b) for a, b in zip(*np.unique(leaves, return_counts=True))}
    assert len(sizes) > 20 and all(not tree.children[n] for n in sizes)
    order = tree.visits(x[0], len(sizes), 0, sizes)
    assert sorted(order) == sorted(sizes) and len(tree.visits(x[0], 3, 0, sizes)) == 3
    assert sum(sizes[n] for n in tree.visits(x[0], 1, 500, sizes)) >= 500


def test_ties_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    pick = random.Random(5)
    same = [0.3, -0.4, 0.5]
    rows = [(i, same if i % 3 else [pick.gauss(0, 1) for _ in range(3)]) for i in range(900)]
    got, expected = found(ann.nearest(frame(spark, rows))), brute(rows)
    hot = [q for q in expected if q % 3]
    assert [got[q] == expected[q] for q in hot] == [True] * len(hot)
    assert recall(got, expected) >= 0.9


def test_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (20, [3.0, 1.0]),
            (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    assert found(ann.nearest(frame(spark, rows))) == {
        0: [(20, 5.0), (7, 3.0)], 20: [(0, 5.0), (7, 4.0)]}
    assert found(ann.nearest(frame(spark, []))) == {}
    assert found(ann.nearest(frame(spark, [(20, [1.0])]))) == {}


@pytest.mark.parametrize("equal", [True, False])
def test_tree_of_few_points(equal):
    x = np.ones((300, 4)) if equal else np.arange(20.0).reshape(5, 4)
    tree = ann.fit_tree(x, float(np.sqrt((x ** 2).sum(1).max())))
    assert tree.leaves_of(x).tolist() == [0] * len(x)


@pytest.mark.parametrize("kind", ["double", "int"])
def test_other_types_of_vectors(spark, kind):
    pick = random.Random(6)
    rows = [(i, [pick.choice([-2, -1, 0, 1, 3]) for _ in range(8)]) for i in range(200)]
    rows = [(i, v if any(v) else [1] * 8) for i, v in rows]
    make = float if kind == "double" else int
    df = spark.createDataFrame([(i, [make(c) for c in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>")
    assert recall(found(ann.nearest(df)), brute(rows)) >= 0.9
