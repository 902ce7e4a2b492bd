import numpy as np
import pytest

from gavel.llm import vector_dedup as dedup
from gavel.llm.queries import op11_embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, node string, dim int, graph int"


def plain(rows, threshold=dedup.THRESHOLD):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    def fine(v, label):
        return label is not None and v is not None and all(
            c is not None and np.isfinite(c) for c in v) and any(v)

    unit = [np.array(v) / np.linalg.norm(v) if fine(v, label) else None for _, v, label in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
                    and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return sorted([(v, links[i], least.get(find(i)), v is not None and v == least[find(i)])
                   for i, (v, _, _) in enumerate(rows)], key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "n", 1, 2) for i, v, label in rows], SCHEMA)
    out = dedup.near_vectors(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def clusters(seed, n, spread, size=16, labels=2, copies=0.1):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((n // 8, size))
    rows = []
    for i in range(n):
        vector = centres[random.integers(len(centres))] + spread * random.standard_normal(size)
        if rows and random.random() < copies:
            vector = np.array(rows[random.integers(len(rows))][1]) * random.choice([1.0, 1.0, 2.0])
        rows.append((int(i) * 7 % (7 * n + 1), vector.tolist(), int(random.integers(labels))))
    return rows


@pytest.mark.parametrize("shard_rows", [4096, 40])
@pytest.mark.parametrize("spread", [0.15, 0.25])
def test_agrees_with_all_pairs(spark, shard_rows, spread):
    """In one shard for each label, and in several that meet."""
    rows = clusters(int(spread * 100), 240, spread)
    assert run(spark, rows, shard_rows=shard_rows) == plain(rows)


def test_a_large_group_of_copies_and_one_of_near_copies(spark):
    random = np.random.default_rng(4)
    base, other = random.standard_normal(32), random.standard_normal(32)
    rows = [(i, base.tolist(), 1) for i in range(200)]
    rows += [(1000 + i, (other + 0.05 * random.standard_normal(32)).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, random.standard_normal(32).tolist(), 1) for i in range(100)]
    assert run(spark, rows, shard_rows=64) == plain(rows)


def test_chains_connect_across_shards(spark):
    step = np.arccos(0.94)
    rows = [(i, [float(np.cos(i * step)), float(np.sin(i * step))], 1) for i in range(12)]
    assert run(spark, rows, shard_rows=3) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
            (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1),
            (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1),
            (2, [2.0, 0.0], 1), (12, [1e300, 0.0], 1), (13, [1e-300, 0.0], 1)]
    expected = plain([r if r[0] not in (12, 13) else (r[0], [1.0, 0.0], 1) for r in rows])
    assert run(spark, rows) == expected
    assert run(spark, []) == [] and run(spark, rows[4:6]) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_cosine_decides_exactly_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0], 1)]
    for i, cosine in enumerate([0.929, 0.9299999, 0.9300001, 0.931]):
        rows.append((10 + i, [cosine, float(np.sqrt(1 - cosine ** 2))], 1))
        rows.append((20 + i, [cosine, -float(np.sqrt(1 - cosine ** 2))], 1))
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [8, 32])
def test_graph_search_finds_what_is_near(size):
    """Without audits, the smallest beam that queries use."""
    random = np.random.default_rng(size)
    centres = random.standard_normal((40, size))
    unit = dedup.unit_vectors(centres[random.integers(40, size=3000)] + 0.2 * random.standard_normal((3000, size)))
    graph = dedup.build_graph(unit, 1)
    found, truth = dedup.search(graph, unit, dedup.FIRST_BEAM, 0.93), unit @ unit.T >= 0.93
    assert (found & truth).sum() >= 0.97 * truth.sum() and not (found & ~truth).any()
    assert len(graph.layers) > 1 and (graph.layers[0] >= 0).any(axis=1).all()


def test_audits_widen_the_beam(spark):
    rows = clusters(9, 300, 0.25, labels=1)
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "node long, vector array<double>")
    classes = df.selectExpr("1 AS label", "16 AS dim", "node", "vector", "1L AS rows")
    graphs = classes.selectExpr("*", "0L AS shard", "1L AS shards").groupBy("label", "dim", "shard").applyInArrow(
        dedup._build, "label int, dim int, shard long, shards long, graph binary")
    width, reached = dedup.audited_beam(graphs, classes, 0.93, 1.1, 64, first=4)
    assert width == 64  # a share that can't be reached ends at the widest beam
    width, reached = dedup.audited_beam(graphs, classes, 0.93, 0.95, 4096, first=1)
    assert reached >= 0.95 and width < 4096


def test_query(spark):
    out = op11_embedding_dedup(spark, "/root/testdata/sf0.001")
    rows = [(r["vec_id"], r["embedding"], r["label"])
            for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted([tuple(r) for r in out.collect()], key=repr) == plain(rows)
