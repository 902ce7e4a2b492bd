import numpy as np
import pytest

from gavel.llm import whitening
from gavel.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, component string, x int, deviation int"


def plain(vectors, k=32):
    """(x - mean projected, eigenvalues, deviations, n) by a dense eigensolver and whole numbers."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    about = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, columns = np.linalg.eigh(about.T @ about / n)
    order = np.argsort(-values)[:k]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return about, values[order], columns[:, order], deviations, about.T @ about / n


def check(rows, ids, vectors, k=32):
    about, values, columns, deviations, cov = plain(vectors, k)
    keep = int((values > 1e-10 * values[0]).sum())
    assert len(rows) == len(ids) * keep
    at = {i: n for n, i in enumerate(ids)}
    got = np.full((len(ids), keep), np.nan)
    for r in rows:
        n = at[r["vec_id"]]
        assert r["n"] == len(ids) and r["deviation"] == deviations[n] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        got[n, r["component"] - 1] = r["whitened"]
    for c in range(keep):
        near = [e for i, e in enumerate(values) if i != c and abs(e - values[c]) < 1e-6 * values[0]]
        if not near:
            want = about @ columns[:, c] / np.sqrt(values[c])
            off = min(np.abs(want - got[:, c]).max(), np.abs(want + got[:, c]).max())
            assert off < 1e-6
    assert np.abs(got.T @ got / len(ids) - np.eye(keep)).max() < 1e-9


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], SCHEMA).repartition(5)
    return whitening.whiten(df, **options).collect()


@pytest.mark.parametrize("kind", ["plain", "flat", "short", "wide", "offset"])
def test_agrees_with_a_dense_solver(spark, kind):
    random = np.random.default_rng(len(kind))
    scale = {"flat": [1.0] * 12, "wide": list(np.logspace(3, -1, 40))}.get(kind, list(np.linspace(3, 1, 20)))
    vectors = random.standard_normal((15 if kind == "short" else 400, len(scale))) * scale
    if kind == "offset":
        vectors += 1e7
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(vectors)]
    check(run(spark, rows), [i for i, _ in rows], [v for _, v in rows])


def test_odd_rows(spark):
    random = np.random.default_rng(2)
    fine = [(i, random.standard_normal(4).tolist()) for i in range(60)] + [(61, [0.0] * 4)]
    broken = [(70, None), (71, []), (72, [1.0, None, 2.0, 3.0]), (73, [float("nan")] * 4),
              (74, [float("inf"), 1.0, 1.0, 1.0]), (75, [1.0]), (76, [1e300, 0.0, 0.0, 0.0])]
    out = run(spark, fine + broken)
    check(out, [i for i, _ in fine], [v for _, v in fine])
    assert run(spark, broken[:5]) == [] and run(spark, []) == []


def test_repeated_rows_and_null_ids(spark):
    vectors = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, [0.5, 0.25])]
    out = run(spark, vectors)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == [
        (0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in out} == {4}


def test_equal_vectors_have_no_components(spark):
    assert run(spark, [(i, [1.5, -2.0]) for i in range(9)]) == []
    # One direction only.
    out = run(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])
    assert {r["component"] for r in out} == {1} and {r["explained"] for r in out} == {1.0}


def test_deviation_beyond_a_long_is_null(spark):
    out = run(spark, [(1, [1e11, 0.0]), (2, [0.0, 1e11]), (3, [1.0, 2.0])])
    assert {r["vec_id"]: r["deviation"] for r in out}[1] is None and len(out) == 6


@pytest.mark.parametrize("values", [[5, 5, 5, 3, 3, 1, 1, 1, 1], [1] * 30, [4, 2, 1, 0, 0], list(range(1, 50)),
                                    [4000, 700, *np.linspace(69, 48, 62)], [1e6, 1e6, 1e3, *np.linspace(1.001, 1, 40)],
                                    list(np.logspace(8, 0, 60))])
def test_clustered_spectra(values):
    random = np.random.default_rng(len(values))
    basis = np.linalg.qr(random.standard_normal((len(values), len(values))))[0]
    matrix = basis @ np.diag(values) @ basis.T
    found, columns = whitening.principal_components((matrix + matrix.T) / 2, 32)
    expected = sorted((v for v in values if v), reverse=True)[:32]
    assert found == pytest.approx(expected, rel=1e-12, abs=1e-14 * max(values))
    assert np.abs(columns.T @ columns - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ columns - columns * found).max() < 1e-11 * max(values)


def test_inertia_counts():
    random = np.random.default_rng(3)
    for _ in range(200):
        size = int(random.integers(1, 20))
        matrix = random.standard_normal((size, size))
        matrix += matrix.T
        if random.random() < 0.3:
            np.fill_diagonal(matrix, 0)
        assert whitening.inertia(matrix, 0.1) == (np.linalg.eigvalsh(matrix) > 0.1).sum()


def test_query(spark):
    out = op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(out.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])
