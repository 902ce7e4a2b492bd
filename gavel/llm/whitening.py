"""Whitening vectors by their largest principal components, found by contour integration.

The covariance of all vectors is gathered by Spark as partial moments of each task, each
centred on its own mean, and put together exactly as Chan, Golub and LeVeque do for
variances. What then comes to the driver is one matrix of the vectors' dimensions, however
many vectors there are. Its eigenvectors are found by FEAST: the spectrum is cut into
slices by counting eigenvalues above a shift (the inertia of the shifted matrix); per
slice, solves of the shifted matrix at the nodes of a quadrature around the slice project
a block of vectors onto its eigenspace, and Rayleigh-Ritz in that space gives the pairs.
The inertia also says how many there must be, so none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import staged

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and beyond aren't whitened; sums over a batch must fit a long.
LARGEST = 2.0 ** 40
#: Eigenvalues in a slice of the spectrum, if none coincide at its end.
SLICE = 8
#: Nodes of the quadrature on the upper half of the circle around a slice.
NODES = 8
#: Rounds after which a slice that doesn't settle is cut in two.
MAX_ROUNDS = 20
#: Eigenvalues nearer than this share of the largest aren't parted between slices.
SAME = 1e-9


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above ``shift``.

    By Sylvester's law these are the positive pivots of an LDL^T factorisation of the
    shifted matrix, with 1x1 and 2x2 pivots chosen as Bunch and Kaufman do.
    """
    a = matrix - shift * np.eye(len(matrix))
    bound, positive = (1 + math.sqrt(17)) / 8, 0
    while len(a):
        if len(a) == 1:
            return positive + int(a[0, 0] > 0)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1
        largest = column[r - 1]
        if largest == 0:
            positive += int(a[0, 0] > 0)
            a = a[1:, 1:]
            continue
        pivot, two = 0, False
        if abs(a[0, 0]) < bound * largest:
            row = np.abs(a[r])
            row[r] = 0
            across = row.max()
            if abs(a[0, 0]) * across >= bound * largest ** 2:
                pivot = 0
            elif abs(a[r, r]) >= bound * across:
                pivot = r
            else:
                two = True
        if two:
            order = [0, r, *[i for i in range(1, len(a)) if i != r]]
            a = a[np.ix_(order, order)]
            block, below = a[:2, :2], a[2:, :2]
            positive += 1  # such a block has one pivot of each sign
            a = a[2:, 2:] - below @ np.linalg.solve(block, below.T)
        else:
            order = [pivot, *[i for i in range(len(a)) if i != pivot]]
            a = a[np.ix_(order, order)]
            positive += int(a[0, 0] > 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0]) / a[0, 0]
    return positive


def _nth_largest(matrix: np.ndarray, n: int, low: float, high: float) -> float:
    """The n-th largest eigenvalue, from 1, by bisection on the inertia."""
    while high - low > 1e-10 * max(abs(low), abs(high)):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if inertia(matrix, middle) >= n:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def _slices(matrix: np.ndarray, wanted: int, floor: float, top: float) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues inside), from the largest down to ``wanted`` or more."""
    total, out, high, above = inertia(matrix, floor), [], top, 0
    wanted = min(wanted, total)
    while above < wanted:
        n = min(above + SLICE, wanted)
        last = _nth_largest(matrix, n, floor, high)
        while n < total:
            following = _nth_largest(matrix, n + 1, floor, high)
            if last - following > SAME * top:
                break
            last, n = following, n + 1
        low = (last + following) / 2 if n < total else (last + floor) / 2
        out.append((low, high, n - above))
        high, above = low, n
    return out


def _feast(matrix: np.ndarray, low: float, high: float, count: int,
           random: np.random.Generator) -> np.ndarray | None:
    """The ``count`` eigenvectors whose eigenvalues lie between low and high.

    None if the quadrature doesn't part them well enough from those outside.
    """
    size = len(matrix)
    norm = np.abs(matrix).sum(axis=1).max()
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = math.pi / 2 * (1 - nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    width = min(size, count + max(4, count // 2))
    basis = np.linalg.qr(random.standard_normal((size, width)))[0]
    found, best = None, math.inf
    for _ in range(MAX_ROUNDS):
        projected = np.zeros_like(basis)
        for angle, weight in zip(angles, weights):
            turn = np.exp(1j * angle)
            solved = np.linalg.solve((centre + radius * turn) * np.eye(size) - matrix, basis)
            projected += weight / 2 * (radius * turn * solved).real
        space = np.linalg.qr(projected)[0]
        values, inner = np.linalg.eigh(space.T @ matrix @ space)
        vectors = space @ inner
        off = np.abs(matrix @ vectors - vectors * values).max(axis=0) / norm
        off[(values <= low) | (values >= high)] = math.inf
        # Mixtures of vectors from outside may look like more; the right ones fit best.
        chosen = np.argsort(off, kind="stable")[:count]
        worst = off[chosen].max()
        if worst < best / 2:
            found, best = vectors[:, chosen], worst
        elif best < 1e-11:  # no longer improving
            return found
        if best < 1e-16:
            return found
        basis = vectors
    return found if best < 1e-11 else None


def _eigenvectors(matrix: np.ndarray, low: float, high: float, above: int, count: int, same: float,
                  random: np.random.Generator) -> list[np.ndarray]:
    """Eigenvectors of a slice with ``above`` eigenvalues beyond it, in one or more parts.

    A circle that reaches far compared with the distance of the next eigenvalue outside
    parts them badly. Such a slice is cut at its widest gap, and one that can't be cut
    gets a smaller circle.
    """
    found = _feast(matrix, low, high, count, random)
    if found is not None:
        return [found]
    values = [_nth_largest(matrix, above + n, low, high) for n in range(1, count + 1)]
    gaps = [a - b for a, b in zip(values, values[1:])]
    if not gaps or max(gaps) <= same:
        reach = min(values[-1] - low, high - values[0]) / 2
        if reach <= same:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but not all were found")
        return _eigenvectors(matrix, values[-1] - reach, values[0] + reach, above, count, same, random)
    n = int(np.argmax(gaps)) + 1
    cut = (values[n - 1] + values[n]) / 2
    return [*_eigenvectors(matrix, cut, high, above, n, same, random),
            *_eigenvectors(matrix, low, cut, above + n, count - n, same, random)]


def principal_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of a covariance, falling, and their unit vectors as columns.

    At most ``wanted``, and none that rounding can't tell from zero.
    """
    if not len(matrix) or not np.trace(matrix) > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    size = float(np.abs(matrix).sum(axis=1).max())
    floor, top = 1e-13 * len(matrix) * size, size * (1 + 1e-9)
    random = np.random.default_rng(13)
    parts, above = [], 0
    for low, high, count in _slices(matrix, wanted, floor, top):
        parts += _eigenvectors(matrix, low, high, above, count, SAME * top, random)
        above += count
    # One more Rayleigh-Ritz step over all slices makes their vectors orthogonal.
    space = np.linalg.qr(np.hstack(parts))[0]
    values, inner = np.linalg.eigh(space.T @ matrix @ space)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], space @ inner[:, order]


# Moments of many rows


@dataclass(frozen=True)
class Moments:
    """Number of rows, their sums (exact where the rows are whole) and their covariance."""

    n: int
    sums: list
    covariance: np.ndarray


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _partial(batches: Iterator[pa.RecordBatch], project) -> Iterator[pa.RecordBatch]:
    """One row per task: how many rows, their sums, and the products about their mean.

    Sums are texts: those of whole numbers may exceed 64 bits.
    """
    n, mean, sums, gram = 0, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = project(_matrix(batch.column(0), np.int64))
        k, own = len(x), x.sum(axis=0).astype(object)
        centre = (own / k).astype(np.float64)
        about = x - centre
        if n:
            gap = centre - mean
            gram += about.T @ about + np.outer(gap, gap) * (n * k / (n + k))
            mean, sums = mean + gap * (k / (n + k)), sums + own
        else:
            mean, sums, gram = centre, own, about.T @ about
        n += k
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([[repr(v) for v in sums]], pa.list_(pa.string())),
             pa.array([gram[np.triu_indices(len(mean))].tolist()], pa.list_(pa.float64()))],
            names=["n", "sums", "gram"])


def _between(batches: Iterator[pa.RecordBatch], mean: np.ndarray,
             number: type) -> Iterator[pa.RecordBatch]:
    """Per task, the products of its mean's distance from ``mean``, as often as it has rows."""
    for batch in batches:
        for n, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            gap = np.array([number(s) / n for s in sums]) - mean
            yield pa.RecordBatch.from_arrays(
                [pa.array([(np.outer(gap, gap) * n)[np.triu_indices(len(gap))].tolist()],
                          pa.list_(pa.float64()))], names=["gram"])


def _summed(rows: DataFrame, column: str, total: Column) -> list:
    """Sums of the arrays of all rows, element by element."""
    by_place = rows.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(total.alias("v"))
    return [r["v"] for r in by_place.orderBy("i").collect()]


def moments(vectors: DataFrame, project=None) -> Moments:
    """Moments of ``x`` (array of long), or of what ``project`` makes of a block of them.

    Each task sends one row; these are added up by Spark, so the driver gets one number
    per pair of dimensions.
    """
    number, kind = (int, "decimal(38,0)") if project is None else (float, "double")
    parts = staged(vectors.select("x").mapInArrow(
        partial(_partial, project=project or _unchanged), "n long, sums array<string>, gram array<double>"))
    n = parts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return Moments(0, [], np.zeros((0, 0)))
    sums = [number(s) for s in _summed(parts, "sums", F.sum(F.col("v").cast(kind)))]
    mean = np.array([s / n for s in sums])
    between = parts.select("n", "sums").mapInArrow(partial(_between, mean=mean, number=number), "gram array<double>")
    upper = np.array(_summed(parts.select("gram").union(between), "gram", F.sum("v")))
    matrix = np.zeros((len(mean), len(mean)))
    matrix[np.triu_indices(len(mean))] = upper / n
    return Moments(n, sums, matrix + np.triu(matrix, 1).T)


def _unchanged(x: np.ndarray) -> np.ndarray:
    return x


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n*x - sums without rounding, in whole numbers that may exceed 64 bits."""
    reach = max(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n, max(map(abs, sums)))
    if reach < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


@dataclass(frozen=True)
class Whitener:
    """Sends a block of vectors to their whitened coordinates."""

    n: int
    sums: list
    projection: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        about = _centred(x, self.n, self.sums)
        return (about / self.n).astype(np.float64) @ self.projection

    def deviations(self, x: np.ndarray) -> list:
        """Sum of (n*x - sums)^2 per row, exact; None beyond 64 bits."""
        about = _centred(x, self.n, self.sums)
        if about.dtype == object or float(np.abs(about).max(initial=0)) ** 2 * about.shape[1] >= 2.0 ** 62:
            about = about.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (about * about).sum(axis=1)]


def _apply(batches: Iterator[pa.RecordBatch], whitener: Whitener) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(whitener.deviations(x), pa.int64()),
                 pa.array(whitener(x).tolist(), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x): each entry c of a vector as the long floor(64 c) + 1000000.

    Vectors that are null or empty, hold null or non-finite entries or entries of
    ``LARGEST`` and beyond, or differ in length from most others are left out.
    """
    vector = F.col("vector")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (
        F.size(vector) > 0)
    good = rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast(
        "array<double>").alias("vector")).where(vector.isNotNull() & fine)
    usual = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vector") == (usual["n"] if usual else 0)).select(
        "vec_id", F.transform("vector", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: its whitened coordinate, and what belongs to it.

    Columns: the id, ``component`` (from 1, by falling eigenvalue), ``n`` vectors in the
    fit, ``deviation`` (sum over dimensions of (n*x - S)^2; null beyond a long),
    ``whitened``, ``explained`` (share of the variance) and ``identity_error`` (largest
    entry by which the covariance of all whitened rows differs from the identity).
    ``whole_vectors`` says which rows take part. Repeated rows and null ids count and come
    back like any others; other columns are left out. Fewer components come back where the
    vectors span fewer dimensions, none where all are equal or the table is empty.
    Eigenvalues that coincide leave their vectors free up to a rotation, which is the same
    for all rows.
    """
    vectors = whole_vectors(rows, id_column, vector_column)
    fitted = moments(vectors)
    values, columns = principal_components(fitted.covariance, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    whitener = Whitener(fitted.n, fitted.sums, columns / np.sqrt(values))
    error = 0.0
    if len(values):
        error = float(np.abs(moments(vectors, whitener).covariance - np.eye(len(values))).max())
    else:
        vectors = vectors.where("false")
    explained = F.array(*[F.lit(float(e)) for e in values / max(np.trace(fitted.covariance), 1e-300)])
    done = vectors.mapInArrow(partial(_apply, whitener=whitener),
                              f"vec_id {kind}, deviation long, whitened array<double>")
    spread = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(
        F.col("vec_id").alias(id_column), (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained.cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"))
