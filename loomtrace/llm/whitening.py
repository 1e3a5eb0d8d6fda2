"""Embedding whitening: exact distributed moments, own symmetric eigensolver, broadcast projection.

Entries become integers, so sums and products over all rows are exact whatever the
order of tasks. The first pass takes counts and sums. The second centres every row on
the integer nearest to the mean before it multiplies; what the rounding of the centre
leaves is taken off exactly, in Python's integers. The matrix has one row for each
dimension, never for each vector, so it is solved on the driver:

* Householder reflections turn it into a tridiagonal one;
* bisection on Sturm counts finds each leading eigenvalue to the last bits;
* inverse iteration finds its vector, made orthogonal to those of the same cluster,
  and the reflections turn it back.

The components, a bounded matrix, go to all tasks, and a third pass over the projected
rows takes the covariance that they have in fact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components that are kept, steps of a unit in the integers, and what is added to them.
COMPONENTS, STEPS, OFFSET = 32, 64, 1_000_000
#: Rows multiplied at once; sums stay exact in doubles while they are under 2**53.
ROWS = 4_096
#: Eigenvalues nearer than this share of the matrix norm are one cluster, and how often an inverse iteration is repeated.
CLUSTER, REPEATS = 1e-3, 4
#: Entries whose integer would be greater count as this; doubles beyond it have no such steps.
LARGEST = 1 << 52
_LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entries = vector.cast("array<double>")
    fine = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine, F.lit(False)) & (F.size(entries) > 0)


def _block(vectors: pa.Array) -> np.ndarray:
    """The rows of vectors of one length as the integers that they stand for."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(STEPS * flat.reshape(len(vectors), -1)), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _wide(x: np.ndarray, power: int = 1) -> np.ndarray:
    """``x``, in Python's integers if sums of that power of it might pass 64 bits."""
    return x.astype(object) if int(np.abs(x).max(initial=0)) ** power * len(x) >= _LONG else x


def _summed(rows: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], int]:
    """Exact sums over ``rows(size, vector)`` by (size, place) of what ``sums`` makes of a block of integers.

    A task sends one row for each place, not for each vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes):
                mine = batch.column(1).take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, len(mine), ROWS):
                    held[int(size)] = held.get(int(size), 0) + sums(_block(mine.slice(at, ROWS))).astype(object)
        for size, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), size, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["size", "place", "total"])

    parts = rows.mapInArrow(run, "size int, place int, total decimal(38,0)")
    return {(r.size, r.place): int(r.total) for r in parts.groupBy("size", "place").agg(F.sum("total").alias("total")).collect()}


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, sums) of the vectors of the commonest length, the longest of several; (0, []) of none."""
    found = _summed(rows, lambda x: np.concatenate([[len(x)], _wide(x).sum(axis=0)]))
    if not found:
        return 0, []
    n, size = max((total, size) for (size, place), total in found.items() if not place)
    return n, [found[size, 1 + i] for i in range(size)]


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of the products of all pairs of columns, the upper triangle row by row, exact."""
    upper = np.triu_indices(y.shape[1])
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z)[upper].astype(np.int64)
    wide = _wide(y, 2)
    return (wide.T @ wide)[upper]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor ``n``) of the integer vectors, each entry exact but for its last rounding."""
    size = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    mid = np.array(centre, np.int64)
    mine = rows.where(F.col("size") == size)
    found = _summed(mine, lambda x: _products(x - mid))
    rest = [s - n * c for s, c in zip(sums, centre)]
    out = np.zeros((size, size))
    for place, (i, j) in enumerate(zip(*np.triu_indices(size))):
        # Whole numbers in Python, so nothing is lost before the one division.
        out[i, j] = out[j, i] = (n * found[size, place] - rest[i] * rest[j]) / (n * n)
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix, by Householder.

    Column ``k`` of the reflections is the unit vector of the k-th one, or zero where none was needed.
    """
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    mirrors = np.zeros((n, max(0, n - 2)))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x[1:]).max(initial=0.0)
        if not scale:
            continue
        v = x / max(scale, abs(x[0]))
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        mirrors[k + 1 :, k] = v
        # Both sides at once: A - v w' - w v'.
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        lead = x - 2 * (v @ x) * v
        a[k + 1 :, k] = a[k, k + 1 :] = np.concatenate([lead[:1], np.zeros(len(lead) - 1)])
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``: the Sturm count."""
    tiny = np.finfo(float).tiny
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, all bisected side by side until their bounds meet."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    slack = np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - slack, high + slack
    wanted = n - np.arange(k)
    while True:
        mid = low + (high - low) / 2
        going = (mid > low) & (mid < high)
        if not going.any():
            return mid
        enough = count_below(diagonal, off, mid) >= wanted
        high, low = np.where(going & enough, mid, high), np.where(going & ~enough, mid, low)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = b, by elimination with row exchanges; pivots under ``least`` count as ``least``."""
    n = len(diagonal)
    d, right, b = diagonal - shift, np.concatenate([off, [0.0]]), b.copy()
    rows = []
    here = [d[0], right[0], 0.0]
    for i in range(n - 1):
        under = [off[i], d[i + 1], right[i + 1]]
        if abs(under[0]) > abs(here[0]):
            here, under, b[i], b[i + 1] = under, here, b[i + 1], b[i]
        pivot = here[0] if abs(here[0]) > least else least
        factor = under[0] / pivot
        rows.append((pivot, here[1], here[2]))
        b[i + 1] -= factor * b[i]
        here = [under[1] - factor * here[1], under[2] - factor * here[2], 0.0]
    rows.append((here[0] if abs(here[0]) > least else least, 0.0, 0.0))
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - rows[i][1] * x[i + 1] - rows[i][2] * x[i + 2]) / rows[i][0]
    return x[:n]


def eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``k`` largest eigenvalues of a symmetric matrix, falling; one unit vector a row.

    Of each vector the largest entry, the first of several, is positive.
    """
    n = len(matrix)
    k = min(k, n)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading(diagonal, off, k)
    norm = max(float((np.abs(diagonal) + np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))).max()), 1e-200)
    rng, vectors, cluster = np.random.default_rng(n), np.zeros((k, n)), 0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * norm:
            cluster = i
        x = rng.standard_normal(n)
        # Equal shifts would give one vector again: they are told apart by a few units in the last place.
        shift = values[i] - (i - cluster) * np.finfo(float).eps * norm
        for _ in range(REPEATS):
            x = _solved(diagonal, off, shift, x, np.finfo(float).eps * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[cluster:i].T @ (vectors[cluster:i] @ x)
            x /= np.sqrt(x @ x)
        vectors[i] = x
    for j in range(mirrors.shape[1] - 1, -1, -1):
        vectors -= 2 * np.outer(vectors @ mirrors[:, j], mirrors[:, j])
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    sign = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return values, vectors * sign[:, None]


def _deviation(y: np.ndarray, n: int, rest: np.ndarray) -> np.ndarray:
    """Sums over dimensions of (n * y - rest)**2; one beyond a long is the largest long."""
    bound = n * int(np.abs(y).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if bound * bound * y.shape[1] < _LONG:
        return ((n * y - rest) ** 2).sum(axis=1)
    exact = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
    return np.array([min(int(v), _LONG - 1) for v in exact], np.int64)


def whiten(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so
    are those of another length than most (of equally many lengths the longest is
    taken). Repeated rows and null ids count like all others; other columns are
    ignored, whatever their names. Components whose eigenvalue is zero but for rounding
    have no unit variance and are absent, so a table of equal vectors, or an empty one, gives no rows.
    """
    entries = F.col(vector_col).cast("array<double>")
    rows = vectors.where(usable(F.col(vector_col))).select(F.size(entries).alias("size"), entries.alias("vector"), F.col(id_col).alias("id"))
    id_type = rows.schema["id"].dataType
    n, sums = moments(rows.select("size", "vector"))
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    matrix, size = covariance(rows.select("size", "vector"), n, sums), len(sums)
    values, axes = eigenpairs(matrix, components)
    kept = int((values > size * np.finfo(float).eps * np.abs(values).max(initial=0.0)).sum())
    values, axes = values[:kept], axes[:kept]
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    explained = values / np.trace(matrix)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], np.int64)
    scaled = (axes / np.sqrt(values)[:, None]).T
    mine = rows.where(F.col("size") == size)

    def projected(y: np.ndarray) -> np.ndarray:
        return (y - rest / n) @ scaled

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = projected(_block(batch.column(0).slice(at, ROWS)) - centre)
                first, second = first + w.sum(axis=0), second + w.T @ w
        total = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "total"])

    held = mine.select("vector").mapInArrow(spread, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    total = np.array([r.total for r in held])
    first, second = total[:kept] / n, total[kept:].reshape(kept, kept) / n
    error = float(np.abs(second - np.outer(first, first) - np.eye(kept)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = _block(part.column(0)) - centre
                w, far = projected(y), _deviation(y, n, rest)
                each = np.repeat(np.arange(len(y)), kept)
                columns = [part.column(1).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(y))), pa.array(np.full(len(each), n, np.int64)), pa.array(far[each])]
                columns += [pa.array(w.ravel()), pa.array(np.tile(explained, len(y))), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return mine.select("vector", "id").mapInArrow(out, schema)
