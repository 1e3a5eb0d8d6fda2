"""Whitening against exact fractions and a library's eigenvalues on small tables."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from loomtrace.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, _n long"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA).repartition(3)


def exact(vectors):
    """(n, sums, V) of the usable vectors, V in fractions."""
    x = [[floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(row, sums)] for row in x]
    return x, n, sums, [[sum(r[i] * r[j] for r in centred) / n for j in range(len(sums))] for i in range(len(sums))]


def matrices():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 40):
        a = rng.standard_normal((n, n))
        q = np.linalg.qr(a)[0]
        yield from (a @ a.T, np.eye(n) * 3, np.zeros((n, n)), (q * np.repeat([5.0, 1.0], [n // 2, n - n // 2])) @ q.T, (q * 10.0 ** -np.arange(n)) @ q.T, np.ones((n, n)))


@pytest.mark.parametrize("matrix", list(matrices()), ids=lambda m: str(len(m)))
def test_eigenpairs_with_clusters_and_zeros(matrix):
    values, vectors = whitening.eigenpairs(matrix, 32)
    size = max(np.abs(matrix).max(), 1e-300) * len(matrix)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][: len(values)]).max() < 1e-14 * size
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-13 * size
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13


def test_sturm_counts():
    matrix = np.diag([3.0, 1.0, 4.0, 1.0]) + np.diag([2.0, 0.0, 5.0], 1) + np.diag([2.0, 0.0, 5.0], -1)
    at = np.array([-9.0, 0.0, 1.0, 2.5, 9.0])
    assert whitening.count_below(np.diag(matrix), np.diag(matrix, 1), at).tolist() == [int((np.linalg.eigvalsh(matrix) < x).sum()) for x in at]


def test_whole_results_by_fractions(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((60, 5)) @ rng.standard_normal((5, 5))).astype(np.float32).tolist()
    vectors += [vectors[0]] * 20 + [None, [], [1.0, None, 1.0, 1.0, 1.0], [nan] * 5, [inf] + [0.0] * 4, [1.0, 2.0]]
    ids = [*range(60), *[0] * 20, 90, 91, 92, 93, None, 95]
    out = whitening.whiten(table(spark, vectors, ids)).collect()
    x, n, sums, cov = exact(vectors[:80])
    values, axes = np.linalg.eigh(np.array(cov, float))
    values, axes = values[::-1], axes[:, ::-1].T
    assert len(out) == 80 * 5 and {r.n for r in out} == {80} and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    far = {}
    for i, row in zip(ids, x):
        far[i] = sum((n * c - s) ** 2 for c, s in zip(row, sums))
    assert all(r.deviation == far[r.vec_id] for r in out)
    for k in range(5):
        mine = sorted((r.vec_id, r.whitened) for r in out if r.component == k + 1)
        want = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(row, sums)] for row in x]) @ axes[k] / np.sqrt(values[k])
        best = max(abs(a - b) for (_, a), (_, b) in zip(mine, sorted(zip(ids, want))))
        turned = max(abs(a - b) for (_, a), (_, b) in zip(mine, sorted(zip(ids, -want))))
        assert min(best, turned) < 1e-9
        assert {round(r.explained, 9) for r in out if r.component == k + 1} == {round(values[k] / values.sum(), 9)}


def test_large_entries_stay_exact(spark):
    vectors = [[1e6, 0.0], [-1e6, 1.0], [3e5, -2.0], [1e30, 5.0], [2.0, 7.0]]
    out = whitening.whiten(table(spark, vectors[:3])).collect()
    x, n, sums, _ = exact(vectors[:3])
    want = {i: min(sum((n * c - s) ** 2 for c, s in zip(row, sums)), (1 << 63) - 1) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in out} == want and out[0].identity_error < 1e-6
    assert max(r.deviation for r in whitening.whiten(table(spark, vectors)).collect()) == (1 << 63) - 1


def test_nothing_to_whiten(spark):
    for vectors in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[1.0]]):
        assert whitening.whiten(table(spark, vectors)).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]]).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {r.component for r in whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 4.0]])).collect()} == {1}


def test_query_over_its_table(spark, sf):
    from loomtrace.llm.queries import op11_embedding_whitening

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = op11_embedding_whitening(spark, sf).toPandas()
    vectors = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], np.float32)
    x = np.floor(64 * vectors.astype(float))
    cov = np.cov(x.T, bias=True)
    values = np.linalg.eigvalsh(cov)[::-1][:32]
    assert len(out) == 32 * len(vectors) and (out.identity_error < 1e-4).all()
    got = out.groupby("component").explained.first().to_numpy()
    assert np.allclose(got, values / np.trace(cov), rtol=1e-8)
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-6
