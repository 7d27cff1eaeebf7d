"""Whitening against numpy's eigenvalues in exact centring, and its defined cases."""

from fractions import Fraction

import numpy as np
import pytest

from flowlake.llm import whitening

NAN, INF = float("nan"), float("inf")


def check(frame, vectors, components=32):
    """The operator's rows against the definition, over the given usable vectors (id, vector)."""
    rows = whitening.whiten(frame, components=components).collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors], object)
    n, total = len(x), x.sum(axis=0)
    y = np.array([[float(Fraction(int(a) * n - int(s), n)) for a, s in zip(row, total)] for row in x])
    v = y.T @ y / n
    values = np.linalg.eigvalsh(v)[::-1]
    rank = int((values > 1e-9 * max(values[0], 1e-300)).sum())
    k = min(components, rank)
    assert len(rows) == n * k
    white = {}
    for r in rows:
        white.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-9 * r.explained and r.identity_error < 1e-8
    want = [(i, int(sum((int(a) * n - int(s)) ** 2 for a, s in zip(row, total)))) for (i, _), row in zip(vectors, x)]
    assert sorted(white, key=str) == sorted(set(want), key=str)
    # One vector a key here: the projections, up to sign and up to turns within equal eigenvalues.
    if len(set(want)) == n:
        w = np.array([[white[key][c + 1][0] for c in range(k)] for key in want])
        assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8)
        axes = y.T @ w / n / np.sqrt(values[:k])  # V u / e = u
        assert np.allclose(v @ axes, axes * values[:k], atol=1e-8 * values[0]) and np.allclose(y @ axes / np.sqrt(values[:k]), w, atol=1e-6)


def frame_of(spark, vectors, kind="array<float>"):
    return spark.createDataFrame([(i, v, "x") for i, v in vectors], f"vec_id long, embedding {kind}, component string").repartition(3)


def test_random_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(300, 40)) @ np.diag(2.0 ** -np.arange(40) * 8 + 0.2)
    vectors = [(k, v) for k, v in enumerate(base.astype(np.float32).astype(float).tolist())]
    check(frame_of(spark, vectors), vectors)
    check(frame_of(spark, vectors, "array<double>"), vectors, components=3)


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [(r.vec_id, list(r.embedding)) for r in rows.collect()]
    check(rows, vectors)


def test_factor_and_rotations():
    draw = np.random.default_rng(1)
    b = draw.normal(size=(12, 7))
    a = b @ b.T  # rank 7
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape == (12, 7) and np.allclose(factor @ factor.T, a)
    order = np.argsort([np.flatnonzero(row)[-1] if row.any() else 9 for row in factor], kind="stable")
    assert factor.shape[1] == 7 and np.count_nonzero(factor[order[0], 1:]) == 0  # triangular in pivot order
    values, axes = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:7]) and np.allclose(axes.T @ axes, np.eye(7)) and np.allclose(a @ axes, axes * values)
    tiny = np.diag([1e12, 1.0, 1e-6])
    assert np.allclose(whitening.one_sided_jacobi(whitening.pivoted_cholesky(tiny))[0], [1e12, 1.0, 1e-6], rtol=1e-12)


def test_rank_and_scale(spark):
    """Constant and dependent dimensions have no component; large numbers are exact."""
    vectors = [(k, [k / 8, 3.0, k / 4, (k * k % 7) / 2]) for k in range(30)]
    assert {r.component for r in whitening.whiten(frame_of(spark, vectors)).collect()} == {1, 2}
    big = [(k, [2.0**44 + 2.0**30 * (k % 5), 2.0**20 * (k % 3)]) for k in range(20)]
    rows = whitening.whiten(frame_of(spark, big, "array<double>")).collect()
    assert len(rows) == 40 and all(r.identity_error < 1e-8 for r in rows)
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in big]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((20 * a - s) ** 2 for a, s in zip(row, total)) for (i, _), row in zip(big, x)}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in rows)


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_odd_rows(spark, kind):
    draw = np.random.default_rng(2)
    good = [(k, draw.normal(size=3).astype(np.float32).astype(float).tolist()) for k in range(12)]
    good += [(None, [0.5, 0.25, -1.0]), (3, [9.0, 9.0, 9.0]), (40, [0.0, 0.0, 0.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, NAN, 2.0]), (94, [INF, 1.0, 2.0]), (95, [1.0, 2.0]), (96, [1.0, 2.0, 3.0, 4.0]), (97, [1e30, 0.0, 0.0])]
    check(frame_of(spark, good + bad, kind), good)
    repeated = good + good
    rows = whitening.whiten(frame_of(spark, repeated, kind)).collect()
    assert len(rows) == 2 * len(good) * 3 and rows[0].n == 2 * len(good)
    for few in ([], bad[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whitening.whiten(frame_of(spark, few, kind)).collect() == []
