import numpy as np
import pytest

from granary.operators import ndarray as nd
from granary.operators.random import default_rng

X = np.arange(24, dtype=float).reshape(2, 3, 4) - 7
M = np.array([[1.0, 2, 3], [4, 5, 6]])


@pytest.fixture
def x(spark):
    return nd.array(spark, X)


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-12)
    assert got.shape == np.shape(want)


def test_construction(spark):
    same(nd.zeros(spark, (2, 3)), np.zeros((2, 3)))
    same(nd.ones(spark, 4), np.ones(4))
    same(nd.full(spark, (2, 2), 7), np.full((2, 2), 7))
    same(nd.arange(spark, 2, 11, 3), np.arange(2, 11, 3))
    same(nd.arange(spark, 6, shape=(2, 3)), np.arange(6).reshape(2, 3))
    same(nd.linspace(spark, 0, 1, 5), np.linspace(0, 1, 5))
    same(nd.linspace(spark, 0, 1, 4, endpoint=False), np.linspace(0, 1, 4, endpoint=False))
    same(nd.eye(spark, 3, 4, 1), np.eye(3, 4, 1))
    same(nd.zeros_like(nd.array(spark, M)), np.zeros_like(M))
    same(nd.fromiter(spark, range(6), (2, 3)), np.arange(6.0).reshape(2, 3))
    same(nd.frombuffer(spark, b"\x01\x02", (2,)), np.array([1, 2]))
    got = nd.array(spark, np.array([1 + 2j, 3j])).to_numpy()
    assert list(got) == [1 + 2j, 3j]


@pytest.mark.parametrize("op", ["sum", "prod", "mean", "std", "var", "min", "max", "any", "all", "argmin", "argmax"])
@pytest.mark.parametrize("axis", [None, 0, 1, -1])
def test_reductions(x, op, axis):
    same(getattr(x, op)(axis=axis), getattr(X, op)(axis=axis))


def test_reduction_options(x):
    same(x.sum(axis=(0, 2)), X.sum(axis=(0, 2)))
    same(x.sum(axis=1, keepdims=True), X.sum(axis=1, keepdims=True))
    same(x.sum(axis=0, where=X > 0), X.sum(axis=0, where=X > 0))
    same(x.std(axis=0, ddof=1), X.std(axis=0, ddof=1))
    same(x.count_nonzero(axis=1), np.count_nonzero(X, axis=1))
    assert x.min(where=X > 99).item() == np.inf
    same(nd.cumulative_sum(x, axis=1), np.cumsum(X, axis=1))
    same(nd.cumulative_prod(x, axis=2), np.cumprod(X, axis=2))
    same(nd.cumulative_sum(nd.array(x.df.sparkSession, M[0]), include_initial=True), [0, 1, 3, 6])


def test_elementwise_and_broadcasting(spark, x):
    a, b = nd.array(spark, M), nd.array(spark, np.array([10.0, 20, 30]))
    same(a + b, M + [10, 20, 30])
    same(a * 2 - 1, M * 2 - 1)
    same(1 / a, 1 / M)
    same(nd.array(spark, M[:, :1]) + b, M[:, :1] + [10, 20, 30])
    same(nd.broadcast_to(b, (2, 3)), np.broadcast_to([10, 20, 30], (2, 3)))
    same(abs(x), abs(X))
    same((x > 3).where(x, 0.0), np.where(X > 3, X, 0))
    same(nd.evaluate("sin(p) * 2 + where(q > 15, q, -q)", {"p": a, "q": b}), np.sin(M) * 2 + np.where(np.array([10, 20, 30]) > 15, [10, 20, 30], [-10, -20, -30]))
    with pytest.raises(ValueError):
        a + nd.array(spark, np.ones(2))


def test_indexing(spark, x):
    for key in [0, -1, slice(1, None), (slice(None), 1), (0, slice(None, None, -1)), (..., 2), (slice(None), slice(0, 3, 2)), (1, 2, 3), (None, 0)]:
        same(x[key], X[key])
    same(x[x > 4], X[X > 4])
    same(x.oindex([1, 0], slice(None), [0, 3]), X[np.ix_([1, 0], range(3), [0, 3])])
    same(nd.take(x, [2, 0, -1], axis=1), np.take(X, [2, 0, -1], axis=1))
    same(nd.take(x, [[0, 5], [7, 23]]), np.take(X, [[0, 5], [7, 23]]))
    order = np.argsort(-X, axis=2)
    same(nd.take_along_axis(x, order, axis=2), np.take_along_axis(X, order, axis=2))
    for bad in (9, (0, 0, 0, 0)):
        with pytest.raises(IndexError):
            x[bad]
    want = X.copy()
    want[:, 1] = 0
    want[0, 0, :2] = [5, 6]
    same(x.with_values((slice(None), 1), 0).with_values((0, 0, slice(0, 2)), np.array([5.0, 6])), want)
    same(nd.array(spark, M).resize((3, 2)), [[1, 2], [4, 5], [0, 0]])
    same(nd.array(spark, M).append(M), np.concatenate([M, M]))


def test_shape(spark, x):
    same(nd.reshape(x, (4, -1)), X.reshape(4, -1))
    same(x.T, X.T)
    same(nd.permute_dims(x, (1, 0, 2)), X.transpose(1, 0, 2))
    same(nd.matrix_transpose(x), np.swapaxes(X, 1, 2))
    same(nd.expand_dims(x, (0, 2)), np.expand_dims(X, (0, 2)))
    same(nd.squeeze(nd.expand_dims(x, 1)), X)
    a, b = nd.array(spark, M), nd.array(spark, M + 10)
    same(nd.concat([a, b], axis=1), np.concatenate([M, M + 10], axis=1))
    same(nd.stack([a, b], axis=1), np.stack([M, M + 10], axis=1))
    one, two = np.array([1.0, 2, 3]), np.array([4.0, 5])
    for mode in ("xy", "ij"):
        for got, want in zip(nd.meshgrid(nd.array(spark, one), nd.array(spark, two), indexing=mode), np.meshgrid(one, two, indexing=mode), strict=True):
            same(got, want)


def test_linear_algebra(spark, x):
    a, b = nd.array(spark, M), nd.array(spark, M.T)
    same(a @ b, M @ M.T)
    same(nd.matmul(x, nd.array(spark, np.ones((4, 2)))), X @ np.ones((4, 2)))
    same(nd.matmul(a, nd.array(spark, np.array([1.0, 2, 3]))), M @ [1, 2, 3])
    same(nd.matmul(nd.array(spark, np.array([1.0, 2])), a), [1, 2] @ M)
    same(nd.tensordot(x, nd.array(spark, np.ones((3, 4, 2)))), np.tensordot(X, np.ones((3, 4, 2))))
    same(nd.tensordot(a, a, axes=([0], [0])), np.tensordot(M, M, axes=([0], [0])))
    same(nd.vecdot(a, a), (M * M).sum(axis=-1))
    same(nd.outer(a[0], b[:, 1]), np.outer(M[0], M.T[:, 1]))
    for k in (-1, 0, 1):
        same(nd.diagonal(a, k), np.diagonal(M, k))


def test_sorting(spark):
    v = np.array([3.0, 1, 2, 1, np.nan])
    same(nd.sort(nd.array(spark, v)), np.sort(v))
    same(nd.argsort(nd.array(spark, v)), np.argsort(v, kind="stable"))
    assert list(nd.iter_sorted(nd.array(spark, v[:4]), 1, 3)) == [1.0, 2.0]


def test_storage(spark, x, tmp_path):
    x.write(str(tmp_path / "x"))
    same(nd.Array.read(spark, str(tmp_path / "x")), X)
    same(nd.Array.from_bytes(spark, x.to_bytes()), X)


def test_random(spark):
    g = default_rng(spark, 5)
    n = 20_000
    for draw, mean, var in (
        (g.random(n), 0.5, 1 / 12),
        (g.uniform(2, 4, shape=n), 3, 4 / 12),
        (g.normal(1, 2, shape=n), 1, 4),
        (g.exponential(3, shape=n), 3, 9),
        (g.integers(0, 10, shape=n), 4.5, 99 / 12),
        (g.gamma(2.0, 1.5, shape=n), 3, 4.5),
        (g.poisson(4, shape=n), 4, 4),
        (g.binomial(10, 0.3, shape=n), 3, 2.1),
        (g.choice(3, shape=n, p=[0.2, 0.3, 0.5]), 1.3, 0.61),
    ):
        got = draw.to_numpy()
        assert abs(got.mean() - mean) < 0.1 and abs(got.var() - var) < 0.08 * var + 0.02, draw
    assert sorted(g.permutation(50).to_numpy()) == list(range(50))
    assert len(set(g.choice(50, shape=20, replace=False).to_numpy())) == 20
    same(default_rng(spark, 1).random((3, 4)), default_rng(spark, 1).random((3, 4)).to_numpy())
    np.testing.assert_allclose(g.dirichlet([1.0, 2.0], shape=(5,)).to_numpy().sum(axis=1), np.ones(5))
    m = np.arange(12).reshape(3, 4)
    assert (np.sort(g.permuted(m, axis=1).to_numpy(), axis=1) == m).all()


def test_nan_decides_extremes(spark):
    v = np.array([[1.0, np.nan, 0.5], [3.0, 2.0, 7.0]])
    a = nd.array(spark, v)
    for op in ("min", "max", "argmin", "argmax"):
        for axis in (None, 0, 1):
            same(getattr(a, op)(axis=axis), getattr(np, op)(v, axis=axis))


def test_running_totals_of_long_axes(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    v = np.random.default_rng(2).normal(size=(3, 11))
    a = nd.array(spark, v)
    same(nd.cumulative_sum(a, axis=1), np.cumsum(v, axis=1))
    same(nd.cumulative_sum(a), np.cumsum(v))
    same(nd.cumulative_prod(a, axis=1), np.cumprod(v, axis=1))
    whole = nd.arange(spark, 10)
    same(nd.cumulative_sum(whole, include_initial=True), np.concatenate([[0], np.cumsum(np.arange(10))]))
    assert "SinglePartition" not in nd.cumulative_sum(a, axis=1).df._jdf.queryExecution().toString()


def test_products_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 4)
    draw = np.random.default_rng(3)
    v, w = draw.normal(size=(7, 9)), draw.normal(size=(9, 5))
    got = nd.matmul(nd.array(spark, v), nd.array(spark, w))
    np.testing.assert_allclose(got.to_numpy(), v @ w, rtol=1e-9, atol=1e-12)
    stack, one = draw.normal(size=(2, 5, 6)), draw.normal(size=6)
    np.testing.assert_allclose(nd.matmul(nd.array(spark, stack), nd.array(spark, one)).to_numpy(), stack @ one, rtol=1e-9, atol=1e-12)
    whole = np.arange(12).reshape(3, 4)
    assert (nd.matmul(nd.array(spark, whole), nd.array(spark, whole.T)).to_numpy() == whole @ whole.T).all()


def test_chunk_facts(spark, x):
    a = nd.arange(spark, 60, shape=(6, 10))
    assert a.chunks_touched((slice(1, 4), 3), (2, 4)) == [0, 3]
    assert a.chunks_touched((slice(None, None, 5), slice(8, None)), (2, 4)) == [2, 8]
    assert a.chunks_touched(5, (2, 4)) == [6, 7, 8] and a.chunks_touched(slice(3, 3), (2, 4)) == []
    assert {r.chunk: (r.cells, r.low, r.high) for r in a.chunks_info((3, 10)).collect()} == {0: (30, 0, 29), 1: (30, 30, 59)}
    same(x.copy(), X)
    assert list(nd.to_utf8(nd.utf8_array(spark, ["a\0\0", "é"])).to_numpy()) == ["a", "é"]
    found = a.create_index("BUCKET").between(57, None).frame.collect()
    assert sorted(r.v for r in found) == [57, 58, 59]
