from itertools import permutations, product

import numpy as np
import pytest

from ragtide.operators import transforms
from ragtide.plans import catalogue


@pytest.mark.parametrize(("name", "grid"), [("coral_ridge", {"beta": [0.0, 0.25, 0.5, 0.75, 1.0], "ridge": [0.1, 0.01, 0.001]}), ("mmd_descent", {"steps": [0.0, 50.0, 100.0], "keep": [0.01, 0.1, 1.0]})])
def test_whole_grid(spark, data, name, grid):
    got = catalogue.QUERIES[name](spark, data).select("query_id", *grid, "mean_displacement", "moved").collect()
    queries = {r.query_id for r in got}
    assert sorted(tuple(r)[:-2] for r in got) == sorted((q, *v) for q in queries for v in product(*grid.values()))
    first = next(iter(grid))
    assert any(r.moved for r in got)
    assert all((r.mean_displacement == 0) == (r[first] == 0 or not r.moved) for r in got)


def two_sides(n=4, m=6, d=5, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) + 1, rng.normal(size=(m, d)) * 2 - 1


def test_recoloured_to_the_clean_mean_and_covariance():
    p, c = two_sides(40, 50)
    raw = transforms.unit_rows

    def of(f, *more):  # before the last step to unit length, by a linear mix whose length is known
        a = f(p, c, 1.0, *more)
        return a

    ridge = of(transforms.coral_ridge, 1e-9)
    w = lambda x, e: (lambda v, q: (q * v**e) @ q.T)(*np.linalg.eigh(np.cov(x.T)))
    want = (p - p.mean(0)) @ w(p, -0.5) @ w(c, 0.5) + c.mean(0)
    assert np.allclose(np.cov(want.T), np.cov(c.T)) and np.allclose(want.mean(0), c.mean(0))
    assert np.allclose(ridge, raw(want), atol=1e-5)
    assert np.allclose(of(transforms.coral_pca), raw(want), atol=1e-6)
    half = raw(0.5 * p + 0.5 * want)
    assert np.allclose(transforms.coral_pca(p, c, 0.5), half, atol=1e-6)


def test_small_sides():
    p, c = two_sides()
    for f in (transforms.coral_pca, transforms.coral_ridge):
        assert np.allclose(f(p, c, 0.0), transforms.unit_rows(p))
        with pytest.raises(ValueError, match="two rows"):
            f(p[:1], c, 0.5)
        with pytest.raises(ValueError, match="two rows"):
            f(p, c[:1], 0.5)
    assert np.isfinite(transforms.coral_pca(p, c, 1.0)).all()
    assert np.allclose(transforms.coral_pca(p, c, 1.0, rank=0), transforms.unit_rows(np.tile(c.mean(0), (4, 1))))
    with pytest.raises(ValueError, match="either side"):
        transforms.mmd_descent(p[:0], c, 1)
    with pytest.raises(ValueError, match="must be positive"):
        transforms.mmd_descent(p, c, 1, rate=0)


def test_trace():
    p, c = two_sides()
    trace = transforms.mmd_trace(p, c, 20, keep=0.01)
    assert len(trace) == 21
    assert np.allclose(trace[0][0], transforms.unit_rows(p)) and trace[0][2] == 0
    assert trace[-1][3] < trace[0][3]
    assert np.allclose(np.linalg.norm(trace[-1][0], axis=1), 1)
    assert np.allclose(transforms.mmd_descent(p * 3, c * 2, 20, keep=0.01), trace[-1][0])


def test_descent_follows_its_loss():
    rng = np.random.default_rng(2)
    p, c = (transforms.unit_rows(rng.normal(size=(n, 5))) for n in (3, 4))

    def loss(z, keep):
        k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1)).mean()
        return k(z, z) - 2 * k(z, c) + keep * ((z - p) ** 2).sum(1).mean()

    z, keep, e = transforms.mmd_descent(p, c, 1, keep=1.0), 1.0, 1e-6
    grad = np.zeros_like(z)
    for i in np.ndindex(*z.shape):
        d = np.zeros_like(z)
        d[i] = e
        grad[i] = (loss(z + d, keep) - loss(z - d, keep)) / (2 * e)
    assert np.allclose(transforms.mmd_descent(p, c, 2, keep=keep), transforms.unit_rows(z - 0.05 * grad), atol=1e-8)


@pytest.mark.parametrize(("n", "m"), [(3, 3), (4, 6), (1, 4), (6, 4), (7, 7), (5, 2)])
def test_anchors_are_the_best_choice(n, m):
    rng = np.random.default_rng(n * 10 + m)
    p, c = (transforms.unit_rows(rng.normal(size=(k, 5))) for k in (n, m))
    offered = list(range(m)) * -(-n // m)
    sim = p @ c.T
    totals = [sum(sim[i, j] for i, j in enumerate(q)) for q in set(permutations(offered, n))]
    for strategy, best in (("nearest", max), ("farthest", min)):
        got = transforms.anchors(p, c, strategy, every=True)
        assert sim[range(n), got].sum() == pytest.approx(best(totals))
        assert np.bincount(got, minlength=m).max() <= -(-n // m)


def test_anchor_strategies():
    rng = np.random.default_rng(5)
    p, c = rng.normal(size=(9, 4)), rng.normal(size=(9, 4))
    drawn = transforms.anchors(p, c, "random")
    assert sorted(drawn) == list(range(9))
    assert list(drawn) == list(transforms.anchors(p, c, "random"))
    assert list(drawn) != list(transforms.anchors(p, c, "random", seed=1))
    with pytest.raises(ValueError, match="no such anchor strategy"):
        transforms.anchors(p, c, "closest")


def test_anchors_query_flags_repeats(spark, data):
    got = catalogue.QUERIES["e1_anchors"](spark, data)
    counts = {r[0]: r[1] for r in catalogue._top(spark, data).groupBy("query_id").agg({"is_poison": "count"}).collect()}
    poisoned = {r[0]: r[1] for r in catalogue._top(spark, data).where("is_poison").groupBy("query_id").count().collect()}
    assert {(r.query_id, r.one_to_one) for r in got.collect()} == {(q, n <= counts[q] - n) for q, n in poisoned.items()}
