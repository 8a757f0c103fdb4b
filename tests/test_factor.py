"""Tall-skinny factorisation against closed forms and numpy."""

import numpy as np
import pytest

from tessera.operators import factor as FA


@pytest.fixture(scope="module")
def shipped(spark):
    from tessera.session import ship_package
    ship_package(spark)
    return spark


def rows_with(rnd, n, mean, spread, turn):
    """n rows whose sample mean is ``mean`` and covariance turn' diag(spread) turn."""
    u = rnd.standard_normal((n, len(spread)))
    u, _ = np.linalg.qr(u - u.mean(0))
    return mean + np.sqrt(n - 1) * (u * np.sqrt(spread)) @ turn


def frame(spark, sides, parts):
    rows = [(s, x.tolist()) for s, m in sides for x in m] + [(None, [0.0] * sides[0][1].shape[1]), ("a", None)]
    return spark.createDataFrame(rows, "side string, v array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 70])
def test_triangles_are_the_covariance(shipped, parts):
    rnd = np.random.default_rng(2)
    a, b = rnd.standard_normal((700, 12)) + 1e6, rnd.standard_normal((5, 12)) * 3
    got = FA.triangles(frame(shipped, [("a", a), ("b", b)], parts), "v", "side")
    for side, x in (("a", a), ("b", b)):
        mean, n, r = got[side]
        assert n == len(x) and np.allclose(mean, x.mean(0)) and r.shape[0] <= 12 + 1
        assert np.allclose(r.T @ r / (n - 1), np.cov(x.T), rtol=1e-9, atol=1e-9)


def test_distance_of_nearly_singular_data(shipped):
    """Closed form: covariances of one eigenbasis, eigenvalues down to 1e-14."""
    rnd = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rnd.standard_normal((40, 40)))
    l1, l2 = np.logspace(0, -14, 40), np.logspace(-14, 0, 40)
    m1, m2 = rnd.standard_normal(40), rnd.standard_normal(40)
    df = frame(shipped, [("a", rows_with(rnd, 300, m1, l1, turn)), ("b", rows_with(rnd, 200, m2, l2, turn))], 9)
    want = ((m1 - m2) ** 2).sum() + l1.sum() + l2.sum() - 2 * np.sqrt(l1 * l2).sum()
    assert abs(FA.frechet_distance(df, "v", "side", "a", "b") - want) < 1e-6 * want
    same = frame(shipped, [("a", rows_with(rnd, 300, m1, l1, turn)), ("b", rows_with(rnd, 250, m1, l1, turn))], 9)
    assert abs(FA.frechet_distance(same, "v", "side", "a", "b")) < 1e-6


def test_distance_against_numpy(shipped):
    rnd = np.random.default_rng(6)
    a, b = rnd.standard_normal((400, 8)) @ rnd.standard_normal((8, 8)), rnd.standard_normal((300, 8)) + 0.3
    s1, s2, d = np.cov(a.T), np.cov(b.T), a.mean(0) - b.mean(0)
    w, v = np.linalg.eigh(s1)
    half = v @ np.diag(np.sqrt(w)) @ v.T
    want = d @ d + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.linalg.eigvalsh(half @ s2 @ half)).sum()
    assert abs(FA.frechet_distance(frame(shipped, [("a", a), ("b", b)], 5), "v", "side", "a", "b") - want) < 1e-9 * want
