"""Distributions, names, class specifications and matrix models against closed forms and numpy."""

import math

import numpy as np
import pytest

from epochal.functions import dist, text
from epochal.operators import arrays, decode, design, group


def test_t_closed_forms():
    t = np.array([-3.0, -0.5, 0.0, 1.0, 4.0])
    assert np.allclose(dist.t_cdf(t, 1), 0.5 + np.arctan(t) / np.pi)
    assert np.allclose(dist.t_cdf(t, 2), 0.5 + t / (2 * np.sqrt(2 + t * t)))
    assert np.allclose(dist.t_p(t, 5), 2 * dist.t_cdf(-np.abs(t), 5))


def test_chi2_f_normal():
    x = np.array([0.1, 1.0, 3.0, 10.0, 40.0])
    assert np.allclose(dist.chi2_cdf(x, 2), 1 - np.exp(-x / 2))
    assert np.allclose(dist.chi2_cdf(x, 1), 2 * dist.normal_cdf(np.sqrt(x)) - 1)
    assert np.allclose(dist.f_cdf(x, 1, 7), 1 - dist.t_p(np.sqrt(x), 7))
    assert np.allclose(dist.normal_cdf(dist.normal_quantile(np.array([0.001, 0.3, 0.5, 0.99]))), [0.001, 0.3, 0.5, 0.99])


def test_auc_identities():
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200)
    assert dist.rank_auc(y, s) + dist.rank_auc(y, -s) == pytest.approx(1)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert dist.rank_auc(y, s) == pytest.approx(np.mean(pairs))


def test_condition_codes():
    kind = [[5, 6, 7], [13, 14, 15], [17, 18, 19]]
    first, immediate, delayed = [5, 13, 17], [6, 14, 18], [7, 15, 19]
    assert text.condition_codes([kind[1]], [first, immediate, delayed]) == "13,14,15"
    assert text.condition_codes([kind[1]], [immediate]) == "14"


def test_class_spec():
    assert design.parse_class_spec("1,2;8,9") == [(1, 1, 1, 1), (1, 1, 2, 2), (1, 2, 1, 8), (1, 2, 2, 9)]
    assert design.overlapping_codes({1: [1, 2], 2: [2, 3]}) == [2]


def test_whitening_gives_identity():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)), np.repeat([0, 1], 100)
    w = decode.whitener(x, y)
    pooled = np.mean([decode.shrink_covariance(x[y == c])[0] for c in (0, 1)], axis=0)
    assert np.allclose(w @ pooled @ w, np.eye(6), atol=1e-8)


def test_shrinkage_follows_its_definition():
    """Entry by entry: variances and covariances of the sample covariance's entries over the rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    z = x - x.mean(axis=0)
    t, n = z.shape
    s = z.T @ z / t
    sd = np.sqrt(np.diag(s))
    r = (s / np.outer(sd, sd))[~np.eye(n, dtype=bool)].mean()
    f = np.where(np.eye(n, dtype=bool), s, r * np.outer(sd, sd))
    cov = lambda i, j, k, m: np.mean((z[:, i] * z[:, j] - s[i, j]) * (z[:, k] * z[:, m] - s[k, m]))
    top = sum(cov(i, j, i, j) - r / 2 * (sd[j] / sd[i] * cov(i, i, i, j) + sd[i] / sd[j] * cov(j, j, i, j)) for i in range(n) for j in range(n) if i != j)
    expected = min(1.0, max(0.0, top / ((f - s) ** 2).sum() / t))
    got, intensity = decode.shrink_covariance(x)
    assert intensity == pytest.approx(expected) and np.allclose(got, expected * f + (1 - expected) * s)


def test_discriminant_separates_and_priors_sum():
    rng = np.random.default_rng(2)
    y = np.repeat([0, 1, 2], 50)
    x = rng.normal(size=(150, 4)) + y[:, None] * 4
    p = decode.posterior(decode.discriminant(decode.moments_of(x, y)), x)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.95


def test_basis_and_slope():
    assert np.array_equal(decode.basis(4, 0), np.eye(4))
    assert decode.basis(8, 1.5).max() == 1
    assert decode.tuning_slope([0, 1, 2, 3, 2, 1, 0]) == pytest.approx(1.0)


def test_source_separation_finds_the_biased_direction():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5))
    s = rng.normal(size=(5000, 5))
    s[:, 0] *= 1 + np.arange(5000) % 2 * 3
    x = s @ mix
    filters, score = arrays.source_separation(x.T @ x, x[1::2].T @ x[1::2])
    found = x @ filters[:, 0]
    assert abs(np.corrcoef(found, s[:, 0])[0, 1]) > 0.95 and score[0] >= score[-1]


def test_canonical_correlation_of_shared_signal():
    rng = np.random.default_rng(4)
    shared = rng.normal(size=(2000, 1))
    x, y = np.hstack([shared, rng.normal(size=(2000, 2))]), np.hstack([shared + 0.1 * rng.normal(size=(2000, 1)), rng.normal(size=(2000, 2))])
    z = np.hstack([x, y])
    r = arrays.canonical(z.T @ z, 3)[2]
    assert r[0] > 0.98 and r[1] < 0.2


def test_eight_connected_labels():
    grid = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], dtype=bool)
    assert group.label_grid(grid).max() == 3 and group.label_grid(grid)[0, 0] == group.label_grid(grid)[1, 1]


def test_robust_detrend_ignores_outliers():
    x = np.arange(100.0)
    x[50] = 5000
    assert np.abs(np.delete(arrays._detrended(x, 1, 3, 4), 50)).max() < 1


def test_quantile_ends():
    assert math.isinf(float(dist.normal_quantile(np.array(1.0))))
