"""Jacobi rotations and the scores that rest on them."""

import numpy as np
import pytest
from trackscore.functions.spectral import eigen, opponents, spectral_inverse
from trackscore.operators import detectors as od


def random_symmetric(width, seed, rank=None):
    x = np.random.default_rng(seed).normal(size=(rank or 2 * width, width)) * np.linspace(0.1, 3, width)
    return x.T @ x / len(x)


@pytest.mark.parametrize("width", [1, 2, 3, 6, 7])
def test_every_pair_meets_once_a_sweep(width):
    even = width + width % 2
    met = [tuple(sorted((i, int(j)))) for turn in range(even - 1) for i, j in enumerate(opponents(width, turn)) if i != j]
    assert sorted(met) == sorted([(i, j) for i in range(width) for j in range(i + 1, width)] * 2)


@pytest.mark.parametrize("matrix", [
    random_symmetric(1, 1), random_symmetric(5, 2), random_symmetric(12, 3), random_symmetric(20, 4, rank=7),
    np.zeros((4, 4)), np.eye(6), np.diag([3.0, -2.0, 0.0, 3.0]), np.ones((9, 9)), 1e-160 * random_symmetric(4, 5)])
def test_eigen_agrees_with_the_library(matrix):
    values, vectors = eigen(matrix)
    scale = max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(values / scale, np.linalg.eigvalsh(matrix)[::-1] / scale, atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(len(matrix)), atol=1e-12)
    assert np.allclose(vectors.T @ np.diag(values / scale) @ vectors, matrix / scale, atol=1e-12)


def test_inverse_of_singular_and_regular_matrices():
    regular, singular = random_symmetric(8, 6), random_symmetric(10, 7, rank=4)
    assert np.allclose(spectral_inverse(regular) @ regular, np.eye(8), atol=1e-9)
    assert np.allclose(spectral_inverse(singular), np.linalg.pinv(singular, rcond=1e-10, hermitian=True), atol=1e-8)
    assert not spectral_inverse(np.zeros((3, 3))).any()
    with pytest.raises(ValueError, match="not symmetric"):
        eigen(np.array([[1.0, 2.0], [0.0, 1.0]]))


def test_scores_and_ledger_of_few_rows(spark):
    """Six rows span five of eight dimensions."""
    x = np.random.default_rng(8).normal(size=(6, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, feature array<double>")
    state = od.fit_gaussian(rows, 8)
    got = [r.s for r in rows.select("i", od.mahalanobis_score(state.mean, state.covariance).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 5.0)  # training rows all lie equally far under their own covariance
    ledger = {r.variant: r for r in od.condition_numbers(spark, state).collect()}
    assert (ledger["full"]["rank"], ledger["full"].condition) == (5, None)
    assert ledger["ridge"]["rank"] == 8 and ledger["ridge"].condition == ledger["ridge"].kept_condition
    pca = od.principal_components(state, 5)
    error = rows.select(od.linear_autoencoder_score(pca).alias("e")).agg({"e": "max"}).first()[0]
    assert error < 1e-20 and np.allclose(pca.variances, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:5])
