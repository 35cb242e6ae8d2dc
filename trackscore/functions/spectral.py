"""Eigenvalues of small symmetric matrices by Jacobi rotations, for states of D x D numbers.

A sweep is a round-robin tournament of the dimensions: in each of its rounds all dimensions
are paired off and all pairs are rotated at once, so a round is two passes over the matrix.
The SQL twins run the same rounds, hence both engines agree on every digit that matters.
"""

from __future__ import annotations

import numpy as np

SWEEPS = 12
#: Eigenvalues up to this share of the largest count as zero.
RANK_TOLERANCE = 1e-10


def opponents(width: int, turn: int) -> np.ndarray:
    """Who each dimension meets in a round; one that meets itself (odd widths) rests."""
    even = width + width % 2
    others = np.arange(even - 1)
    met = (2 * turn - others) % (even - 1)
    met[met == others] = even - 1
    met = np.append(met, turn % (even - 1))[:width]
    return np.where(met < width, met, np.arange(width))


def eigen(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): eigenvalues in falling order, and a row per eigenvector."""
    a = np.array(matrix, dtype=np.float64)
    width = len(a)
    if a.shape != (width, width) or not np.allclose(a, a.T, rtol=1e-9, atol=1e-12 * (np.abs(a).max(initial=0) + 1e-300)):
        raise ValueError("the matrix is not symmetric")
    v, own = np.eye(width), np.arange(width)
    for turn in range(sweeps * (width + width % 2 - 1)):
        met = opponents(width, turn % (width + width % 2 - 1))
        low, high = np.minimum(own, met), np.maximum(own, met)
        off = np.where(own == met, 0.0, a[low, high])
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            tau = (a[high, high] - a[low, low]) / (2 * off)
            t = np.where(off == 0, 0.0, np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau)))
        c = 1 / np.sqrt(1 + t * t)
        d = np.where(own < met, -t * c, t * c)
        a = c[:, None] * a + d[:, None] * a[met]
        a = a * c + a[:, met] * d
        v = c[:, None] * v + d[:, None] * v[met]
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], v[order]


def spectral_inverse(matrix: np.ndarray, tolerance: float = RANK_TOLERANCE) -> np.ndarray:
    """Inverse on the directions whose eigenvalue is above ``tolerance`` times the largest; zero on the others."""
    values, vectors = eigen(matrix)
    kept = values > tolerance * max(values[0], 0.0)
    if kept.all():
        return np.linalg.inv(matrix)
    return (vectors[kept].T / values[kept]) @ vectors[kept]
