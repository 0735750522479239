"""Numpy kernels: no Spark and no scipy here. Used inside grouped maps."""

from __future__ import annotations

import math
from functools import cache

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d if abs(1 + t * d) > tiny else tiny)
        c = 1 + t / c if abs(1 + t / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 and math.isfinite(t) else math.nan


@cache
def _window(window: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the places in a window, and what fits a polynomial to it; the same for every series."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return basis, np.linalg.pinv(basis)


def savgol(y: np.ndarray, window: int = 9, order: int = 2) -> np.ndarray:
    """Local polynomial smoothing; ends use the polynomial of the first and last window."""
    n = len(y)
    window = min(window, n if n % 2 else n - 1)
    if window <= order:
        return y.copy()
    half = window // 2
    basis, fit = _window(window, order)
    out = np.convolve(y, fit[0][::-1], mode="same")
    out[:half] = basis[:half] @ (fit @ y[:window])
    out[-half:] = basis[half + 1 :] @ (fit @ y[-window:])
    return out


def bayesian_ridge(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, shape: float = 1e-6, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Evidence maximisation on sufficient statistics: coefficients, their covariance, noise variance. shape: of the gamma prior
    of the noise precision; the other parameters of the priors are 1e-6."""
    d = len(xty)
    values, vectors = np.linalg.eigh(xtx)
    values = np.maximum(values, 0)
    alpha, beta = 1.0, n / max(yty, 1e-12)
    proj = vectors.T @ xty
    for _ in range(rounds):
        m = vectors @ (beta * proj / (alpha + beta * values))
        gamma = float((beta * values / (alpha + beta * values)).sum())
        sse = max(yty - 2 * float(m @ xty) + float(m @ xtx @ m), 1e-12)
        new_alpha, new_beta = (gamma + 2e-6) / (float(m @ m) + 2e-6), (n - gamma + 2 * shape) / (sse + 2e-6)
        done = abs(new_alpha - alpha) < 1e-6 * alpha and abs(new_beta - beta) < 1e-6 * beta
        alpha, beta = new_alpha, max(new_beta, 1e-9)
        if done:
            break
    cov = vectors @ np.diag(1 / (alpha + beta * values)) @ vectors.T
    return beta * cov @ xty, cov, 1 / beta if d else math.nan
