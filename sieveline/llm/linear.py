"""Logistic regression on sparse rows, fitted on the driver to a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, float)))


def fit_logistic(of: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, *, ridge: float, rounds: int = 120) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the log loss plus ridge/2 |w|^2, by L-BFGS from nought.

    Entry i says that row of[i] has value[i] at feature[i].
    """
    n = len(y)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] + np.bincount(of, weights=value * p[1:][feature], minlength=n)
        error = sigmoid(z) - y
        grad = np.empty_like(p)
        grad[0] = error.sum()
        grad[1:] = np.bincount(feature, weights=value * error[of], minlength=size) + ridge * p[1:]
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge * (p[1:] @ p[1:])), grad

    at = np.zeros(size + 1)
    f, g = loss(at)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, used = g.copy(), []
        for s, t, rho in reversed(past):
            a = rho * (s @ d)
            used.append(a)
            d -= a * t
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, t, rho), a in zip(past, reversed(used)):
            d += (a - rho * (t @ d)) * s
        slope, step = float(g @ d), 1.0
        while step > 1e-8:
            f2, g2 = loss(at - step * d)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * d, g2 - g
        if (st := s @ t) > 1e-12:
            past = [*past, (s, t, 1 / st)][-8:]
        at, done = at + s, f - f2 < 1e-5 * max(1.0, abs(f))
        f, g = f2, g2
        if done:
            break
    return float(at[0]), at[1:]
