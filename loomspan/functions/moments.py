"""Linear models from moments: sums and products of rows, so that one more row is a rank-one update and no fit sees the rows.

All models work on features scaled to mean 0 and deviation 1, and on several targets
at once (columns of y), which share one set of products."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Moments:
    """Sums over rows x (n, k) and y (n, m), taken about the first row so that little is lost to rounding."""

    k: int
    m: int = 1
    n: int = 0
    about: tuple[np.ndarray, np.ndarray] | None = None
    total: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.total = np.zeros((self.k + self.m + 1, self.k + self.m + 1))

    def add(self, x: np.ndarray, y: np.ndarray) -> "Moments":
        """One row or several."""
        x, y = np.atleast_2d(x).astype(float), np.asarray(y, float).reshape(-1, self.m)
        if len(x):
            if self.about is None:
                self.about = x[0].copy(), y[0].copy()
            z = np.column_stack([np.ones(len(x)), x - self.about[0], y - self.about[1]])
            self.total += z.T @ z
            self.n += len(x)
        return self

    def scaled(self, unit: bool = True) -> "Scaled":
        """Products of centred features, divided by their deviations unless `unit` is false."""
        n, k = max(1, self.n), self.k
        mean = self.total[0, 1:] / n
        inner = self.total[1:, 1:] - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(inner)[:k], 0) / n)
        spread = np.where(unit & (spread > 1e-13 * (1 + np.abs(mean[:k]))), spread, 1.0)
        x0, y0 = self.about if self.about is not None else (np.zeros(k), np.zeros(self.m))
        return Scaled(n, inner[:k, :k] / np.outer(spread, spread), inner[:k, k:] / spread[:, None], np.maximum(np.diag(inner)[k:], 0), x0 + mean[:k], spread, y0 + mean[k:])


@dataclass
class Scaled:
    """A model's input: products of scaled features among themselves (xx), with the centred targets (xy), and the targets' squares (yy)."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    level: np.ndarray

    def predict(self, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One row for each target: rows (m, k) with weights (k, m)."""
        return ((rows - self.mean) / self.spread * w.T).sum(axis=1) + self.level

    def raw(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts for unscaled features."""
        w = w / self.spread[:, None]
        return w, self.level - self.mean @ w


def ridge(s: Scaled, alpha: float = 1.0) -> np.ndarray:
    return np.linalg.solve(s.xx + alpha * np.eye(len(s.xx)), s.xy)


def elastic_net(s: Scaled, alpha: float = 0.1, l1: float = 0.5, start: np.ndarray | None = None, rounds: int = 5000) -> np.ndarray:
    """Coordinate descent on the products for squared error / 2n + alpha (l1 |w| + (1 - l1) / 2 w^2), from `start` if given."""
    w = np.zeros_like(s.xy) if start is None else start.copy()
    moves = np.flatnonzero(np.diag(s.xx) > 0)
    tiny = 1e-10 * (1 + np.abs(s.xy).max(initial=0) / s.n)
    for _ in range(rounds):
        moved = 0.0
        for j in moves:
            rho = (s.xy[j] - s.xx[j] @ w) / s.n + s.xx[j, j] / s.n * w[j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - alpha * l1, 0) / (s.xx[j, j] / s.n + alpha * (1 - l1))
            moved = max(moved, float(np.abs(new - w[j]).max()))
            w[j] = new
        if moved < tiny:
            break
    return w


def elastic_path(s: Scaled, alphas: tuple[float, ...], l1: float) -> dict[float, np.ndarray]:
    """Weights for each penalty, the largest first, each fit going on from the one before."""
    found, w = {}, None
    for alpha in sorted(alphas, reverse=True):
        found[alpha] = w = elastic_net(s, alpha, l1, w)
    return found


def bayesian_ridge(s: Scaled, rounds: int = 300) -> np.ndarray:
    """Ridge whose penalty comes from evidence iteration with flat gamma priors (1e-6); each target has its own."""
    tiny, n = 1e-6, s.n
    values, vectors = np.linalg.eigh(s.xx)
    values, proj = np.maximum(values, 0)[:, None], vectors.T @ s.xy
    noise, weight, w = 1 / (s.yy / n + 1e-12), np.ones(len(s.yy)), np.zeros_like(s.xy)
    for _ in range(rounds):
        new = vectors @ (proj / (values + weight / noise))
        gamma = (noise * values / (weight + noise * values)).sum(axis=0)
        weight = (gamma + 2 * tiny) / ((new * new).sum(axis=0) + 2 * tiny)
        left = np.maximum(s.yy - 2 * (new * s.xy).sum(axis=0) + (new * (s.xx @ new)).sum(axis=0), 0)
        noise = (n - gamma + 2 * tiny) / (left + 2 * tiny)
        done, w = np.abs(new - w).sum(axis=0).max(initial=0) < 1e-3, new
        if done:
            break
    return w


MODELS = {"Ridge": ridge, "ElasticNet": elastic_net, "BayesianRidge": bayesian_ridge}
