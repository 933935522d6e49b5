"""One-series forecasts on numpy arrays: the few models that windows can't express. Each gives the next values."""

from __future__ import annotations

import numpy as np


def linear(y: np.ndarray, h: int = 1) -> np.ndarray:
    if len(y) < 2:
        return np.repeat(y[-1:], h)
    slope, level = np.polyfit(np.arange(len(y)), y, 1)
    return level + slope * np.arange(len(y), len(y) + h)


def _smooth(y: np.ndarray, alpha, beta, phi):
    """Holt's recursion for a whole grid of parameters at once: final level and trend, and the sum of squared one-step errors."""
    level, trend, sse = y[0] + 0 * alpha, (y[1] - y[0]) + 0 * alpha, 0 * alpha
    for x in y[1:]:
        ahead = level + phi * trend
        sse = sse + (x - ahead) ** 2
        new = ahead + alpha * (x - ahead)
        trend = phi * trend + beta * (new - level - phi * trend)
        level = new
    return level, trend, sse


DAMPING = (1.0, 0.98, 0.95, 0.9, 0.85, 0.8)


def holt(y: np.ndarray, h: int = 1, phi: float | None = None) -> np.ndarray:
    """Holt's linear trend; smoothing weights from a grid, then a finer one around the best. Damped by phi, else by the one of DAMPING with the least error."""
    if len(y) < 3:
        return np.repeat(y[-1:], h)
    best = None
    for f in DAMPING if phi is None else (phi,):
        a0, b0, width = 0.5, 0.5, 0.5
        for _ in range(3):
            a, b = np.meshgrid(np.clip(np.linspace(a0 - width, a0 + width, 11), 0.01, 0.99), np.clip(np.linspace(b0 - width, b0 + width, 11), 0.0, 0.99))
            level, trend, sse = _smooth(y, a.ravel(), b.ravel(), f)
            k = int(sse.argmin())
            a0, b0, width = a.ravel()[k], b.ravel()[k], width / 4
        if best is None or sse[k] < best[0]:
            best = sse[k], level[k], trend[k], f
    _, level, trend, f = best
    return level + np.cumsum(f ** np.arange(1, h + 1)) * trend


def damped_holt(y: np.ndarray, h: int = 1) -> np.ndarray:
    return holt(y, h, 0.85)


def ma_with_drift(d: np.ndarray, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(-2 log likelihood, drift, forecast of the next deviation) of d as drift plus MA(1), for an array of q.

    The exact one: the same filter goes over d and over a constant, and the drift is
    the weighted regression of one on the other."""
    q = np.asarray(q, float)
    r, ahead, unit, last = 1 + q * q, np.zeros(q.shape), np.zeros(q.shape), (0.0, 0.0)
    ee, eu, uu, logs = (np.zeros(q.shape) for _ in range(4))
    for x in d:
        e, u = x - ahead, 1 - unit
        ee, eu, uu, logs = ee + e * e / r, eu + e * u / r, uu + u * u / r, logs + np.log(r)
        last = q / r * e, q / r * u
        ahead, unit = last
        r = 1 + q * q - q * q / r
    n, drift = len(d), eu / uu
    return n * np.log(np.maximum(ee - eu * drift, 1e-300) / n) + logs + n * (1 + np.log(2 * np.pi)), drift, last[0] - drift * last[1]


def theta(y: np.ndarray, h: int = 1) -> np.ndarray:
    """Exponential smoothing with half the drift of an ARIMA(0,1,1), both by exact likelihood; a smoothing weight over 1 becomes 0.9998."""
    if len(y) < 3:
        return np.repeat(y[-1:], h)
    d, q, width = np.diff(y), np.linspace(-0.999, 0.999, 400), 0.005
    for _ in range(3):
        best = float(q[ma_with_drift(d, q)[0].argmin()])
        q, width = np.clip(np.linspace(best - width, best + width, 41), -0.9999, 0.9999), width / 20
    a = 0.9998 if best > 0 else 1 + best
    _, drift, ahead = (float(v[0]) for v in ma_with_drift(d, np.array([a - 1])))
    return y[-1] + ahead + drift / 2 * (np.arange(h) + (1 - (1 - a) ** len(y)) / a)


def arma_likelihood(d: np.ndarray, p, q):
    """-2 log likelihood of d as ARMA(1,1) with its variance at the maximum, for arrays of p and q, and the next value's forecast.

    The exact one: one-step forecasts and their variances (in units of the noise) start
    from the stationary law, as a Kalman filter of the two-element state would have it."""
    p, q = np.broadcast_arrays(np.asarray(p, float), np.asarray(q, float))
    r = (1 + 2 * p * q + q * q) / (1 - p * p)
    ahead, squares, logs = np.zeros(p.shape), np.zeros(p.shape), np.zeros(p.shape)
    for x in d:
        e = x - ahead
        squares, logs = squares + e * e / r, logs + np.log(r)
        ahead = p * x + q / r * e
        r = 1 + q * q - q * q / r
    n = len(d)
    return n * np.log(np.maximum(squares, 1e-300) / n) + logs + n * (1 + np.log(2 * np.pi)), ahead


def fit_arma(d: np.ndarray) -> tuple[float, float]:
    """(p, q) of greatest likelihood: the best of a grid, then simplex steps from there."""
    grid = np.linspace(-0.98, 0.98, 50)
    p, q = (x.ravel() for x in np.meshgrid(grid, grid))
    loss, _ = arma_likelihood(d, p, q)
    k = int(loss.argmin())
    # a small simplex search in a space without bounds
    cost = lambda z: float(arma_likelihood(d, 0.995 * np.tanh(z[0]), 0.995 * np.tanh(z[1]))[0])
    start = np.arctanh(np.array([p[k], q[k]]) / 0.995)
    z = [(cost(v), tuple(v)) for v in (start, start + [0.1, 0], start + [0, 0.1])]
    for _ in range(60):
        z.sort()
        if z[2][0] - z[0][0] < 1e-9:
            break
        middle, worst = (np.array(z[0][1]) + z[1][1]) / 2, np.array(z[2][1])
        tried = [(cost(v), tuple(v)) for v in (2 * middle - worst, 3 * middle - 2 * worst, (middle + worst) / 2)]
        best = min(tried)
        if best[0] < z[2][0]:
            z[2] = best
        else:
            z[1:] = [(cost(v), tuple(v)) for v in ((np.array(x[1]) + z[0][1]) / 2 for x in z[1:])]
    a, b = 0.995 * np.tanh(np.array(min(z)[1]))
    return float(a), float(b)


def arima111(y: np.ndarray, h: int = 1) -> np.ndarray:
    """ARIMA(1,1,1) without constant by exact likelihood of the differences. Where they can't tell (fewer than three, or all zero) the last value goes on."""
    d = np.diff(y)
    if len(d) < 3 or not d.any():
        return np.repeat(y[-1:], h)
    p, q = fit_arma(d)
    return y[-1] + np.cumsum(float(arma_likelihood(d, p, q)[1]) * p ** np.arange(h))


MODELS = {"Holt": holt, "DampedHolt": damped_holt, "Theta": theta, "ARIMA": arima111, "LinearTrend": linear}


def median_filled(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Gaps and infinities of x become the column medians of `like`, 0 where a column has none."""
    like = np.where(np.isfinite(like), like, np.nan)
    with np.errstate(all="ignore"):
        middle = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in like.T])
    return np.where(np.isfinite(x), x, middle)


def scaled(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    spread = like.std(axis=0)
    return (x - like.mean(axis=0)) / np.where(spread > 0, spread, 1.0)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, intercept) minimising squared error plus alpha times the squared weights. y may have several columns."""
    xm, ym = x.mean(axis=0), y.mean(axis=0)
    c = x - xm
    w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - ym))
    return w, ym - xm @ w


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, l1: float = 0.5, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Coordinate descent for squared error / 2n + alpha (l1 |w| + (1 - l1) / 2 w^2)."""
    n, xm, ym = len(y), x.mean(axis=0), y.mean()
    c, r = x - xm, y - ym
    w, norm = np.zeros(x.shape[1]), (c * c).sum(axis=0) / n
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(norm):
            rho = c[:, j] @ r / n + norm[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (norm[j] + alpha * (1 - l1))
            r, moved, w[j] = r - (new - w[j]) * c[:, j], max(moved, abs(new - w[j])), new
        if moved < 1e-7:
            break
    return w, ym - xm @ w


def bayesian_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Ridge whose penalty comes from evidence iteration with flat gamma priors (1e-6)."""
    n, xm, ym, tiny = len(y), x.mean(axis=0), y.mean(), 1e-6
    c, r = x - xm, y - ym
    values, vectors = np.linalg.eigh(c.T @ c)
    values, proj = np.maximum(values, 0), vectors.T @ (c.T @ r)
    noise, weight, w = 1 / (r.var() + 1e-12), 1.0, np.zeros(x.shape[1])
    for _ in range(rounds):
        new = vectors @ (proj / (values + weight / noise))
        gamma = (noise * values / (weight + noise * values)).sum()
        weight = (gamma + 2 * tiny) / (new @ new + 2 * tiny)
        noise = (n - gamma + 2 * tiny) / (((r - c @ new) ** 2).sum() + 2 * tiny)
        if np.abs(new - w).sum() < 1e-3:
            w = new
            break
        w = new
    return w, ym - xm @ w


LINEAR = {"Ridge": ridge, "ElasticNet": elastic_net, "BayesianRidge": bayesian_ridge}


def adf(y: np.ndarray) -> tuple[float, float, float]:
    """Augmented Dickey-Fuller with a constant, lags by AIC: (statistic, p, 5 % critical value) by MacKinnon's published surfaces."""
    from math import erfc, sqrt

    n, d = len(y), np.diff(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    fits = []
    for lags in range(max(most, 0) + 1):
        rows = np.arange(most, len(d))
        x = np.column_stack([y[rows], np.ones(len(rows)), *[d[rows - k] for k in range(1, lags + 1)]])
        b, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
        rss = ((d[rows] - x @ b) ** 2).sum()
        fits.append((len(rows) * np.log(max(rss, 1e-300) / len(rows)) + 2 * x.shape[1], lags))
    lags = min(fits)[1]
    rows = np.arange(lags, len(d))
    x = np.column_stack([y[rows], np.ones(len(rows)), *[d[rows - k] for k in range(1, lags + 1)]])
    b, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
    free = len(rows) - x.shape[1]
    if free < 1:
        return float("nan"), float("nan"), float("nan")
    s2 = ((d[rows] - x @ b) ** 2).sum() / free
    se = sqrt(max(s2 * np.linalg.pinv(x.T @ x)[0, 0], 1e-300))
    t = b[0] / se
    # MacKinnon (1994) p surfaces and (2010) 5 % critical values, constant, one series.
    small, large, low, star, high = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -18.83, -1.61, 2.74
    crit = (-2.86154, -2.8903, -4.234, -40.04)
    z = sum(c * t**k for k, c in enumerate(small if t <= star else large))
    p = 0.0 if t < low else 1.0 if t > high else 0.5 * erfc(-z / sqrt(2))
    return float(t), float(p), float(sum(c / len(rows) ** k for k, c in enumerate(crit)))
