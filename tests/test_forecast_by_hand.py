"""Forecast and growth answers with numbers worked out by hand from the published rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import series
from loomspan.operators import forecast, growth


def test_extrapolation_band_starts_at_thirty_per_cent(spark):
    # the line doubles each step: 1, 1, 1, 100 -> far above the band of the last value 100
    df = spark.createDataFrame([("a", 2020 + i, v) for i, v in enumerate([-1000.0, -500.0, 0.0, 100.0])], "area string, year int, x double")
    got = {r["step"]: r["value"] for r in forecast.extrapolate(df, ["x"], 3).collect()}
    assert got == pytest.approx({1: 130.0, 2: 135.0, 3: 140.0})
    assert forecast.outlook(np.array([-1000.0, -500.0, 0.0, 100.0]), 3).tolist() == pytest.approx([130.0, 135.0, 140.0])
    assert forecast.outlook(np.array([1.0, np.nan, 0.0]), 2).tolist() == pytest.approx([-0.5, -1.0])  # a last value of 0 doesn't bind


def test_known_steps():
    rows = forecast.known_ahead([2001, 2002, 2003], {"x": np.array([1.0, 2.0, 3.0])}, 4.0, 2)
    assert [r["trend"] for r in rows] == [3.0, 4.0] and rows[1]["trend_sq"] == 16.0 and rows[0]["country_code"] == 4.0
    # x goes on as min(4, 3 * 1.30), then min(5, 3 * 1.35)
    assert rows[0]["x_lag1"] == pytest.approx(3.9) and rows[0]["x_lag2"] == 3.0 and rows[1]["x_lag1"] == pytest.approx(4.05)
    assert rows[0]["x_ma3"] == pytest.approx((2 + 3 + 3.9) / 3) and rows[0]["x_yoy"] == pytest.approx(30.0)
    assert forecast.future_row([5.0, 10.0], "y", ["y_lag1", "y_yoy", "y_lag3", "trend", "z"], rows[0])[:2] == [10.0, 100.0]
    assert forecast.future_row([5.0, 10.0], "y", ["trend", "z"], rows[0]) == [3.0, 0.0]


def test_recursion_follows_the_trend(spark):
    """A target that the trend alone gives keeps rising, and the band of the first step is 35 %."""
    rows = [("a", 2000 + t, 100.0 + 3 * t, float(t)) for t in range(25)]
    df = spark.createDataFrame(rows, "area string, year int, y double, trend double")
    got = forecast.recursive_forecast(df, ["trend"], "y", 6, alpha=1e-6, draws=20).orderBy("year").collect()
    assert [r["forecast"] for r in got] == pytest.approx([100 + 3 * t for t in range(25, 31)], abs=1e-3)
    assert all(r["forecast"] * 0.65 - 1e-6 <= r["lower_90"] and r["upper_90"] <= r["forecast"] * 1.35 + 1e-6 for r in got[:1])


def test_growth_summary_rules(spark):
    history = spark.createDataFrame([("a", 2024, 100.0), ("b", 2024, -5.0), ("c", 2024, 50.0), ("d", 2024, 10.0)], "area string, year int, y double")
    ahead = [(k, m, y, v, v - 1, v + 1) for k, m, v0, v1 in (("a", "M1", 110.0, 200.0), ("b", "M2", 1.0, 2.0), ("c", "M3", 60.0, 150.0)) for y, v in ((2025, v0), (2030, v1))]
    ahead.append(("d", "M4", 2025, 11.0, 10.0, 12.0))
    fc = spark.createDataFrame(ahead, "area string, model string, year int, forecast double, lower_90 double, upper_90 double")
    best = spark.createDataFrame([("a", "Other", 2.0), ("b", "Other", 8.0)], "area string, model string, mape double")
    got = growth.growth_summary(history, fc, best, "y").collect()
    assert [(r["area"], r["model"], r["quality"]) for r in got] == [("c", "M3", "Poor"), ("a", "M1", "Excellent"), ("b", "M2", "Moderate")]
    assert got[1]["total_growth_pct"] == pytest.approx(100.0) and got[1]["cagr_pct"] == pytest.approx((2 ** (1 / 6) - 1) * 100)
    assert got[2]["total_growth_pct"] is None and got[2]["cagr_pct"] is None


def test_holt_fits_its_damping():
    y = 10 + np.cumsum(0.8 ** np.arange(20)) * 5  # a trend that fades by 0.8
    damped, straight = series.holt(y, 10), series.holt(y, 10, 1.0)
    assert abs(damped[-1] - (10 + 5 * (1 - 0.8**30) / 0.2)) < abs(straight[-1] - (10 + 5 * (1 - 0.8**30) / 0.2))
    assert series.holt(np.arange(12.0), 3).tolist() == pytest.approx([12, 13, 14], abs=1e-6)


def test_metadata_lists_every_area(spark):
    from loomspan.plans import prepare

    df = spark.range(1500).select(F.format_string("a%04d", "id").alias("area"), F.lit(2000).alias("year"), F.rand(1).alias("y"), F.rand(2).alias("x_lag1"))
    assert len(prepare.metadata(df, "y", ["x"], 2016, 2020, 2024)["countries"]) == 1500


def test_arma_likelihood_is_exact():
    """Against the joint normal density with the covariances written out, and the closed form of an AR(1)."""
    d = np.array([1.0, -0.4, 0.8, 2.0, -1.1, 0.3, 0.9])
    n, at = len(d), np.arange(len(d))

    def joint(p, q):
        g0, g1 = (1 + 2 * p * q + q * q) / (1 - p * p), (1 + p * q) * (p + q) / (1 - p * p)
        lag = np.abs(at[:, None] - at)
        cov = np.where(lag == 0, g0, g1 * float(p) ** np.maximum(lag - 1, 0))
        s2 = d @ np.linalg.solve(cov, d) / n
        return n * np.log(s2) + np.linalg.slogdet(cov)[1] + n * (1 + np.log(2 * np.pi))

    for p, q in ((0.5, 0.3), (-0.6, 0.8), (0.9, -0.4), (0.0, 0.5)):
        assert float(series.arma_likelihood(d, p, q)[0]) == pytest.approx(joint(p, q))
    p = 0.7
    squares = (1 - p * p) * d[0] ** 2 + ((d[1:] - p * d[:-1]) ** 2).sum()
    loss, ahead = series.arma_likelihood(d, p, 0.0)
    assert float(loss) == pytest.approx(n * np.log(squares / n) - np.log(1 - p * p) + n * (1 + np.log(2 * np.pi))) and float(ahead) == pytest.approx(p * d[-1])


def test_arima_finds_the_best():
    rng = np.random.default_rng(5)
    for p, q in ((0.7, 0.2), (-0.5, 0.4), (0.3, -0.8)):
        e, d = rng.normal(size=200), [0.0]
        for t in range(1, 200):
            d.append(p * d[-1] + e[t] + q * e[t - 1])
        y = np.cumsum(d)
        grid = np.linspace(-0.99, 0.99, 199)
        a, b = (x.ravel() for x in np.meshgrid(grid, grid))
        found = series.fit_arma(np.diff(y))
        assert float(series.arma_likelihood(np.diff(y), *found)[0]) <= series.arma_likelihood(np.diff(y), a, b)[0].min() + 1e-6
        got = series.arima111(y, 3)
        assert got[0] - y[-1] == pytest.approx(float(series.arma_likelihood(np.diff(y), *found)[1]))
        assert (got[2] - got[1]) == pytest.approx((got[1] - got[0]) ** 2 / (got[0] - y[-1]), rel=1e-6)  # steps fade by p
    assert series.arima111(np.full(10, 3.0), 2).tolist() == [3, 3]


def test_theta_is_smoothing_with_half_the_drift():
    d = np.array([1.0, 2.5, -0.5, 1.8, 0.2, 1.4, 0.9, 2.1])
    n = len(d)
    q = np.array([-0.7, -0.3, 0.4])
    loss, drift, ahead = series.ma_with_drift(d, q)
    for k, v in enumerate(q):
        cov = (1 + v * v) * np.eye(n) + v * (np.eye(n, k=1) + np.eye(n, k=-1))
        one = np.ones(n)
        c = one @ np.linalg.solve(cov, d) / (one @ np.linalg.solve(cov, one))
        s2 = (d - c) @ np.linalg.solve(cov, d - c) / n
        assert drift[k] == pytest.approx(c) and loss[k] == pytest.approx(n * np.log(s2) + np.linalg.slogdet(cov)[1] + n * (1 + np.log(2 * np.pi)))
        assert ahead[k] == pytest.approx(v * np.linalg.solve(cov, d - c)[-1])  # the last shock's share
    # a straight line: the level is the last value, and half its slope goes on
    assert series.theta(np.arange(20.0) * 2 + 5, 3).tolist() == pytest.approx([43 + 1, 43 + 2, 43 + 3], abs=0.02)
    rng = np.random.default_rng(1)
    e = rng.normal(size=400)
    y = np.cumsum(0.5 + e - np.append(0, 0.6 * e[:-1]))
    steps = np.diff(series.theta(y, 4))
    assert steps == pytest.approx(0.25, abs=0.06) and np.ptp(steps) < 1e-9
