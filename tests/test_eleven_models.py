"""All models in one log and one forecast table, linear models from moments, tuning grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import moments, series
from loomspan.operators import features, forecast, metrics, reshape, walkforward
from loomspan.plans import report

NAMES = ["demand_lag1", "demand_lag2", "demand_ma3", "trend"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = [(a, 2000 + t, float(100 + 20 * i + (3 + i) * t + 4 * math.sin(t) + rng.normal())) for i, a in enumerate("abcd") for t in range(25)]
    df = spark.createDataFrame(rows, "area string, year int, demand double")
    return reshape.drop_null_lags(features.trend(features.lag_features(df, ["demand"]))).cache()


def test_moments_equal_rows():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 4)) * [1, 100, 1e-3, 5] + [0, 1e4, 3, -2], rng.normal(size=40) * 30 + 500
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=40) * 0.1
    sums = moments.Moments(4)
    for k in range(40):  # one rank-one update a row
        sums.add(x[k], y[k])
        if k < 6:
            continue
        z = series.scaled(x[: k + 1], x[: k + 1])
        fit = sums.scaled()
        for name, rows, args in (("Ridge", series.ridge, {"alpha": 0.7}), ("BayesianRidge", series.bayesian_ridge, {})):
            w, b = rows(z, y[: k + 1], **args)
            assert np.allclose(moments.MODELS[name](fit, **args)[:, 0], w, rtol=1e-5, atol=1e-6) and math.isclose(fit.level[0], b, rel_tol=1e-9)
    for alpha in (0.01, 0.1, 1.0):
        for l1 in (0.2, 0.5, 0.8):
            w, _ = series.elastic_net(z, y, alpha, l1, rounds=20_000)
            assert np.allclose(moments.elastic_net(fit, alpha, l1)[:, 0], w, atol=1e-6)
            assert np.allclose(moments.elastic_path(fit, (0.01, 0.1, 1.0), l1)[alpha][:, 0], w, atol=1e-6)
    assert np.allclose(fit.predict(moments.ridge(fit), x[:1]), (series.scaled(x[:1], x) @ series.ridge(z, y)[0] + series.ridge(z, y)[1]))


def test_columns_of_targets_are_single_fits():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(30, 5))
    many = moments.Moments(3, 5).add(x, y).scaled()
    for name, fit in moments.MODELS.items():
        for j in range(5):
            assert np.allclose(fit(many)[:, j], fit(moments.Moments(3).add(x, y[:, j]).scaled())[:, 0], atol=2e-3 if name == "BayesianRidge" else 1e-8)


def test_constant_and_missing_columns(spark, panel):
    df = panel.withColumn("same", F.lit(3.0)).withColumn("gappy", F.when(F.col("year") % 3 == 0, F.lit(None)).otherwise(F.col("demand")))
    got = walkforward.linear_predictions(df, [*NAMES, "same", "gappy"], "demand", [2020, 2021])
    assert got.count() == 4 * 2 * 3 and got.where("y_pred is null or isnan(y_pred)").isEmpty()
    a, b = (walkforward.linear_predictions(df, n, "demand", [2021], ("Ridge",)).orderBy("area").collect() for n in (NAMES, [*NAMES, "same"]))
    assert [r["y_pred"] for r in a] == pytest.approx([r["y_pred"] for r in b])


def test_residuals_do_not_see_their_year():
    """The growth of year t gives its target away; residuals must be those of a row built from the years before."""
    y = np.array([100.0, 104, 99, 110, 108, 115, 113, 121, 118, 127, 125, 133, 129, 140])
    yoy = np.append(0.0, np.diff(y) / y[:-1] * 100)
    lag = np.append(np.nan, y[:-1])
    x = np.column_stack([lag, yoy])[1:]
    h = forecast.History(list(range(2001, 2014)), y[1:], x, ["y_lag1", "y_yoy"], "y", {})
    got, want = h.residuals("Ridge", {"alpha": 0.01}, 3), []
    for t in (10, 11, 12):
        z, past = x[:t], y[1 : t + 1]
        row = np.array([[past[-1], (past[-1] - past[-2]) / past[-2] * 100]])
        w, b = series.ridge(series.scaled(z, z), past, 0.01)
        want.append(y[t + 1] - float((series.scaled(row, z) @ w + b)[0]))
    assert got.tolist() == pytest.approx(want)
    seen = []
    for t in (10, 11, 12):
        w, b = series.ridge(series.scaled(x[:t], x[:t]), y[1 : t + 1], 0.01)
        seen.append(abs(y[t + 1] - float((series.scaled(x[t : t + 1], x[:t]) @ w + b)[0])))
    assert np.abs(got).mean() > 2 * np.mean(seen)


def test_one_log(spark, panel):
    log = walkforward.full_log(panel, NAMES, "demand", [2022, 2023], parameters={"RandomForest": {"numTrees": 5}, "BoostedTrees": {"maxIter": 3}}).cache()
    assert log.count() == 4 * 2 * 11 and {r[0] for r in log.select("model").distinct().collect()} == set(walkforward.ELEVEN)
    assert log.groupBy("area", "year").agg(F.count_distinct("y_actual").alias("n")).where("n <> 1").isEmpty()
    anchors = panel.where("year = 2021").select("area", F.col("demand").alias("anchor"))
    got = report.model_report(log, anchors).collect()
    assert len(got) == 44 and sum(r["best"] for r in got) == 4 and all(r["robustness_flag"] for r in got)
    best = {r["area"]: r["model"] for r in metrics.best_models(metrics.accuracy(log)).collect()}
    assert all(best[r["area"]] == r["model"] for r in got if r["best"])
    assert walkforward.full_log(panel.where("year > 2019"), NAMES, "demand", [2022], ("Naive", "Holt", "Ridge", "RandomForest")).isEmpty()


def test_all_forecasts(spark, panel):
    got = forecast.all_forecasts(panel, NAMES, "demand", 3, parameters={"RandomForest": {"numTrees": 5}, "BoostedTrees": {"maxIter": 3}}).collect()
    assert len(got) == 4 * 11 * 3 and {r["year"] for r in got} == {2025, 2026, 2027}
    last = {r["area"]: r["demand"] for r in panel.where("year = 2024").collect()}
    for r in got:
        room = last[r["area"]] * (0.40 + 0.10 * (r["year"] - 2025))
        assert last[r["area"]] - room - 0.01 <= r["forecast"] <= last[r["area"]] + room + 0.01
    assert forecast.series_forecasts(panel, "demand", 2, ("Whatever",)).where("area = 'a'").select("forecast").distinct().collect()[0][0] == last["a"]


def test_tree_steps_are_the_recursion(spark, panel):
    """A tree model's steps against the same model asked row by row, with a column drawn out ahead."""
    from pyspark.ml.linalg import Vectors

    df = features.lag_features(panel.withColumn("other", F.col("demand") * 2 + F.col("year") % 4), ["other"]).where("year > 2005")
    names = [*NAMES, "demand_yoy", "demand_ma5", "other_lag1", "other_lag2", "other_ma3", "other_yoy", "unheard"]
    df = df.withColumn("unheard", F.lit(1.5))
    got = {(r["area"], r["year"]): r["forecast"] for r in forecast.tree_forecasts(df, names, "demand", 3, ["other"], ("BoostedTrees",), {"BoostedTrees": {"maxIter": 5}}).collect()}
    rows, release = walkforward.assembled(df, names, "demand")
    fitted = walkforward.tree("BoostedTrees", {"maxIter": 5}).fit(rows)
    release()
    for a in "abcd":
        mine = df.where(F.col("area") == a).orderBy("year").toPandas()
        known = forecast.known_ahead(mine["year"].tolist(), {"other": mine["other"].to_numpy()}, 0.0, 3)
        past = mine["demand"].tolist()
        for step in range(3):
            past.append(fitted.predict(Vectors.dense(forecast.future_row(past, "demand", names, known[step]))))
            assert got[a, 2025 + step] == pytest.approx(past[-1])


def test_best_forecasts(spark, panel):
    best = spark.createDataFrame([("a", "ElasticNet"), ("b", "Holt"), ("c", "RandomForest"), ("d", "Nothing")], "area string, model string")
    log = walkforward.full_log(panel, NAMES, "demand", [2022, 2023, 2024], ("RandomForest",), {"RandomForest": {"numTrees": 5}})
    got = forecast.best_forecasts(panel, best, "demand", 4, NAMES, parameters={"RandomForest": {"numTrees": 5}}, log=log, draws=30).collect()
    assert {(r["area"], r["model"]) for r in got} == {("a", "ElasticNet"), ("b", "Holt"), ("c", "RandomForest"), ("d", "Holt (fallback)")} and len(got) == 16
    assert all(r["lower_90"] <= r["forecast"] <= r["upper_90"] for r in got) and any(r["lower_90"] < r["upper_90"] for r in got if r["area"] == "c")
    few = forecast.best_forecasts(panel.where("year > 2022"), best.where("area = 'a'"), "demand", 2, NAMES).select("model").distinct().collect()
    assert few == [("Holt (fallback)",)]


def test_linear_grid_is_that_of_the_rows(spark, panel):
    df = panel.withColumn("gappy", F.when(F.col("year") % 4 == 0, F.lit(None)).otherwise(F.col("demand") % 7)).withColumn("empty", F.when(F.col("year") == 2010, 1.0))
    got = {(r["model"], r["alpha"], r["l1_ratio"]): r["mae"] for r in walkforward.tune_linear(df, [*NAMES, "gappy", "empty"], "demand", 2020).collect()}
    assert len(got) == 5 + 9
    pdf = df.where("year <= 2020").toPandas()
    x = pdf[[*NAMES, "gappy"]].fillna(pdf[[*NAMES, "gappy"]].median()).to_numpy(float)
    y, year = pdf["demand"].to_numpy(), pdf["year"].to_numpy()
    cuts = walkforward.fold_bounds(int(year.min()), int(year.max()), 3)
    for (model, alpha, l1), mae in got.items():
        folds = []
        for f in range(3):
            t, v = year < cuts[f], (year >= cuts[f]) & (year < cuts[f + 1])
            z = series.scaled(x[t], x[t])
            w, b = series.ridge(z, y[t], alpha) if model == "Ridge" else series.elastic_net(z, y[t], alpha, l1, rounds=50_000)
            folds.append(np.abs(y[v] - series.scaled(x[v], x[t]) @ w - b).mean())
        assert mae == pytest.approx(np.mean(folds), rel=1e-6)


def test_tree_grid(spark):
    """Halving finds the full grid's winner, with fewer fits; rounds of one boosted fit are the shorter fits."""
    rng = np.random.default_rng(8)
    x = rng.random((600, 2))
    df = spark.createDataFrame([("a", 2000 + i // 30, float(p), float(q), float(20 * (p > 0.5) * (q > 0.5) + 5 * np.sin(9 * p))) for i, (p, q) in enumerate(x)], "area string, year int, p double, q double, demand double")
    grids = {"RandomForest": tuple({"numTrees": n, "maxDepth": m} for n in (1, 8) for m in (6, 1, 2)), "BoostedTrees": tuple({"maxIter": n, "stepSize": s, "maxDepth": 2} for n in (2, 12) for s in (0.05, 0.3))}
    full, half = (walkforward.tune_trees(df, ["p", "q"], "demand", 2019, grids, exact=e).collect() for e in (True, False))
    assert len(full) == len(half) == 10 and {r["folds"] for r in full} == {3}
    first = lambda rows: {r["model"]: r["parameters"] for r in rows if r["rank"] == 1}
    assert first(full) == first(half) and sum(r["folds"] for r in half) < 30
    one = walkforward.tune_trees(df, ["p", "q"], "demand", 2019, {"BoostedTrees": grids["BoostedTrees"][:1]}, exact=True).first()
    assert one["mae"] == pytest.approx(next(r["mae"] for r in full if r["parameters"] == one["parameters"]))
    assert walkforward.tune_trees(df.limit(0), ["p", "q"], "demand", 2019, grids).isEmpty()


def test_panels_are_read_once_in_few_partitions(spark, monkeypatch):
    """What lies behind a panel is read once, and trees see it in one partition while it has few rows."""
    met, seen = spark.sparkContext.accumulator(0), []
    small = [(a, y, float(y % 5 + k), float(y % 3), float((y * 7 + k) % 11)) for k, a in enumerate("abc") for y in range(2000, 2020)]

    def counted(batches):
        for pdf in batches:
            met.add(len(pdf))
            yield pdf

    def assembled(df, *more):
        seen.append(df.rdd.getNumPartitions())
        return given(df, *more)

    given = walkforward.assembled
    monkeypatch.setattr(walkforward, "assembled", assembled)
    names = "area string, year int, p double, q double, demand double"
    df = spark.createDataFrame(small, names).repartition(12, "area", "year").mapInPandas(counted, names)
    jobs = [
        lambda: walkforward.tune_trees(df, ["p", "q"], "demand", 2019, {"RandomForest": ({"numTrees": 2, "maxDepth": 2},)}),
        lambda: forecast.all_forecasts(df, ["p", "q"], "demand", 2, models=("Naive", "Holt", "Ridge", "RandomForest"), parameters={"RandomForest": {"numTrees": 2, "maxDepth": 2}}),
    ]
    for k, job in enumerate(jobs, 1):
        assert job().count() and met.value == k * len(small)
    assert seen == [1, 1]
