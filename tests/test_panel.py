"""Operators on hand-made frames: gaps, bounds, ranks, tests, forecasts, and that nothing leaks from later years."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import pvalues, series
from loomspan.functions.columns import growth_rate, number
from loomspan.operators import features, forecast, growth, impute, metrics, reshape, robustness, serving, significance, stats, walkforward
from loomspan.plans import prepare
from loomspan.sources import panel as source


def frame(spark, values, name="x", area="a", start=2000):
    return spark.createDataFrame([(area, start + i, None if v is None else float(v)) for i, v in enumerate(values)], f"area string, year int, {name} double")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("area", "year").collect()]


def test_interpolation_and_ends(spark):
    assert column(impute.impute(frame(spark, [None, 100, None, 300, None, 500, None]), ["x"], 2100)) == [100, 100, 200, 300, 400, 500, 500]
    assert column(impute.impute(frame(spark, [None, None]), ["x"], 2100)) == [None, None]


def test_later_years_carry_forward(spark):
    got = column(impute.impute(frame(spark, [10, 20, 30, None, 50, None]), ["x"], 2002))
    assert got == [10, 20, 30, 30, 50, 50]
    # the last training year is a gap itself: the training mean, not the last value
    assert column(impute.impute(frame(spark, [10, 20, None, None]), ["x"], 2002))[3] == 15


def test_winsor(spark):
    df = frame(spark, [10, 10.1, 10.2, 10.3, 10.4, 1000])
    b = impute.winsor_bounds(df, ["x"], 2100).first()
    assert math.isclose(b["x_lo"], 10.125 - 2.5 * 0.25) and math.isclose(b["x_hi"], 10.375 + 2.5 * 0.25)
    bounds = impute.winsor_bounds(df, ["x"], 2100)
    assert max(column(impute.winsorise(df, bounds, ["x"]))) == b["x_hi"]
    assert impute.clipped_counts(df, bounds, ["x"]).first()["clipped"] == 1
    gap = frame(spark, [1, None, 3])
    assert column(impute.winsorise(gap, impute.winsor_bounds(gap, ["x"], 1990), ["x"])) == [1, None, 3]


def test_lags(spark):
    rows = features.lag_features(frame(spark, [10 * 1.05**t for t in range(6)]), ["x"]).orderBy("year").collect()
    assert rows[0]["x_lag1"] is None and rows[0]["x_yoy"] == 0 and math.isclose(rows[1]["x_yoy"], 5)
    assert math.isclose(rows[3]["x_ma3"], sum(10 * 1.05**t for t in range(3)) / 3) and rows[0]["x_ma3"] is None
    assert reshape.drop_null_lags(features.lag_features(frame(spark, range(6)), ["x"])).count() == 3


def test_nothing_leaks_from_later_years(spark):
    rng = np.random.default_rng(0)
    rows = [(a, 2000 + y, s, "u", float(rng.random() * 100 + 1)) for a in "abc" for y in range(25) for s in ("p", "q r") if rng.random() > 0.2 or y < 2]
    long = spark.createDataFrame(rows, "area string, year int, subcategory string, unit string, value double")
    other = long.withColumn("value", F.when(F.col("year") > 2016, F.col("value") * 50 + 7).otherwise(F.col("value")))
    a, b = (prepare.feature_matrix(x, ["p", "q r"], "p", 2016).where("year <= 2016").orderBy("area", "year").toPandas() for x in (long, other))
    assert a.equals(b) and "q_r_lag3" in a and len(a) == 3 * 14
    assert not any(c.startswith(("p_lag", "p_ma")) for c in features.feature_columns(prepare.feature_matrix(long, ["p", "q r"], "p", 2016), "p"))


def test_growth_below_zero_that_rounds_to_zero_keeps_its_sign(spark):
    paths = {"a": (241392.1, 241274.0), "b": (241274.0, 241392.1), "c": (5.0, 5.0), "d": (100.0, 87.6)}
    df = spark.createDataFrame([(area, 2000 + 24 * i, v) for area, vs in paths.items() for i, v in enumerate(vs)], "area string, year int, x double")
    assert {r["area"]: r["growth"] for r in stats.summary(df, "x", 2000, 2024).collect()} == {"a": "-0.0%", "b": "0.0%", "c": "0.0%", "d": "-12.4%"}


def test_growth_and_numbers(spark):
    row = spark.range(1).select(growth_rate(F.lit(100.0), F.lit(200.0), 10).alias("g"), growth_rate(F.lit(-1.0), F.lit(2.0), 1).alias("n"), number(F.lit("1e3")).alias("a"), number(F.lit("x")).alias("b"), number(F.lit("NaN")).alias("c")).first()
    assert round(row["g"] * 100, 2) == 7.18 and row["n"] is None and (row["a"], row["b"], row["c"]) == (1000.0, None, None)


def log(spark, rows):
    return spark.createDataFrame(rows, "area string, year int, model string, y_actual double, y_pred double")


def test_accuracy(spark):
    rows = {r["model"]: r for r in metrics.accuracy(log(spark, [("a", 1, "m", 0.0, 3.0), ("a", 2, "m", 0.0, 4.0), ("a", 1, "n", 100.0, 150.0), ("a", 2, "n", 0.0, 0.0)])).collect()}
    assert math.isclose(rows["m"]["rmse"], math.sqrt(12.5)) and rows["m"]["mape"] is None and rows["n"]["mape"] == 50
    best = metrics.best_models(spark.createDataFrame([("a", "z", 1.0), ("a", "b", 1.0), ("a", "c", None)], "area string, model string, mape double"))
    assert [r["model"] for r in best.collect()] == ["b"]


TESTLOG = [("a", y, m, t, p) for m, ps in {"Ridge": (101, 104, 99, 109), "Naive": (90, 95, 130, 70)}.items() for y, t, p in zip(range(4), (100.0, 105.0, 98.0, 110.0), map(float, ps))]


def test_significance(spark):
    rows = significance.significance_tests(log(spark, TESTLOG)).collect()
    assert len(rows) == 1 and rows[0]["better_model"] == "Ridge" and 0 <= rows[0]["dm_p"] <= 1
    assert math.isclose(rows[0]["wx_p"], math.erfc(5 / math.sqrt(7.375) / math.sqrt(2))) and rows[0]["dm_stat"] > 0  # two differences are tied
    assert significance.significance_tests(log(spark, [r for r in TESTLOG if r[2] == "Ridge" or r[1] < 2])).count() == 0
    same = [(a, y, m, t, t + 1) for a, y, m, t, _ in TESTLOG]
    row = significance.significance_tests(log(spark, same)).first()
    assert (row["dm_stat"], row["dm_p"], row["wx_p"]) == (0, 1, 1)
    row = significance.hln_tests(log(spark, TESTLOG), pooled=True).first()
    e = {m: np.array([(p - t) / t * 100 for _, _, k, t, p in TESTLOG if k == m]) for m in ("Naive", "Ridge")}
    d = e["Naive"] ** 2 - e["Ridge"] ** 2
    assert row["n"] == 4 and math.isclose(row["hln_stat"], d.mean() / math.sqrt(d.var(ddof=1) / 4) * math.sqrt(3 / 4)) and math.isclose(row["wx_p"], 0.125)


def test_p_values():
    assert math.isclose(pvalues.t_two_sided(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(float(pvalues.normal_two_sided(np.array(1.959963984540054))), 0.05, rel_tol=1e-9)
    assert pvalues.wilcoxon_exact(0, 5) == 2 / 32 and pvalues.wilcoxon(0, 0, 0) == 1
    assert abs(pvalues.wilcoxon(400, 50, 0) - pvalues.wilcoxon(400, 50, 6)) < 0.01


def paths(spark, values, model="m"):
    return spark.createDataFrame([("a", model, 2025 + i, float(v)) for i, v in enumerate(values)], "area string, model string, year int, forecast double")


@pytest.mark.parametrize("values, anchor, flag", [((26, 26.5, 27, 28.5), 26, "STABLE"), ((100, 110, 130), 100, "WATCH"), ((480, 300, 100, -10.9, 50, 90), 508.2, "UNSTABLE"), ((100, 120), 100, "STABLE")])
def test_robustness_flags(spark, values, anchor, flag):
    anchors = spark.createDataFrame([("a", float(anchor))], "area string, anchor double")
    assert robustness.robustness(paths(spark, values), anchors).first()["robustness_flag"] == flag


def test_robustness_edges(spark):
    anchors = spark.createDataFrame([("a", 100.0)], "area string, anchor double")
    assert robustness.robustness(paths(spark, (1, 2, 3, 4)), anchors).first()["direction_flips"] == 0
    assert robustness.robustness(paths(spark, (5, 1, 1, 5, 1, 5)), anchors).first()["direction_flips"] == 3
    assert robustness.robustness(paths(spark, (1,)), anchors).count() == 0
    for bad in (0.0, None):
        assert robustness.robustness(paths(spark, (1, 2)), spark.createDataFrame([("a", bad)], "area string, anchor double")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(" Area, Year ,Subcategory,Unit,Value,More\nA,2000,Demand,TWh,1.5,x\nA,2001,Demand,TWh,bad,x\nB,2000,CO2,g,2,x\nA,2001,CO2,g,3,x\n")
    long = source.read_long_csv(spark, str(tmp_path / "raw.csv"), ["A"])
    assert sorted((r["year"], r["value"]) for r in long.collect() if r["subcategory"] == "Demand") == [(2000, 1.5), (2001, None)]
    for _ in range(2):  # a rebuild changes nothing
        source.write_star(source.star_schema(long, 2000, 2000, 2001, "raw.csv", "2020-01-01"), f"{tmp_path}/star")
    star = source.read_star(spark, f"{tmp_path}/star")
    assert source.from_star(star).columns == ["area", "year", "subcategory", "unit", "value"] and source.from_star(star).count() == 3
    assert source.from_star(star, split="train").agg(F.max("year")).first()[0] == 2000 and source.from_star(star, areas=["B"]).count() == 0
    source.create_views(star)
    assert spark.table("v_train_measurements").count() == 1
    source.write_document(spark, {"target": "Demand", "all_subs": ["a"]}, f"{tmp_path}/meta")
    assert source.read_document(spark, f"{tmp_path}/meta") == {"target": "Demand", "all_subs": ["a"]}
    source.write_table(long, f"{tmp_path}/csv", "csv")
    assert source.read_if_there(spark, f"{tmp_path}/none", "a string").count() == 0
    assert {r["name"]: r["available"] for r in source.availability(spark, {"star": f"{tmp_path}/star/fact", "no": f"{tmp_path}/none"}).collect()} == {"star": True, "no": False}


def test_series_models():
    line = 5 + 2.0 * np.arange(20)
    for name in ("Holt", "LinearTrend"):
        assert np.allclose(series.MODELS[name](line, 3), [45, 47, 49], atol=0.2)
    flat = np.full(12, 7.0)
    for name, f in series.MODELS.items():
        assert np.allclose(f(flat, 4), 7, atol=1e-6), name
    assert series.damped_holt(line, 30)[-1] < series.holt(line, 30)[-1]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.0] + 4 + rng.normal(size=80) * 0.01
    for w, b in (series.ridge(x, y, 1e-6), series.elastic_net(x, y, 1e-6), series.bayesian_ridge(x, y)):
        assert np.allclose(w, [1, -2, 0], atol=0.02) and abs(b - 4) < 0.02
    assert series.elastic_net(x, y, 0.5, 1.0)[0][2] == 0
    walk = np.cumsum(rng.normal(size=200))
    assert series.adf(walk)[1] > 0.05 > series.adf(rng.normal(size=200))[1] and abs(series.adf(walk)[2] + 2.876) < 0.01


def test_forecasts(spark):
    df = frame(spark, [100 + 3 * t for t in range(25)], "demand")
    made = features.trend(features.lag_features(df, ["demand"]))
    out = forecast.recursive_forecast(reshape.drop_null_lags(made), ["demand_lag1", "demand_ma3", "trend"], "demand", 6, draws=20).orderBy("year").collect()
    assert [r["year"] for r in out] == list(range(2025, 2031)) and all(r["lower_90"] <= r["forecast"] <= r["upper_90"] for r in out)
    best = spark.createDataFrame([("a", "Nothing")], "area string, model string")
    assert {r["model"] for r in forecast.best_forecasts(df, best, "demand", 3).collect()} == {"Holt (fallback)"}
    errors = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -1.0)], "area string, year int, error double")
    band = forecast.residual_bootstrap(paths(spark, (10, 11, 12)), errors).collect()
    assert all(r["lower_90"] <= r["forecast"] <= r["upper_90"] for r in band) and band == forecast.residual_bootstrap(paths(spark, (10, 11, 12)), errors).collect()
    assert all(r["lower_90"] == r["upper_90"] for r in forecast.residual_bootstrap(paths(spark, (10,)), errors.where("area = 'b'")).collect())
    with pytest.raises(ValueError):
        growth.growth_summary(df, paths(spark, (1, 2)).withColumns({"lower_90": F.lit(0.0), "upper_90": F.lit(0.0)}), best.withColumn("mape", F.lit(1.0)), "demand")


def test_walk_forward_needs_five_years(spark):
    df = frame(spark, range(1, 8), "demand")
    assert walkforward.window_predictions(df, "demand", [2004, 2005]).select("year").distinct().count() == 1
    assert walkforward.series_predictions(df, "demand", [2004, 2005]).count() == 4
    assert walkforward.linear_predictions(df.withColumn("f", F.col("demand") - 1), ["f"], "demand", [2006]).where("abs(y_pred - 7) < 1").count() >= 1


def test_reads(spark):
    df = frame(spark, [1, 2, 3], "demand")
    assert [r["period"] for r in serving.with_period(df, [(2001, 2002, "P"), (2002, 2002, "Q")]).orderBy("year").collect()] == ["Normal", "P", "P"]
    assert [tuple(p) for p in serving.histories(df, "demand").first()["points"]] == [(2000, 1.0), (2001, 2.0), (2002, 3.0)]
    assert impute.sparse_columns(frame(spark, [1, None, None, None, None, None]), ["x"], 2100) == []
    assert {r["metric"]: r["value"] for r in stats.quality_report(df.union(df)).collect()}["duplicates"] == 3
    diff = metrics.differences(df, df.withColumn("demand", F.col("demand") * 2), ["area", "year"])
    assert {r["issue"]: r["n"] for r in diff.collect()} == {"differs: demand": 3}


def test_ranks_and_conflicts(spark):
    found = spark.createDataFrame([("a", m, d, "STABLE" if d <= 20 else "WATCH") for m, d in zip("wxyz", (50.0, 10.0, 20.0, 30.0))], "area string, model string, max_deviation_pct double, robustness_flag string")
    scores = spark.createDataFrame([("a", "w", 1.0), ("a", "x", 2.0), ("a", "y", 3.0)], "area string, model string, mape double")
    rows = {r["model"]: r for r in robustness.against_accuracy(found, scores).collect()}
    assert (rows["w"]["accuracy_rank"], rows["w"]["robustness_rank"], rows["w"]["axes_agree"]) == (1, 4, False)
    assert rows["z"]["accuracy_rank"] is None and not rows["z"]["axes_agree"] and rows["x"]["axes_agree"]
    flags = ["WATCH", "UNSTABLE", "WATCH", "WATCH", "UNSTABLE", "STABLE", None]
    best = spark.createDataFrame([(f"a{i}", "m", 1.0) for i in range(7)], "area string, model string, mape double")
    rob = spark.createDataFrame([(f"a{i}", "m", f, 1.0) for i, f in enumerate(flags) if f], "area string, model string, robustness_flag string, max_deviation_pct double")
    assert robustness.conflict_count(robustness.conflicts(best, rob)).first()[:] == (5, 7)


def test_metadata_and_windows(spark):
    df = features.lag_features(frame(spark, [t**1.5 for t in range(25)], "demand").withColumn("other", F.col("demand") * 2 + F.col("year")), ["demand", "other"])
    doc = prepare.metadata(df, "demand", ["demand", "other"], 2016, 2020, 2024)
    assert doc["countries"] == ["a"] and "other_lag1" in doc["all_features"] and not any(c.startswith(("demand_lag", "demand_ma")) for c in doc["all_features"])
    got = features.sliding_windows(df, ["demand", "other"], "demand", 5)
    assert got.count() == 20 and len(got.orderBy("year").first()["x"]) == 5
    assert features.sliding_windows(df.where("year < 2006"), ["demand"], "demand", 5).count() == 0
    scaled = np.array(column(features.scale(frame(spark, [1, 2, 3, 40]), ["x"], 2002)))
    assert np.allclose(scaled, (np.array([1, 2, 3, 40]) - 2) / math.sqrt(2 / 3))


def test_ridge_tuning_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = x @ [2.0, -1.0] + 1 + rng.normal(size=40) * 0.1
    df = spark.createDataFrame([("a", 2000 + i // 2, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "area string, year int, p double, q double, demand double")
    got = {r["alpha"]: r["mae"] for r in walkforward.tune_ridge(df, ["p", "q"], "demand", 2019, alphas=(0.1, 100.0)).collect()}
    year, want = 2000 + np.arange(40) // 2, {}
    for a in got:
        folds = []
        for lo, hi in ((2005, 2010), (2010, 2015), (2015, 2020)):
            z = np.column_stack([np.ones(40), x])
            t, v = year < lo, (year >= lo) & (year < hi)
            w = np.linalg.solve(z[t].T @ z[t] + np.diag([1e-9, a, a]), z[t].T @ y[t])
            folds.append(np.abs(y[v] - z[v] @ w).mean())
        want[a] = np.mean(folds)
    assert all(math.isclose(got[a], want[a], rel_tol=1e-9) for a in got) and got[0.1] < got[100.0]
