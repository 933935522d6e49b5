"""Operators that must not meet a whole table in one task: quantiles, numbers in order, interval tables."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import features, impute, lineage, reshape, serving, significance, stats
from loomspan.sources import panel


@pytest.mark.parametrize("probes, last", [(stats.PROBES, 10), (stats.PROBES, stats.LAST)])
def test_quantiles(spark, probes, last):
    rng = np.random.default_rng(7)
    columns = {"normal": rng.normal(size=999), "ties": rng.integers(0, 4, 999).astype(float), "wide": 10.0 ** rng.integers(-300, 300, 999) * rng.choice([-1, 1], 999), "one": np.full(999, 2.5)}
    rows = [(*(float(v[i]) for v in columns.values()), None if i % 3 else float("nan" if i % 2 else i), float("inf")) for i in range(999)]
    df = spark.createDataFrame(rows, "normal double, ties double, wide double, one double, gaps double, none double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = stats.quantiles(df, df.columns, at, probes, last)
    for c, v in columns.items():
        assert got[c] == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12)
    assert got["gaps"] == pytest.approx(np.quantile([float(i) for i in range(0, 999, 6)], at).tolist()) and got["none"] == [None] * 6
    spark_own = df.agg(*[F.percentile(c, 0.25).alias(c) for c in columns]).first()
    assert all(got[c][2] == pytest.approx(spark_own[c]) for c in columns)
    assert stats.quantiles(df.limit(0), ["one"], [0.5]) == {"one": [None]}


def test_median_of_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (float("inf"), None)], "x double, y double")
    assert [r["x"] for r in impute.fill_median(df, ["x", "y"]).collect()] == [1.0, 3.0, 2.0, 2.0]


def test_numbers_in_order(spark):
    names = [f"n{i:04d}" for i in range(1500)]
    df = spark.createDataFrame([(n,) for n in np.random.default_rng(1).permutation(names)], "area string").repartition(7)
    got = {r["area"]: r["k"] for r in lineage.numbered(df, "area", "k", 1).collect()}
    assert got == {n: i + 1 for i, n in enumerate(names)}
    codes = {r["area"]: r["country_code"] for r in features.area_codes(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "area string")).collect()}
    assert codes == {"a": 0, "b": 1, None: None}
    plan = features.area_codes(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(area" not in plan  # no window over all rows
    assert lineage.numbered(df.limit(0), "area", "k").count() == 0
    long = spark.createDataFrame([("b", 2000, "x", "u", 1.0), ("a", 2001, "y", "u", 2.0)], "area string, year int, subcategory string, unit string, value double")
    star = panel.star_schema(long, 2016, 2020, 2024)
    assert {tuple(r) for r in star["dim_country"].collect()} == {(1, "a"), (2, "b")} and star["fact"].where("country_key is null").isEmpty()


def test_interval_table(spark):
    """Overlapping intervals of all lengths, the first of the list winning, against every interval tried."""
    rng = np.random.default_rng(3)
    periods = [(i, int(s := rng.integers(-50, 3000)), int(s + rng.choice([0, 1, 3, 4, 5, 16, 60, 400]) - (i == 7)), f"p{i}") for i in range(120)]
    periods += [(120, None, 5, "open"), (121, 9, 3, "back")]
    years = [None, *range(-60, 3100, 7), 2**31 - 1]
    df = spark.createDataFrame([(y, k) for y in years for k in (1, 2)], "year int, k int")
    table = spark.createDataFrame(periods, "place int, start int, end int, name string")
    found = serving.with_periods(df, table)
    got = {}
    for r in found.collect():
        got.setdefault(r["year"], []).append(r["period"])
    for y in years:
        want = next((n for _, s, e, n in periods if y is not None and s is not None and s <= y <= e), "Normal")
        assert got[y] == [want, want]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["period"] for r in serving.with_periods(df, table.limit(0)).collect()} == {"Normal"}


@pytest.mark.parametrize("most", [1, 3])
def test_lags_by_ranges(spark, most):
    """Ranges of a few rows, keys that end inside one: the same lags as one window per key."""
    rng = np.random.default_rng(9)
    rows = [(a, y, "A", b, float(rng.normal())) for b, n in (("B", 40), ("C", 3), ("D", 1), ("E", 25)) for a, y in sorted({(f"a{rng.integers(6)}", int(rng.integers(50))) for _ in range(n)})]
    df = spark.createDataFrame(rows, "area string, year int, model_a string, model_b string, d double").repartition(9)
    got = {tuple(r[:4]): tuple(r[4:]) for r in significance._lags(df, ["model_a", "model_b"], most).select("area", "year", "model_a", "model_b", *[f"d{k}" for k in range(1, most + 1)]).collect()}
    w = Window.partitionBy("model_a", "model_b").orderBy("area", "year")
    want = {tuple(r[:4]): tuple(r[4:]) for r in df.select("area", "year", "model_a", "model_b", *[F.lag("d", k).over(w) for k in range(1, most + 1)]).collect()}
    assert got == want and len(got) == len(rows)


def test_sources_share_a_schema(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Area , Year,Subcategory,Unit,Value\na,2000,x,TWh,1.5\nb,2017,x,TWh,bad\na,2021,y,TWh,2.5\n")
    long = panel.read_measurements(spark, "csv", str(tmp_path / "m.csv"))
    panel.write_star(panel.star_schema(long, 2016, 2020, 2024, load_date="2024-01-01"), str(tmp_path / "star"))
    back = panel.read_measurements(spark, "warehouse", str(tmp_path / "star"))
    assert [f.simpleString() for f in back.schema] == [f.simpleString() for f in long.schema]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, long.collect()), key=str)
    assert [tuple(r)[:2] for r in panel.read_measurements(spark, "warehouse", str(tmp_path / "star"), ["a"], "train").collect()] == [("a", 2000)]
    with pytest.raises(ValueError):
        panel.read_measurements(spark, "csv", str(tmp_path / "m.csv"), split="train")
    with pytest.raises(ValueError):
        panel.read_measurements(spark, "queue", "")


def test_sorted_sink(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (-F.col("id")).alias("v")).repartition(5)
    panel.write_table(df, str(tmp_path / "t"), order=["k"])
    parts = sorted((tmp_path / "t").glob("*.parquet"))
    assert [r["k"] for p in parts for r in spark.read.parquet(str(p)).collect()] == list(range(500))


def test_gap_shares_and_pairs(spark):
    df = spark.createDataFrame([(2000, None, 1.0), (2001, float("nan"), 1.0), (2002, 3.0, float("inf")), (2003, 3.0, 1.0), (2050, None, None)], "year int, x double, y double")
    assert {r["feature"]: r["share"] for r in impute.gap_shares(df, ["x", "y"], 2003).collect()} == {"x": 0.5, "y": 0.25}
    assert impute.sparse_columns(df, ["x", "y"], 2003, 0.5) == ["y"] and impute.sparse_columns(df, [], 2003) == []
    log = spark.createDataFrame([("a", 2000 + t, m, 10.0 + t, 10.0 + t + e) for t in range(6) for m, e in (("M", 0.1 * t), ("N", 1.0), ("O", (-1.0) ** t))], "area string, year int, model string, y_actual double, y_pred double")
    rows = serving.area_significance(significance.significance_tests(log), "A").collect()
    assert len(rows) == 3 and [r["dm_p"] for r in rows] == sorted(r["dm_p"] for r in rows)
    plan = significance.significance_tests(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0
    assert reshape.same_area(significance.significance_tests(log.limit(0)), "a").isEmpty()
