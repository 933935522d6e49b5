"""The registered queries of the panel operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import features, forecast, growth, impute, metrics, reshape, robustness, serving, significance, stats, walkforward
from ..operators.lineage import cut
from ..sources import panel as source
from . import prepare, report
from .panels import ANCHORS, COLUMNS, DEMAND, FORECAST, LOG, METRICS, P1, P2, P3, SUBS, TEST, TRAIN, VAL, WIDE, months, quarters, user_days

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}
YEARS = list(range(VAL + 1, TEST + 1))


#: Added on both sides before rounding, so that exact halves (means of cents) go the same way whatever the order of a sum.
NUDGE = 3e-8


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`") + NUDGE, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, ctes: list[str] | None = None, sql: str | None = None):
    def add(f: Callable) -> Callable:
        _queries[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            whole = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
            _sql[name] = whole.replace(", 4)", f" + {NUDGE}, 4)")
        return f

    return add


def rs(*names: str, digits: int = 4) -> str:
    """Columns of the SQL side, rounded like rounded()."""
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)


def cents(x):
    """Hundredths as text, halves up on both sides whatever the order of a sum: how arrays are compared."""
    return F.floor(x * 100 + 0.500001).cast("string")


def demand(spark: SparkSession, d: str, until: int | None = None) -> DataFrame:
    df = prepare.single_series(quarters(spark, d), "demand")
    return df if until is None else df.where(F.col("year") <= until)


def wide(spark: SparkSession, d: str, panel=quarters) -> DataFrame:
    return reshape.pivot_wide(panel(spark, d), SUBS)


def dense(spark: SparkSession, d: str) -> DataFrame:
    return reshape.densify(wide(spark, d, months))


def log(spark: SparkSession, d: str, years: list[int] = YEARS) -> DataFrame:
    return walkforward.window_predictions(demand(spark, d), "demand", years)


def test_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(log(spark, d))


def as_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The walk-forward log read as forecasts from 2020 on."""
    return log(spark, d).select("area", "model", "year", F.col("y_pred").alias("forecast"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return growth.last_known(demand(spark, d, VAL), "demand")


def trend(spark: SparkSession, d: str, horizon: int = 6) -> DataFrame:
    return forecast.linear_forecast(demand(spark, d, TEST), "demand", horizon)


def banded(spark: SparkSession, d: str) -> DataFrame:
    """The trend with bounds five and ten per cent away."""
    return trend(spark, d).withColumns({"lower_90": F.col("forecast") * 0.95, "upper_90": F.col("forecast") * 1.1})


_BANDED = "banded AS (SELECT *, forecast * 0.95 AS lower_90, forecast * 1.1 AS upper_90 FROM trend)"
_WIDE1, _WIDE2 = WIDE("p1", "wide"), WIDE("p2", "wide2")
_DENSE = """span AS (SELECT min(year) AS lo, max(year) AS hi FROM wide2), areas AS (SELECT DISTINCT area FROM wide2),
grid AS (SELECT area, CAST(y AS INT) AS year FROM areas, span, range(lo, hi + 1) r(y)), dense AS (SELECT grid.area, grid.year, """ + ", ".join(f'"{c}"' for c in COLUMNS) + " FROM grid LEFT JOIN wide2 USING (area, year))"
_BOUNDS = "bounds AS (SELECT area, " + ", ".join(f'quantile_cont("{c}", 0.25) - 2.5 * (quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25)) AS "{c}_lo", quantile_cont("{c}", 0.75) + 2.5 * (quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25)) AS "{c}_hi"' for c in COLUMNS) + " FROM wide2 WHERE year <= 40 GROUP BY area)"
_CORR = lambda a, b: f'CASE WHEN stddev_pop(CASE WHEN "{b}" IS NOT NULL THEN "{a}" END) * stddev_pop(CASE WHEN "{a}" IS NOT NULL THEN "{b}" END) > 0 THEN covar_pop("{a}", "{b}") / (stddev_pop(CASE WHEN "{b}" IS NOT NULL THEN "{a}" END) * stddev_pop(CASE WHEN "{a}" IS NOT NULL THEN "{b}" END)) END'
_PAIRS = """slim AS (SELECT area, year, model, y_actual, y_actual - y_pred AS e FROM test WHERE y_actual IS NOT NULL AND y_pred IS NOT NULL),
pairs AS (SELECT a.area, a.year, a.model AS model_a, b.model AS model_b, a.y_actual AS y, a.e AS ea, b.e AS eb FROM slim a JOIN slim b ON a.area = b.area AND a.year = b.year AND a.model < b.model
  QUALIFY count(*) OVER (PARTITION BY a.area, a.model, b.model) >= 3)"""
_BASE = [P1, DEMAND, LOG]
_ROBUST = """steps AS (SELECT area, model, year, y_pred AS f, anchor, lag(y_pred) OVER (PARTITION BY area, model ORDER BY year) AS before FROM test JOIN anchors USING (area) WHERE anchor <> 0),
signs AS (SELECT *, nullif(sign(f - before), 0) AS s FROM steps),
turns AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY area, model ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM signs),
raw AS (SELECT area, model, max(abs(f - anchor) / abs(anchor) * 100) AS dev, max(abs(f - before) / abs(before + 1e-9) * 100) AS jump, stddev_pop(f) AS sd, count(CASE WHEN s <> s0 THEN 1 END) AS flips FROM turns GROUP BY area, model HAVING count(*) >= 2),
robust AS (SELECT area, model, round(dev, 1) AS max_deviation_pct, round(jump, 1) AS max_yoy_change_pct, round(sd, 1) AS trajectory_std, CAST(flips AS INT) AS direction_flips, CASE WHEN dev > 40 THEN 'UNSTABLE' WHEN dev > 20 THEN 'WATCH' ELSE 'STABLE' END AS robustness_flag FROM raw)"""
_RANKS = """ranks AS (SELECT r.*, m.mape, CASE WHEN mape IS NOT NULL THEN rank() OVER (PARTITION BY area ORDER BY mape NULLS LAST) END AS accuracy_rank, rank() OVER (PARTITION BY area ORDER BY max_deviation_pct NULLS LAST) AS robustness_rank FROM robust r LEFT JOIN metrics m USING (area, model))"""


# --- flagship -----------------------------------------------------------------

@query("best_model_per_area", [*_BASE, METRICS], f"SELECT area, model, {rs('mae', 'rmse', 'mape')} FROM best")
def _(spark, d):
    return metrics.best_models(test_metrics(spark, d))


# --- sources, star schema, filters --------------------------------------------

@query("a1_long_panel", [P1], "SELECT area, year, subcategory, unit, round(value, 4) AS value FROM p1 WHERE area IN ('FRANCE', 'GERMANY', 'CANADA', 'NATION_1', 'NATION_2', 'NATION_3')")
def _(spark, d):
    return reshape.only_areas(quarters(spark, d), ["FRANCE", "GERMANY", "CANADA", "NATION_1", "NATION_2", "NATION_3"])


@query("b1_semi_filter", [P1], "SELECT area, count(*) AS n FROM p1 WHERE area IN (SELECT n_name FROM nation WHERE n_regionkey <= 1) GROUP BY area")
def _(spark, d):
    chosen = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey <= 1").select(F.col("n_name").alias("area"))
    return reshape.only_areas(quarters(spark, d), chosen).groupBy("area").agg(F.count("*").alias("n"))


@query("b2_target_rows", [P1], "SELECT area, count(*) AS n, round(sum(value), 2) AS total FROM p1 WHERE subcategory = 'HIGH' GROUP BY area")
def _(spark, d):
    return quarters(spark, d).where("subcategory = 'HIGH'").groupBy("area").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("b3_split_labels", [P1], "SELECT CASE WHEN year <= 2016 THEN 'train' WHEN year <= 2020 THEN 'val' WHEN year <= 2024 THEN 'test' ELSE 'forecast' END AS split_label, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM p1 GROUP BY 1")
def _(spark, d):
    label = col.split_label(F.col("year"), TRAIN, VAL, TEST).alias("split_label")
    return quarters(spark, d).groupBy(label).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


_KEYS = "dc AS (SELECT CAST(row_number() OVER (ORDER BY area) AS INT) AS country_key, area FROM (SELECT DISTINCT area FROM p1)), ds AS (SELECT CAST(row_number() OVER (ORDER BY subcategory) AS INT) AS subcategory_key, subcategory FROM (SELECT DISTINCT subcategory FROM p1))"


@query("a3_star_fact", [P1, _KEYS], "SELECT country_key, year AS year_key, subcategory_key, round(avg(value), 4) AS value FROM p1 JOIN dc USING (area) JOIN ds USING (subcategory) GROUP BY 1, 2, 3")
def _(spark, d):
    return source.star_schema(quarters(spark, d), TRAIN, VAL, TEST, load_date="x")["fact"].select("country_key", "year_key", "subcategory_key", "value")


@query("a3_dim_year", [P1], "SELECT DISTINCT year AS year_key, year, CASE WHEN year <= 2016 THEN 'train' WHEN year <= 2020 THEN 'val' WHEN year <= 2024 THEN 'test' ELSE 'forecast' END AS split_label FROM p1")
def _(spark, d):
    return source.star_schema(quarters(spark, d), TRAIN, VAL, TEST)["dim_year"]


@query("c2_dim_subcategory", [P1, _KEYS], "SELECT subcategory_key, subcategory AS subcategory_name, 'USD' AS unit FROM ds")
def _(spark, d):
    return source.star_schema(quarters(spark, d), TRAIN, VAL, TEST)["dim_subcategory"]


@query("c1_train_measurements", [P1], "SELECT area, year, subcategory, unit, round(avg(value), 4) AS value FROM p1 WHERE year <= 2016 GROUP BY ALL")
def _(spark, d):
    return source.from_star(source.star_schema(quarters(spark, d), TRAIN, VAL, TEST, load_date="x"), split="train")


@query("a4_area_measurements", [P1], "SELECT area, year, subcategory, unit, round(avg(value), 4) AS value FROM p1 WHERE area IN (SELECT n_name FROM nation WHERE n_nationkey < 3) AND year BETWEEN 2021 AND 2024 GROUP BY ALL")
def _(spark, d):
    names = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 3").select("n_name").collect()]
    return source.from_star(source.star_schema(quarters(spark, d), TRAIN, VAL, TEST, load_date="x"), areas=names, split="test")


@query("b12_same_area", [P1], "SELECT area, count(*) AS n FROM p1 WHERE lower(area) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 6) GROUP BY area")
def _(spark, d):
    name = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey = 6").first()["n_name"]
    return reshape.same_area(quarters(spark, d), name.swapcase()).groupBy("area").agg(F.count("*").alias("n"))


@query("b11_recent", [P1, DEMAND], f"SELECT area, year, {rs('demand')} FROM demand d WHERE year >= (SELECT max(year) FROM demand e WHERE e.area = d.area) - 10")
def _(spark, d):
    return growth.recent(demand(spark, d), 10)


# --- reshaping, imputation, winsorising ----------------------------------------

@query("d1_cell_means", [P1], f"SELECT area, year, subcategory, {rs('value')} FROM (SELECT area, year, subcategory, avg(value) AS value FROM p1 WHERE value IS NOT NULL GROUP BY ALL)")
def _(spark, d):
    return reshape.cell_means(quarters(spark, d))


@query("d1_user_day_means", [P3], f"SELECT area, year, subcategory, {rs('value')} FROM (SELECT area, year, subcategory, avg(value) AS value FROM p3 WHERE value IS NOT NULL GROUP BY ALL)")
def _(spark, d):
    return reshape.cell_means(user_days(spark, d))


@query("g1_wide_panel", [P1, _WIDE1], f"SELECT area, year, {rs(*COLUMNS)} FROM wide")
def _(spark, d):
    return wide(spark, d)


@query("c3_dense_panel", [P2, _WIDE2, _DENSE], f"SELECT area, year, {rs(*COLUMNS)} FROM dense")
def _(spark, d):
    return dense(spark, d)


@query("g7_long_again", [P1, _WIDE1], "SELECT area, year, feature, round(value, 4) AS value FROM (UNPIVOT wide ON " + ", ".join(COLUMNS) + " INTO NAME feature VALUE value)")
def _(spark, d):
    return reshape.unpivot(wide(spark, d), ["area", "year"], COLUMNS).where("value is not null")


def _imputed(c: str) -> str:
    tr, po = "PARTITION BY area, year <= 40 ORDER BY year", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    fw = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    t = f'CASE WHEN "{c}" IS NOT NULL THEN year END'
    return f"""last_value("{c}" IGNORE NULLS) OVER ({tr} {po}) AS x0_{c}, first_value("{c}" IGNORE NULLS) OVER ({tr} {fw}) AS x1_{c},
last_value({t} IGNORE NULLS) OVER ({tr} {po}) AS t0_{c}, first_value({t} IGNORE NULLS) OVER ({tr} {fw}) AS t1_{c},
avg(CASE WHEN year <= 40 THEN "{c}" END) OVER (PARTITION BY area) AS m_{c}, max(CASE WHEN year = 40 THEN "{c}" END) OVER (PARTITION BY area) AS s_{c}"""


_IMPUTE = "parts AS (SELECT *, " + ", ".join(map(_imputed, COLUMNS)) + " FROM dense)"
_IMPUTED = ", ".join(f'round(CASE WHEN year <= 40 THEN coalesce("{c}", CASE WHEN t1_{c} > t0_{c} THEN x0_{c} + (x1_{c} - x0_{c}) * (year - t0_{c}) / (t1_{c} - t0_{c}) END, x0_{c}, x1_{c}, m_{c}) ELSE coalesce(x0_{c}, s_{c}, m_{c}) END, 4) AS "{c}"' for c in COLUMNS)


@query("e4_imputed", [P2, _WIDE2, _DENSE, _IMPUTE], f"SELECT area, year, {_IMPUTED} FROM parts")
def _(spark, d):
    return impute.impute(dense(spark, d), COLUMNS, 40)


@query("d9_winsor_bounds", [P2, _WIDE2, _BOUNDS], "SELECT area, " + rs(*[f"{c}_{e}" for c in COLUMNS for e in ("lo", "hi")]) + " FROM bounds")
def _(spark, d):
    return impute.winsor_bounds(wide(spark, d, months), COLUMNS, 40)


@query("h3_winsorised", [P2, _WIDE2, _BOUNDS], "SELECT area, year, " + ", ".join(f'round(CASE WHEN "{c}" IS NOT NULL THEN least(greatest("{c}", "{c}_lo"), "{c}_hi") END, 4) AS "{c}"' for c in COLUMNS) + " FROM wide2 LEFT JOIN bounds USING (area)")
def _(spark, d):
    df = wide(spark, d, months)
    return impute.winsorise(df, impute.winsor_bounds(df, COLUMNS, 40), COLUMNS)


@query("d10_clipped_counts", [P2, _WIDE2, _BOUNDS], " UNION ALL ".join(f"SELECT '{c}' AS feature, count(CASE WHEN abs(least(greatest(\"{c}\", \"{c}_lo\"), \"{c}_hi\") - \"{c}\") > 0 THEN 1 END) AS clipped FROM wide2 LEFT JOIN bounds USING (area)" for c in COLUMNS))
def _(spark, d):
    df = wide(spark, d, months)
    return impute.clipped_counts(df, impute.winsor_bounds(df, COLUMNS, 40), COLUMNS)


@query("d24_median_filled", [P2, _WIDE2, _DENSE], "SELECT area, year, " + ", ".join(f'round(coalesce("{c}", (SELECT quantile_cont("{c}", 0.5) FROM dense)), 4) AS "{c}"' for c in COLUMNS) + " FROM dense")
def _(spark, d):
    return impute.fill_median(dense(spark, d), COLUMNS)


# --- features -------------------------------------------------------------------

def _lags(c: str) -> str:
    w = "PARTITION BY area ORDER BY year"
    rows = lambda a, b: f"OVER ({w} ROWS BETWEEN {a} AND {b})"
    before = f'last_value("{c}" IGNORE NULLS) {rows("UNBOUNDED PRECEDING", "1 PRECEDING")}'
    now = f'last_value("{c}" IGNORE NULLS) {rows("UNBOUNDED PRECEDING", "CURRENT ROW")}'
    return ", ".join([*[f'round(lag("{c}", {k}) OVER ({w}), 4) AS "{c}_lag{k}"' for k in (1, 2, 3)], *[f'round(avg("{c}") {rows(f"{k} PRECEDING", "1 PRECEDING")}, 4) AS "{c}_ma{k}"' for k in (3, 5)], f'round(coalesce(({now} - {before}) / nullif({before}, 0) * 100, 0), 4) AS "{c}_yoy"'])


@query("e1_lag_features", [P1, _WIDE1], f"SELECT area, year, {rs('URGENT', 'LOW')}, {_lags('URGENT')}, {_lags('LOW')} FROM wide")
def _(spark, d):
    return features.lag_features(wide(spark, d).select("area", "year", "URGENT", "LOW"), ["URGENT", "LOW"])


_TOTAL = " + ".join(f'coalesce("{c}", 0)' for c in COLUMNS)


@query("h6_shares", [P1, _WIDE1], "SELECT area, year, " + ", ".join(f'round("{c}" / ({_TOTAL} + 1e-9), 4) AS "share_{c}"' for c in COLUMNS) + " FROM wide")
def _(spark, d):
    df = features.shares(wide(spark, d), COLUMNS, words=tuple(c.lower() for c in COLUMNS))
    return df.select("area", "year", *[f"share_{c}" for c in COLUMNS])


@query("h7_ratios", [P1, _WIDE1], 'SELECT area, year, round("URGENT" / ("HIGH" + 1e-9), 4) AS "demand_ratio_HIGH", round("URGENT" / ("LOW" + 1e-9), 4) AS "demand_ratio_LOW" FROM wide')
def _(spark, d):
    return features.ratios(wide(spark, d), "URGENT", ["HIGH", "LOW"]).select("area", "year", "demand_ratio_HIGH", "demand_ratio_LOW")


_CORRS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_CORR(c, 'URGENT')} AS correlation FROM wide WHERE year <= 2016" for c in COLUMNS[1:])


@query("d11_correlations", [P1, _WIDE1], f"SELECT feature, {rs('correlation')} FROM ({_CORRS}) WHERE correlation IS NOT NULL")
def _(spark, d):
    return features.correlations(wide(spark, d), COLUMNS, "URGENT", TRAIN)


@query("f1_top_correlated", [P1, _WIDE1], f"SELECT feature, {rs('correlation')} FROM ({_CORRS}) WHERE correlation IS NOT NULL ORDER BY abs(correlation) DESC, feature LIMIT 2")
def _(spark, d):
    return features.top_correlated(wide(spark, d), COLUMNS, "URGENT", 2, TRAIN)


@query("d12_correlation_matrix", [P1, _WIDE1], " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_CORR(a, b)}, 4) AS correlation FROM wide" for i, a in enumerate(COLUMNS) for b in COLUMNS[i:]))
def _(spark, d):
    return features.correlation_matrix(wide(spark, d), COLUMNS)


@query("e11_trend_and_codes", [P1, DEMAND], "SELECT area, year, year - (SELECT min(year) FROM demand) AS trend, (year - (SELECT min(year) FROM demand)) ** 2 AS trend_sq, CAST(dense_rank() OVER (ORDER BY area) - 1 AS INT) AS country_code FROM demand")
def _(spark, d):
    return features.area_codes(features.trend(demand(spark, d))).select("area", "year", "trend", F.col("trend_sq").cast("double").alias("trend_sq"), "country_code")


@query("d23_scaled", [P1, DEMAND], "SELECT area, year, round((demand - avg(CASE WHEN year <= 2016 THEN demand END) OVER (PARTITION BY area)) / coalesce(nullif(stddev_pop(CASE WHEN year <= 2016 THEN demand END) OVER (PARTITION BY area), 0), 1), 4) AS demand FROM demand")
def _(spark, d):
    return features.scale(demand(spark, d), ["demand"], TRAIN)


@query("e16_sliding_windows", [P1, DEMAND], "SELECT area, year, round(list_sum(x), 4) AS x_sum, len(x) AS n, array_to_string(list_transform(x, lambda v: CAST(floor(v * 100 + 0.500001) AS BIGINT)), ' ') AS x, round(y, 4) AS y FROM (SELECT area, year, demand AS y, list(demand) OVER (PARTITION BY area ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x FROM demand) WHERE len(x) = 5")
def _(spark, d):
    found = features.sliding_windows(demand(spark, d), ["demand"], "demand", 5)
    return found.select("area", "year", F.aggregate("x", F.lit(0.0), lambda s, v: s + v[0]).alias("x_sum"), F.size("x").cast("bigint").alias("n"), F.array_join(F.transform("x", lambda v: cents(v[0])), " ").alias("x"), "y")


@query("feature_matrix")
def _(spark, d):
    return prepare.feature_matrix(quarters(spark, d), SUBS, "URGENT", TRAIN)


# The whole matrix in SQL: imputed, capped, the two ratios by their place (their names depend on the data), lags, trend, code.
_FULL1 = "full1 AS (SELECT area, year, " + re.sub(r"round\((CASE.*?END), 4\) AS", r"\1 AS", _IMPUTED).replace("year <= 40", "year <= 2016") + " FROM parts)"
_CAPPED1 = (
    "bounds1 AS (SELECT area, " + ", ".join(f'quantile_cont("{c}", 0.25) AS "{c}_a", quantile_cont("{c}", 0.75) AS "{c}_b"' for c in COLUMNS) + " FROM full1 WHERE year <= 2016 GROUP BY area), "
    "capped AS (SELECT area, year, " + ", ".join(f'CASE WHEN "{c}" IS NOT NULL THEN least(greatest("{c}", "{c}_a" - 2.5 * ("{c}_b" - "{c}_a")), "{c}_b" + 2.5 * ("{c}_b" - "{c}_a")) END AS "{c}"' for c in COLUMNS) + " FROM full1 LEFT JOIN bounds1 USING (area))"
)
_TOP1 = "corrs AS (" + " UNION ALL ".join(f"SELECT '{c}' AS f, {_CORR(c, 'URGENT')} AS r FROM capped WHERE year <= 2016" for c in COLUMNS if c != "URGENT") + "), top AS (SELECT f, row_number() OVER (ORDER BY abs(r) DESC, f) AS k FROM corrs WHERE r IS NOT NULL)"
_RATIO = lambda k: f'"URGENT" / (CASE (SELECT f FROM top WHERE k = {k}) ' + " ".join(f"WHEN '{c}' THEN \"{c}\"" for c in COLUMNS) + " END + 1e-9)"
_SPAN1 = _DENSE.replace("wide2", "wide")
_WHOLE = [P1, _WIDE1, _SPAN1, _IMPUTE.replace("year <= 40", "year <= 2016").replace("year = 40", "year = 2016"), _FULL1, _CAPPED1, _TOP1]
_GAPLESS = " AND ".join(f'"{c}_lag{k}" IS NOT NULL' for c in COLUMNS for k in (1, 2, 3))


@query("feature_matrix_whole", _WHOLE, f"""SELECT * FROM (SELECT area, year, {rs(*COLUMNS)}, {", ".join(map(_lags, COLUMNS))}, round({_RATIO(1)}, 4) AS ratio_1, round({_RATIO(2)}, 4) AS ratio_2,
year - (SELECT min(year) FROM capped) AS trend, (year - (SELECT min(year) FROM capped)) ** 2 AS trend_sq, CAST(dense_rank() OVER (ORDER BY area) - 1 AS INT) AS country_code FROM capped) WHERE {_GAPLESS}""")
def _(spark, d):
    df = prepare.feature_matrix(quarters(spark, d), SUBS, "URGENT", TRAIN)
    ratios = [c for c in df.columns if c.startswith("demand_ratio_")]  # the better correlated one first
    return df.withColumnsRenamed({c: f"ratio_{i}" for i, c in enumerate(ratios, 1)}).withColumn("trend_sq", F.col("trend_sq").cast("double"))


# --- exploration -----------------------------------------------------------------

@query("d2_yearly", [P1], "SELECT area, year, subcategory, round(CASE WHEN subcategory = 'LOW' THEN coalesce(sum(value), 0) ELSE avg(value) END, 4) AS value FROM p1 GROUP BY area, year, subcategory")
def _(spark, d):
    return stats.yearly(quarters(spark, d), ("LOW",))


@query("d3_units", [P1], "SELECT subcategory, min(unit) AS unit, count(DISTINCT unit) AS n_units, count(DISTINCT unit) > 1 AS mixed FROM p1 GROUP BY subcategory")
def _(spark, d):
    return stats.units(quarters(spark, d))


@query("d4_summary", [P1, DEMAND], """SELECT area, round(s, 1) AS start, round(e, 1) AS "end", round((e - s) / s * 100, 1) AS growth_pct, printf('%.1f%%', round((e - s) / s * 100, 1)) AS growth, round(slope, 2) AS slope, round(mean, 1) AS mean, round(sd, 1) AS std
FROM (SELECT area, max(CASE WHEN year = 2000 THEN demand END) AS s, coalesce(max(CASE WHEN year = 2024 THEN demand END), max_by(demand, year)) AS e, regr_slope(demand, year) AS slope, avg(demand) AS mean, stddev_samp(demand) AS sd FROM demand GROUP BY area)""")
def _(spark, d):
    return stats.summary(demand(spark, d), "demand", 2000, 2024)


@query("d5_period_rates", [P1, DEMAND], " UNION ALL ".join(f"SELECT area, '{a}-{b}' AS period, round(round(CASE WHEN s > 0 AND e >= 0 THEN (e / s) ** (1.0 / {b - a}) - 1 END,4) * 100, 4) AS cagr_pct FROM (SELECT area, max(CASE WHEN year = {a} THEN demand END) AS s, max(CASE WHEN year = {b} THEN demand END) AS e FROM demand GROUP BY area)" for a, b in growth.PERIODS))
def _(spark, d):
    return growth.period_rates(demand(spark, d), "demand")


@query("d6_gap_share", [P2, _WIDE2, _DENSE], " UNION ALL ".join(f"SELECT area, '{c}' AS feature, round(avg(CASE WHEN \"{c}\" IS NULL THEN 100.0 ELSE 0.0 END), 4) AS missing_pct FROM dense GROUP BY area" for c in COLUMNS))
def _(spark, d):
    return stats.gap_share(dense(spark, d), COLUMNS)


@query("d7_describe", [P1, _WIDE1], " UNION ALL ".join(f"SELECT '{c}' AS feature, count(\"{c}\") AS count, round(avg(\"{c}\"), 2) AS mean, round(stddev_samp(\"{c}\"), 2) AS std, round(min(\"{c}\"), 2) AS min, round(quantile_cont(\"{c}\", 0.25), 2) AS q25, round(quantile_cont(\"{c}\", 0.5), 2) AS q50, round(quantile_cont(\"{c}\", 0.75), 2) AS q75, round(max(\"{c}\"), 2) AS max FROM wide" for c in COLUMNS))
def _(spark, d):
    return stats.describe(wide(spark, d), COLUMNS)


@query("d7_quality_report", [P1], "SELECT 'rows' AS metric, count(*) AS value FROM p1 UNION ALL SELECT 'duplicates', (SELECT count(*) FROM p1) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p1)) UNION ALL SELECT 'columns', 5 " + " ".join(f"UNION ALL SELECT 'nulls_{c}', count(*) - count({c}) FROM p1" for c in ("area", "year", "subcategory", "unit", "value")))
def _(spark, d):
    return stats.quality_report(quarters(spark, d))


@query("d8_coverage", [P2, _WIDE2], "SELECT area, " + ", ".join(f'count(CASE WHEN year = {y} THEN "URGENT" END) AS "{y}"' for y in range(0, 12)) + " FROM wide2 GROUP BY area")
def _(spark, d):
    years = list(range(0, 12))
    found = stats.coverage(wide(spark, d, months), "URGENT", years)
    return found.select("area", *[F.coalesce(F.col(f"`{y}`"), F.lit(0).cast("bigint")).alias(str(y)) for y in years])


@query("d22_inventory", [P1], "SELECT min(year) AS first_year, max(year) AS last_year, count(DISTINCT area) AS n_areas, count(DISTINCT subcategory) AS n_subcategories FROM p1")
def _(spark, d):
    return stats.inventory(quarters(spark, d))


@query("e7_index", [P1, DEMAND], 'SELECT area, year, round(demand, 4) AS demand, round(demand / base * 100, 4) AS "index" FROM (SELECT *, max(CASE WHEN year = 2000 THEN demand END) OVER (PARTITION BY area) AS base FROM demand) WHERE base <> 0')
def _(spark, d):
    return growth.index_100(demand(spark, d), "demand", 2000)


@query("j14_stationarity")
def _(spark, d):
    return walkforward.stationarity(demand(spark, d), "demand")


# --- evaluation --------------------------------------------------------------------

@query("e14_walk_forward", _BASE, f"SELECT area, year, model, {rs('y_actual', 'y_pred')} FROM test")
def _(spark, d):
    return log(spark, d)


@query("h12_errors", _BASE, f"SELECT area, year, model, {rs('y_actual', 'y_pred')}, round(y_actual - y_pred, 4) AS error, round(abs(y_actual - y_pred) / (abs(y_actual) + 1e-9) * 100, 4) AS abs_pct_error FROM test")
def _(spark, d):
    return metrics.with_errors(log(spark, d))


@query("d13_accuracy", [*_BASE, METRICS], f"SELECT area, model, {rs('mae', 'rmse', 'mape')} FROM metrics")
def _(spark, d):
    return test_metrics(spark, d)


@query("d14_accuracy_extended", [*_BASE, METRICS], f"SELECT area, model, {rs('mae', 'rmse', 'mape', 'smape')}, n FROM metrics JOIN (SELECT area, model, avg(2 * abs(y_actual - y_pred) / nullif(abs(y_actual) + abs(y_pred), 0)) * 100 AS smape, count(*) AS n FROM test GROUP BY area, model) USING (area, model)")
def _(spark, d):
    return metrics.accuracy(log(spark, d), extended=True)


@query("c4_validation_against_test", [*_BASE, METRICS], "SELECT area, model, round(v, 4) AS mape_val, round(mape, 4) AS mape_test, round(mape - v, 4) AS gap FROM metrics JOIN (SELECT area, model, avg(CASE WHEN y_actual <> 0 THEN abs((y_actual - y_pred) / y_actual) END) * 100 AS v FROM log WHERE year <= 2020 GROUP BY area, model) USING (area, model)")
def _(spark, d):
    return metrics.validation_against_test(metrics.accuracy(log(spark, d, list(range(TRAIN + 1, VAL + 1)))), test_metrics(spark, d))


@query("c5_skill", [*_BASE, METRICS], "SELECT m.area, m.model, round((1 - m.mape / b.mape) * 100, 4) AS skill_pct FROM metrics m JOIN metrics b ON m.area = b.area AND b.model = 'Naive' WHERE b.mape <> 0 AND m.mape IS NOT NULL")
def _(spark, d):
    return metrics.skill(test_metrics(spark, d))


_FAMILY = "family AS (SELECT area, arg_min(model, mape) FILTER (model IN ('Naive', 'LinearTrend')) AS classic_model, min(mape) FILTER (model IN ('Naive', 'LinearTrend')) AS classic_mape, arg_min(model, mape) FILTER (model NOT IN ('Naive', 'LinearTrend')) AS deep_model, min(mape) FILTER (model NOT IN ('Naive', 'LinearTrend')) AS deep_mape FROM metrics GROUP BY area)"


def _families(spark, d) -> tuple[DataFrame, DataFrame]:
    m = test_metrics(spark, d)
    return m.where(F.col("model").isin("Naive", "LinearTrend")), m.where(~F.col("model").isin("Naive", "LinearTrend"))


@query("c9_family_comparison", [*_BASE, METRICS, _FAMILY], "SELECT area, classic_model, round(classic_mape, 4) AS classic_mape, deep_model, round(deep_mape, 4) AS deep_mape, CASE WHEN deep_mape < classic_mape THEN deep_model ELSE classic_model END AS winner, round(classic_mape - deep_mape, 4) AS gain FROM family")
def _(spark, d):
    return metrics.family_comparison(*_families(spark, d))


@query("c16_best_overview", [*_BASE, METRICS, _FAMILY], f"SELECT area, classic_model, {rs('classic_mape')}, deep_model, {rs('deep_mape')} FROM family")
def _(spark, d):
    return serving.best_overview(*_families(spark, d))


@query("e19_best_residuals", [*_BASE, METRICS], "SELECT area, year, model, round(y_actual - y_pred, 4) AS error FROM test JOIN (SELECT area, model FROM best) USING (area, model)")
def _(spark, d):
    return metrics.best_residuals(log(spark, d), metrics.best_models(test_metrics(spark, d)))


@query("g2_metric_matrix", [*_BASE, METRICS], "SELECT area, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN mape END), 4) AS \"{m}\"" for m in ("LinearTrend", "MA3", "Naive")) + " FROM metrics GROUP BY area")
def _(spark, d):
    return reshape.pivot_matrix(test_metrics(spark, d), "area", "model", ["LinearTrend", "MA3", "Naive"], F.max("mape"))


@query("c10_model_pairs", [*_BASE, _PAIRS], f"SELECT area, year, model_a, model_b, {rs('y', 'ea', 'eb')} FROM pairs")
def _(spark, d):
    return significance.pairs(log(spark, d))


_DM = """ds_ AS (SELECT area, model_a, model_b, year, ea * ea - eb * eb AS d FROM pairs), dl AS (SELECT *, lag(d) OVER (PARTITION BY area, model_a, model_b ORDER BY year) AS b FROM ds_),
dm AS (SELECT area, model_a, model_b, count(*) AS n, avg(d) AS mean, (var_samp(d) + 2 * coalesce(covar_samp(d, b), 0)) / count(*) AS v FROM dl GROUP BY ALL)"""


@query("j12_diebold_mariano", [*_BASE, _PAIRS, _DM], "SELECT area, model_a, model_b, n, v > 0 AS dm_ok, round(CASE WHEN v > 0 THEN mean / sqrt(v) ELSE 0 END, 4) AS dm_stat FROM dm")
def _(spark, d):
    return significance.diebold_mariano(significance.pairs(log(spark, d)))


_WX = """wd AS (SELECT area, model_a, model_b, round(abs(ea) - abs(eb), 9) AS d FROM pairs), wv AS (SELECT area, model_a, model_b, abs(d) AS size, count(*) AS t, count(CASE WHEN d > 0 THEN 1 END) AS up FROM wd WHERE d <> 0 GROUP BY ALL),
wr AS (SELECT *, sum(t) OVER (PARTITION BY area, model_a, model_b ORDER BY size) - t + (t + 1) / 2.0 AS r FROM wv),
ws AS (SELECT area, model_a, model_b, CAST(sum(t) AS BIGINT) AS n_nonzero, CAST(sum(r * up) AS DOUBLE) AS w_plus, CAST(sum(r * (t - up)) AS DOUBLE) AS w_minus, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM wr GROUP BY ALL)"""


@query("j12_signed_ranks", [*_BASE, _PAIRS, _WX], "SELECT area, model_a, model_b, coalesce(n_nonzero, 0) AS n_nonzero, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, coalesce(ties, 0) AS ties, least(coalesce(w_plus, 0), coalesce(w_minus, 0)) AS w FROM (SELECT DISTINCT area, model_a, model_b FROM wd) LEFT JOIN ws USING (area, model_a, model_b)")
def _(spark, d):
    return significance.signed_ranks(significance.pairs(log(spark, d)))


@query("j12_paired_t", [*_BASE, _PAIRS], "SELECT area, model_a, model_b, count(*) AS n, round(coalesce(avg(abs(ea) - abs(eb)) / nullif(stddev_samp(abs(ea) - abs(eb)) / sqrt(count(*)), 0), 0), 4) AS t_stat FROM pairs GROUP BY area, model_a, model_b")
def _(spark, d):
    return significance.paired_t(significance.pairs(log(spark, d)))


@query("j12_significance_tests")
def _(spark, d):
    return significance.significance_tests(log(spark, d))


@query("j12_dm_flags", [*_BASE, _PAIRS, _DM], "SELECT area, model_a, model_b, v > 0 AND abs(mean / sqrt(v)) > 1.959964 AS significant_dm FROM dm")
def _(spark, d):
    return significance.significance_tests(log(spark, d)).select("area", "model_a", "model_b", "significant_dm")


@query("d17_dm_summary", [*_BASE, _PAIRS, _DM], "SELECT area, count(*) AS total_pairs, count(CASE WHEN v > 0 AND abs(mean / sqrt(v)) > 1.959964 THEN 1 END) AS significant_dm FROM dm GROUP BY area")
def _(spark, d):
    return significance.significance_summary(significance.significance_tests(log(spark, d))).select("area", "total_pairs", "significant_dm")


@query("d17_significance_summary")
def _(spark, d):
    return significance.significance_summary(significance.significance_tests(log(spark, d)))


_HLN = "he AS (SELECT area, year, model, (y_pred - y_actual) / nullif(y_actual, 0) * 100 AS e FROM test), hd AS (SELECT a.area, a.model AS model_a, b.model AS model_b, a.e * a.e - b.e * b.e AS d FROM he a JOIN he b ON a.area = b.area AND a.year = b.year AND a.model < b.model WHERE a.e IS NOT NULL AND b.e IS NOT NULL)"
_HLN_STAT = "count(*) AS n, round(CASE WHEN count(*) >= 2 THEN avg(d) / sqrt(greatest(var_samp(d), 1e-12) / count(*)) * sqrt((count(*) - 1.0) / count(*)) END, 4) AS hln_stat"


@query("j13_hln_by_area", [*_BASE, _HLN], f"SELECT area, model_a, model_b, {_HLN_STAT} FROM hd GROUP BY area, model_a, model_b")
def _(spark, d):
    return significance.hln(log(spark, d))


@query("j13_hln_pooled", [*_BASE, _HLN], f"SELECT model_a, model_b, {_HLN_STAT} FROM hd GROUP BY model_a, model_b")
def _(spark, d):
    return significance.hln(log(spark, d), pooled=True)


_HLN_LAGS = """hy AS (SELECT a.model AS model_a, b.model AS model_b, a.area, a.year, a.e * a.e - b.e * b.e AS d FROM he a JOIN he b ON a.area = b.area AND a.year = b.year AND a.model < b.model WHERE a.e IS NOT NULL AND b.e IS NOT NULL),
hl AS (SELECT *, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM hy WINDOW w AS (PARTITION BY model_a, model_b ORDER BY area, year)),
hg AS (SELECT model_a, model_b, count(*) AS n, avg(d) AS mean, var_samp(d) + 2 * covar_samp(d, d1) + 2 * covar_samp(d, d2) AS v FROM hl GROUP BY model_a, model_b)"""


@query("j13_hln_pooled_lags", [*_BASE, _HLN, _HLN_LAGS], "SELECT model_a, model_b, n, round(mean / sqrt(greatest(v, 1e-12) / n) * sqrt(greatest((n - 5 + 6.0 / n) / n, 0)), 4) AS hln_stat FROM hg")
def _(spark, d):
    return significance.hln(log(spark, d), pooled=True, horizon=3)


_WXP = _WX.replace("FROM pairs)", "FROM (SELECT a.model AS model_a, b.model AS model_b, a.e AS ea, b.e AS eb FROM he a JOIN he b ON a.area = b.area AND a.year = b.year AND a.model < b.model WHERE a.e IS NOT NULL AND b.e IS NOT NULL))").replace("area, model_a", "model_a")


@query("j13_pooled_ranks", [*_BASE, _HLN, _WXP], "SELECT model_a, model_b, n_nonzero, w_plus, w_minus, ties, least(w_plus, w_minus) AS w FROM ws")
def _(spark, d):
    return significance.signed_ranks(significance.pct_pairs(log(spark, d)), ("model_a", "model_b"), spread=True)


@query("j13_hln_tests")
def _(spark, d):
    return significance.hln_tests(log(spark, d), pooled=True)


@query("j2_series_walk_forward")
def _(spark, d):
    return walkforward.series_predictions(demand(spark, d), "demand", YEARS)


def _matrix(spark, d) -> tuple[DataFrame, list[str]]:
    df = features.trend(features.lag_features(demand(spark, d), ["demand"]))
    return reshape.drop_null_lags(df), ["demand_lag1", "demand_lag2", "demand_lag3", "demand_ma3", "demand_ma5", "demand_yoy", "trend"]


@query("j4_linear_walk_forward")
def _(spark, d):
    df, names = _matrix(spark, d)
    return walkforward.linear_predictions(df, names, "demand", YEARS)


@query("j5_tree_walk_forward")
def _(spark, d):
    df, names = _matrix(spark, d)
    return walkforward.tree_predictions(df, names, "demand", YEARS)


@query("j6_feature_importance")
def _(spark, d):
    df, names = _matrix(spark, d)
    return walkforward.feature_importance(df, names, "demand", TRAIN)


@query("j7_tuned_ridge")
def _(spark, d):
    df, names = _matrix(spark, d)
    return walkforward.tune_ridge(df, names, "demand", VAL)


@query("j7_tuned_linear")
def _(spark, d):
    df, names = _matrix(spark, d)
    return walkforward.tune_linear(df, names, "demand", VAL)


@query("j7_tuned_trees")
def _(spark, d):
    df, names = _matrix(spark, d)
    return walkforward.tune_trees(df, names, "demand", VAL).withColumn("parameters", F.to_json("parameters"))


@query("j1_full_log")
def _(spark, d):
    df, names = _matrix(spark, d)
    return metrics.with_errors(walkforward.full_log(df, names, "demand", YEARS))


@query("j1_window_rows", _BASE, f"SELECT area, year, model, {rs('y_actual', 'y_pred')} FROM test WHERE model IN ('Naive', 'LinearTrend')")
def _(spark, d):
    return walkforward.full_log(demand(spark, d), [], "demand", YEARS, ("Naive", "LinearTrend"))


@query("j1_model_report")
def _(spark, d):
    df, names = _matrix(spark, d)
    return report.model_report(cut(walkforward.full_log(df, names, "demand", YEARS)), growth.last_known(demand(spark, d, VAL), "demand"))


# --- forecasts -----------------------------------------------------------------------

_FC = [P1, DEMAND, FORECAST]


@query("j3_linear_forecast", _FC, f"SELECT area, model, year, {rs('forecast')} FROM trend")
def _(spark, d):
    return trend(spark, d)


@query("j3_persistence", [P1, DEMAND], "SELECT area, 'Persistence' AS model, CAST(last + h AS INT) AS year, round(f, 4) AS forecast FROM (SELECT area, max(year) AS last, max_by(demand, year) AS f FROM demand WHERE year <= 2024 GROUP BY area), range(1, 7) t(h)")
def _(spark, d):
    return forecast.persistence(demand(spark, d, TEST), "demand", 6)


@query("j3_series_forecasts")
def _(spark, d):
    return forecast.series_forecasts(demand(spark, d, TEST), "demand", 6)


@query("j8_recursive_forecast")
def _(spark, d):
    df, names = _matrix(spark, d)
    return forecast.recursive_forecast(df.where(F.col("year") <= TEST), names, "demand", 6)


@query("j8_recursive_exogenous")
def _(spark, d):
    df = prepare.feature_matrix(quarters(spark, d), SUBS, "URGENT", TRAIN).where(F.col("year") <= TEST)
    names = [f"{c}_{x}" for c in ("URGENT", "LOW") for x in ("lag1", "lag2", "lag3", "ma3", "ma5", "yoy")]
    return forecast.recursive_forecast(df, [*names, "trend"], "URGENT", 6, columns=["LOW"])


@query("j15_all_forecasts")
def _(spark, d):
    df, names = _matrix(spark, d)
    return forecast.all_forecasts(df.where(F.col("year") <= TEST), names, "demand", 6)


_LAST = "last AS (SELECT area, max_by(demand, year) AS anchor, max(year) AS known FROM demand WHERE year <= 2024 GROUP BY area)"


@query("j15_trend_forecasts", [*_FC, _LAST], """SELECT area, m.model, year, round(least(greatest(forecast, anchor - abs(anchor) * (0.4 + 0.1 * (year - known - 1))), anchor + abs(anchor) * (0.4 + 0.1 * (year - known - 1))), 4) AS forecast
FROM trend JOIN last USING (area), (VALUES ('Naive'), ('LinearTrend')) m(model)""")
def _(spark, d):
    return forecast.all_forecasts(demand(spark, d, TEST), [], "demand", 6, models=("Naive", "LinearTrend"), digits=None)


@query("j16_best_forecasts")
def _(spark, d):
    df, names = _matrix(spark, d)
    found = cut(walkforward.full_log(df, names, "demand", YEARS))
    return forecast.best_forecasts(df.where(F.col("year") <= TEST), metrics.best_models(metrics.accuracy(found)), "demand", 6, names, log=found)


_EXTRA = """lw AS (UNPIVOT (SELECT * FROM wide2 WHERE area IN (SELECT area FROM wide2)) ON "URGENT", "LOW" INTO NAME feature VALUE value),
le AS (SELECT w.area, w.year, f.feature, CASE f.feature WHEN 'URGENT' THEN w."URGENT" ELSE w."LOW" END AS value FROM wide2 w, (VALUES ('URGENT'), ('LOW')) f(feature)),
lm AS (SELECT area, feature, row_number() OVER (PARTITION BY area, feature ORDER BY year) - 1 AS i, coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY area, feature)) AS value FROM le),
lf AS (SELECT area, feature, regr_slope(value, i) AS slope, regr_intercept(value, i) AS level, count(*) AS n, max_by(value, i) AS last FROM lm GROUP BY ALL),
lx AS (SELECT *, level + slope * (n + step - 1) AS line, abs(last) * (0.30 + 0.05 * (step - 1)) AS room FROM lf, range(1,4) s(step))"""


@query("j9_extrapolate", [P2, _WIDE2, _EXTRA], "SELECT area, feature, CAST(step AS INT) AS step, round(CASE WHEN last = 0 THEN line ELSE least(greatest(line, last - room), last + room) END, 4) AS value FROM lx")
def _(spark, d):
    return forecast.extrapolate(wide(spark, d, months), ["URGENT", "LOW"], 3)


@query("j15_clamp", [*_BASE, ANCHORS], "SELECT area, model, year, round(least(greatest(f, anchor - abs(anchor) * (0.4 + 0.1 * i)), anchor + abs(anchor) * (0.4 + 0.1 * i)), 4) AS forecast FROM (SELECT t.area, model, year, y_pred AS f, anchor, row_number() OVER (PARTITION BY t.area, model ORDER BY year) - 1 AS i FROM test t JOIN anchors USING (area))")
def _(spark, d):
    return forecast.clamp(as_forecast(spark, d), anchors(spark, d), digits=None)


_BOOT = f"""res AS (SELECT area, y_actual - y_pred AS error, row_number() OVER (PARTITION BY area ORDER BY year) - 1 AS k, count(*) OVER (PARTITION BY area) AS n FROM test WHERE model = 'MA3'),
st AS (SELECT area, model, year, forecast, row_number() OVER (PARTITION BY area, model ORDER BY year) AS step FROM trend),
dr AS (SELECT st.*, draw, CAST('0x' || substr(md5(st.area || '~' || draw || '~' || step || '~42'), 1, 8) AS BIGINT) % (SELECT max(n) FROM res r WHERE r.area = st.area) AS k FROM st, range(1, {forecast.DRAWS + 1}) b(draw)),
bv AS (SELECT dr.area, dr.model, dr.year, dr.forecast, dr.forecast + avg(error) OVER (PARTITION BY dr.area, dr.model, draw ORDER BY step) AS v FROM dr JOIN res ON dr.area = res.area AND dr.k = res.k)"""


@query("j11_residual_bootstrap", [*_BASE, FORECAST, _BOOT], "SELECT area, model, year, round(forecast, 4) AS forecast, round(least(quantile_cont(v, 0.05), forecast), 4) AS lower_90, round(greatest(quantile_cont(v, 0.95), forecast), 4) AS upper_90 FROM bv GROUP BY area, model, year, forecast")
def _(spark, d):
    errors = metrics.with_errors(log(spark, d)).where("model = 'MA3'").select("area", "year", "error")
    return forecast.residual_bootstrap(trend(spark, d), errors)


@query("c13_anchors", [P1, DEMAND, ANCHORS], f"SELECT area, {rs('anchor')} FROM anchors")
def _(spark, d):
    return anchors(spark, d).select("area", "anchor")


@query("d16_robustness", [*_BASE, ANCHORS, _ROBUST], "SELECT * FROM robust")
def _(spark, d):
    return robustness.robustness(as_forecast(spark, d), anchors(spark, d))


_RANKED = "area, model, max_deviation_pct, max_yoy_change_pct, trajectory_std, direction_flips, robustness_flag, round(mape, 4) AS mape, accuracy_rank, robustness_rank, coalesce(abs(accuracy_rank - robustness_rank) <= 2, false) AS axes_agree"


@query("e9_robustness_against_accuracy", [*_BASE, METRICS, ANCHORS, _ROBUST, _RANKS], f"SELECT {_RANKED} FROM ranks")
def _(spark, d):
    found = robustness.against_accuracy(robustness.robustness(as_forecast(spark, d), anchors(spark, d)), test_metrics(spark, d))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("accuracy_rank", "robustness_rank")})


def _conflicts(spark, d):
    return robustness.conflicts(metrics.best_models(test_metrics(spark, d)), robustness.robustness(as_forecast(spark, d), anchors(spark, d)))


_CONFLICT = "conf AS (SELECT area, model, mape, robustness_flag, max_deviation_pct, coalesce(robustness_flag IN ('WATCH', 'UNSTABLE'), false) AS conflict FROM best LEFT JOIN robust USING (area, model))"


@query("c7_conflicts", [*_BASE, METRICS, ANCHORS, _ROBUST, _CONFLICT], f"SELECT area, model, {rs('mape')}, robustness_flag, max_deviation_pct, conflict FROM conf")
def _(spark, d):
    return _conflicts(spark, d)


@query("d18_conflict_count", [*_BASE, METRICS, ANCHORS, _ROBUST, _CONFLICT], "SELECT count(CASE WHEN conflict THEN 1 END) AS conflicts, count(*) AS areas FROM conf")
def _(spark, d):
    return robustness.conflict_count(_conflicts(spark, d))


@query("e18_interval_widths", [*_FC, _BANDED], "SELECT area, " + ", ".join(f'round(max(CASE WHEN year = {y} THEN upper_90 - lower_90 END), 4) AS "{y}"' for y in range(2025, 2031)) + " FROM banded GROUP BY area")
def _(spark, d):
    return robustness.interval_widths(banded(spark, d), list(range(2025, 2031)))


@query("d19_growth_summary", [*_BASE, METRICS, FORECAST, _BANDED], """SELECT area, model, round(h, 4) AS last, round(near, 4) AS near, round(far, 4) AS far, round(fl, 4) AS far_lower, round(fu, 4) AS far_upper, round(CASE WHEN h > 0 THEN (far - h) / h * 100 END, 4) AS total_growth_pct,
round(CASE WHEN h > 0 AND far >= 0 THEN (far / h) ** (1.0 / 6) - 1 END * 100, 4) AS cagr_pct, CASE WHEN mape < 3 THEN 'Excellent' WHEN mape < 7 THEN 'Good' WHEN mape < 15 THEN 'Moderate' ELSE 'Poor' END AS quality
FROM (SELECT area, max_by(demand, year) AS h FROM demand WHERE year <= 2024 GROUP BY area) LEFT JOIN (SELECT area, mape FROM best) USING (area) JOIN (SELECT area, max(CASE WHEN year = 2030 THEN model END) AS model, max(CASE WHEN year = 2025 THEN forecast END) AS near, max(CASE WHEN year = 2030 THEN forecast END) AS far, max(CASE WHEN year = 2030 THEN lower_90 END) AS fl, max(CASE WHEN year = 2030 THEN upper_90 END) AS fu FROM banded GROUP BY area) USING (area) WHERE near IS NOT NULL AND far IS NOT NULL""")
def _(spark, d):
    return growth.growth_summary(demand(spark, d, TEST), banded(spark, d), metrics.best_models(test_metrics(spark, d)), "demand")


_BETWEEN = "btw AS (SELECT area, demand AS s, forecast AS e, round((forecast - demand) / nullif(demand, 0) * 100, 2) AS growth_pct, round(CASE WHEN demand > 0 AND forecast >= 0 THEN (forecast / demand) ** (1.0 / 8) - 1 END * 100, 2) AS cagr_pct FROM (SELECT area, demand FROM demand WHERE year = 2020) JOIN (SELECT area, forecast FROM trend WHERE year = 2028) USING (area))"


@query("d20_growth_between", [*_FC, _BETWEEN], 'SELECT area, round(s, 4) AS start, round(e, 4) AS "end", growth_pct, cagr_pct FROM btw')
def _(spark, d):
    return growth.growth_between(demand(spark, d), trend(spark, d), "demand", 2020, 2028)


@query("c15_direction_flips", [*_FC, _BETWEEN], "SELECT area, a AS cagr_a, b AS cagr_b FROM (SELECT area, cagr_pct AS a FROM btw) JOIN (SELECT area, round((max(CASE WHEN year = 2024 THEN demand END) / max(CASE WHEN year = 2016 THEN demand END)) ** (1.0 / 8) * 100 - 100, 2) AS b FROM demand GROUP BY area) USING (area) WHERE sign(a) * sign(b) < 0")
def _(spark, d):
    a = growth.growth_between(demand(spark, d), trend(spark, d), "demand", 2020, 2028)
    ends = demand(spark, d).groupBy("area").agg(*[F.max(F.when(F.col("year") == y, F.col("demand"))).alias(f"y{y}") for y in (2016, 2024)])
    return growth.direction_flips(a, ends.select("area", F.round(F.pow(F.col("y2024") / F.col("y2016"), F.lit(1 / 8)) * 100 - 100, 2).alias("cagr_pct")))


@query("d21_highest_forecast", _FC, "SELECT area, round(avg(forecast), 4) AS mean_forecast FROM trend GROUP BY area ORDER BY avg(forecast) DESC, area LIMIT 3")
def _(spark, d):
    return serving.highest_forecast(trend(spark, d), 3)


@query("d21_highest_growth", [*_FC, _BETWEEN], "SELECT area, cagr_pct FROM btw ORDER BY cagr_pct DESC, area LIMIT 3")
def _(spark, d):
    return serving.highest_growth(growth.growth_between(demand(spark, d), trend(spark, d), "demand", 2020, 2028), 3)


@query("c17_promotion", [*_BASE, METRICS], """SELECT area, 'classic' AS model_type, CASE WHEN m IS NULL OR mape < m - 0.5 THEN model ELSE v END AS champion, round(CASE WHEN m IS NULL OR mape < m - 0.5 THEN mape ELSE m END, 4) AS champion_mape, CASE WHEN m IS NULL OR mape < m - 0.5 THEN 'Production' ELSE 'Staging' END AS challenger_stage
FROM best LEFT JOIN (SELECT area, model AS v, mape AS m FROM metrics WHERE model = 'Naive' AND area < 'M') USING (area)""")
def _(spark, d):
    m = test_metrics(spark, d)
    row = lambda df: df.select("area", F.lit("classic").alias("model_type"), F.col("model").alias("version"), "mape")
    return metrics.promote(row(m.where("model = 'Naive' and area < 'M'")), row(metrics.best_models(m)), 0.5)


@query("g8_table_difference", [P1, DEMAND], "SELECT 'differs: demand' AS issue, count(*) AS n, round(max(abs(demand * 0.1)), 4) AS worst FROM demand WHERE year = 2010 UNION ALL SELECT 'row only in a', count(*), NULL FROM demand WHERE year = 2024")
def _(spark, d):
    a = demand(spark, d)
    b = a.where("year <> 2024").withColumn("demand", F.when(F.col("year") == 2010, F.col("demand") * 0.9).otherwise(F.col("demand")))
    return metrics.differences(a, b, ["area", "year"])


# --- reads ---------------------------------------------------------------------------

_AREA = "(SELECT n_name FROM nation WHERE n_nationkey = 7)"


def _area(spark, d) -> str:
    return spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey = 7").first()["n_name"]


@query("k1_area_forecast", _FC, f"SELECT area, model, year, {rs('forecast')} FROM trend WHERE area = {_AREA}")
def _(spark, d):
    return serving.area_forecast(trend(spark, d), _area(spark, d).lower())


@query("k2_histories", [P1, DEMAND], "SELECT area, count(*) AS n, min(year) AS first_year, round(sum(demand), 4) AS total, string_agg(year || '=' || CAST(floor(demand * 100 + 0.500001) AS BIGINT), ' ' ORDER BY year) AS points FROM demand GROUP BY area")
def _(spark, d):
    found = serving.histories(demand(spark, d), "demand")
    return found.select("area", F.size("points").cast("bigint").alias("n"), F.get("points", F.lit(0))["year"].alias("first_year"), F.aggregate("points", F.lit(0.0), lambda s, p: s + p["value"]).alias("total"), F.array_join(F.transform("points", lambda p: F.concat_ws("=", p["year"].cast("string"), cents(p["value"]))), " ").alias("points"))


@query("k3_subcategory_series", [P1], f"SELECT subcategory, year, unit, round(avg(value), 4) AS value FROM p1 WHERE area = {_AREA} GROUP BY ALL")
def _(spark, d):
    rows = reshape.same_area(quarters(spark, d), _area(spark, d))
    return stats.yearly(rows).join(stats.units(rows).select("subcategory", "unit"), "subcategory").select("subcategory", "year", "unit", "value")


@query("c11_period_join", [P1, DEMAND], """SELECT area, year, coalesce((SELECT arg_min(n_name, n_nationkey) FROM nation WHERE year BETWEEN 1998 + n_nationkey % 20 AND 1998 + n_nationkey % 20 + n_regionkey * n_regionkey - 1), 'Normal') AS period FROM demand""")
def _(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    start = 1998 + F.col("n_nationkey") % 20
    periods = nation.select(F.col("n_nationkey").alias("place"), start.alias("start"), (start + F.col("n_regionkey") * F.col("n_regionkey") - 1).alias("end"), F.col("n_name").alias("name"))
    return serving.with_periods(demand(spark, d), periods).select("area", "year", "period")


_PERIODS = [(2003, 2005, "First"), (2005, 2008, "Second"), (2019, 2020, "Third")]


@query("k4_scatter", [P1, _WIDE1], 'SELECT area, year, round("URGENT", 4) AS x, round("LOW", 4) AS y, CASE WHEN year BETWEEN 2003 AND 2005 THEN \'First\' WHEN year BETWEEN 2005 AND 2008 THEN \'Second\' WHEN year BETWEEN 2019 AND 2020 THEN \'Third\' ELSE \'Normal\' END AS period FROM wide WHERE "URGENT" IS NOT NULL AND "LOW" IS NOT NULL')
def _(spark, d):
    return serving.scatter(wide(spark, d), "URGENT", "LOW", _PERIODS)


@query("k5_model_paths", _BASE, f"SELECT model, count(*) AS n, round(sum(y_pred), 4) AS total, string_agg(year || '=' || CAST(floor(y_pred * 100 + 0.500001) AS BIGINT), ' ' ORDER BY year) AS points FROM test WHERE area = {_AREA} GROUP BY model")
def _(spark, d):
    found = serving.model_paths(as_forecast(spark, d), _area(spark, d))
    return found.select("model", F.size("points").cast("bigint").alias("n"), F.aggregate("points", F.lit(0.0), lambda s, p: s + p["forecast"]).alias("total"), F.array_join(F.transform("points", lambda p: F.concat_ws("=", p["year"].cast("string"), cents(p["forecast"]))), " ").alias("points"))


@query("k6_area_metrics", [*_BASE, METRICS], f"SELECT m.area, m.model, round(m.mae, 4) AS mae, round(m.rmse, 4) AS rmse, round(m.mape, 4) AS mape, b.model IS NOT NULL AS best FROM metrics m LEFT JOIN best b ON m.area = b.area AND m.model = b.model WHERE m.area = {_AREA}")
def _(spark, d):
    return serving.area_metrics(test_metrics(spark, d), _area(spark, d))


@query("k7_area_robustness", [*_BASE, METRICS, ANCHORS, _ROBUST, _RANKS], f"SELECT {_RANKED} FROM ranks WHERE area = {_AREA}")
def _(spark, d):
    return reshape.same_area(_queries["e9_robustness_against_accuracy"](spark, d), _area(spark, d))


@query("k7_area_significance", [*_BASE, _PAIRS, _DM], f"SELECT area, model_a, model_b, n, round(CASE WHEN v > 0 THEN mean / sqrt(v) ELSE 0 END, 4) AS dm_stat FROM dm WHERE area = {_AREA}")
def _(spark, d):
    return serving.area_significance(significance.significance_tests(log(spark, d)), _area(spark, d)).select("area", "model_a", "model_b", "n", "dm_stat")


@query("b8_gap_shares", [P2, _WIDE2, _DENSE], " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CASE WHEN \"{c}\" IS NULL THEN 1.0 ELSE 0.0 END), 4) AS share FROM dense WHERE year <= 40" for c in COLUMNS))
def _(spark, d):
    return impute.gap_shares(dense(spark, d), COLUMNS, 40)


@query("k8_growth_by_area", [*_FC, _BETWEEN], f"SELECT area, growth_pct, cagr_pct FROM btw WHERE area = {_AREA}")
def _(spark, d):
    return reshape.same_area(growth.growth_between(demand(spark, d), trend(spark, d), "demand", 2020, 2028), _area(spark, d)).select("area", "growth_pct", "cagr_pct")


@query("k10_forecast_text", _FC, "SELECT area, area || ': ' || min(year) || '=' || printf('%.1f', min_by(forecast, year)) || ', ' || max(year) || '=' || printf('%.1f', max_by(forecast, year)) AS line FROM trend GROUP BY area")
def _(spark, d):
    return serving.forecast_text(trend(spark, d))


@query("c12_event_years", [P1, DEMAND], "SELECT area, year, round(demand, 4) AS demand, CASE year WHEN 2008 THEN 'crisis' WHEN 2020 THEN 'pandemic' END AS event FROM demand")
def _(spark, d):
    return serving.with_events(demand(spark, d), [(2008, "crisis"), (2020, "pandemic")]).select("area", "year", "demand", "event")


@query("g4_first_per_key", [P1], "SELECT area, year, subcategory, round(value, 4) AS value FROM p1 QUALIFY row_number() OVER (PARTITION BY area, year ORDER BY value DESC, subcategory) = 1")
def _(spark, d):
    return reshape.first_per_key(quarters(spark, d), ["area", "year"], [F.col("value").desc(), F.col("subcategory")]).drop("unit")


@query("b9_full_lags", [P1, _WIDE1], 'SELECT * FROM (SELECT area, year, round(lag("URGENT", 1) OVER w, 4) AS "URGENT_lag1", round(lag("URGENT", 2) OVER w, 4) AS "URGENT_lag2", round(lag("URGENT", 3) OVER w, 4) AS "URGENT_lag3" FROM wide WINDOW w AS (PARTITION BY area ORDER BY year)) WHERE "URGENT_lag1" IS NOT NULL AND "URGENT_lag2" IS NOT NULL AND "URGENT_lag3" IS NOT NULL')
def _(spark, d):
    found = features.lag_features(wide(spark, d).select("area", "year", "URGENT"), ["URGENT"])
    return reshape.drop_null_lags(found).select("area", "year", "URGENT_lag1", "URGENT_lag2", "URGENT_lag3")


@query("b13_finite_metrics", [*_BASE, METRICS], "SELECT area, model, round(mape, 4) AS mape FROM metrics WHERE mape IS NOT NULL AND mape < 'inf'::DOUBLE")
def _(spark, d):
    return test_metrics(spark, d).select("area", "model", F.when(col.finite(F.col("mape")).isNotNull(), F.col("mape")).alias("mape")).where("mape is not null")


@query("h11_signed_errors", _BASE, "SELECT area, year, model, round((y_pred - y_actual) / nullif(y_actual, 0) * 100, 4) AS error_pct FROM test")
def _(spark, d):
    return log(spark, d).select("area", "year", "model", col.error_pct(F.col("y_pred"), F.col("y_actual")).alias("error_pct"))


@query("c8_deep_robustness", [*_BASE, METRICS, ANCHORS, _ROBUST], "SELECT area, model, round(mape, 4) AS mape, robustness_flag, max_deviation_pct, coalesce(robustness_flag IN ('WATCH', 'UNSTABLE'), false) AS conflict FROM (SELECT * FROM metrics WHERE model LIKE 'MA%' AND mape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY area ORDER BY mape, model) = 1) LEFT JOIN robust USING (area, model)")
def _(spark, d):
    deep = test_metrics(spark, d).where("model like 'MA%'")
    return robustness.conflicts(metrics.best_models(deep), robustness.robustness(as_forecast(spark, d).where("model like 'MA%'"), anchors(spark, d)))


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
