"""Panels over the test tables: orders by nation and quarter or month, events by user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBS = ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]
COLUMNS = ["URGENT", "HIGH", "MEDIUM", "NOT_SPECIFIED", "LOW"]
TRAIN, VAL, TEST = 2016, 2020, 2024


def _orders(spark: SparkSession, d: str, time) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    orders = read("orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    rows = orders.join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("area"), time.cast("int").alias("year"), F.expr("substring(o_orderpriority, 3)").alias("subcategory"), F.lit("USD").alias("unit"), F.col("o_totalprice").alias("value"))


def quarters(spark: SparkSession, d: str) -> DataFrame:
    """Quarter panel: `year` 2000 is the first quarter of 1995, so that the usual bounds 2016, 2020 and 2024 apply."""
    return _orders(spark, d, 2000 + (F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1)


def months(spark: SparkSession, d: str) -> DataFrame:
    """Month panel: `year` counts months from 0; it has gaps."""
    return _orders(spark, d, (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1)


def user_days(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_type", "value")
    return rows.select(F.col("user_id").cast("string").alias("area"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("year"), F.col("event_type").alias("subcategory"), F.lit("unit").alias("unit"), "value")


_JOIN = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
P1 = f"p1 AS (SELECT n_name AS area, CAST(2000 + (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INT) AS year, substr(o_orderpriority, 3) AS subcategory, 'USD' AS unit, o_totalprice AS value {_JOIN})"
P2 = f"p2 AS (SELECT n_name AS area, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS year, substr(o_orderpriority, 3) AS subcategory, 'USD' AS unit, o_totalprice AS value {_JOIN})"
P3 = "p3 AS (SELECT CAST(user_id AS VARCHAR) AS area, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS year, event_type AS subcategory, 'unit' AS unit, value FROM events)"
DEMAND = "demand AS (SELECT area, year, avg(value) AS demand FROM p1 GROUP BY area, year)"
WIDE = lambda p, name: f"{name} AS (SELECT area, year, " + ", ".join(f"avg(CASE WHEN subcategory = '{s}' THEN value END) AS \"{c}\"" for s, c in zip(SUBS, COLUMNS)) + f" FROM {p} GROUP BY area, year)"
LOG = """walk AS (SELECT area, year, demand AS y, row_number() OVER (PARTITION BY area ORDER BY year) - 1 AS i FROM demand),
guess AS (SELECT area, year, y, count(y) OVER past AS n, lag(y) OVER w AS naive, regr_intercept(y, i) OVER past + regr_slope(y, i) OVER past * i AS line,
  avg(y) OVER (PARTITION BY area ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ma3,
  avg(y) OVER (PARTITION BY area ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma5, lag(y,4) OVER w AS season
  FROM walk WINDOW w AS (PARTITION BY area ORDER BY year), past AS (PARTITION BY area ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
log AS (SELECT area, year, m.model, y AS y_actual, CASE m.model WHEN 'Naive' THEN naive WHEN 'LinearTrend' THEN line WHEN 'MA3' THEN ma3 WHEN 'MA5' THEN ma5 ELSE season END AS y_pred
  FROM guess, (VALUES ('Naive'), ('LinearTrend'), ('MA3'), ('MA5'), ('SeasonalLag')) m(model) WHERE n >= 5 AND year BETWEEN 2017 AND 2024),
test AS (SELECT * FROM log WHERE year > 2020)"""
METRICS = """metrics AS (SELECT area, model, avg(abs(y_actual - y_pred)) AS mae, sqrt(avg((y_actual - y_pred) ** 2)) AS rmse,
  avg(CASE WHEN y_actual <> 0 THEN abs((y_actual - y_pred) / y_actual) END) * 100 AS mape FROM test GROUP BY area, model),
best AS (SELECT * FROM metrics WHERE mape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY area ORDER BY mape, model) = 1)"""
ANCHORS = "anchors AS (SELECT area, max_by(demand, year) AS anchor FROM demand WHERE year <= 2020 GROUP BY area)"
FORECAST = """fit AS (SELECT area, regr_slope(demand, i) AS slope, regr_intercept(demand, i) AS level, count(*) AS n, max(year) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY year) - 1 AS i FROM demand WHERE year <= 2024) GROUP BY area),
trend AS (SELECT area, 'Naive' AS model, CAST(last + h AS INT) AS year, level + slope * (n + h - 1) AS forecast FROM fit, range(1, 7) t(h))"""
