"""Reads over result tables: what a dashboard or a notebook asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import best_models
from .reshape import same_area


def area_forecast(forecast: DataFrame, area: str) -> DataFrame:
    return same_area(forecast, area).orderBy("model", "year")


def area_significance(tests: DataFrame, area: str) -> DataFrame:
    """An area's model pairs, the most significant first."""
    return same_area(tests, area).orderBy("dm_p", "model_a", "model_b")


def histories(df: DataFrame, value: str) -> DataFrame:
    """(area, points): each area's series as one array in time order."""
    return df.groupBy("area").agg(F.sort_array(F.collect_list(F.struct("year", F.col(value).alias("value")))).alias("points"))


def model_paths(forecast: DataFrame, area: str) -> DataFrame:
    return same_area(forecast, area).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("year", "forecast"))).alias("points"))


def with_events(df: DataFrame, events: list[tuple[int, str]]) -> DataFrame:
    return df.join(F.broadcast(df.sparkSession.createDataFrame(events, "year int, event string")), "year", "left")


def with_period(df: DataFrame, periods: list[tuple[int, int, str]], normal: str = "Normal") -> DataFrame:
    """period of each row: the first interval in the list that holds its year. A short list is a chain of conditions, so nothing is joined."""
    label = F.lit(normal)
    for start, end, name in reversed(periods):
        label = F.when(F.col("year").between(start, end), name).otherwise(label)
    return df.withColumn("period", label)


def with_periods(df: DataFrame, periods: DataFrame, normal: str = "Normal") -> DataFrame:
    """period of each row by a table (place, start, end, name) of any length: the interval of the lowest place that holds its year.

    Each interval lies in at most two cells of the power of four that is at least its
    length, so years and intervals meet by (cell width, cell), never by comparing all.
    Only the different years are looked up. Rows with a null year, and those in no
    interval, are `normal`; intervals with a null or a start behind their end hold nothing."""
    held = periods.where("start <= end").select("place", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name")
    held = held.withColumn("width", F.pow(F.lit(4.0), F.ceil(F.log2((F.col("end") - F.col("start") + 1).cast("double")) / 2)).cast("long"))
    cell = lambda c: F.expr(f"({c} - pmod({c}, width)) div width")
    cells = held.withColumn("cell", F.explode(F.sequence(cell("start"), cell("end"))))
    widths = sorted(r[0] for r in held.select("width").distinct().collect())  # 32 at most: powers of four
    years = df.select(F.col("year").cast("long").alias("_year")).where("_year is not null").distinct()
    asked = years.select("_year", F.explode(F.array(*[F.lit(w).cast("long") for w in widths]).cast("array<bigint>")).alias("width")).withColumn("cell", cell("_year"))
    first = asked.join(cells, ["width", "cell"]).where("_year >= start and _year <= end").groupBy("_year").agg(F.min_by("name", "place").alias("period"))
    return df.join(first, F.col("year") == F.col("_year"), "left").withColumn("period", F.coalesce("period", F.lit(normal))).drop("_year")


def scatter(wide: DataFrame, x: str, y: str, periods: list[tuple[int, int, str]]) -> DataFrame:
    return with_period(wide.select("area", "year", F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"]), periods)


def area_metrics(metrics: DataFrame, area: str) -> DataFrame:
    """All models of an area with a mark at the best."""
    best = best_models(metrics).select("area", "model", F.lit(True).alias("best"))
    return same_area(metrics.join(best, ["area", "model"], "left"), area).withColumn("best", F.coalesce("best", F.lit(False)))


def best_overview(classic: DataFrame, deep: DataFrame) -> DataFrame:
    """Best model of either family per area; a family may be missing."""
    a, b = (best_models(x).select("area", F.col("model").alias(f"{n}_model"), F.col("mape").alias(f"{n}_mape")) for n, x in (("classic", classic), ("deep", deep)))
    return a.join(b, "area", "full_outer")


def forecast_text(forecast: DataFrame) -> DataFrame:
    """(area, line): first and last forecast year and value as text."""
    ends = forecast.groupBy("area").agg(F.min("year").alias("y0"), F.min_by("forecast", "year").alias("f0"), F.max("year").alias("y1"), F.max_by("forecast", "year").alias("f1"))
    return ends.select("area", F.concat("area", F.lit(": "), F.col("y0").cast("string"), F.lit("="), F.format_string("%.1f", "f0"), F.lit(", "), F.col("y1").cast("string"), F.lit("="), F.format_string("%.1f", "f1")).alias("line"))


def highest_forecast(forecast: DataFrame, k: int = 1) -> DataFrame:
    return forecast.groupBy("area").agg(F.avg("forecast").alias("mean_forecast")).orderBy(F.col("mean_forecast").desc_nulls_last(), "area").limit(k)


def highest_growth(growth: DataFrame, k: int = 1) -> DataFrame:
    return growth.select("area", "cagr_pct").orderBy(F.col("cagr_pct").desc_nulls_last(), "area").limit(k)
