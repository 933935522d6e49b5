"""Growth: compound rates over periods, base-100 index, forecast growth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import accuracy_label, growth_rate

PERIODS = ((2000, 2005), (2005, 2010), (2010, 2015), (2015, 2020), (2020, 2024))


def period_rates(df: DataFrame, value: str, periods: tuple[tuple[int, int], ...] = PERIODS) -> DataFrame:
    """(area, period, cagr_pct): null where an end is missing. All ends come from one aggregate."""
    years = sorted({y for p in periods for y in p})
    ends = df.where(F.col("year").isin(years)).groupBy("area").agg(*[F.max(F.when(F.col("year") == y, F.col(value))).alias(f"y{y}") for y in years])
    rate = lambda a, b: F.round(growth_rate(F.col(f"y{a}"), F.col(f"y{b}"), b - a), 4) * 100
    cells = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("period"), rate(a, b).alias("cagr_pct")) for a, b in periods])
    return ends.select("area", F.explode(cells).alias("c")).select("area", "c.period", "c.cagr_pct")


def index_100(df: DataFrame, value: str, base: int) -> DataFrame:
    """value as per cent of the area's value in the base year; areas without one are left out."""
    at_base = F.max(F.when(F.col("year") == base, F.col(value))).over(Window.partitionBy("area"))
    return df.withColumn("_base", at_base).where(F.col("_base").isNotNull() & (F.col("_base") != 0)).withColumn("index", F.col(value) / F.col("_base") * 100).drop("_base")


def recent(df: DataFrame, years: int = 10) -> DataFrame:
    """The last `years` years of each area, by its own last one."""
    return df.withColumn("_last", F.max("year").over(Window.partitionBy("area"))).where(F.col("year") >= F.col("_last") - years).drop("_last")


def last_known(history: DataFrame, value: str) -> DataFrame:
    return history.where(F.col(value).isNotNull()).groupBy("area").agg(F.max_by(value, "year").alias("anchor"), F.max("year").alias("anchor_year"))


def growth_summary(history: DataFrame, forecast: DataFrame, best: DataFrame, value: str, near: int = 2025, far: int = 2030) -> DataFrame:
    """Per area with both forecasts: last value, the near and far forecast with the far one's bounds and model, total and yearly growth (over six years, as published; null unless the last value is above 0), quality by the best model's MAPE (Poor without one); greatest yearly growth first.

    Raises if no forecast of the near or the far year exists (one small aggregate looks)."""
    there = forecast.agg(F.count_if(F.col("year") == near), F.count_if(F.col("year") == far)).first()
    if not all(there):
        raise ValueError(f"forecasts of {near} and {far} are needed")
    at = lambda y, c: F.max(F.when(F.col("year") == y, F.col(c)))
    ends = forecast.groupBy("area").agg(
        at(near, "forecast").alias("near"), at(far, "forecast").alias("far"), at(far, "lower_90").alias("far_lower"), at(far, "upper_90").alias("far_upper"),
        at(far, "model").alias("model"),
    ).where("near is not null and far is not null")
    rows = last_known(history, value).join(ends, "area").join(best.select("area", "mape"), "area", "left")
    rows = rows.select(
        "area", "model", F.col("anchor").alias("last"), "near", "far", "far_lower", "far_upper",
        F.when(F.col("anchor") > 0, (F.col("far") - F.col("anchor")) / F.col("anchor") * 100).alias("total_growth_pct"),
        (growth_rate(F.col("anchor"), F.col("far"), 6) * 100).alias("cagr_pct"), F.coalesce(accuracy_label(F.col("mape")), F.lit("Poor")).alias("quality"),
    )
    return rows.orderBy(F.col("cagr_pct").desc_nulls_last(), "area")


def growth_between(history: DataFrame, forecast: DataFrame, value: str, base: int, target: int) -> DataFrame:
    """(area, start, end, growth_pct, cagr_pct) from the history's base year to the forecast's target year; areas that lack one are left out."""
    start = history.where(F.col("year") == base).groupBy("area").agg(F.max(value).alias("start"))
    end = forecast.where(F.col("year") == target).groupBy("area").agg(F.max("forecast").alias("end"))
    rows = start.join(end, "area").where("start is not null and end is not null")
    return rows.withColumns({"growth_pct": F.round(F.try_divide(F.col("end") - F.col("start"), F.col("start")) * 100, 2), "cagr_pct": F.round(growth_rate(F.col("start"), F.col("end"), target - base) * 100, 2)})


def direction_flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Areas where two growth tables (area, cagr_pct) point opposite ways."""
    both = a.select("area", F.col("cagr_pct").alias("cagr_a")).join(b.select("area", F.col("cagr_pct").alias("cagr_b")), "area")
    return both.where(F.signum("cagr_a") * F.signum("cagr_b") < 0)
