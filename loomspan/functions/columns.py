"""Scalar rules as column expressions. Nothing here raises under ANSI mode; what can't be computed is null."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-9


def clean_name(name: str) -> str:
    return name.strip().replace(" ", "_").replace("/", "_")


def series(area: str = "area", time: str = "year"):
    """The window of one series in time order; every time-ordered operator shares it, so one shuffle and one sort serve all."""
    return Window.partitionBy(area).orderBy(time)


def split_label(year: Column, train_end: int, val_end: int, test_end: int) -> Column:
    return F.when(year <= train_end, "train").when(year <= val_end, "val").when(year <= test_end, "test").otherwise("forecast")


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """x held in lo..hi; a null bound doesn't bind, a null x stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def number(text: Column) -> Column:
    """Text as a double; bad text, NaN and infinities give null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite(x: Column, digits: int = 4) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x, digits))


def growth_rate(start: Column, end: Column, periods: Column | float) -> Column:
    """Compound growth per period as a share; null unless both ends have start > 0 and end >= 0."""
    n = periods if isinstance(periods, Column) else F.lit(float(periods))
    return F.when((start > 0) & (end >= 0), F.pow(end / start, F.lit(1.0) / n) - 1)


def change_pct(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


def error_pct(predicted: Column, actual: Column) -> Column:
    """Signed percentage error, null at actual 0."""
    return F.try_divide(predicted - actual, actual) * 100


def abs_error_pct(predicted: Column, actual: Column) -> Column:
    """Absolute percentage error with a small constant in the denominator, as prediction logs carry it."""
    return F.abs(actual - predicted) / (F.abs(actual) + EPS) * 100


def accuracy_label(mape: Column) -> Column:
    return F.when(mape < 3, "Excellent").when(mape < 7, "Good").when(mape < 15, "Moderate").otherwise("Poor")


def stability_label(deviation: Column) -> Column:
    return F.when(deviation > 40, "UNSTABLE").when(deviation > 20, "WATCH").otherwise("STABLE")


def percent_text(x: Column) -> Column:
    """x to one digit, halves up; what rounds to zero from below keeps its sign, which round() drops."""
    digits = F.round(x, 1)
    return F.when(x.isNotNull(), F.concat(F.format_string("%.1f", F.when((x < 0) & (digits == 0), F.lit(-0.0)).otherwise(digits)), F.lit("%")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over the rows that have both; null for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
