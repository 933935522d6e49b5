"""Leak-safe imputation and winsorising: whatever is fitted sees training years only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from .stats import quantiles

_ALL_BEFORE, _ALL_BEHIND = Window.unboundedPreceding, Window.unboundedFollowing


def impute(dense: DataFrame, columns: list[str], train_until: int) -> DataFrame:
    """Fills gaps of a dense panel.

    Training years: linear between neighbours, nearest value at the ends. Later
    years: the last own value since, else the raw value of the last training year,
    else the training mean. All columns share two windows over the area."""
    area = Window.partitionBy("area")
    part = Window.partitionBy("area", "_train").orderBy("year")
    before, behind = part.rowsBetween(_ALL_BEFORE, 0), part.rowsBetween(0, _ALL_BEHIND)
    rows = dense.withColumn("_train", F.col("year") <= train_until).withColumn("_last", F.max(F.when(F.col("_train"), F.col("year"))).over(area))
    filled = {}
    for c in columns:
        x, year = F.col(c), F.when(F.col(c).isNotNull(), F.col("year"))
        x0, x1 = F.last(x, True).over(before), F.first(x, True).over(behind)
        t0, t1 = F.last(year, True).over(before), F.first(year, True).over(behind)
        mean = F.avg(F.when(F.col("_train"), x)).over(area)
        seed = F.max(F.when(F.col("year") == F.col("_last"), x)).over(area)
        line = x0 + (x1 - x0) * F.try_divide((F.col("year") - t0).cast("double"), (t1 - t0).cast("double"))
        filled[c] = F.when(F.col("_train"), F.coalesce(x, line, x0, x1, mean)).otherwise(F.coalesce(x0, seed, mean))
    return rows.withColumns(filled).drop("_train", "_last")


def winsor_bounds(df: DataFrame, columns: list[str], train_until: int, factor: float = 2.5) -> DataFrame:
    """Per area and column c the bounds c_lo and c_hi: quartiles of the training years, factor interquartile ranges apart."""
    quarts = df.where(F.col("year") <= train_until).groupBy("area").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns])
    low, high = (lambda c: F.get(c, F.lit(0))), (lambda c: F.get(c, F.lit(1)))
    return quarts.select("area", *[b for c in columns for b in ((low(c) - factor * (high(c) - low(c))).alias(f"{c}_lo"), (high(c) + factor * (high(c) - low(c))).alias(f"{c}_hi"))])


def winsorise(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    names = df.columns
    joined = df.join(bounds, "area", "left")
    return joined.select(*[clip(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) if c in columns else F.col(c) for c in names])


def clipped_counts(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, clipped): how many cells the bounds change."""
    joined = df.join(bounds, "area", "left")
    counts = joined.agg(*[F.count_if(F.abs(clip(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")) - F.col(c)) > 0).alias(c) for c in columns])
    return counts.unpivot([], columns, "feature", "clipped")


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities and gaps become the column's median over the whole table; a column without a value stays null."""
    middle = quantiles(df, columns, [0.5])
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in columns}
    return df.withColumns({c: F.coalesce(x, F.lit(middle[c][0]).cast("double")) for c, x in finite.items()})


def gap_shares(df: DataFrame, columns: list[str], until: int) -> DataFrame:
    """(feature, share) of null, NaN and infinite values in the years up to `until`, all columns in one pass; no rows, a null share."""
    gap = lambda c: F.avg(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 1.0).otherwise(0.0))
    return df.where(F.col("year") <= until).agg(*[gap(c).alias(c) for c in columns]).unpivot([], columns, "feature", "share")


def sparse_columns(df: DataFrame, columns: list[str], until: int, most: float = 0.8) -> list[str]:
    """Columns with a share of gaps below `most` in the years up to `until`. Runs one aggregate; the result is a row a column."""
    if not columns:
        return []
    shares = {r["feature"]: r["share"] for r in gap_shares(df, columns, until).collect()}
    return [c for c in columns if shares[c] is not None and shares[c] < most]
