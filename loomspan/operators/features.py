"""Lags, moving averages, growth, shares, ratios, trend and area codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, change_pct, correlation, series
from .lineage import numbered

SHARE_WORDS = ("generation", "wind", "solar", "hydro", "coal", "gas", "nuclear", "other")


def lag_features(df: DataFrame, columns: list[str], lags: tuple[int, ...] = (1, 2, 3), widths: tuple[int, ...] = (3, 5)) -> DataFrame:
    """c_lag{k}, c_ma{k} (mean of the k rows before, this one left out) and c_yoy (null and infinite growth: 0), all over one window."""
    w = series()
    added = {}
    for c in columns:
        filled = F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        before = F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        added |= {f"{c}_lag{k}": F.lag(c, k).over(w) for k in lags}
        added |= {f"{c}_ma{k}": F.avg(c).over(w.rowsBetween(-k, -1)) for k in widths}
        added[f"{c}_yoy"] = F.coalesce(change_pct(filled, before), F.lit(0.0))
    return df.withColumns(added)


def shares(df: DataFrame, columns: list[str], words: tuple[str, ...] = SHARE_WORDS) -> DataFrame:
    """share_c of each column whose name holds one of the words, if there are two or more."""
    found = [c for c in columns if any(w in c.lower() for w in words)]
    if len(found) < 2:
        return df
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in found), F.lit(0.0))
    return df.withColumns({f"share_{c}": F.col(c) / (total + EPS) for c in found})


def ratios(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    return df.withColumns({f"demand_ratio_{c}": F.col(target) / (F.col(c) + EPS) for c in columns})


def trend(df: DataFrame) -> DataFrame:
    """Years since the table's first, and their square; the first year is one broadcast row, no window over all rows."""
    first = df.agg(F.min("year").alias("_first")).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one")
    t = F.col("year") - F.col("_first")
    return joined.withColumns({"trend": t, "trend_sq": t * t}).drop("_first", "_one")


def area_codes(df: DataFrame) -> DataFrame:
    """country_code: the area's place in alphabetical order, from 0 (null for a null area). Numbered by ranges on the table of areas, joined back."""
    return df.join(numbered(df.select("area").where("area is not null").distinct(), "area", "country_code"), "area", "left")


def correlations(df: DataFrame, columns: list[str], target: str, train_until: int | None = None) -> DataFrame:
    """(feature, correlation) with the target, in one pass over the rows that have both; constants are left out."""
    rows = df if train_until is None else df.where(F.col("year") <= train_until)
    row = rows.agg(*[correlation(F.col(c), F.col(target)).alias(c) for c in columns if c != target])
    return row.unpivot([], [c for c in columns if c != target], "feature", "correlation").where("correlation is not null")


def top_correlated(df: DataFrame, columns: list[str], target: str, k: int, train_until: int | None = None) -> DataFrame:
    return correlations(df, columns, target, train_until).orderBy(F.abs("correlation").desc(), "feature").limit(k)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) for each unordered pair, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """Numeric columns that a model may see: not the year, the code, the target, its lags or its moving averages."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if t in numeric and c not in ("year", "country_code", target) and not c.startswith((f"{target}_lag", f"{target}_ma"))]


def scale(df: DataFrame, columns: list[str], train_until: int) -> DataFrame:
    """z-scores per area by training mean and population deviation (0 counts as 1)."""
    train = Window.partitionBy("area")
    seen = lambda c: F.when(F.col("year") <= train_until, F.col(c))
    deviation = lambda c: F.coalesce(F.nullif(F.stddev_pop(seen(c)).over(train), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: (F.col(c) - F.avg(seen(c)).over(train)) / deviation(c) for c in columns})


def sliding_windows(df: DataFrame, columns: list[str], target: str, length: int) -> DataFrame:
    """(area, year, x, y): the `length` rows of features before each row, and its target; areas with under length + 2 rows have none."""
    w = series()
    rows = df.withColumns({
        "x": F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w.rowsBetween(-length, -1)),
        "_n": F.count("*").over(Window.partitionBy("area")),
    })
    return rows.where((F.size("x") == length) & (F.col("_n") >= length + 2)).select("area", "year", "x", F.col(target).alias("y"))
