"""From the long table to a leak-safe feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_name
from ..operators import features, impute, reshape
from ..operators.lineage import cut


def feature_matrix(long: DataFrame, values: list[str], target: str, train_until: int, areas: list[str] | None = None, factor: float = 2.5) -> DataFrame:
    """Pivot, densify, impute, winsorise, lag, share, ratio, trend, code; rows whose lags reach before the first year go.

    One shuffle by area serves every window; statistics see training years only.
    Which two columns give ratios is decided by their training correlation with the
    target: the one point where the plan needs a (one-row) answer to go on. The imputed
    panel, small beside the raw rows, is checkpointed, as bounds, correlations and
    features all read it; it goes when nothing refers to it."""
    columns = [clean_name(v) for v in values]
    wide = reshape.pivot_wide(long, values)
    full = cut(impute.impute(reshape.densify(wide, areas).repartition("area"), columns, train_until))
    capped = impute.winsorise(full, impute.winsor_bounds(full, columns, train_until, factor), columns)
    top = [r["feature"] for r in features.top_correlated(capped, columns, target, 2, train_until).collect()]
    out = features.lag_features(capped, columns)
    out = features.ratios(features.shares(out, columns), target, top)
    return reshape.drop_null_lags(features.area_codes(features.trend(out)))


def metadata(df: DataFrame, target: str, columns: list[str], train_end: int, val_end: int, test_end: int, top: int = 20, areas: bool = True) -> dict:
    """The document that goes with a feature matrix: target, columns, features, the most correlated ones, split bounds.

    It lists every area, as a document must; with millions of them leave the list out
    (areas=False) and write `area_list` as a table of its own."""
    usable = features.feature_columns(df, target)
    best = [r["feature"] for r in features.top_correlated(df, usable, target, top, train_end).select("feature").collect()]
    document = {"target": target, "all_subs": columns, "all_features": usable, f"top_corr_{top}": best, "train_end": train_end, "val_end": val_end, "test_end": test_end}
    if areas:
        document["countries"] = [r[0] for r in area_list(df).orderBy("area").toLocalIterator()]
    return document


def area_list(df: DataFrame) -> DataFrame:
    return df.select("area").distinct()


def single_series(long: DataFrame, name: str) -> DataFrame:
    """The mean of all values per (area, year) as one target column."""
    return long.groupBy("area", "year").agg(F.avg("value").alias(name))
