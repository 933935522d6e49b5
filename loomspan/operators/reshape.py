"""Long to wide and back, dense grids, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_name


def only_areas(df: DataFrame, areas: list[str] | DataFrame, area: str = "area") -> DataFrame:
    """Rows of the areas: a short list as a predicate that reaches the scan, a table by a semi join."""
    if isinstance(areas, DataFrame):
        return df.join(areas.select(area).distinct(), area, "left_semi")
    return df.where(F.col(area).isin(areas))


def same_area(df: DataFrame, name: str, area: str = "area") -> DataFrame:
    return df.where(F.lower(area) == name.lower())


def cell_means(long: DataFrame, keys: tuple[str, ...] = ("area", "year", "subcategory"), value: str = "value") -> DataFrame:
    """One row per cell with the mean of its values; cells without a value are left out."""
    return long.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(value))


def pivot_wide(long: DataFrame, values: list[str], dropped: tuple[str, ...] = ("Total", "Aggregate_fuel")) -> DataFrame:
    """One row per (area, year), one column per value named; names are cleaned, `dropped` ones left out.

    The list of values keeps the plan's schema fixed and saves the job that would look for them."""
    wide = long.where(F.col("value").isNotNull()).groupBy("area", "year").pivot("subcategory", values).agg(F.avg("value"))
    return wide.withColumnsRenamed({v: clean_name(v) for v in values}).drop(*dropped)


def pivot_matrix(df: DataFrame, rows: str, columns: str, names: list, value: Column) -> DataFrame:
    return df.groupBy(rows).pivot(columns, names).agg(value)


def unpivot(wide: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def densify(wide: DataFrame, areas: list[str] | DataFrame | None = None) -> DataFrame:
    """wide on the grid areas x all years between the first and last of the table.

    Years are a sequence made per area, so raw rows are never crossed. Areas default
    to those of the table; a listed area without rows gets empty ones, an unlisted one vanishes."""
    spark = wide.sparkSession
    if areas is None:
        areas = wide.select("area").distinct()
    elif not isinstance(areas, DataFrame):
        areas = spark.createDataFrame([(a,) for a in areas], "area string")
    span = wide.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    grid = areas.select("area", F.lit(1).alias("one")).join(F.broadcast(span.withColumn("one", F.lit(1))), "one").where("lo is not null").select("area", F.explode(F.sequence("lo", "hi")).alias("year"))
    return grid.join(wide, ["area", "year"], "left")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order (dropDuplicates would take any)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def drop_null_lags(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[c for c in df.columns if "_lag" in c])
