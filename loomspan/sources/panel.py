"""Long measurement tables, the star schema over them, result files and metadata documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import number, split_label
from ..operators.lineage import numbered

RAW = "Area string, Year string, Subcategory string, Unit string, Value string"


def read_long_csv(spark: SparkSession, path: str, areas: list[str] | None = None, names: tuple[str, ...] = ("Area", "Year", "Subcategory", "Unit", "Value")) -> DataFrame:
    """(area, year, subcategory, unit, value) of a CSV file with a header whose names may have white space around them.

    Bad numbers give null values; rows without a year go. The area filter stands on
    the raw column, before anything is parsed."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    rows = raw if areas is None else raw.where(F.col(names[0]).isin(areas))
    area, year, sub, unit, value = (F.col(f"`{n}`") for n in names)
    return rows.select(area.alias("area"), year.try_cast("double").cast("int").alias("year"), sub.alias("subcategory"), unit.alias("unit"), number(value).alias("value")).where("year is not null")


def star_schema(long: DataFrame, train_end: int, val_end: int, test_end: int, source: str = "", load_date: str | None = None) -> dict[str, DataFrame]:
    """dim_country, dim_year (with split_label), dim_subcategory and fact of a long table. Keys are the places of the names in order, numbered by ranges; null names have none."""
    key = lambda df, by, name: numbered(df.where(F.col(by).isNotNull()), by, name, 1).select(name, *df.columns)
    country = key(long.select(F.col("area").alias("area_name")).distinct(), "area_name", "country_key")
    years = long.select("year").distinct().select(F.col("year").cast("int").alias("year_key"), "year", split_label(F.col("year"), train_end, val_end, test_end).alias("split_label"))
    subs = key(long.groupBy(F.col("subcategory").alias("subcategory_name")).agg(F.min("unit").alias("unit")), "subcategory_name", "subcategory_key")
    fact = long.groupBy("area", "year", "subcategory").agg(F.avg("value").alias("value"))
    fact = fact.join(country.withColumnRenamed("area_name", "area"), "area", "left").join(subs.select("subcategory_key", F.col("subcategory_name").alias("subcategory")), "subcategory", "left")
    stamp = F.lit(load_date) if load_date else F.date_format(F.current_date(), "yyyy-MM-dd")
    fact = fact.select("country_key", F.col("year").cast("int").alias("year_key"), "subcategory_key", "value", stamp.alias("load_date"), F.lit(source).alias("source_file"))
    return {"dim_country": country, "dim_year": years, "dim_subcategory": subs, "fact": fact}


def write_star(tables: dict[str, DataFrame], path: str) -> None:
    """A full rebuild: every table is overwritten, facts in one folder per year."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("year_key") if name == "fact" else writer).parquet(f"{path}/{name}")


def read_star(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("dim_country", "dim_year", "dim_subcategory", "fact")}


def from_star(star: dict[str, DataFrame], areas: list[str] | None = None, split: str | None = None) -> DataFrame:
    """The long table again. Filters stand on the dimensions, so those on the year prune fact folders."""
    country, year = star["dim_country"], star["dim_year"]
    if areas is not None:
        country = country.where(F.col("area_name").isin(areas))
    if split is not None:
        year = year.where(F.col("split_label") == split)
    rows = star["fact"].join(year, "year_key").join(country, "country_key").join(star["dim_subcategory"], "subcategory_key")
    return rows.select(F.col("area_name").alias("area"), "year", F.col("subcategory_name").alias("subcategory"), "unit", "value")


def read_measurements(spark: SparkSession, source: str, path: str, areas: list[str] | None = None, split: str | None = None) -> DataFrame:
    """(area, year, subcategory, unit, value) from a CSV file (source "csv") or a star schema's folder ("warehouse"): one schema either way.

    The warehouse holds the mean of repeated measurements and one unit a subcategory; a
    split is labelled only there."""
    if source == "csv":
        if split is not None:
            raise ValueError("a CSV file has no split labels")
        return read_long_csv(spark, path, areas)
    if source == "warehouse":
        return from_star(read_star(spark, path), areas, split)
    raise ValueError(f"no source {source}")


def create_views(star: dict[str, DataFrame]) -> None:
    from_star(star).createOrReplaceTempView("v_all_measurements")
    from_star(star, split="train").createOrReplaceTempView("v_train_measurements")


def write_table(df: DataFrame, path: str, kind: str = "parquet", order: list | None = None) -> None:
    """A result table as Parquet, or CSV with a header. With an order (names or columns), files follow one another in it, each sorted."""
    writer = (df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small metadata document as JSON text."""
    import json

    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def availability(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, available) of result tables."""
    there = [(n, not read_if_there(spark, p, "_ string").isEmpty()) for n, p in paths.items()]
    return spark.createDataFrame(there, "name string, available boolean")
