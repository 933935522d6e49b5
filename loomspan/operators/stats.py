"""Exploration tables: summaries, coverage, gaps, quality report, inventories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent_text


def yearly(long: DataFrame, summed: tuple[str, ...] = ("Fuel",)) -> DataFrame:
    """Value per (area, year, subcategory): the sum for the named subcategories (0 without values), the mean for others."""
    value = F.when(F.col("subcategory").isin(list(summed)), F.coalesce(F.sum("value"), F.lit(0.0))).otherwise(F.avg("value"))
    return long.groupBy("area", "year", "subcategory").agg(value.alias("value"))


def units(long: DataFrame) -> DataFrame:
    """(subcategory, unit, n_units, mixed): the first unit in order, and whether there are several."""
    return long.groupBy("subcategory").agg(F.min("unit").alias("unit"), F.count_distinct("unit").alias("n_units")).withColumn("mixed", F.col("n_units") > 1)


def summary(df: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """Per area: value in the first and the last year (else the latest there is), total growth, slope per year, mean and deviation."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col(value)))
    g = df.groupBy("area").agg(
        at(first).alias("start"), F.coalesce(at(last), F.max_by(value, F.when(F.col(value).isNotNull(), F.col("year")))).alias("end"),
        F.regr_slope(value, F.col("year").cast("double")).alias("slope"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
    )
    growth = F.try_divide(F.col("end") - F.col("start"), F.col("start")) * 100
    return g.select("area", F.round("start", 1).alias("start"), F.round("end", 1).alias("end"), F.round(growth, 1).alias("growth_pct"), percent_text(growth).alias("growth"), F.round("slope", 2).alias("slope"), F.round("mean", 1).alias("mean"), F.round("std", 1).alias("std"))


def gap_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(area, feature, missing_pct)."""
    gaps = df.groupBy("area").agg(*[F.avg(F.when(F.col(c).isNull(), 100.0).otherwise(0.0)).alias(c) for c in columns])
    return gaps.unpivot(["area"], columns, "feature", "missing_pct")


def coverage(df: DataFrame, target: str, years: list[int]) -> DataFrame:
    return df.groupBy("area").pivot("year", years).agg(F.count(target))


PROBES = 1024  # parts that a round cuts the range around a quantile into
LAST = 4096  # values of a part that are fetched and sorted


def _part(probes: int) -> Column:
    """The part of its range (lo, hi) that a value v lies in, each step monotone, so that parts never overlap.

    A range around zero falls into negative, zero and positive; one of far apart sizes is
    cut by the logarithm, any other into equal widths (halved, to stay finite)."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    up = lambda x, a, b: F.floor((F.ln(x) - F.ln(a)) / (F.ln(b) - F.ln(a)) * probes)
    far = lambda a, b: F.ln(b) - F.ln(a) > 7.0
    wide = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * probes)
    return F.when((lo <= 0) & (hi >= 0), F.signum(v)).when((lo > 0) & far(lo, hi), up(v, lo, hi)).when((hi < 0) & far(-hi, -lo), -up(-v, -hi, -lo)).otherwise(wide)


def quantiles(df: DataFrame, columns: list[str], at: list[float], probes: int = PROBES, last: int = LAST) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns with linear interpolation, null for a column without finite values.

    Each round counts the values in equal parts of the range that holds a wanted place
    and goes on inside the part it falls in, all columns and places in one pass, until a
    part has one value or few enough to fetch. Memory is bounded by the probes, not by
    the distinct values; df is read once a round (about ten at the very most), so give
    a stored table."""
    fine = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    long = df.select(*[fine(c).alias(f"c{i}") for i, c in enumerate(columns)]).unpivot([], [f"c{i}" for i in range(len(columns))], "f", "v").where("v is not null")
    whole = {r["f"]: r for r in long.groupBy("f").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    # wanted places: (column, place) -> range, rows below it and rows in it
    places = {f: sorted({k for q in at for k in (math.floor(q * (r["n"] - 1)), math.ceil(q * (r["n"] - 1)))}) for f, r in whole.items()}
    open_ = {(f, k): (whole[f]["lo"], whole[f]["hi"], 0, whole[f]["n"]) for f, ks in places.items() for k in ks}
    found: dict[tuple[str, int], float] = {}
    while open_:
        found |= {key: lo for key, (lo, hi, _, _) in open_.items() if lo == hi}
        open_ = {key: r for key, r in open_.items() if key not in found}
        ranges = sorted({(key[0], r[0], r[1], r[2], r[3]) for key, r in open_.items()})
        if not ranges:
            break
        table = F.broadcast(df.sparkSession.createDataFrame([(f, lo, hi, n <= last, i) for i, (f, lo, hi, _, n) in enumerate(ranges)], "f string, lo double, hi double, few boolean, i int"))
        met = long.join(table, "f").where("v >= lo and v <= hi")
        part = _part(probes)
        parts: dict[int, list] = {i: [] for i in range(len(ranges))}
        # one row a part and range, or of a short range one a value
        for r in met.groupBy("i", F.when(F.col("few"), F.col("v")).otherwise(part.cast("double")).alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            parts[r["i"]].append((r["lo"], r["hi"], r["n"]))
        for (f, k), r in list(open_.items()):
            below = r[2]
            for lo, hi, n in sorted(parts[ranges.index((f, *r))]):
                if k < below + n:
                    open_[f, k] = (lo, hi, below, n)
                    break
                below += n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        f = f"c{i}"
        n = whole[f]["n"] if f in whole else 0
        ends = [(found[f, math.floor(q * (n - 1))], found[f, math.ceil(q * (n - 1))], q * (n - 1) % 1) if n else None for q in at]
        out[c] = [None if e is None else e[0] + (e[1] - e[0]) * e[2] for e in ends]
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max), exact quantiles, rounded to 2."""
    exact = quantiles(df, columns, [0.25, 0.5, 0.75])
    at = lambda c, i: F.lit(exact[c][i]).cast("double")
    stats = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("count"), *[F.round(x, 2).alias(n) for n, x in (("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("min", F.min(c)), ("q25", at(c, 0)), ("q50", at(c, 1)), ("q75", at(c, 2)), ("max", F.max(c)))])
    return df.agg(F.array(*[stats(c) for c in columns]).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def quality_report(df: DataFrame) -> DataFrame:
    """(metric, value): rows, columns, duplicate rows, and nulls by column. Duplicates are counted by grouping whole rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    row = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), *[F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)), F.lit(0)).alias(f"nulls_{c}") for c in df.columns])
    row = row.withColumn("columns", F.lit(len(df.columns)).cast("bigint"))
    return row.unpivot([], row.columns, "metric", "value")


def inventory(long: DataFrame) -> DataFrame:
    return long.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("area").alias("n_areas"), F.count_distinct("subcategory").alias("n_subcategories"))
