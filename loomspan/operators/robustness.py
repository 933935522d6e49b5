"""How far forecasts stray: deviation from the last known value, jumps, flips, and ranks against accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, stability_label


def robustness(forecast: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per (area, model) of forecasts (area, model, year, forecast) and anchors (area, anchor).

    Forecasts without an anchor, with anchor 0, or of one point only have no row.
    Flips are changes of sign between steps that are not 0. The label goes by the
    unrounded deviation."""
    rows = forecast.join(anchors.select("area", "anchor"), "area").where("anchor is not null and anchor <> 0 and forecast is not null")
    w = Window.partitionBy("area", "model").orderBy("year")
    rows = rows.withColumn("before", F.lag("forecast").over(w)).withColumn("sign", F.nullif(F.signum(F.col("forecast") - F.col("before")), F.lit(0.0)))
    rows = rows.withColumn("sign_before", F.last("sign", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = rows.groupBy("area", "model").agg(
        F.count("*").alias("n"),
        F.max(F.abs(F.col("forecast") - F.col("anchor")) / F.abs("anchor") * 100).alias("deviation"),
        F.max(F.abs(F.col("forecast") - F.col("before")) / F.abs(F.col("before") + EPS) * 100).alias("jump"),
        F.stddev_pop("forecast").alias("std"),
        F.count_if(F.col("sign") != F.col("sign_before")).alias("flips"),
    ).where("n >= 2")
    return g.select("area", "model", F.round("deviation", 1).alias("max_deviation_pct"), F.round("jump", 1).alias("max_yoy_change_pct"), F.round("std", 1).alias("trajectory_std"), F.col("flips").cast("int").alias("direction_flips"), stability_label(F.col("deviation")).alias("robustness_flag"))


def against_accuracy(found: DataFrame, metrics: DataFrame) -> DataFrame:
    """Ranks of accuracy and robustness within each area; they agree if at most 2 apart. Without a MAPE there is no rank and no agreement."""
    area = Window.partitionBy("area")
    rows = found.join(metrics.select("area", "model", "mape"), ["area", "model"], "left")
    rows = rows.withColumns({
        "accuracy_rank": F.when(F.col("mape").isNotNull(), F.rank().over(area.orderBy(F.col("mape").asc_nulls_last()))),
        "robustness_rank": F.when(F.col("max_deviation_pct").isNotNull(), F.rank().over(area.orderBy(F.col("max_deviation_pct").asc_nulls_last()))),
    })
    return rows.withColumn("axes_agree", F.coalesce(F.abs(F.col("accuracy_rank") - F.col("robustness_rank")) <= 2, F.lit(False)))


def conflicts(best: DataFrame, found: DataFrame) -> DataFrame:
    """Best models by accuracy whose forecasts are flagged."""
    rows = best.select("area", "model", "mape").join(found.select("area", "model", "robustness_flag", "max_deviation_pct"), ["area", "model"], "left")
    return rows.withColumn("conflict", F.coalesce(F.col("robustness_flag").isin("WATCH", "UNSTABLE"), F.lit(False)))


def conflict_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("conflict").alias("conflicts"), F.count("*").alias("areas"))


def interval_widths(forecast: DataFrame, years: list[int]) -> DataFrame:
    return forecast.groupBy("area").pivot("year", years).agg(F.max(F.col("upper_90") - F.col("lower_90")))
