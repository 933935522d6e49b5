"""Accuracy of a prediction log (area, year, model, y_actual, y_pred), and choice of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import abs_error_pct


def with_errors(log: DataFrame) -> DataFrame:
    return log.withColumns({"error": F.col("y_actual") - F.col("y_pred"), "abs_pct_error": abs_error_pct(F.col("y_pred"), F.col("y_actual"))})


def accuracy(log: DataFrame, keys: tuple[str, ...] = ("area", "model"), extended: bool = False) -> DataFrame:
    """mae, rmse and mape (zero actuals left out; null if all are). extended: rows with gaps go first, and smape and n are added."""
    e = F.col("y_actual") - F.col("y_pred")
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(F.try_divide(e, F.col("y_actual")))) * 100).alias("mape")]
    if extended:
        log = log.dropna(subset=["y_actual", "y_pred"])
        both = F.abs("y_actual") + F.abs("y_pred")
        aggs += [(F.avg(F.when(both > 0, F.try_divide(2 * F.abs(e), both))) * 100).alias("smape"), F.count("*").alias("n")]
    return log.groupBy(*keys).agg(*aggs)


def best_models(metrics: DataFrame, by: str = "mape") -> DataFrame:
    """The row with the least error of each area; null errors never win, ties go to the first model by name."""
    w = Window.partitionBy("area").orderBy(F.col(by).asc_nulls_last(), "model")
    return metrics.where(F.col(by).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def validation_against_test(val: DataFrame, test: DataFrame) -> DataFrame:
    both = val.select("area", "model", F.col("mape").alias("mape_val")).join(test.select("area", "model", F.col("mape").alias("mape_test")), ["area", "model"])
    return both.withColumn("gap", F.col("mape_test") - F.col("mape_val"))


def skill(metrics: DataFrame, baseline: str = "Naive") -> DataFrame:
    """(area, model, skill_pct): improvement on the baseline's MAPE; areas without one, or with 0, have no rows."""
    base = F.max(F.when(F.col("model") == baseline, F.col("mape"))).over(Window.partitionBy("area"))
    return metrics.withColumn("skill_pct", (1 - F.try_divide(F.col("mape"), base)) * 100).where("skill_pct is not null").select("area", "model", "skill_pct")


def family_comparison(classic: DataFrame, deep: DataFrame) -> DataFrame:
    """Best classical against best deep model per area, winner and gain."""
    a, b = (best_models(x).select("area", F.col("model").alias(f"{n}_model"), F.col("mape").alias(f"{n}_mape")) for n, x in (("classic", classic), ("deep", deep)))
    won = F.col("deep_mape") < F.col("classic_mape")
    return a.join(b, "area").withColumns({"winner": F.when(won, F.col("deep_model")).otherwise(F.col("classic_model")), "gain": F.col("classic_mape") - F.col("deep_mape")})


def best_residuals(log: DataFrame, best: DataFrame) -> DataFrame:
    return with_errors(log).join(best.select("area", "model"), ["area", "model"]).select("area", "year", "model", "error")


def promote(champions: DataFrame, challengers: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per (area, model_type): the challenger (version, mape) becomes champion if there is none or it is better by more than the threshold; else it is staged."""
    c = champions.select("area", "model_type", F.col("version").alias("_v"), F.col("mape").alias("_m"))
    wins = F.col("_m").isNull() | (F.col("mape") < F.col("_m") - threshold)
    return challengers.join(c, ["area", "model_type"], "left").select("area", "model_type", F.when(wins, F.col("version")).otherwise(F.col("_v")).alias("champion"), F.when(wins, F.col("mape")).otherwise(F.col("_m")).alias("champion_mape"), F.when(wins, "Production").otherwise("Staging").alias("challenger_stage"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 0.01, atol: float = 0.5) -> DataFrame:
    """(issue, n, worst): rows and columns that only one table has, and cells that differ (numbers by atol + rtol * |b|, gaps on either side pass)."""
    issues = [(f"column only in {n}: {c}", 1, None) for n, x, y in (("a", a, b), ("b", b, a)) for c in sorted(set(x.columns) - set(y.columns))]
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    numeric = {c for c, t in a.dtypes if t in ("int", "bigint", "double", "float")}
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in shared], F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in shared], F.lit(1).alias("_b")), keys, "full_outer")
    cells = [F.struct(F.lit("row only in a").alias("issue"), F.count_if(F.col("_b").isNull()).alias("n"), F.lit(None).cast("double").alias("worst")), F.struct(F.lit("row only in b").alias("issue"), F.count_if(F.col("_a").isNull()).alias("n"), F.lit(None).cast("double").alias("worst"))]
    for c in shared:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in numeric:
            gap = F.abs(x - y)
            cells.append(F.struct(F.lit(f"differs: {c}").alias("issue"), F.count_if(gap > atol + rtol * F.abs(y)).alias("n"), F.max(gap).cast("double").alias("worst")))
        else:
            cells.append(F.struct(F.lit(f"differs: {c}").alias("issue"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~x.eqNullSafe(y)).alias("n"), F.lit(None).cast("double").alias("worst")))
    found = both.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("n > 0")
    return found.unionByName(a.sparkSession.createDataFrame(issues, "issue string, n bigint, worst double")) if issues else found
