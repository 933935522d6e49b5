"""What one prediction log says of its models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, robustness, significance


def model_report(log: DataFrame, anchors: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(area, model, mae, rmse, mape, best, pairs, wins, losses, max_deviation_pct, robustness_flag) from one log, read as it is by every part.

    best marks the least MAPE of an area. pairs counts the other models that a model
    was tested against, wins and losses those that Diebold-Mariano calls worse and
    better at alpha. The log's path is also judged as a forecast from `anchors`
    (area, anchor). Give a stored or checkpointed log: it is read several times."""
    scores = metrics.accuracy(log)
    best = metrics.best_models(scores).select("area", "model", F.lit(True).alias("best"))
    tests = significance.significance_tests(log, alpha)
    sides = tests.select("area", F.explode(F.array(*[F.struct(F.col(f"model_{s}").alias("model"), (F.col("better_model") == F.col(f"model_{s}")).alias("better")) for s in "ab"])).alias("s"), "significant_dm")
    counts = sides.groupBy("area", "s.model").agg(F.count("*").alias("pairs"), F.count_if(F.col("significant_dm") & F.col("s.better")).alias("wins"), F.count_if(F.col("significant_dm") & ~F.col("s.better")).alias("losses"))
    path = robustness.robustness(log.select("area", "model", "year", F.col("y_pred").alias("forecast")), anchors).select("area", "model", "max_deviation_pct", "robustness_flag")
    found = scores.join(best, ["area", "model"], "left").join(counts, ["area", "model"], "left").join(path, ["area", "model"], "left")
    return found.select("area", "model", "mae", "rmse", "mape", F.coalesce("best", F.lit(False)).alias("best"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pairs", "wins", "losses")], "max_deviation_pct", "robustness_flag")
