"""Forecast tables (area, model, year, forecast): trends, extrapolation, recursion, intervals, clamps."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moments
from ..functions import series as one
from ..functions.columns import clip, series
from . import walkforward
from .lineage import compact, cut
from .stats import quantiles

DRAWS = 200  # resampled paths behind an interval
SERIES = one.MODELS | {"Naive": one.linear}  # over several steps Naive is the trend
FORECAST = "area string, model string, year int, forecast double, lower_90 double, upper_90 double"


def linear_forecast(df: DataFrame, target: str, horizon: int, name: str = "Naive") -> DataFrame:
    """Least squares on each series' place in time, drawn out `horizon` steps. Drawn out over several steps, the model named Naive is this trend."""
    rows = df.where(F.col(target).isNotNull()).withColumn("i", (F.row_number().over(series()) - 1).cast("double"))
    fit = rows.groupBy("area").agg(F.regr_slope(target, "i").alias("slope"), F.regr_intercept(target, "i").alias("level"), F.count("*").alias("n"), F.max("year").alias("last"))
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.select("area", F.lit(name).alias("model"), (F.col("last") + F.col("h")).cast("int").alias("year"), (F.col("level") + F.col("slope") * (F.col("n") + F.col("h") - 1)).alias("forecast"))


def persistence(df: DataFrame, target: str, horizon: int) -> DataFrame:
    last = df.where(F.col(target).isNotNull()).groupBy("area").agg(F.max_by(target, "year").alias("forecast"), F.max("year").alias("last"))
    steps = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.select("area", F.lit("Persistence").alias("model"), (F.col("last") + F.col("h")).cast("int").alias("year"), "forecast")


def extrapolate(df: DataFrame, columns: list[str], horizon: int) -> DataFrame:
    """(area, feature, step, value): each column's least-squares line, gaps as the series' median, held within last +- |last| (0.30 + 0.05 (step - 1)), steps from 1; a last value of 0 doesn't bind."""
    long = df.select("area", "year", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["area", "year"], columns, "feature", "value")
    w = Window.partitionBy("area", "feature")
    long = long.withColumn("i", (F.row_number().over(w.orderBy("year")) - 1).cast("double")).withColumn("value", F.coalesce("value", F.percentile("value", 0.5).over(w)))
    fit = long.groupBy("area", "feature").agg(F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("level"), F.count("*").alias("n"), F.max_by("value", "i").alias("last"))
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    line = F.col("level") + F.col("slope") * (F.col("n") + F.col("step") - 1)
    room = F.abs("last") * (F.lit(0.30) + F.lit(0.05) * (F.col("step") - 1))
    return steps.select("area", "feature", "step", F.when(F.col("last") == 0, line).otherwise(clip(line, F.col("last") - room, F.col("last") + room)).alias("value"))


def clamp(forecast: DataFrame, anchors: DataFrame, base: float = 0.40, per_step: float = 0.10, digits: int | None = 2) -> DataFrame:
    """Forecasts held within anchor +- |anchor| (base + per_step i), i counting a series' forecasts from 0; rounded to `digits`."""
    rows = forecast.join(anchors.select("area", "anchor"), "area", "left").withColumn("i", F.row_number().over(Window.partitionBy("area", "model").orderBy("year")) - 1)
    room = F.abs("anchor") * (F.lit(base) + F.lit(per_step) * F.col("i"))
    held = clip(F.col("forecast"), F.col("anchor") - room, F.col("anchor") + room)
    return rows.withColumn("forecast", held if digits is None else F.round(held, digits)).drop("anchor", "i")


def residual_bootstrap(forecast: DataFrame, residuals: DataFrame, draws: int = DRAWS, coverage: float = 0.9, seed: int = 42) -> DataFrame:
    """forecast with lower_90 and upper_90: the point plus the running mean of resampled residuals (area, year, error), percentiles over the draws.

    Draws are picked by md5 of (area, draw, step, seed), so a rerun gives the same
    interval. Series without residuals get a width of zero."""
    w = Window.partitionBy("area").orderBy("year")
    pool = residuals.where("error is not null").withColumn("k", F.row_number().over(w) - 1).select("area", "k", "error")
    sizes = pool.groupBy("area").agg(F.count("*").alias("n"))
    steps = forecast.select("area", "model", "year", "forecast", F.row_number().over(Window.partitionBy("area", "model").orderBy("year")).alias("step")).join(sizes, "area", "left")
    drawn = steps.where("n is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picked = F.conv(F.substring(F.md5(F.concat_ws("~", "area", "draw", "step", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("bigint")
    drawn = drawn.withColumn("k", F.pmod(picked, F.col("n")).cast("int")).join(pool, ["area", "k"])
    path = Window.partitionBy("area", "model", "draw").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("value", F.col("forecast") + F.avg("error").over(path))
    tail = (1 - coverage) / 2
    bands = drawn.groupBy("area", "model", "year").agg(F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    out = steps.join(bands, ["area", "model", "year"], "left")
    lo, hi = F.coalesce(F.get("q", F.lit(0)), F.col("forecast")), F.coalesce(F.get("q", F.lit(1)), F.col("forecast"))
    return out.select("area", "model", "year", "forecast", F.least(lo, F.col("forecast")).alias("lower_90"), F.greatest(hi, F.col("forecast")).alias("upper_90"))


def _derived(name: str, values: list[float]) -> dict[str, float]:
    """Lags, moving averages and growth by |previous| behind the last of the values."""
    n = len(values)
    out = {f"{name}_lag{k}": values[n - k] if n >= k else np.nan for k in (1, 2, 3)}
    out |= {f"{name}_ma{k}": float(np.mean(values[-k:])) for k in (3, 5)}
    return out | {f"{name}_yoy": (values[-1] - values[-2]) / abs(values[-2]) * 100 if n >= 2 and values[-2] else 0.0}


def outlook(values: np.ndarray, horizon: int) -> np.ndarray:
    """One column drawn out as `extrapolate` does."""
    y = np.where(np.isfinite(values), values, np.nanmedian(values) if np.isfinite(values).any() else 0.0)
    line, last = one.linear(y, horizon), y[-1]
    room = abs(last) * (0.30 + 0.05 * np.arange(horizon))
    return line if last == 0 else np.clip(line, last - room, last + room)


def known_ahead(years: list[int], columns: dict[str, np.ndarray], code: float, horizon: int) -> list[dict[str, float]]:
    """What is known of each coming step beside the target: the trend goes on by year, columns by their outlook (the step's own value included), the code stays."""
    ahead = {c: [*v.tolist(), *outlook(v, horizon).tolist()] for c, v in columns.items()}
    out = []
    for step in range(1, horizon + 1):
        trend = float(years[-1] + step - years[0])
        row = {"trend": trend, "trend_sq": trend**2, "area_code": code, "country_code": code}
        for c, v in ahead.items():
            row |= _derived(c, v[: len(years) + step])
        out.append(row)
    return out


def future_rows(past: np.ndarray, target: str, features: list[str], known: dict[str, float]) -> np.ndarray:
    """Features of the next step for each column of past (steps, columns): the target's own from what is behind, others as known, else 0."""
    n, rows = len(past), np.zeros((past.shape[1], len(features)))
    own = {f"{target}_lag{k}": past[n - k] if n >= k else np.nan for k in (1, 2, 3)} | {f"{target}_ma{k}": past[-k:].mean(axis=0) for k in (3, 5)}
    before = past[-2] if n >= 2 else np.zeros(past.shape[1])
    own[f"{target}_yoy"] = np.where(before == 0, 0.0, (past[-1] - before) / np.where(before == 0, 1.0, np.abs(before)) * 100)
    for j, f in enumerate(features):
        rows[:, j] = own[f] if f in own else known.get(f, 0.0)
    return rows


def future_row(history: list[float], target: str, features: list[str], known: dict[str, float]) -> list[float]:
    return future_rows(np.array(history)[:, None], target, features, known)[0].tolist()


def _steps(y: np.ndarray, x: np.ndarray, features: list[str], target: str, known: list[dict[str, float]], predict) -> np.ndarray:
    """(steps, columns) of predict(rows), each step's rows built from the columns of y and what was predicted before."""
    past = y
    for ahead in known:
        past = np.vstack([past, predict(one.median_filled(future_rows(past, target, features, ahead), x))])
    return past[len(y) :]


@dataclass
class History:
    """One area's rows in order: years, target, features, and the columns that are drawn out ahead."""

    years: list[int]
    y: np.ndarray
    x: np.ndarray
    features: list[str]
    target: str
    columns: dict[str, np.ndarray]

    @classmethod
    def of(cls, pdf: pd.DataFrame, features: list[str], target: str, columns: list[str]) -> "History":
        pdf = pdf.sort_values("year")
        return cls(pdf["year"].tolist(), pdf["y"].to_numpy(float), pdf[features].to_numpy(float), features, target, {c: pdf[f"_{c}"].to_numpy(float) for c in columns})

    def until(self, t: int) -> "History":
        return History(self.years[:t], self.y[:t], self.x[:t], self.features, self.target, {c: v[:t] for c, v in self.columns.items()})

    def paths(self, model: str, horizon: int, y: np.ndarray, parameters: dict) -> np.ndarray:
        """Forecasts (horizon, columns) for each column of targets y over these rows. An unknown model gives the last value; a linear one needs 3 rows."""
        if model not in moments.MODELS:
            f = SERIES.get(model, lambda v, h: np.repeat(v[-1:], h))
            return np.column_stack([f(y[:, j], horizon) for j in range(y.shape[1])])
        if len(y) < 3:
            raise ValueError("too few rows")
        clean = one.median_filled(self.x, self.x)
        fit = moments.Moments(clean.shape[1], y.shape[1]).add(clean, y).scaled()
        w = moments.MODELS[model](fit, **parameters)
        codes = [f for f in self.features if f in ("area_code", "country_code")]
        known = known_ahead(self.years, self.columns, float(self.x[0, self.features.index(codes[0])]) if codes else 0.0, horizon)
        return _steps(y, self.x, self.features, self.target, known, lambda rows: fit.predict(w, rows))

    def residuals(self, model: str, parameters: dict, held: int) -> np.ndarray:
        """One-step errors of the last `held` rows from the tenth on. Each row to predict is built from the rows before it, as a coming one is."""
        found = []
        for t in range(max(10, len(self.y) - held), len(self.y)):
            try:
                guess = self.until(t).paths(model, 1, self.y[:t, None], parameters)[0, 0]
            except (np.linalg.LinAlgError, ValueError):
                continue
            found.append(self.y[t] - guess)
        return np.array(found)

    def interval(self, model: str, horizon: int, parameters: dict, draws: int, held: int, rng: np.random.Generator) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(model, point, lower, upper) by refits on targets with half of resampled residuals added; raises where the model gives nothing."""
        point, y = self.paths(model, horizon, self.y[:, None], parameters)[:, 0], self.y
        if not np.isfinite(point).all():
            raise ValueError("no finite forecast")
        if y[-1] != 0 and abs(point[0] - y[-1]) > 0.25 * abs(y[-1]):
            model, point, spread = "LinearTrend", one.linear(y, horizon), y[-8:].std() * 0.10
            return model, point, point - 1.645 * spread, point + 1.645 * spread
        errors = self.residuals(model, parameters, held)
        errors = errors[np.isfinite(errors)]
        if len(errors) < 3:
            spread = y.std() * 0.10
            return model, point, point - 1.645 * spread, point + 1.645 * spread
        noisy = np.maximum(y[:, None] + 0.5 * rng.choice(errors, (len(y), draws)), 0.3 * y.min())
        paths = self.paths(model, horizon, noisy, parameters)
        paths = np.where(np.isfinite(paths), paths, point[:, None])
        room = np.maximum(np.abs(point), 1) * (0.35 + 0.05 * np.arange(horizon))
        lo, hi = np.percentile(np.clip(paths, (point - room)[:, None], (point + room)[:, None]), [5, 95], axis=1)
        return model, point, np.minimum(lo, point), np.maximum(hi, point)


def _table(area: str, model: str, last: int, point, lo, hi) -> pd.DataFrame:
    return pd.DataFrame({"area": area, "model": model, "year": last + 1 + np.arange(len(point)), "forecast": point, "lower_90": lo, "upper_90": hi})


def _rows(df: DataFrame, target: str, features: list[str], columns: list[str], *more: str) -> DataFrame:
    double = lambda c, name: F.col(c).cast("double").alias(name)
    return df.where(F.col(target).isNotNull()).select("area", F.col("year").cast("int").alias("year"), double(target, "y"), *more, *[double(c, c) for c in features], *[double(c, f"_{c}") for c in columns])


def _random(area: str) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(area.encode()))


def recursive_forecast(df: DataFrame, features: list[str], target: str, horizon: int, alpha: float = 1.0, draws: int = DRAWS, held: int = 8, columns: list[str] | None = None) -> DataFrame:
    """(area, model, year, forecast, lower_90, upper_90) of ridge, fed with its own predictions.

    Coming steps have the target's lags, averages and growth from what is forecast
    so far, trend and its square by year, an area's code as it is, the same of
    `columns` (of df) drawn out by their line, and 0 for any other feature. So do the
    rows behind the one-step residuals, which know nothing of the year they predict.
    Intervals refit on targets with half of resampled residuals added (all
    draws of a series are one solve with many right sides), held within point +-
    max(|point|, 1) (0.35 + 0.05 step), steps from 0. Under 3 residuals: +- 1.645 tenths of the
    deviation. If the first step strays over 25 % from the last value, the linear
    trend takes over, with a tenth of the deviation of the last 8; under 3 rows the
    last value goes on. Seeds come from the area's name."""
    columns = columns or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, area = History.of(pdf, features, target, columns), pdf["area"].iloc[0]
        try:
            found = h.interval("Ridge", horizon, {"alpha": alpha}, draws, held, _random(area))
        except (np.linalg.LinAlgError, ValueError):
            if len(h.y) < 3:
                found = "Ridge", (point := np.repeat(h.y[-1:], horizon)), point - 1.645 * h.y.std() * 0.1, point + 1.645 * h.y.std() * 0.1
            else:
                found = h.interval("LinearTrend", horizon, {}, draws, held, _random(area))
        return _table(area, found[0], h.years[-1], *found[1:])

    return _rows(df, target, features, columns).groupBy("area").applyInPandas(run, FORECAST)


def series_forecasts(df: DataFrame, target: str, horizon: int, models: tuple[str, ...] = tuple(one.MODELS), features: list[str] | None = None, columns: list[str] | None = None, parameters: dict[str, dict] | None = None) -> DataFrame:
    """(area, model, year, forecast) of every area and model that one area's rows are enough for: those of one series and, on the features, the linear ones.

    An unknown name gives the last value; a model that fails on a series is left out for it."""
    features, columns, parameters = features or [], columns or [], parameters or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, parts = History.of(pdf, features, target, columns), []
        for name in models:
            try:
                guess = h.paths(name, horizon, h.y[:, None], parameters.get(name, {}))[:, 0]
            except (np.linalg.LinAlgError, ValueError):
                continue
            if np.isfinite(guess).all():
                parts += [(pdf["area"].iloc[0], name, h.years[-1] + 1 + k, g) for k, g in enumerate(guess)]
        return pd.DataFrame(parts, columns=["area", "model", "year", "forecast"])

    return _rows(df, target, features, columns).groupBy("area").applyInPandas(run, "area string, model string, year int, forecast double")


def _ahead(df: DataFrame, target: str, horizon: int, columns: list[str], code: str | None) -> DataFrame:
    """One row per area: `past`, its last five targets, first and last year, its code, and of each column the last five values with its outlook behind them (v_column)."""
    last = lambda c: F.slice(F.transform(F.sort_array(F.collect_list(F.struct("year", c))), lambda p: p[c]), F.greatest(F.count("*") - 4, F.lit(1)).cast("int"), 5)
    rows = df.where(F.col(target).isNotNull())
    rows = rows.select("area", F.col("year").cast("int").alias("year"), F.col(target).cast("double").alias("past"), (F.col(code) if code else F.lit(0.0)).cast("double").alias("code"), *[F.col(c).cast("double").alias(f"v_{c}") for c in columns])
    state = rows.groupBy("area").agg(last("past").alias("past"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max_by("code", "year").alias("code"), *[last(f"v_{c}").alias(f"v_{c}") for c in columns])
    if columns:
        lines = extrapolate(df.where(F.col(target).isNotNull()), columns, horizon).groupBy("area").pivot("feature", columns).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "value"))), lambda p: p["value"]))
        state = state.join(lines.select("area", *[F.col(f"`{c}`").alias(f"l_{c}") for c in columns]), "area", "left")
        state = state.withColumns({f"v_{c}": F.concat(f"v_{c}", f"l_{c}") for c in columns}).drop(*[f"l_{c}" for c in columns])
    return state


def _next_features(features: list[str], target: str, columns: list[str], step: int) -> dict[str, Column]:
    """Expressions for the features of a step (from 1) on the rows of _ahead, `past` having what is forecast so far."""

    def derived(name: str, v: Column) -> dict[str, Column]:
        at = lambda k: F.get(v, F.size(v) - k)
        mean = lambda k: F.aggregate(F.slice(v, F.greatest(F.size(v) - k + 1, F.lit(1)), k), F.lit(0.0), lambda s, x: s + x) / F.least(F.size(v), F.lit(k))
        growth = F.coalesce(F.try_divide(at(1) - at(2), F.abs(at(2))) * 100, F.lit(0.0))
        return {f"{name}_lag{k}": at(k) for k in (1, 2, 3)} | {f"{name}_ma{k}": mean(k) for k in (3, 5)} | {f"{name}_yoy": growth}

    trend = (F.col("last_year") + step - F.col("first_year")).cast("double")
    known = derived(target, F.col("past")) | {"trend": trend, "trend_sq": trend * trend, "area_code": F.col("code"), "country_code": F.col("code")}
    for c in columns:
        known |= derived(c, F.slice(f"v_{c}", F.lit(1), F.size(f"v_{c}") - F.col("horizon") + step))
    return {f: known.get(f, F.lit(0.0)) for f in features}


def tree_forecasts(df: DataFrame, features: list[str], target: str, horizon: int, columns: list[str] | None = None, models: tuple[str, ...] = walkforward.TREES, parameters: dict[str, dict] | None = None, seed: int = 42) -> DataFrame:
    """(area, model, year, forecast) of panel trees, fed with their own predictions.

    A model is fitted once, on the rows of all areas. Then every area takes a step at a
    time: features from its last five values, prediction, append; a step is one
    narrow pass over a row per area, checkpointed so that plans don't grow with the
    horizon. Coming steps know what `recursive_forecast` says; a gap in a feature is
    filled with the median of the fitted rows."""
    from pyspark.ml.feature import VectorAssembler

    columns, df = columns or [], compact(df)
    rows, release = walkforward.assembled(df, features, target)
    middle = {f: v[0] for f, v in quantiles(df.where(F.col(target).isNotNull()), features, [0.5]).items()}
    codes = [f for f in features if f in ("area_code", "country_code")]
    start = compact(_ahead(df, target, horizon, columns, codes[0] if codes else None).withColumn("horizon", F.lit(horizon)))
    pack, parts = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features"), []
    for name in models:
        fitted, state = walkforward.tree(name, (parameters or {}).get(name, {}), seed).fit(rows), start
        for step in range(1, horizon + 1):
            made = _next_features(features, target, columns, step)
            made = {f"_f{i}": F.coalesce(F.when(~F.isnan(made[f]), made[f]), F.lit(float(middle[f] or 0.0))) for i, f in enumerate(features)}
            guess = fitted.transform(pack.transform(state.withColumns(made)))
            state = cut(guess.withColumn("past", F.concat("past", F.array("prediction"))).select(start.columns))
        # past holds five values of history at most, and the forecasts behind them
        steps = state.select("area", "last_year", F.posexplode(F.slice("past", -horizon, horizon)).alias("i", "forecast"))
        parts.append(steps.select("area", F.lit(name).alias("model"), (F.col("last_year") + F.col("i") + 1).cast("int").alias("year"), "forecast"))
    release()
    return reduce(DataFrame.unionByName, parts)


def all_forecasts(df: DataFrame, features: list[str], target: str, horizon: int, columns: list[str] | None = None, models: tuple[str, ...] = walkforward.ELEVEN, parameters: dict[str, dict] | None = None, digits: int | None = 2) -> DataFrame:
    """(area, model, year, forecast) of all eleven models for every area, held near each area's last value by `clamp`.

    Drawn out over several steps, Naive is the trend. A model that fails on an area has no rows there.
    Trends are aggregates, the other models of one area a grouped map, trees panel models that step together."""
    rows = compact(df.where(F.col(target).isNotNull()))
    parts = [linear_forecast(rows, target, horizon, name) for name in models if name in ("Naive", "LinearTrend")]
    if grouped := tuple(m for m in models if m not in ("Naive", "LinearTrend", *walkforward.TREES)):
        parts.append(series_forecasts(rows, target, horizon, grouped, features, columns, parameters))
    if trees := tuple(m for m in models if m in walkforward.TREES):
        parts.append(tree_forecasts(rows, features, target, horizon, columns, trees, parameters))
    anchors = rows.groupBy("area").agg(F.max_by(target, "year").alias("anchor"))
    free = clamp(reduce(DataFrame.unionByName, parts), anchors.where("anchor <> 0"), digits=digits)
    return free.select("area", "model", "year", "forecast")


def best_forecasts(df: DataFrame, best: DataFrame, target: str, horizon: int, features: list[str] | None = None, columns: list[str] | None = None, parameters: dict[str, dict] | None = None, log: DataFrame | None = None, draws: int = DRAWS, held: int = 8) -> DataFrame:
    """(area, model, year, forecast, lower_90, upper_90): each area's best model (area, model) drawn out with its interval.

    Only the model wanted is computed. One-series and linear models refit on resampled
    targets (see `recursive_forecast`). Trees are panel models, for which that would be
    a fit of the whole panel a draw; their interval resamples the model's residuals in
    `log` (`residual_bootstrap`; without a log the width is zero). Where a model gives
    nothing, Holt goes on ("Holt (fallback)"), then the trend ("LinearTrend (last
    resort)") with +- 1.645 tenths of the deviation. Areas without a best model have no rows."""
    features, columns, parameters, df = features or [], columns or [], parameters or {}, compact(df)
    wanted = best.select("area", F.col("model").alias("wanted"))
    rows = df.join(wanted, "area")
    is_tree = F.col("wanted").isin(*walkforward.TREES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, area = History.of(pdf, features, target, columns), pdf["area"].iloc[0]
        for model, label in ((pdf["wanted"].iloc[0], None), ("Holt", "Holt (fallback)")):
            try:
                if model not in SERIES and model not in moments.MODELS:
                    raise ValueError(f"no model {model}")
                name, *found = h.interval(model, horizon, parameters.get(model, {}), draws, held, _random(area))
                return _table(area, label or name, h.years[-1], *found)
            except (np.linalg.LinAlgError, ValueError):
                continue
        point, half = one.linear(h.y, horizon), 1.645 * h.y.std() * 0.10
        return _table(area, "LinearTrend (last resort)", h.years[-1], point, point - half, point + half)

    grouped = _rows(rows.where(~is_tree), target, features, columns, "wanted").groupBy("area").applyInPandas(run, FORECAST)
    asked = [r[0] for r in wanted.where(is_tree).select("wanted").distinct().collect()]  # two names at most
    if not asked:
        return grouped
    ahead = tree_forecasts(df, features, target, horizon, columns, tuple(sorted(asked)), parameters).join(wanted.withColumnRenamed("wanted", "model"), ["area", "model"])
    errors = log.join(wanted.withColumnRenamed("wanted", "model"), ["area", "model"]).select("area", "year", (F.col("y_actual") - F.col("y_pred")).alias("error")) if log is not None else None
    if errors is None:
        trees = ahead.withColumns({"lower_90": F.col("forecast"), "upper_90": F.col("forecast")})
    else:
        trees = residual_bootstrap(ahead, errors, draws)
    return grouped.unionByName(trees.select(*grouped.columns))
