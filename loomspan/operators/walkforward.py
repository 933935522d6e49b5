"""Expanding walk-forward: for every test year, models fitted on the years before it predict one step.

Models that are aggregates of the past are windows; the rest run in one grouped map
per series, all cut-offs and models of a series in one call."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moments
from ..functions import series as one
from ..functions.columns import finite, series
from .impute import sparse_columns
from .lineage import compact, cut
from .stats import quantiles

LEAST = 5  # years that a model needs
TREES = ("RandomForest", "BoostedTrees")
ELEVEN = ("Naive", "LinearTrend", "Holt", "DampedHolt", "Theta", "ARIMA", "Ridge", "ElasticNet", "BayesianRidge", *TREES)
LOG = "area string, year int, model string, y_actual double, y_pred double"


def window_predictions(df: DataFrame, target: str, years: list[int]) -> DataFrame:
    """(area, year, model, y_actual, y_pred) of Naive, LinearTrend, MA3, MA5 and SeasonalLag (four before) for the years named."""
    w = series()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(target).isNotNull()).select("area", "year", F.col(target).alias("y")).withColumn("i", (F.row_number().over(w) - 1).cast("double"))
    rows = rows.withColumns({
        "n": F.count("y").over(past),
        "Naive": F.lag("y").over(w),
        "LinearTrend": F.regr_intercept("y", "i").over(past) + F.regr_slope("y", "i").over(past) * F.col("i"),
        "MA3": F.avg("y").over(w.rowsBetween(-3, -1)),
        "MA5": F.avg("y").over(w.rowsBetween(-5, -1)),
        "SeasonalLag": F.lag("y", 4).over(w),
    }).where((F.col("n") >= LEAST) & F.col("year").isin(years))
    return rows.unpivot(["area", "year", "y"], ["Naive", "LinearTrend", "MA3", "MA5", "SeasonalLag"], "model", "y_pred").select("area", F.col("year").cast("int").alias("year"), "model", F.col("y").alias("y_actual"), "y_pred")


def series_predictions(df: DataFrame, target: str, years: list[int], models: tuple[str, ...] = ("Holt", "DampedHolt", "Theta", "ARIMA")) -> DataFrame:
    """The same log for smoothing models and ARIMA; a model that fails gives the last value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        year, y, out = pdf["year"].to_numpy(), pdf["y"].to_numpy(float), []
        for t in years:
            k = int(np.searchsorted(year, t))
            if k < LEAST or k >= len(year) or year[k] != t:
                continue
            for name in models:
                try:
                    guess = float(one.MODELS[name](y[:k])[0])
                except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                    guess = np.nan
                out.append((pdf["area"].iloc[0], t, name, y[k], guess if np.isfinite(guess) else y[k - 1]))
        return pd.DataFrame(out, columns=["area", "year", "model", "y_actual", "y_pred"])

    rows = df.where(F.col(target).isNotNull()).select("area", F.col("year").cast("int").alias("year"), F.col(target).cast("double").alias("y"))
    return rows.groupBy("area").applyInPandas(run, LOG)


def linear_predictions(df: DataFrame, features: list[str], target: str, years: list[int], models: tuple[str, ...] = ("Ridge", "ElasticNet", "BayesianRidge"), parameters: dict[str, dict] | None = None) -> DataFrame:
    """The same log for regularised linear models on the features, z-scored by what the model may see.

    Products of rows are kept and each cut-off adds the rows since the one before (a
    rank-one update a row) in place of a refit; an area with gaps, whose medians move
    with every row, is refitted. A model that fails gives the last value."""
    parameters = parameters or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        year, y, x, out = pdf["year"].to_numpy(), pdf["y"].to_numpy(float), pdf[features].to_numpy(float), []
        whole, sums, added = bool(np.isfinite(x).all()), moments.Moments(len(features)), 0
        for t in sorted(years):
            k = int(np.searchsorted(year, t))
            if k < LEAST or k >= len(year) or year[k] != t:
                continue
            if whole:
                sums.add(x[added:k], y[added:k])
                row, added = x[k : k + 1], k
            else:
                sums = moments.Moments(len(features)).add(one.median_filled(x[:k], x[:k]), y[:k])
                row = one.median_filled(x[k : k + 1], x[:k])
            fit = sums.scaled()
            for name in models:
                try:
                    guess = float(fit.predict(moments.MODELS[name](fit, **parameters.get(name, {})), row)[0])
                except (np.linalg.LinAlgError, ValueError):
                    guess = np.nan
                out.append((pdf["area"].iloc[0], t, name, y[k], guess if np.isfinite(guess) else y[k - 1]))
        return pd.DataFrame(out, columns=["area", "year", "model", "y_actual", "y_pred"])

    rows = df.where(F.col(target).isNotNull()).select("area", F.col("year").cast("int").alias("year"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    return rows.groupBy("area").applyInPandas(run, LOG)


def tree(name: str, parameters: dict, seed: int = 42):
    """A panel tree model by name. parameters are those of pyspark.ml (numTrees, maxDepth, maxIter, stepSize)."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if name == "RandomForest":
        return RandomForestRegressor(labelCol="y", seed=seed, **{"numTrees": 50} | parameters)
    return GBTRegressor(labelCol="y", seed=seed, **{"maxIter": 20, "maxDepth": 3} | parameters)


def assembled(df: DataFrame, features: list[str], target: str) -> tuple[DataFrame, Callable[[], None]]:
    """(area, year, y, features) as the trees read it, persisted (memory, then disk) in the partitions of df (see `compact`), and what releases it. Rows with gaps are skipped."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.where(F.col(target).isNotNull()))
    rows = rows.select("area", F.col("year").cast("int").alias("year"), F.col(target).cast("double").alias("y"), "features").persist()
    return rows, lambda: rows.unpersist()


def tree_predictions(df: DataFrame, features: list[str], target: str, years: list[int], trees: int = 50, seed: int = 42, models: tuple[str, ...] = TREES, parameters: dict[str, dict] | None = None) -> DataFrame:
    """The same log for a random forest and boosted trees: one panel model for each year, fitted on all areas' years before it."""
    rows, release = assembled(compact(df), features, target)
    given, parts = {"RandomForest": {"numTrees": trees}} | (parameters or {}), []
    for t in years:
        for name in models:
            fitted = tree(name, given.get(name, {}), seed).fit(rows.where(F.col("year") < t))
            parts.append(fitted.transform(rows.where(F.col("year") == t)).select("area", "year", F.lit(name).alias("model"), F.col("y").alias("y_actual"), F.col("prediction").alias("y_pred")))
    found = cut(reduce(DataFrame.unionByName, parts))
    release()
    return found


def full_log(df: DataFrame, features: list[str], target: str, years: list[int], models: tuple[str, ...] = ELEVEN, parameters: dict[str, dict] | None = None) -> DataFrame:
    """One log (area, year, model, y_actual, y_pred) of all eleven models, or those named.

    An area and year is in it for a model only if five years come before and the year
    has a target, as in each part: windows, one grouped map a family, panel trees. Trees
    see an area through the panel, so they need its row of features alone; rows of
    areas with fewer than five years before are left out of theirs too."""
    rows = compact(df.where(F.col(target).isNotNull()))
    parts = []
    if windows := [m for m in models if m in ("Naive", "LinearTrend", "MA3", "MA5", "SeasonalLag")]:
        parts.append(window_predictions(rows, target, years).where(F.col("model").isin(windows)))
    if grouped := tuple(m for m in models if m in one.MODELS and m != "LinearTrend"):
        parts.append(series_predictions(rows, target, years, grouped))
    if linear := tuple(m for m in models if m in moments.MODELS):
        parts.append(linear_predictions(rows, features, target, years, linear, parameters))
    if boosted := tuple(m for m in models if m in TREES):
        before = rows.withColumn("_n", F.count("*").over(series().rowsBetween(Window.unboundedPreceding, -1)))
        enough = before.where(F.col("_n") >= LEAST).select("area", F.col("year").cast("int").alias("year"))
        parts.append(tree_predictions(rows, features, target, years, models=boosted, parameters=parameters).join(enough, ["area", "year"], "left_semi"))
    return reduce(DataFrame.unionByName, [p.select("area", "year", "model", "y_actual", "y_pred") for p in parts])


def feature_importance(df: DataFrame, features: list[str], target: str, train_until: int, trees: int = 150, seed: int = 42) -> DataFrame:
    """(feature, importance), largest first, of a random forest on the training years; rows with gaps are skipped."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.where((F.col("year") <= train_until) & F.col(target).isNotNull()))
    fitted = RandomForestRegressor(labelCol=target, numTrees=trees, seed=seed).fit(rows)
    found = sorted(zip(features, map(float, fitted.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def fold_bounds(first: int, last: int, folds: int) -> list[int]:
    """Years that end the training of each fold, and the one after the last."""
    return [first + (last - first + 1) * (i + 1) // (folds + 1) for i in range(folds + 1)]


def tune_linear(df: DataFrame, features: list[str], target: str, until: int, ridge: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0), alphas: tuple[float, ...] = (0.01, 0.1, 1.0), l1_ratios: tuple[float, ...] = (0.2, 0.5, 0.8), folds: int = 3, scaled: bool = True) -> DataFrame:
    """(model, alpha, l1_ratio, mae, rank) of ridge and ElasticNet over expanding folds by year, least error of each model first.

    A fold trains on the years before it and is scored on its own. Columns with gaps in
    over 80 % of the rows go first, other gaps take the column's median. A fit needs
    only sums of products, which Spark adds up by year in one pass: features are scaled
    from them (unless `scaled` is false), and ElasticNet goes down its penalties from one solution to the next, so
    candidates cost no pass. A second pass scores all of them."""
    spark, df = df.sparkSession, compact(df)
    used = sparse_columns(df.where(F.col(target).isNotNull()), features, until)
    k = len(used)
    rows = df.where((F.col("year") <= until) & F.col(target).isNotNull())
    fine = {c: F.when(finite(F.col(c).cast("double")).isNotNull(), F.col(c).cast("double")) for c in used}
    facts = rows.agg(F.min("year").alias("_lo"), F.max("year").alias("_hi"), F.avg(target).alias("_y")).first()
    if facts["_lo"] is None or not used:
        return spark.createDataFrame([], "model string, alpha double, l1_ratio double, mae double, rank int")
    middle = {c: v[0] for c, v in quantiles(rows, used, [0.5]).items()}
    rows = rows.select("year", F.array(*[F.coalesce(fine[c], F.lit(middle[c])) for c in used]).alias("x"), F.col(target).cast("double").alias("y"))
    cuts = fold_bounds(facts["_lo"], facts["_hi"], folds)
    about = np.array([middle[c] for c in used]), np.array([float(facts["_y"])])

    def sums(batches):
        total: dict[int, moments.Moments] = {}
        for pdf in batches:
            for year, g in pdf.groupby("year"):
                total.setdefault(year, moments.Moments(k, about=about)).add(np.stack(g["x"].to_numpy()), g["y"].to_numpy())
        if total:
            yield pd.DataFrame({"year": list(total), "gram": [m.total.ravel().tolist() for m in total.values()]})

    parts = rows.mapInPandas(sums, "year int, gram array<double>")
    by_year = parts.select("year", F.posexplode("gram").alias("i", "v")).groupBy("year", "i").agg(F.sum("v").alias("v"))
    gram: dict[int, np.ndarray] = {}
    for r in by_year.toLocalIterator():  # years x (features + 2) ** 2 numbers
        gram.setdefault(r["year"], np.zeros((k + 2) ** 2))[r["i"]] = r["v"]
    candidates = []
    for f in range(folds):
        fit = moments.Moments(k, about=about)
        fit.total = sum((m for y, m in gram.items() if y < cuts[f]), np.zeros((k + 2) ** 2)).reshape(k + 2, k + 2)
        fit.n = int(round(fit.total[0, 0]))
        if not fit.n:
            continue
        s = fit.scaled(scaled)
        found = [("Ridge", a, None, moments.ridge(s, a)) for a in ridge]
        found += [("ElasticNet", a, l1, w) for l1 in l1_ratios for a, w in moments.elastic_path(s, alphas, l1).items()]
        for model, a, l1, w in found:
            raw, level = s.raw(w)
            candidates.append((f, float(cuts[f]), float(cuts[f + 1]), model, a, l1, raw[:, 0].tolist(), float(level[0])))
    fitted = spark.createDataFrame(candidates, "fold int, lo double, hi double, model string, alpha double, l1_ratio double, w array<double>, level double")
    scored = rows.join(F.broadcast(fitted), (F.col("year") >= F.col("lo")) & (F.col("year") < F.col("hi")))
    guess = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("level")
    mae = scored.groupBy("model", "alpha", "l1_ratio", "fold").agg(F.avg(F.abs(F.col("y") - guess)).alias("mae")).groupBy("model", "alpha", "l1_ratio").agg(F.avg("mae").alias("mae"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy("mae", "alpha", "l1_ratio"))
    return mae.withColumn("rank", rank).orderBy(F.desc("model"), "rank")


def tune_ridge(df: DataFrame, features: list[str], target: str, until: int, alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 3) -> DataFrame:
    """(alpha, mae) of the ridge part of `tune_linear` on features as they are, least error first."""
    return tune_linear(df, features, target, until, alphas, (), (), folds, scaled=False).select("alpha", "mae").orderBy("mae", "alpha")


FOREST_GRID = tuple({"numTrees": n, "maxDepth": d} for n in (50, 100) for d in (30, 5, 10))  # 30: as deep as it goes
BOOST_GRID = tuple({"maxIter": n, "stepSize": s, "maxDepth": d} for n in (50, 100) for s in (0.05, 0.1) for d in (3, 5))


def tune_trees(df: DataFrame, features: list[str], target: str, until: int, grids: dict[str, tuple[dict, ...]] | None = None, folds: int = 3, exact: bool = False, seed: int = 42, parallel: int = 8) -> DataFrame:
    """(model, parameters, folds, mae, rank) of panel trees over the expanding folds of `tune_linear`, best first.

    Successive halving: all candidates are fitted for the first fold, which trains on
    the fewest years, the better half of each model for the next, and so on; a
    candidate's mae is its mean over the folds that it met, and rank puts those that met more
    first. exact: all candidates meet all folds. Fits run side by side on one
    persisted table. Boosted candidates that differ in rounds alone are one fit: the
    model of fewer rounds is the beginning of the other."""
    from multiprocessing.pool import ThreadPool

    grids, df = {"RandomForest": FOREST_GRID, "BoostedTrees": BOOST_GRID} if grids is None else grids, compact(df)
    used = sparse_columns(df.where(F.col(target).isNotNull()), features, until)
    rows, release = assembled(df.where(F.col("year") <= until), used, target)
    span = rows.agg(F.min("year"), F.max("year")).first()
    schema = "model string, parameters map<string,double>, folds int, mae double, rank int"
    if span[0] is None:
        return df.sparkSession.createDataFrame([], schema)
    cuts = fold_bounds(*span, folds)

    def errors(job: tuple) -> list[tuple]:
        """mae of some candidates of one fit on a fold."""
        name, fold, shared, some = job
        train, held = rows.where(F.col("year") < cuts[fold]), rows.where((F.col("year") >= cuts[fold]) & (F.col("year") < cuts[fold + 1]))
        if name == "RandomForest":
            fitted = tree(name, shared, seed).fit(train)
            return [(some[0], fitted.transform(held).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0])]
        rounds = [grids[name][c]["maxIter"] for c in some]
        by_round = tree(name, {**shared, "maxIter": max(rounds)}, seed).fit(train).evaluateEachIteration(held, "absolute")
        return [(c, by_round[n - 1]) for c, n in zip(some, rounds)]

    met: dict[str, dict[int, list[float]]] = {name: {c: [] for c in range(len(grid))} for name, grid in grids.items()}
    alive = {name: list(found) for name, found in met.items()}
    pool = ThreadPool(parallel)
    try:
        for fold in range(folds):
            jobs: dict[tuple, tuple] = {}
            for name, left in alive.items():
                for c in left:
                    shared = {k: v for k, v in grids[name][c].items() if name == "RandomForest" or k != "maxIter"}
                    jobs.setdefault((name, str(shared)), (name, fold, shared, []))[3].append(c)
            for job, found in zip(jobs.values(), pool.map(errors, jobs.values())):
                for c, mae in found:
                    if mae is not None:
                        met[job[0]][c].append(mae)
            if not exact:
                mean = lambda name, c: (sum(met[name][c]) / max(1, len(met[name][c])), c)
                alive = {name: sorted(left, key=lambda c: mean(name, c))[: max(1, (len(left) + 1) // 2)] if fold + 1 < folds else left for name, left in alive.items()}
    finally:
        pool.close()
        release()
    out = []
    for name, found in met.items():
        order = sorted(found, key=lambda c: (-len(found[c]), sum(found[c]) / max(1, len(found[c])), c))
        for rank, c in enumerate(order, 1):
            if found[c]:
                out.append((name, {k: float(v) for k, v in grids[name][c].items()}, len(found[c]), sum(found[c]) / len(found[c]), rank))
    return df.sparkSession.createDataFrame(out, schema)


def stationarity(df: DataFrame, target: str) -> DataFrame:
    """(area, statistic, p_value, critical_5, stationary) by the augmented Dickey-Fuller test; under 5 points no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("year")["y"].to_numpy(float)
        t, p, c = one.adf(y) if len(y) >= 5 else (np.nan, np.nan, np.nan)
        return pd.DataFrame([(pdf["area"].iloc[0], t, p, c, bool(p < 0.05))] if len(y) >= 5 else [], columns=["area", "statistic", "p_value", "critical_5", "stationary"])

    rows = df.where(F.col(target).isNotNull()).select("area", "year", F.col(target).cast("double").alias("y"))
    return rows.groupBy("area").applyInPandas(run, "area string, statistic double, p_value double, critical_5 double, stationary boolean")
