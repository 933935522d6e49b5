"""Pairwise tests of models on a prediction log: Diebold-Mariano, HLN correction, Wilcoxon, paired t.

Statistics are aggregates and windows; only p-values are computed in Python, on one row per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import error_pct
from ..functions.pvalues import p_normal, p_student, p_wilcoxon
from .lineage import cut


def pairs(log: DataFrame, least: int = 3) -> DataFrame:
    """(area, year, model_a, model_b, y, ea, eb): each unordered pair of models on the years both predict, pairs with under `least` such years left out.

    The log crosses the network once, by area; the errors of a year become one row, and
    its pairs are made inside that row, not by joining the log to itself. Windows and
    aggregates by area and pair go on from there. A model that stands twice in a year
    meets the others with each of its rows."""
    slim = log.where("y_actual is not null and y_pred is not null").repartition("area")
    year = slim.groupBy("area", "year").agg(F.sort_array(F.collect_list(F.struct("model", F.col("y_actual").alias("y"), (F.col("y_actual") - F.col("y_pred")).alias("e")))).alias("m"))
    later = lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("model_a"), b["model"].alias("model_b"), a["y"].alias("y"), a["e"].alias("ea"), b["e"].alias("eb")))
    both = year.select("area", "year", F.inline(F.flatten(F.transform("m", later))))
    n = F.count("*").over(Window.partitionBy("area", "model_a", "model_b"))
    return both.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def diebold_mariano(rows: DataFrame, keys: tuple[str, ...] = ("area", "model_a", "model_b")) -> DataFrame:
    """n, dm_stat and dm_ok per pair from squared errors; a variance of 0 or less gives statistic 0 (and p 1)."""
    d = rows.withColumn("d", F.col("ea") * F.col("ea") - F.col("eb") * F.col("eb"))
    d = d.withColumn("before", F.lag("d").over(Window.partitionBy(*keys).orderBy("year")))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_samp("d").alias("var"), F.coalesce(F.covar_samp(F.when(F.col("before").isNotNull(), F.col("d")), F.col("before")), F.lit(0.0)).alias("cov"))
    var = (F.col("var") + 2 * F.col("cov")) / F.col("n")
    return g.withColumn("dm_ok", F.coalesce(var > 0, F.lit(False))).withColumn("dm_stat", F.when(F.col("dm_ok"), F.col("mean") / F.sqrt(F.when(var > 0, var)))).fillna(0.0, ["dm_stat"]).select(*keys, "n", "dm_ok", "dm_stat")


def signed_ranks(rows: DataFrame, keys: tuple[str, ...] = ("area", "model_a", "model_b"), a: str = "ea", b: str = "eb", spread: bool = False) -> DataFrame:
    """Wilcoxon's sums per pair on |a| - |b|, zeros left out: n_nonzero, w_plus, w_minus, w (the lesser) and ties (sum of t^3 - t).

    Equal absolute differences are counted first, so the window runs over distinct values, not rows.
    With spread, few keys may hold all rows: values are ranked within 64 parts of each octave, and a
    small table says how many lie in the parts below."""
    diff = F.round(F.abs(F.col(a)) - F.abs(F.col(b)), 9)
    d = rows.select(*keys, diff.alias("d"))
    values = d.where("d <> 0").groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    if spread:
        values = values.withColumn("part", F.floor(F.log2("size") * 64).cast("int"))
        sizes = values.groupBy(*keys, "part").agg(F.sum("t").alias("n"))
        base = sizes.select(*keys, "part", (F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).alias("base"))
        values = values.withColumn("within", F.sum("t").over(Window.partitionBy(*keys, "part").orderBy("size")) - F.col("t")).join(base, [*keys, "part"])
        below = F.col("base") + F.col("within")
    else:
        below = F.sum("t").over(Window.partitionBy(*keys).orderBy("size")) - F.col("t")
    ranked = values.withColumn("rank", below + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("t").alias("n_nonzero"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    all_ = d.select(*keys).distinct().join(sums, list(keys), "left").fillna(0)
    return all_.withColumn("w", F.least("w_plus", "w_minus"))


def paired_t(rows: DataFrame, keys: tuple[str, ...] = ("area", "model_a", "model_b")) -> DataFrame:
    d = F.abs("ea") - F.abs("eb")
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return g.withColumn("t_stat", F.coalesce(F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")), F.lit(0.0))).select(*keys, "n", "t_stat")


def pair_errors(rows: DataFrame, keys: tuple[str, ...] = ("area", "model_a", "model_b")) -> DataFrame:
    """mape_a, mape_b and the better model (the second on a tie); zero actuals are left out."""
    m = lambda e: F.avg(F.abs(F.try_divide(F.col(e), F.col("y")))) * 100
    g = rows.groupBy(*keys).agg(m("ea").alias("mape_a"), m("eb").alias("mape_b"))
    return g.withColumn("better_model", F.when(F.col("mape_a") < F.col("mape_b"), F.col("model_a")).otherwise(F.col("model_b")))


def significance_tests(log: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per area and model pair: errors, statistics, p-values, significance at alpha.

    All statistics are one aggregate over the pairs' rows, behind windows of the same
    partitions: the squared differences' lag, and the rank of each absolute difference.
    A rank among equal sizes is their mean; zeros, which Wilcoxon leaves out, rank
    lowest and are taken off."""
    keys = ["area", "model_a", "model_b"]
    pair = Window.partitionBy(*keys)
    d, t = F.col("ea") * F.col("ea") - F.col("eb") * F.col("eb"), F.abs("ea") - F.abs("eb")
    rows = pairs(log).withColumns({"d": d, "t": t, "w": F.round(t, 9)}).withColumn("size", F.abs("w"))
    rows = rows.withColumns({
        "before": F.lag("d").over(pair.orderBy("year")),
        "below": F.rank().over(pair.orderBy("size")) - 1,
        "same": F.count("*").over(Window.partitionBy(*keys, "size")),
        "zeros": F.count_if(F.col("w") == 0).over(pair),
    })
    rank = F.col("below") - F.col("zeros") + (F.col("same") + 1) / 2
    signed = lambda hit: F.coalesce(F.sum(F.when(hit, rank)), F.lit(0.0))
    mape = lambda e: F.avg(F.abs(F.try_divide(F.col(e), F.col("y")))) * 100
    found = rows.groupBy(*keys).agg(
        mape("ea").alias("mape_a"), mape("eb").alias("mape_b"), F.count("*").alias("n"), F.avg("d").alias("mean"),
        ((F.var_samp("d") + 2 * F.coalesce(F.covar_samp(F.when(F.col("before").isNotNull(), F.col("d")), F.col("before")), F.lit(0.0))) / F.count("*")).alias("var"),
        signed(F.col("w") > 0).alias("w_plus"), signed(F.col("w") < 0).alias("w_minus"), F.count_if(F.col("w") != 0).alias("n_nonzero"),
        F.coalesce(F.sum(F.when(F.col("w") != 0, F.col("same") * F.col("same") - 1)), F.lit(0)).cast("double").alias("ties"),
        F.coalesce(F.try_divide(F.avg("t"), F.stddev_samp("t") / F.sqrt(F.count("*"))), F.lit(0.0)).alias("t_stat"),
    )
    ok = F.coalesce(F.col("var") > 0, F.lit(False))
    found = found.withColumns({"better_model": F.when(F.col("mape_a") < F.col("mape_b"), F.col("model_a")).otherwise(F.col("model_b")), "wx_stat": F.least("w_plus", "w_minus"), "dm_stat": F.when(ok, F.col("mean") / F.sqrt(F.when(ok, F.col("var")))).otherwise(0.0)})
    found = found.withColumns({"dm_p": F.when(ok, p_normal(F.col("dm_stat"))).otherwise(1.0), "wx_p": p_wilcoxon(F.col("wx_stat"), F.col("n_nonzero"), F.col("ties")), "t_p": p_student(F.col("t_stat"), F.col("n") - 1)})
    found = found.withColumns({"significant_dm": F.col("dm_p") < alpha, "significant_wx": F.col("wx_p") < alpha})
    return found.select(*keys, "mape_a", "mape_b", "better_model", "n", "dm_stat", "t_stat", "dm_p", "wx_p", "t_p", "wx_stat", "significant_dm", "significant_wx")


def significance_summary(tests: DataFrame) -> DataFrame:
    return tests.groupBy("area").agg(F.count("*").alias("total_pairs"), F.count_if("significant_dm").alias("significant_dm"), F.count_if("significant_wx").alias("significant_wx"), F.coalesce(F.bool_or(F.col("significant_dm") | F.col("significant_wx")), F.lit(False)).alias("any_significant"))


def pct_pairs(log: DataFrame) -> DataFrame:
    """(area, year, model_a, model_b, ea, eb) of signed percentage errors; pairs meet on (area, year), so a model missing a year loses that year only."""
    slim = log.select("area", "year", "model", error_pct(F.col("y_pred"), F.col("y_actual")).alias("e")).where("e is not null")
    year = slim.repartition("area").groupBy("area", "year").agg(F.sort_array(F.collect_list(F.struct("model", "e"))).alias("m"))
    later = lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("model_a"), b["model"].alias("model_b"), a["e"].alias("ea"), b["e"].alias("eb")))
    return year.select("area", "year", F.inline(F.flatten(F.transform("m", later))))


def _lags(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows with d1 to d`most`: d of so many rows before, by keys in order of (area, year).

    Few keys may hold all rows, so rows are dealt by ranges of (keys, area, year) and
    lagged inside each. What a range's first rows need of those before it is carried
    over: the last `most` values of each range and key, some numbers a partition."""
    ranged = cut(rows.repartitionByRange(*keys, "area", "year")).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", *keys).orderBy("area", "year")
    ranged = ranged.withColumns({"_i": F.row_number().over(inside), **{f"d{k}": F.lag("d", k).over(inside) for k in range(1, most + 1)}})
    size = F.count("*").over(Window.partitionBy("_part", *keys))
    tails = ranged.withColumn("_n", size).where(F.col("_i") > F.col("_n") - most).groupBy("_part", *keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "d"))), lambda t: t["d"]).alias("tail"))
    carried, halo = {}, []
    for r in sorted(tails.collect(), key=lambda r: r["_part"]):  # partitions x keys they hold, at most
        key = tuple(r[k] for k in keys)
        halo.append((r["_part"], *key, carried.get(key, [])))
        carried[key] = (carried.get(key, []) + r["tail"])[-most:]
    schema = "_part int, " + ", ".join(f"{k} string" for k in keys) + ", before array<double>"
    ranged = ranged.join(F.broadcast(rows.sparkSession.createDataFrame(halo, schema)), ["_part", *keys])
    # row i lacks its k-th before if k >= i: that is the (k - i + 1)-th from the end of what came before
    return ranged.withColumns({f"d{k}": F.when(F.col("_i") > k, F.col(f"d{k}")).otherwise(F.get("before", F.size("before") - 1 - (k - F.col("_i")))) for k in range(1, most + 1)}).drop("_part", "_i", "before")


def hln(log: DataFrame, pooled: bool = False, horizon: int = 1) -> DataFrame:
    """Diebold-Mariano with the small-sample correction of Harvey, Leybourne and Newbold, on signed percentage errors.

    Per area and pair, or pooled over areas, which follow one another by name; n below
    2: null. The pooled groups are few and hold all rows: for horizon 1 they are plain
    aggregates, beyond it lags go by ranges."""
    keys = ["model_a", "model_b"] if pooled else ["area", "model_a", "model_b"]
    d = pct_pairs(log).withColumn("d", F.col("ea") * F.col("ea") - F.col("eb") * F.col("eb"))
    lags = range(1, horizon)
    if pooled and lags:
        d = _lags(d, keys, horizon - 1)
    else:
        d = d.withColumns({f"d{k}": F.lag("d", k).over(Window.partitionBy(*keys).orderBy("area", "year")) for k in lags})
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_samp("d").alias("g0"), *[F.coalesce(F.covar_samp(F.when(F.col(f"d{k}").isNotNull(), F.col("d")), F.col(f"d{k}")), F.lit(0.0)).alias(f"g{k}") for k in lags])
    var = F.greatest(F.col("g0") + 2 * sum((F.col(f"g{k}") for k in lags), F.lit(0.0)), F.lit(1e-12)) / F.col("n")
    n, h = F.col("n").cast("double"), float(horizon)
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(0.0)))
    return g.select(*keys, "n", F.when(F.col("n") >= 2, F.col("mean") / F.sqrt(var) * factor).alias("hln_stat"))


def hln_tests(log: DataFrame, pooled: bool = False, horizon: int = 1) -> DataFrame:
    """hln with p-values, and Wilcoxon on the absolute percentage errors (null under two differences)."""
    keys = ["model_a", "model_b"] if pooled else ["area", "model_a", "model_b"]
    ranks = signed_ranks(pct_pairs(log), tuple(keys), spread=pooled)
    few = F.col("n_nonzero") < 2
    ranks = ranks.select(*keys, F.when(~few, F.col("w")).alias("wx_stat"), F.when(~few, p_wilcoxon(F.col("w"), F.col("n_nonzero"), F.col("ties"))).alias("wx_p"))
    return hln(log, pooled, horizon).withColumn("hln_p", p_student(F.col("hln_stat"), F.col("n") - 1)).join(ranks, keys, "left")
