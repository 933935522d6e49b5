"""p-values of test statistics, vectorised: normal, Student t, exact and approximate Wilcoxon."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 50  # pairs up to which the Wilcoxon distribution is counted out
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return math.nan if math.isnan(t) or df < 1 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def wilcoxon_exact(w: float, n: int) -> float:
    """Two-sided P of a signed-rank sum as small as w (the lesser of the two sums), without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return float(min(1.0, 2 * ways[: int(math.floor(w)) + 1].sum() / 2.0**n))


def wilcoxon(w: float, n: int, ties: float) -> float:
    """Exact for n up to 50 without ties; else normal, with ties the sum of t**3 - t over tied groups. n = 0: 1."""
    if n == 0:
        return 1.0
    if n <= EXACT and not ties:
        return wilcoxon_exact(w, n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(normal_two_sided(np.array((w - n * (n + 1) / 4) / math.sqrt(var)))) if var > 0 else 1.0


def p_normal(z: Column) -> Column:
    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series(normal_two_sided(z.to_numpy(float)))

    return p(z)


def p_student(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, n) for x, n in zip(t.to_numpy(float), df.to_numpy(float))])

    return p(t, df)


def p_wilcoxon(w: Column, n: Column, ties: Column) -> Column:
    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([math.nan if k is None or math.isnan(k) else wilcoxon(x, int(k), c) for x, k, c in zip(w.to_numpy(float), n.to_numpy(float), ties.to_numpy(float))])

    return p(w, n, ties)
