"""Tail probabilities, applied to rows that are already aggregated (one row per feature, run or category).

Spark has no incomplete-beta or error function, so these are Arrow-batched helpers over result rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _each(fn, *series: pd.Series) -> pd.Series:
    out = []
    for values in zip(*series):
        bad = any(v is None or (isinstance(v, float) and math.isnan(v)) for v in values)
        out.append(None if bad else fn(*[float(v) for v in values]))
    return pd.Series(np.array(out, dtype="float64"))


@F.pandas_udf(T.DoubleType())
def _f_tail(stat: pd.Series, dfn: pd.Series, dfd: pd.Series) -> pd.Series:
    return _each(lambda f, m, n: beta_share(n / 2.0, m / 2.0, n / (n + m * f)) if f > 0 else 1.0, stat, dfn, dfd)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(stat: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda t, n: beta_share(n / 2.0, 0.5, n / (n + t * t)), stat, df)


@F.pandas_udf(T.DoubleType())
def _chi2_one(stat: pd.Series) -> pd.Series:
    return _each(lambda x: math.erfc(math.sqrt(max(x, 0.0) / 2.0)), stat)


@F.pandas_udf(T.DoubleType())
def _normal_upper(z: pd.Series) -> pd.Series:
    return _each(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), z)


@F.pandas_udf(T.DoubleType())
def _binomial_two_sided(small: pd.Series, total: pd.Series) -> pd.Series:
    def tail(k: float, n: float) -> float:
        if n == 0 or 2 * k >= n:
            return 1.0
        if n <= 512:  # exact integers
            return min(1.0, 2 * sum(math.comb(int(n), i) for i in range(int(k) + 1)) / 2 ** int(n))
        return min(1.0, 2.0 * beta_share(n - k, k + 1.0, 0.5))

    return _each(tail, small, total)


def f_pvalue(stat: Column, dfn: Column, dfd: Column) -> Column:
    """Upper tail of the F distribution."""
    return _f_tail(stat.cast("double"), dfn.cast("double"), dfd.cast("double"))


def t_pvalue(stat: Column, df: Column) -> Column:
    """Two-sided tail of Student's t."""
    return _t_two_sided(stat.cast("double"), df.cast("double"))


def chi2_pvalue(stat: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return _chi2_one(stat.cast("double"))


def normal_pvalue(z: Column) -> Column:
    """Upper tail of the standard normal."""
    return _normal_upper(z.cast("double"))


def binomial_pvalue(small: Column, total: Column) -> Column:
    """Two-sided exact sign-test probability: min(1, 2 P[X <= small]) for X ~ Binomial(total, 1/2)."""
    return _binomial_two_sided(small.cast("double"), total.cast("double"))
