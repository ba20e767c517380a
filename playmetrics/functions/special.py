"""p-values of test statistics, applied to the few rows of a result table.

The incomplete beta and gamma functions come from their continued fraction and series forms
(Abramowitz and Stegun, 26.5 and 6.5).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 1000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b, c = x + 1.0 - a, 1.0 / _TINY
    d = 1.0 / b
    value = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or _TINY)
        c = (b + step / c) or _TINY
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value


def _pearson(r: float, n: float) -> float | None:
    if r is None or r != r or n < 3:
        return None
    df = n - 2
    return beta_inc(df / 2.0, 0.5, 1.0 - min(r * r, 1.0))


@F.pandas_udf(T.DoubleType())
def _pearson_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_pearson(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2_udf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([gamma_upper(d / 2.0, s / 2.0) for s, d in zip(stat, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f_udf(stat: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    return pd.Series(
        [beta_inc(w / 2.0, b / 2.0, w / (w + b * s)) for s, b, w in zip(stat, between, within)], dtype="float64"
    )


def pearson_p(r: str, n: str) -> Column:
    """Two-sided p-value of a correlation from r and n."""
    return _pearson_udf(F.col(r), F.col(n))


def chi2_p(stat: str, dof: str) -> Column:
    """Upper tail of the chi-square distribution."""
    return _chi2_udf(F.col(stat), F.col(dof))


def f_p(stat: str, between: str, within: str) -> Column:
    """Upper tail of the F distribution."""
    return _f_udf(F.col(stat), F.col(between), F.col(within))
