"""Statistics that Spark lacks: a safe correlation, and the Student tail on small metric tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from barley.functions.numeric import ratio


def correlate(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null for a constant side (``corr`` raises there in ANSI mode)."""
    whole = x.isNotNull() & y.isNotNull()
    a, b = F.when(whole, x), F.when(whole, y)
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    if t != t or df != df or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def p_value(t: Column, df: Column) -> Column:
    """Two-sided Student p-value, for tables of metrics."""
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float))], dtype=float)

    return F.pandas_udf(tail, "double")(t, df)
