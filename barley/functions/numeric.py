"""Null, NaN and truth rules of the panel, as Column helpers.

Missing values are null everywhere. Every other module takes these rules from here, so that the
treatment of missing cells, zero divisors and truth values is decided in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN to null, on reading."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NaN and the infinities to null, on writing results."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in doubles; a zero divisor gives null instead of an ANSI error."""
    return F.try_divide(a.cast("double"), b.cast("double"))


_COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def compare(sign: str, a: Column, b: Column) -> Column:
    """1.0 or 0.0. A missing side compares false, except that it is unequal to everything."""
    return F.coalesce(_COMPARE[sign](a, b).cast("double"), F.lit(1.0 if sign == "!=" else 0.0))


def truth(x: Column) -> Column:
    """Truth value: zero is false, everything else, missing too, is true."""
    return F.coalesce(x != 0, F.lit(True))


def both(a: Column, b: Column) -> Column:
    return (truth(a) & truth(b)).cast("double")


def either(a: Column, b: Column) -> Column:
    return (truth(a) | truth(b)).cast("double")


def negate(a: Column) -> Column:
    return (~truth(a)).cast("double")


def pick(condition: Column, a: Column, b: Column) -> Column:
    return F.when(truth(condition), a).otherwise(b)


def top_of(a: Column, b: Column) -> Column:
    """The larger of two values, missing when either is (``greatest`` would skip nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def bottom_of(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


# Coefficients of the rational approximation of the normal quantile, algorithm AS 241
# (Wichura 1988, PPND16), lowest power first.
CENTRE_NUM = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
              4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
CENTRE_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
              2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
MIDDLE_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
              1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
MIDDLE_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
              1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
TAIL_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
TAIL_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def normal_inverse(p: Column) -> Column:
    """Quantile of the standard normal at ``p`` in (0, 1), else null."""
    q = p - 0.5
    inner = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    centre = q * _horner(CENTRE_NUM, inner) / _horner(CENTRE_DEN, inner)
    middle = _horner(MIDDLE_NUM, r - 1.6) / _horner(MIDDLE_DEN, r - 1.6)
    tail = _horner(TAIL_NUM, r - 5.0) / _horner(TAIL_DEN, r - 5.0)
    outer = F.signum(q) * F.when(r <= 5, middle).otherwise(tail)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(outer))
