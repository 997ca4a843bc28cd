"""Cell-by-cell operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barley.functions import numeric as N
from barley.operators.registry import operator


@operator("scalar")
def log(x: Column) -> Column:
    return F.ln(x)


@operator("scalar")
def sign(x: Column) -> Column:
    return F.signum(x)


@operator("scalar", "abs")
def absolute(x: Column) -> Column:
    return F.abs(x)


@operator("scalar")
def sqrt(x: Column) -> Column:
    return N.root(x)


@operator("scalar", "power", series=2)
def power(x: Column, y: Column) -> Column:
    return N.clean(F.pow(x, y))


@operator("scalar", "signed_power", series=2)
def signed_power(x: Column, y: Column) -> Column:
    return N.clean(F.signum(x) * F.pow(F.abs(x), y))


@operator("scalar")
def exp(x: Column) -> Column:
    return F.exp(x)


@operator("scalar")
def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


@operator("scalar")
def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


@operator("scalar", "round", extra=1)
def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, int(digits))


@operator("scalar")
def is_nan(x: Column) -> Column:
    return x.isNull().cast("double")


@operator("scalar", extra=1)
def fill_nan(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(float(value)))


@operator("scalar", extra=1)
def replace_zero(x: Column, eps: float = 1e-4) -> Column:
    return F.when(x == 0, F.lit(float(eps))).otherwise(x)


operator("scalar", "max", series=2)(N.top_of)
operator("scalar", "min", series=2)(N.bottom_of)
operator("scalar", "if_else", series=3)(N.pick)
operator("scalar", "both", series=2)(N.both)
operator("scalar", "either", series=2)(N.either)
operator("scalar", "negate")(N.negate)
operator("scalar", "div", series=2)(N.ratio)
operator("scalar", "add", series=2)(lambda a, b: a + b)
operator("scalar", "sub", series=2)(lambda a, b: a - b)
operator("scalar", "mul", series=2)(lambda a, b: a * b)
operator("scalar", "neg")(lambda a: -a)
for _name, _sign in {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}.items():
    operator("scalar", _name, series=2)(lambda a, b, s=_sign: N.compare(s, a, b))
