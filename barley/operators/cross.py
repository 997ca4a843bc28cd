"""Cross-sectional operators: Column builders over all instruments at one time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barley.functions.numeric import normal_inverse, ratio
from barley.operators.registry import operator
from barley.operators.spec import BY_TIME, ID, Slice


def _present(x: Column, value: Column) -> Column:
    return F.when(x.isNotNull(), value)


@operator("slice", "cs_rank", "rank", extra=1)
def cs_rank(x: Column, unused: float = 0.0, on: Slice = BY_TIME) -> Column:
    """Smallest-rank share in (0, 1]. The second argument is accepted and has no effect."""
    place = F.rank().over(on.by(x.asc_nulls_last()))
    return _present(x, place / F.count(x).over(on.all()))


@operator("slice", "cs_rank_average", extra=0)
def cs_rank_average(x: Column, on: Slice = BY_TIME) -> Column:
    """Average rank 1..n, ties sharing their mean rank."""
    first = F.rank().over(on.by(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Slice((*on.keys,)).by(x.asc_nulls_last()).rangeBetween(0, 0))
    return _present(x, first + (ties - 1) / 2.0)


@operator("slice", "cs_zscore", "zscore")
def cs_zscore(x: Column, on: Slice = BY_TIME) -> Column:
    return ratio(x - F.avg(x).over(on.all()), F.stddev_samp(x).over(on.all()))


@operator("slice", "cs_zscore_pop")
def cs_zscore_pop(x: Column, on: Slice = BY_TIME) -> Column:
    return ratio(x - F.avg(x).over(on.all()), F.stddev_pop(x).over(on.all()))


@operator("slice", "cs_scale")
def cs_scale(x: Column, on: Slice = BY_TIME) -> Column:
    size = F.sum(F.abs(x)).over(on.all())
    even = ratio(F.lit(1.0), F.count(x).over(on.all()))
    return _present(x, F.when(size == 0, even).otherwise(ratio(x, size)))


@operator("slice", "cs_demean", "demean")
def cs_demean(x: Column, on: Slice = BY_TIME) -> Column:
    return x - F.avg(x).over(on.all())


@operator("slice", "cs_max")
def cs_max(x: Column, on: Slice = BY_TIME) -> Column:
    return _present(x, F.max(x).over(on.all()))


@operator("slice", "cs_min")
def cs_min(x: Column, on: Slice = BY_TIME) -> Column:
    return _present(x, F.min(x).over(on.all()))


@operator("slice", "normalize", extra=2)
def normalize(x: Column, use_std: bool = False, limit: float = 0.0, on: Slice = BY_TIME) -> Column:
    value = x - F.avg(x).over(on.all())
    if use_std:
        spread = F.stddev_samp(x).over(on.all())
        value = F.when(spread > 0, ratio(value, spread)).otherwise(value)
    if limit > 0:
        value = F.when(value.isNotNull(), F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), value)))
    return F.when(F.count(x).over(on.all()) >= 2, value)


@operator("slice", "winsorize", extra=1)
def winsorize(x: Column, k: float = 4.0, on: Slice = BY_TIME) -> Column:
    centre, reach = F.avg(x).over(on.all()), F.stddev_pop(x).over(on.all()) * F.lit(float(k))
    return _present(x, F.greatest(centre - reach, F.least(centre + reach, x)))


@operator("slice", "scale_down", extra=1)
def scale_down(x: Column, constant: float = 0.0, on: Slice = BY_TIME) -> Column:
    low, high = F.min(x).over(on.all()), F.max(x).over(on.all())
    value = F.when(high == low, F.lit(0.5)).otherwise(ratio(x - low, high - low)) - F.lit(float(constant))
    return F.when(x.isNotNull() & (F.count(x).over(on.all()) >= 2), value)


@operator("slice", "clip_quantile", extra=2)
def clip_quantile(x: Column, low: float = 0.2, high: float = 0.8, on: Slice = BY_TIME) -> Column:
    edges = F.percentile(x, F.array(F.lit(float(low)), F.lit(float(high)))).over(on.all())
    return _present(x, F.greatest(edges[0], F.least(edges[1], x)))


@operator("slice", "quantile", extra=2)
def quantile(x: Column, driver: str = "gaussian", sigma: float = 1.0, on: Slice = BY_TIME) -> Column:
    """Rank, shift into [1/n, 1 - 1/n], then the inverse of the named distribution. Ties go by instrument."""
    n = F.count(x).over(on.all())
    place = F.row_number().over(on.by(x.asc_nulls_last(), F.col(ID))) - 1
    p = ratio(F.lit(1.0), n) + ratio(place, n - 1) * (1.0 - ratio(F.lit(2.0), n))
    if driver == "gaussian":
        value = normal_inverse(p) * F.lit(float(sigma))
    elif driver == "cauchy":
        value = F.tan(F.lit(3.141592653589793) * (p - 0.5)) * F.lit(float(sigma))
    elif driver == "uniform":
        value = p - 0.5
    else:
        raise ValueError(f"unknown driver {driver!r}, use gaussian, cauchy or uniform")
    return F.when(x.isNotNull() & (n >= 2), value)


@operator("slice", "vector_neut", "c_residual", series=2)
def vector_neut(x: Column, y: Column, on: Slice = BY_TIME) -> Column:
    """Residual of ``x`` on ``y`` over the pairs present; a constant ``y`` only takes the mean out."""
    w = on.all()
    whole = x.isNotNull() & y.isNotNull()
    a, b = F.when(whole, x), F.when(whole, y)
    slope = F.coalesce(ratio(F.covar_pop(a, b).over(w), F.var_pop(b).over(w)), F.lit(0.0))
    value = (a - F.avg(a).over(w)) - slope * (b - F.avg(b).over(w))
    return F.when(F.count(a).over(w) >= 3, value)


@operator("total", "scale", extra=1)
def scale(x: Column, total: Column, k: float = 1.0) -> Column:
    """``x`` over the sum of its absolute values in the instrument's whole history. It looks ahead."""
    return ratio(x * F.lit(float(k)), total)
