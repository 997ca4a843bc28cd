"""Rolling operators: Column builders over the last ``n`` rows of one instrument.

A window that is not full, or holds a missing value, gives null. ``on`` says how a history is
partitioned; the default is one instrument of a dense panel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barley.functions.numeric import ratio
from barley.operators.registry import operator
from barley.operators.spec import BY_INSTRUMENT, Track

#: correlations are rounded here, so that rounding noise never breaks ties in a later rank
CORR_DIGITS = 12


def _full(x: Column, n: int, on: Track, value: Column) -> Column:
    return F.when(F.count(x).over(on.last(n)) == n, value)


def _window(x: Column, n: int, on: Track) -> Column:
    """The window's values, oldest first; missing unless all ``n`` are present."""
    return _full(x, n, on, F.collect_list(x).over(on.last(n)))


@operator("rolling", "ts_mean", "sma", extra=1)
def ts_mean(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return _full(x, n, on, F.avg(x).over(on.last(n)))


@operator("rolling", "ts_sum", extra=1)
def ts_sum(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return _full(x, n, on, F.sum(x).over(on.last(n)))


@operator("rolling", "ts_std", "stddev", "ts_std_dev", extra=1)
def ts_std(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return _full(x, n, on, F.stddev_samp(x).over(on.last(n)))


@operator("rolling", "ts_min", extra=1)
def ts_min(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return _full(x, n, on, F.min(x).over(on.last(n)))


@operator("rolling", "ts_max", extra=1)
def ts_max(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return _full(x, n, on, F.max(x).over(on.last(n)))


@operator("rolling", "ts_max_to_min", extra=1)
def ts_max_to_min(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return ts_max(x, n, on) - ts_min(x, n, on)


@operator("rolling", "diff_sign", extra=1)
def diff_sign(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return F.signum(x - ts_mean(x, n, on))


@operator("rolling", "delay", "ts_delay", extra=1, back=int)
def delay(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return F.lag(x, n).over(on.line())


@operator("rolling", "delta", "ts_delta", extra=1, back=int)
def delta(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return x - delay(x, n, on)


@operator("rolling", "ts_product", "product", extra=1)
def ts_product(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return F.aggregate(_window(x, n, on), F.lit(1.0), lambda a, v: a * v)


@operator("rolling", "ts_skew", "skewness", extra=1)
def ts_skew(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    if n < 3:
        return F.lit(None).cast("double")
    bias = (n * (n - 1)) ** 0.5 / (n - 2)
    spread = F.stddev_samp(x).over(on.last(n))
    return _full(x, n, on, F.when(spread > 0, F.skewness(x).over(on.last(n)) * bias))


@operator("rolling", "decay_linear", "ts_decay_linear", extra=1)
def decay_linear(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    weighted = F.transform(_window(x, n, on), lambda v, i: v * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v) / F.lit(n * (n + 1) / 2.0)


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    whole = x.isNotNull() & y.isNotNull()
    return F.when(whole, x), F.when(whole, y)


@operator("rolling", "covariance", "ts_covariance", series=2, extra=1)
def covariance(x: Column, y: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    a, b = _pairs(x, y)
    return _full(a, n, on, F.covar_samp(a, b).over(on.last(n)))


@operator("rolling", "correlation", "ts_corr", series=2, extra=1)
def correlation(x: Column, y: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    a, b = _pairs(x, y)
    w = on.last(n)
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    return _full(a, n, on, F.round(ratio(F.covar_samp(a, b).over(w), spread), CORR_DIGITS))


@operator("rolling", "ts_slope", extra=1)
def ts_slope(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return _full(x, n, on, F.regr_slope(x, F.col(on.clock)).over(on.last(n)))


@operator("rolling", "ts_rsquare", extra=1)
def ts_rsquare(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    w = on.last(n)
    moving = F.max(x).over(w) > F.min(x).over(w)
    return _full(x, n, on, F.when(moving, F.regr_r2(x, F.col(on.clock)).over(w)))


@operator("rolling", "ts_residual", extra=1)
def ts_residual(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    # the line passes through (mean clock, mean x) and the newest clock is (n - 1) / 2 past its mean
    return x - ts_mean(x, n, on) - ts_slope(x, n, on) * ((n - 1) / 2.0)


@operator("rolling", "ts_percentile", extra=2)
def ts_percentile(x: Column, n: int, q: float, on: Track = BY_INSTRUMENT) -> Column:
    place = q * (n - 1)
    low = min(int(place), n - 1)
    high = min(low + 1, n - 1)
    ordered = F.sort_array(_window(x, n, on))
    a, b = F.element_at(ordered, low + 1), F.element_at(ordered, high + 1)
    return a + (b - a) * F.lit(place - low)


@operator("rolling", "ts_rank", extra=1)
def ts_rank(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return (F.size(F.filter(_window(x, n, on), lambda v: v < x)) + 1).cast("double")


@operator("rolling", "wq_ts_rank", extra=1)
def wq_ts_rank(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    if n == 1:
        return F.when(x.isNotNull(), F.lit(0.5))
    seen = _window(x, n, on)
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return (below + (equal - 1) / 2.0) / F.lit(n - 1.0)


@operator("rolling", "ts_argmax", "ts_arg_max", extra=1)
def ts_argmax(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    seen = _window(x, n, on)
    return F.array_position(seen, F.array_max(seen)).cast("double")


@operator("rolling", "ts_argmin", "ts_arg_min", extra=1)
def ts_argmin(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    seen = _window(x, n, on)
    return F.array_position(seen, F.array_min(seen)).cast("double")


@operator("rolling", "wq_ts_argmax", extra=1)
def wq_ts_argmax(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return F.lit(float(n)) - ts_argmax(x, n, on)


@operator("rolling", "wq_ts_argmin", extra=1)
def wq_ts_argmin(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    return F.lit(float(n)) - ts_argmin(x, n, on)


def _selected_mean(x: Column, y: Column, n: int, k: int, top: bool, on: Track) -> Column:
    w = on.last(n)
    whole = x.isNotNull() & y.isNotNull()
    pair = F.struct(y.alias("y"), F.col(on.order).alias("t"), x.alias("x"))
    ordered = F.array_sort(F.collect_list(F.when(whole, pair)).over(w))
    chosen = F.slice(ordered, -k if top else 1, k)
    total = F.aggregate(chosen, F.lit(0.0), lambda a, p: a + p["x"])
    spans = F.count(F.lit(1)).over(w) == n
    return F.when(spans & (F.size(ordered) >= k), total / F.lit(float(k)))


@operator("rolling", "rolling_selmean_top", series=2, extra=2)
def rolling_selmean_top(x: Column, y: Column, n: int, k: int, on: Track = BY_INSTRUMENT) -> Column:
    return _selected_mean(x, y, n, k, True, on)


@operator("rolling", "rolling_selmean_btm", series=2, extra=2)
def rolling_selmean_btm(x: Column, y: Column, n: int, k: int, on: Track = BY_INSTRUMENT) -> Column:
    return _selected_mean(x, y, n, k, False, on)


@operator("rolling", "rolling_selmean_diff", series=2, extra=2)
def rolling_selmean_diff(x: Column, y: Column, n: int, k: int, on: Track = BY_INSTRUMENT) -> Column:
    return rolling_selmean_top(x, y, n, k, on) - rolling_selmean_btm(x, y, n, k, on)


@operator("rolling", "ts_mean_any", extra=1)
def ts_mean_any(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
    """Mean of whatever the window holds, one value being enough."""
    return F.avg(x).over(on.last(n))


@operator("macro", "ts_meanrank", extra=1)
def ts_meanrank(board, x, n: int = 20):
    return board.ts_mean_any(board.cs_rank(x), n)
