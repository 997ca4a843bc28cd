"""Classic indicators from open, high, low, close and volume."""

from __future__ import annotations

from barley.operators import FactorSet

TINY = 1e-12


def _change(o, n):
    return o.delta(o.close, n) / o.delay(o.close, n)


def _stochastic(o, n):
    return (o.close - o.ts_min(o.low, n)) / (o.ts_max(o.high, n) - o.ts_min(o.low, n) + TINY)


def _true_range(o):
    before = o.delay(o.close, 1)
    return o.max(o.high - o.low, o.max(o.abs(o.high - before), o.abs(o.low - before)))


def _rsi(o, n):
    d = o.delta(o.close, 1)
    return o.ts_sum(o.if_else(d > 0, d, 0), n) / (o.ts_sum(o.abs(d), n) + TINY)


def _cci(o, n):
    off = o.close - o.ts_mean(o.close, n)
    return off / (0.015 * o.ts_mean(o.abs(off), n) + TINY)


def _signed_volume(o):
    before = o.delay(o.close, 1)
    return o.if_else(o.close > before, o.volume, o.if_else(o.close < before, -1 * o.volume, 0))


TECHNICAL = {
    **{f"sma_{n}": (lambda o, n=n: o.ts_mean(o.close, n) / o.close) for n in (5, 10, 20, 60)},
    **{f"ema_{n}": (lambda o, n=n: o.ema(o.close, n) / o.close) for n in (12, 26)},
    "macd_line": lambda o: (o.ema(o.close, 12) - o.ema(o.close, 26)) / o.close,
    "macd_hist": lambda o: o.ema(o.close, 12) - o.ema(o.close, 26),
    "rsi_14": lambda o: _rsi(o, 14),
    **{f"roc_{n}": (lambda o, n=n: _change(o, n)) for n in (5, 10, 20)},
    "williams_r": lambda o: (o.ts_max(o.high, 14) - o.close) / (o.ts_max(o.high, 14) - o.ts_min(o.low, 14) + TINY),
    "cci_20": lambda o: _cci(o, 20),
    "stochastic_k": lambda o: _stochastic(o, 14),
    "stochastic_d": lambda o: o.ts_mean(_stochastic(o, 14), 3),
    **{f"momentum_{n}": (lambda o, n=n: o.close / o.delay(o.close, n)) for n in (10, 20)},
    "atr_14": lambda o: o.ts_mean(_true_range(o), 14) / o.close,
    "bb_upper": lambda o: (o.ts_mean(o.close, 20) + 2 * o.ts_std(o.close, 20)) / o.close,
    "bb_lower": lambda o: (o.ts_mean(o.close, 20) - 2 * o.ts_std(o.close, 20)) / o.close,
    "bb_width": lambda o: 4 * o.ts_std(o.close, 20) / (o.ts_mean(o.close, 20) + TINY),
    **{f"realized_vol_{n}": (lambda o, n=n: o.ts_std(_change(o, 1), n)) for n in (10, 20)},
    "obv_change": _signed_volume,
    "volume_ratio": lambda o: o.volume / (o.ts_mean(o.volume, 20) + TINY),
    "volume_roc": lambda o: o.delta(o.volume, 5) / (o.delay(o.volume, 5) + TINY),
    "pvt_change": lambda o: o.volume * o.delta(o.close, 1) / (o.delay(o.close, 1) + TINY),
    "volume_price_corr": lambda o: o.correlation(o.close, o.volume, 20),
}


def technical(names=None) -> FactorSet:
    library = FactorSet({}, dict(TECHNICAL))
    return library if names is None else library.only(names)
