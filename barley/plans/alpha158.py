"""The 158-feature set, without the one that needs a volume-weighted price: 12 bar shapes and 29 kinds x 5 windows."""

from __future__ import annotations

from barley.operators import FactorSet

# The published windows, bar shapes and rolling kinds.
WINDOWS = (5, 10, 20, 30, 60)
TINY = 1e-12

SHAPES = {
    "KMID": lambda o: (o.close - o.open) / o.open,
    "KLEN": lambda o: (o.high - o.low) / o.open,
    "KMID2": lambda o: (o.close - o.open) / (o.high - o.low + TINY),
    "KUP": lambda o: (o.high - o.max(o.open, o.close)) / o.open,
    "KUP2": lambda o: (o.high - o.max(o.open, o.close)) / (o.high - o.low + TINY),
    "KLOW": lambda o: (o.min(o.open, o.close) - o.low) / o.open,
    "KLOW2": lambda o: (o.min(o.open, o.close) - o.low) / (o.high - o.low + TINY),
    "KSFT": lambda o: (2 * o.close - o.high - o.low) / o.open,
    "KSFT2": lambda o: (2 * o.close - o.high - o.low) / (o.high - o.low + TINY),
    "OPEN0": lambda o: o.open / o.close,
    "HIGH0": lambda o: o.high / o.close,
    "LOW0": lambda o: o.low / o.close,
}


def _share(o, n, field, way):
    """Rises (or falls, or both with sign) of a field as a share of all its movement."""
    before = o.delay(field, 1)
    moved = o.ts_sum(o.abs(field - before), n) + TINY
    up, down = o.ts_sum(o.max(field - before, 0), n), o.ts_sum(o.max(before - field, 0), n)
    return {"up": up, "down": down, "net": up - down}[way] / moved


def _days(o, n, sign):
    before = o.delay(o.close, 1)
    return o.ts_mean(o.if_else(o.close > before if sign > 0 else o.close < before, 1, 0), n)


def _turnover(o):
    return o.abs(o.close / o.delay(o.close, 1) - 1) * o.volume


KINDS = {
    "ROC": lambda o, n: o.delay(o.close, n) / o.close,
    "MA": lambda o, n: o.ts_mean(o.close, n) / o.close,
    "STD": lambda o, n: o.ts_std(o.close, n) / o.close,
    "BETA": lambda o, n: o.ts_slope(o.close, n) / o.close,
    "RSQR": lambda o, n: o.ts_rsquare(o.close, n),
    "RESI": lambda o, n: o.ts_residual(o.close, n) / o.close,
    "MAX": lambda o, n: o.ts_max(o.high, n) / o.close,
    "MIN": lambda o, n: o.ts_min(o.low, n) / o.close,
    "QTLU": lambda o, n: o.ts_percentile(o.close, n, 0.8) / o.close,
    "QTLD": lambda o, n: o.ts_percentile(o.close, n, 0.2) / o.close,
    "RANK": lambda o, n: o.ts_rank(o.close, n),
    "RSV": lambda o, n: (o.close - o.ts_min(o.low, n)) / (o.ts_max(o.high, n) - o.ts_min(o.low, n) + TINY),
    "IMAX": lambda o, n: o.ts_argmax(o.high, n) / n,
    "IMIN": lambda o, n: o.ts_argmin(o.low, n) / n,
    "IMXD": lambda o, n: (o.ts_argmax(o.high, n) - o.ts_argmin(o.low, n)) / n,
    "CORR": lambda o, n: o.correlation(o.close, o.log(o.volume + 1), n),
    "CORD": lambda o, n: o.correlation(o.close / o.delay(o.close, 1), o.log(o.volume / o.delay(o.volume, 1) + 1), n),
    "CNTP": lambda o, n: _days(o, n, 1),
    "CNTN": lambda o, n: _days(o, n, -1),
    "CNTD": lambda o, n: _days(o, n, 1) - _days(o, n, -1),
    "SUMP": lambda o, n: _share(o, n, o.close, "up"),
    "SUMN": lambda o, n: _share(o, n, o.close, "down"),
    "SUMD": lambda o, n: _share(o, n, o.close, "net"),
    "VMA": lambda o, n: o.ts_mean(o.volume, n) / (o.volume + TINY),
    "VSTD": lambda o, n: o.ts_std(o.volume, n) / (o.volume + TINY),
    "WVMA": lambda o, n: o.ts_std(_turnover(o), n) / (o.ts_mean(_turnover(o), n) + TINY),
    "VSUMP": lambda o, n: _share(o, n, o.volume, "up"),
    "VSUMN": lambda o, n: _share(o, n, o.volume, "down"),
    "VSUMD": lambda o, n: _share(o, n, o.volume, "net"),
}


def alpha158(windows=WINDOWS, shapes: bool = True) -> FactorSet:
    factors = dict(SHAPES) if shapes else {}
    for kind, formula in KINDS.items():
        for n in windows:
            factors[f"{kind}{n}"] = lambda o, n=n, formula=formula: formula(o, n)
    return FactorSet({}, factors)
