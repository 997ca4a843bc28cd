"""The published set of 101 formulaic alphas, without the sector-neutral ones.

Each entry is a function of a board ``o``. ``returns`` and ``vwap`` are variables, defined at the end.
"""

from __future__ import annotations

from barley.operators import FactorSet


def adv(o, n):
    """Average volume."""
    return o.ts_mean(o.volume, n)


def mid(o):
    return (o.high + o.low) / 2



def bend(o):
    """Slope of the last ten bars less the slope of the ten before."""
    return (o.delay(o.close, 20) - o.delay(o.close, 10)) / 10 - (o.delay(o.close, 10) - o.close) / 10


def follow_trend(o, n):
    """The last change while all ``n`` changes agree in sign, else its opposite."""
    d = o.delta(o.close, 1)
    return o.if_else(o.ts_min(d, n) > 0, d, o.if_else(o.ts_max(d, n) < 0, d, -1 * d))


def band_signal(o):
    slow, fast, width = o.ts_mean(o.close, 8), o.ts_mean(o.close, 2), o.ts_std(o.close, 8)
    busy = o.if_else(o.volume / adv(o, 20) >= 1, 1, -1)
    return o.if_else(slow + width < fast, -1, o.if_else(fast < slow - width, 1, busy))


def location(o, eps):
    """Where the close lies between low and high, from -1 to 1."""
    return ((o.close - o.low) - (o.high - o.close)) / o.replace_zero(o.high - o.low, eps)


# The published formulas, by number.
ALPHA101 = {
    "alpha001": lambda o: o.cs_rank(o.ts_argmax(o.signed_power(o.if_else(o.returns < 0, o.ts_std(o.returns, 20), o.close), 2), 5)) - 0.5,
    "alpha002": lambda o: -1 * o.correlation(o.cs_rank(o.delta(o.log(o.volume), 2)), o.cs_rank((o.close - o.open) / o.open), 6),
    "alpha003": lambda o: -1 * o.correlation(o.cs_rank(o.open), o.cs_rank(o.volume), 10),
    "alpha004": lambda o: -1 * o.ts_rank(o.cs_rank(o.low), 9),
    "alpha005": lambda o: o.cs_rank(o.open - o.ts_sum(o.vwap, 10) / 10) * -1 * o.abs(o.cs_rank(o.close - o.vwap)),
    "alpha006": lambda o: -1 * o.correlation(o.open, o.volume, 10),
    "alpha007": lambda o: o.if_else(adv(o, 20) < o.volume, -1 * o.ts_rank(o.abs(o.delta(o.close, 7)), 60) * o.sign(o.delta(o.close, 7)), -1),
    "alpha008": lambda o: -1 * o.cs_rank(o.delta(o.ts_sum(o.open, 5) * o.ts_sum(o.returns, 5), 10)),
    "alpha009": lambda o: follow_trend(o, 5),
    "alpha010": lambda o: o.cs_rank(follow_trend(o, 4)),
    "alpha011": lambda o: (o.cs_rank(o.ts_max(o.vwap - o.close, 3)) + o.cs_rank(o.ts_min(o.vwap - o.close, 3))) * o.cs_rank(o.delta(o.volume, 3)),
    "alpha012": lambda o: o.sign(o.delta(o.volume, 1)) * -1 * o.delta(o.close, 1),
    "alpha013": lambda o: -1 * o.cs_rank(o.covariance(o.cs_rank(o.close), o.cs_rank(o.volume), 5)),
    "alpha014": lambda o: -1 * o.cs_rank(o.delta(o.returns, 3)) * o.correlation(o.open, o.volume, 10),
    "alpha015": lambda o: -1 * o.ts_sum(o.cs_rank(o.correlation(o.cs_rank(o.high), o.cs_rank(o.volume), 3)), 3),
    "alpha016": lambda o: -1 * o.cs_rank(o.covariance(o.cs_rank(o.high), o.cs_rank(o.volume), 5)),
    "alpha017": lambda o: -1 * o.cs_rank(o.ts_rank(o.close, 10)) * o.cs_rank(o.delta(o.delta(o.close, 1), 1)) * o.cs_rank(o.ts_rank(o.volume / adv(o, 20), 5)),
    "alpha018": lambda o: -1 * o.cs_rank(o.ts_std(o.abs(o.close - o.open), 5) + (o.close - o.open) + o.correlation(o.close, o.open, 10)),
    "alpha019": lambda o: -1 * o.sign((o.close - o.delay(o.close, 7)) + o.delta(o.close, 7)) * (1 + o.cs_rank(1 + o.ts_sum(o.returns, 250))),
    "alpha020": lambda o: -1 * o.cs_rank(o.open - o.delay(o.high, 1)) * o.cs_rank(o.open - o.delay(o.close, 1)) * o.cs_rank(o.open - o.delay(o.low, 1)),
    "alpha021": band_signal,
    "alpha022": lambda o: -1 * o.delta(o.correlation(o.high, o.volume, 5), 5) * o.cs_rank(o.ts_std(o.close, 20)),
    "alpha023": lambda o: o.if_else(o.ts_mean(o.high, 20) < o.high, -1 * o.delta(o.high, 2), 0),
    "alpha024": lambda o: o.if_else(o.delta(o.ts_mean(o.close, 100), 100) / o.delay(o.close, 100) <= 0.05, -1 * (o.close - o.ts_min(o.close, 100)), -1 * o.delta(o.close, 3)),
    "alpha025": lambda o: o.cs_rank(-1 * o.returns * adv(o, 20) * o.vwap * (o.high - o.close)),
    "alpha026": lambda o: -1 * o.ts_max(o.correlation(o.ts_rank(o.volume, 5), o.ts_rank(o.high, 5), 5), 3),
    "alpha027": lambda o: o.if_else(o.cs_rank(o.ts_mean(o.correlation(o.cs_rank(o.volume), o.cs_rank(o.vwap), 6), 2)) > 0.5, -1, 1),
    "alpha028": lambda o: o.scale(o.correlation(adv(o, 20), o.low, 5) + mid(o) - o.close),
    "alpha029": lambda o: o.ts_min(o.cs_rank(o.cs_rank(o.scale(o.log(o.ts_sum(o.cs_rank(o.cs_rank(-1 * o.cs_rank(o.delta(o.close - 1, 5)))), 2))))), 5) + o.ts_rank(o.delay(-1 * o.returns, 6), 5),
    "alpha030": lambda o: (1 - o.cs_rank(o.sign(o.close - o.delay(o.close, 1)) + o.sign(o.delay(o.close, 1) - o.delay(o.close, 2)) + o.sign(o.delay(o.close, 2) - o.delay(o.close, 3)))) * o.ts_sum(o.volume, 5) / o.ts_sum(o.volume, 20),
    "alpha031": lambda o: o.cs_rank(o.cs_rank(o.cs_rank(o.decay_linear(-1 * o.cs_rank(o.cs_rank(o.delta(o.close, 10))), 10)))) + o.cs_rank(-1 * o.delta(o.close, 3)) + o.sign(o.scale(o.correlation(adv(o, 20), o.low, 12))),
    "alpha032": lambda o: o.scale(o.ts_mean(o.close, 7) - o.close) + 20 * o.scale(o.correlation(o.vwap, o.delay(o.close, 5), 230)),
    "alpha033": lambda o: o.cs_rank(-1 + o.open / o.close),
    "alpha034": lambda o: o.cs_rank(2 - o.cs_rank(o.ts_std(o.returns, 2) / o.ts_std(o.returns, 5)) - o.cs_rank(o.delta(o.close, 1))),
    "alpha035": lambda o: o.ts_rank(o.volume, 32) * (1 - o.ts_rank(o.close + o.high - o.low, 16)) * (1 - o.ts_rank(o.returns, 32)),
    "alpha036": lambda o: 2.21 * o.cs_rank(o.correlation(o.close - o.open, o.delay(o.volume, 1), 15)) + 0.7 * o.cs_rank(o.open - o.close) + 0.73 * o.cs_rank(o.ts_rank(o.delay(-1 * o.returns, 6), 5)) + o.cs_rank(o.abs(o.correlation(o.vwap, adv(o, 20), 6))) + 0.6 * o.cs_rank((o.ts_mean(o.close, 200) - o.open) * (o.close - o.open)),
    "alpha037": lambda o: o.cs_rank(o.correlation(o.delay(o.open - o.close, 1), o.close, 200)) + o.cs_rank(o.open - o.close),
    "alpha038": lambda o: -1 * o.cs_rank(o.ts_rank(o.open, 10)) * o.cs_rank(o.close / o.open),
    "alpha039": lambda o: -1 * o.cs_rank(o.delta(o.close, 7) * (1 - o.cs_rank(o.decay_linear(o.volume / adv(o, 20), 9)))) * (1 + o.cs_rank(o.ts_mean(o.returns, 250))),
    "alpha040": lambda o: -1 * o.cs_rank(o.ts_std(o.high, 10)) * o.correlation(o.high, o.volume, 10),
    "alpha041": lambda o: o.power(o.high * o.low, 0.5) - o.vwap,
    "alpha042": lambda o: o.cs_rank(o.vwap - o.close) / o.cs_rank(o.vwap + o.close),
    "alpha043": lambda o: o.ts_rank(o.volume / adv(o, 20), 20) * o.ts_rank(-1 * o.delta(o.close, 7), 8),
    "alpha044": lambda o: -1 * o.correlation(o.high, o.cs_rank(o.volume), 5),
    "alpha045": lambda o: -1 * o.cs_rank(o.ts_mean(o.delay(o.close, 5), 20)) * o.correlation(o.close, o.volume, 2) * o.cs_rank(o.correlation(o.ts_sum(o.close, 5), o.ts_sum(o.close, 20), 2)),
    "alpha046": lambda o: o.if_else(bend(o) > 0.25, -1, o.if_else(bend(o) < 0, 1, -1 * o.delta(o.close, 1))),
    "alpha047": lambda o: (o.cs_rank(1 / o.close) * o.volume / adv(o, 20)) * (o.high * o.cs_rank(o.high - o.close) / o.ts_mean(o.high, 5)) - o.cs_rank(o.vwap - o.delay(o.vwap, 5)),
    "alpha049": lambda o: o.if_else(bend(o) < -0.1, 1, -1 * o.delta(o.close, 1)),
    "alpha050": lambda o: -1 * o.ts_max(o.cs_rank(o.correlation(o.cs_rank(o.volume), o.cs_rank(o.vwap), 5)), 5),
    "alpha051": lambda o: o.if_else(bend(o) < -0.05, 1, -1 * o.delta(o.close, 1)),
    "alpha052": lambda o: -1 * o.delta(o.ts_min(o.low, 5), 5) * o.cs_rank((o.ts_sum(o.returns, 240) - o.ts_sum(o.returns, 20)) / 220) * o.ts_rank(o.volume, 5),
    "alpha053": lambda o: -1 * o.delta(((o.close - o.low) - (o.high - o.close)) / o.replace_zero(o.close - o.low, 0.0001), 9),
    "alpha054": lambda o: -1 * (o.low - o.close) * o.power(o.open, 5) / (o.replace_zero(o.low - o.high, -0.0001) * o.power(o.close, 5)),
    "alpha055": lambda o: -1 * o.correlation(o.cs_rank((o.close - o.ts_min(o.low, 12)) / o.replace_zero(o.ts_max(o.high, 12) - o.ts_min(o.low, 12), 0.0001)), o.cs_rank(o.volume), 6),
    "alpha057": lambda o: 0 - (o.close - o.vwap) / o.decay_linear(o.cs_rank(o.ts_argmax(o.close, 30)), 2),
    "alpha060": lambda o: 0 - (2 * o.scale(o.cs_rank(location(o, 0.0001) * o.volume)) - o.scale(o.cs_rank(o.ts_argmax(o.close, 10)))),
    "alpha061": lambda o: o.if_else(o.cs_rank(o.vwap - o.ts_min(o.vwap, 16)) < o.cs_rank(o.correlation(o.vwap, adv(o, 180), 18)), 1, 0),
    "alpha062": lambda o: (o.cs_rank(o.correlation(o.vwap, o.ts_mean(adv(o, 20), 22), 10)) < o.cs_rank(o.cs_rank(o.open) + o.cs_rank(o.open) < o.cs_rank(mid(o)) + o.cs_rank(o.high))) * -1,
    "alpha064": lambda o: o.if_else(o.cs_rank(o.correlation(o.ts_mean(o.open * 0.178404 + o.low * 0.821596, 13), o.ts_mean(adv(o, 120), 13), 17)) < o.cs_rank(o.delta(mid(o) * 0.178404 + o.vwap * 0.821596, 4)), -1, 0),
    "alpha065": lambda o: o.if_else(o.cs_rank(o.correlation(o.open * 0.00817205 + o.vwap * 0.99182795, o.ts_mean(adv(o, 60), 9), 6)) < o.cs_rank(o.open - o.ts_min(o.open, 14)), -1, 0),
    "alpha066": lambda o: (o.cs_rank(o.decay_linear(o.delta(o.vwap, 4), 7)) + o.ts_rank(o.decay_linear((o.low * 0.96633 + o.low * 0.03367 - o.vwap) / (o.open - mid(o)), 11), 7)) * -1,
    "alpha068": lambda o: (o.ts_rank(o.correlation(o.cs_rank(o.high), o.cs_rank(adv(o, 15)), 9), 14) < o.cs_rank(o.delta(o.close * 0.518371 + o.low * 0.481629, 2)) * 14) * -1,
    "alpha071": lambda o: o.max(o.ts_rank(o.decay_linear(o.correlation(o.ts_rank(o.close, 3), o.ts_rank(adv(o, 180), 12), 18), 4), 16), o.ts_rank(o.decay_linear(o.power(o.cs_rank(o.low + o.open - o.vwap - o.vwap), 2), 16), 4)),
    "alpha072": lambda o: o.cs_rank(o.decay_linear(o.correlation(mid(o), adv(o, 40), 9), 10)) / o.cs_rank(o.decay_linear(o.correlation(o.ts_rank(o.vwap, 4), o.ts_rank(o.volume, 19), 7), 3)),
    "alpha073": lambda o: o.max(o.cs_rank(o.decay_linear(o.delta(o.vwap, 5), 3)), o.ts_rank(o.decay_linear(-1 * o.delta(o.open * 0.147155 + o.low * 0.852845, 2) / (o.open * 0.147155 + o.low * 0.852845), 3), 17)) * -1,
    "alpha074": lambda o: o.if_else(o.cs_rank(o.correlation(o.close, o.ts_mean(adv(o, 30), 37), 15)) < o.cs_rank(o.correlation(o.cs_rank(o.high * 0.0261661 + o.vwap * 0.973839), o.cs_rank(o.volume), 11)), -1, 0),
    "alpha075": lambda o: o.if_else(o.cs_rank(o.correlation(o.vwap, o.volume, 4)) < o.cs_rank(o.correlation(o.cs_rank(o.low), o.cs_rank(adv(o, 50)), 12)), 1, 0),
    "alpha077": lambda o: o.min(o.cs_rank(o.decay_linear(mid(o) + o.high - o.vwap - o.high, 20)), o.cs_rank(o.decay_linear(o.correlation(mid(o), adv(o, 40), 3), 6))),
    "alpha078": lambda o: o.power(o.cs_rank(o.correlation(o.ts_sum(o.low * 0.352233 + o.vwap * 0.647767, 20), o.ts_sum(adv(o, 40), 20), 7)), o.cs_rank(o.correlation(o.cs_rank(o.vwap), o.cs_rank(o.volume), 6))),
    "alpha081": lambda o: o.if_else(o.cs_rank(o.log(o.ts_product(o.cs_rank(o.power(o.cs_rank(o.correlation(o.vwap, o.ts_sum(adv(o, 10), 50), 8)), 4)), 15))) < o.cs_rank(o.correlation(o.cs_rank(o.vwap), o.cs_rank(o.volume), 5)), -1, 0),
    "alpha083": lambda o: o.cs_rank(o.delay((o.high - o.low) / (o.ts_sum(o.close, 5) / 5), 2)) * o.cs_rank(o.cs_rank(o.volume)) / ((o.high - o.low) / (o.ts_sum(o.close, 5) / 5) / (o.vwap - o.close)),
    "alpha084": lambda o: o.signed_power(o.ts_rank(o.vwap - o.ts_max(o.vwap, 15), 21), o.delta(o.close, 5)),
    "alpha085": lambda o: o.power(o.cs_rank(o.correlation(o.high * 0.876703 + o.close * 0.123297, adv(o, 30), 10)), o.cs_rank(o.correlation(o.ts_rank(mid(o), 4), o.ts_rank(o.volume, 10), 7))),
    "alpha086": lambda o: (o.ts_rank(o.correlation(o.close, o.ts_mean(adv(o, 20), 15), 6), 20) < o.cs_rank((o.open + o.close) - (o.vwap + o.open)) * 20) * -1,
    "alpha088": lambda o: o.min(o.cs_rank(o.decay_linear((o.cs_rank(o.open) + o.cs_rank(o.low)) - (o.cs_rank(o.high) + o.cs_rank(o.close)), 8)), o.ts_rank(o.decay_linear(o.correlation(o.ts_rank(o.close, 8), o.ts_rank(adv(o, 60), 21), 8), 7), 3)),
    "alpha092": lambda o: o.min(o.ts_rank(o.decay_linear(o.if_else(mid(o) + o.close < o.low + o.open, 1, 0), 15), 19), o.ts_rank(o.decay_linear(o.correlation(o.cs_rank(o.low), o.cs_rank(adv(o, 30)), 8), 7), 7)),
    "alpha094": lambda o: o.power(o.cs_rank(o.vwap - o.ts_min(o.vwap, 12)), o.ts_rank(o.correlation(o.ts_rank(o.vwap, 20), o.ts_rank(adv(o, 60), 4), 18), 3)) * -1,
    "alpha095": lambda o: o.cs_rank(o.open - o.ts_min(o.open, 12)) * 12 < o.ts_rank(o.power(o.cs_rank(o.correlation(o.ts_mean(mid(o), 19), o.ts_mean(adv(o, 40), 19), 13)), 5), 12),
    "alpha096": lambda o: o.max(o.ts_rank(o.decay_linear(o.correlation(o.cs_rank(o.vwap), o.cs_rank(o.volume), 4), 4), 8), o.ts_rank(o.decay_linear(o.ts_argmax(o.correlation(o.ts_rank(o.close, 7), o.ts_rank(adv(o, 60), 4), 4), 13), 14), 13)) * -1,
    "alpha098": lambda o: o.cs_rank(o.decay_linear(o.correlation(o.vwap, o.ts_mean(adv(o, 5), 26), 5), 7)) - o.cs_rank(o.decay_linear(o.ts_rank(o.ts_argmin(o.correlation(o.cs_rank(o.open), o.cs_rank(adv(o, 15)), 21), 9), 7), 8)),
    "alpha099": lambda o: o.if_else(o.cs_rank(o.correlation(o.ts_sum(mid(o), 20), o.ts_sum(adv(o, 60), 20), 9)) < o.cs_rank(o.correlation(o.low, o.volume, 6)), -1, 0),
    "alpha101": lambda o: (o.close - o.open) / ((o.high - o.low) + 0.001),
}

VARIABLES = {
    "returns": lambda o: o.delta(o.close, 1) / o.delay(o.close, 1),
    "vwap": lambda o: o.quote_volume / o.replace_zero(o.volume),
}


def alpha101(names=None) -> FactorSet:
    """The set, or the named part of it. The panel needs OHLC, ``volume`` and ``quote_volume``."""
    library = FactorSet(dict(VARIABLES), dict(ALPHA101))
    return library if names is None else library.only(names)
