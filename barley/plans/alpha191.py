"""The published set of 191 alphas, as far as it needs only open, high, low, close and volume (128 formulas).

Exponential smoothers of the publication are plain rolling means here. ``returns`` is a variable.
"""

from __future__ import annotations

from barley.operators import FactorSet
from barley.plans.alpha101 import adv, bend, band_signal, mid


def prev(o, field, n=1):
    return o.delay(field, n)


def off_mean(o, n):
    """Close over its mean, as a share."""
    return (o.close - o.ts_mean(o.close, n)) / o.ts_mean(o.close, n)


def change(o, field, n):
    return (field - o.delay(field, n)) / o.delay(field, n)


def typical(o):
    return (o.high + o.low + o.close) / 3


def rise(o, field):
    return o.max(field - o.delay(field, 1), 0)


def strength(o, field, n):
    """Mean rise as a percentage of the mean movement."""
    return o.ts_mean(rise(o, field), n) / o.ts_mean(o.abs(field - o.delay(field, 1)), n) * 100


def accumulation(o):
    return ((o.close - o.low) - (o.high - o.close)) / (o.high - o.low)


def pressure(o):
    """Distance of the close from the previous close or the bar's far end, signed by the direction."""
    before = prev(o, o.close)
    return o.if_else(o.close.equals(before), 0, o.if_else(o.close > before, o.close - o.min(o.low, before), o.close - o.max(o.high, before)))


def signed_volume(o):
    before = prev(o, o.close)
    return o.if_else(o.close > before, o.volume, o.if_else(o.close < before, -1 * o.volume, 0))


def when_up(o, value):
    return o.if_else(o.close > prev(o, o.close), value, 0)


def when_not_up(o, value):
    return o.if_else(o.close <= prev(o, o.close), value, 0)


def widest_move(o):
    return o.max(o.abs(o.high - prev(o, o.high)), o.abs(o.low - prev(o, o.low)))


def moves_down(o, n):
    """Summed moves of the bars that did not move up."""
    return o.ts_sum(o.if_else(o.high + o.low > prev(o, o.high) + prev(o, o.low), 0, widest_move(o)), n)


def moves_up(o, n):
    return o.ts_sum(o.if_else(o.high + o.low <= prev(o, o.high) + prev(o, o.low), 0, widest_move(o)), n)


def open_up(o, n):
    before = prev(o, o.open)
    return o.ts_sum(o.if_else(o.open <= before, 0, o.max(o.high - o.open, o.open - before)), n)


def open_down(o, n):
    before = prev(o, o.open)
    return o.ts_sum(o.if_else(o.open >= before, 0, o.max(o.open - o.low, o.open - before)), n)


def open_balance(o, n):
    up, down = open_up(o, n), open_down(o, n)
    return o.if_else(up > down, (up - down) / up, o.if_else(up.equals(down), 0, (up - down) / down))


def mid_shift(o, n):
    """Mean move of the bar's middle, weighted by range over volume."""
    return o.ts_mean((mid(o) - (prev(o, o.high) + prev(o, o.low)) / 2) * (o.high - o.low) / o.volume, n)


def from_high(o, n, smooth):
    return o.ts_mean((o.ts_max(o.high, n) - o.close) / (o.ts_max(o.high, n) - o.ts_min(o.low, n)) * 100, smooth)


def from_low(o, n, smooth):
    return o.ts_mean((o.close - o.ts_min(o.low, n)) / (o.ts_max(o.high, n) - o.ts_min(o.low, n)) * 100, smooth)


def gains(o, n):
    d = o.close - prev(o, o.close)
    return o.ts_sum(o.if_else(d > 0, d, 0), n)


def losses(o, n):
    d = o.close - prev(o, o.close)
    return o.ts_sum(o.if_else(d < 0, o.abs(d), 0), n)


def true_range(o, n):
    before = prev(o, o.close)
    return o.ts_mean(o.max(o.max(o.high - o.low, o.abs(before - o.high)), o.abs(before - o.low)), n)


def thrice(o, field, n):
    return o.ts_mean(o.ts_mean(o.ts_mean(field, n), n), n)


def gap_of_means(o, field, fast, slow, smooth):
    """Difference of two means, less its own mean."""
    gap = o.ts_mean(field, fast) - o.ts_mean(field, slow)
    return gap - o.ts_mean(gap, smooth)


def lagged_gap(o, field, smooth):
    base = o.delay(o.ts_mean(field, 9), 1)
    return o.ts_mean(o.ts_mean(base, 12) - o.ts_mean(base, 26), smooth)


def up_spread(o):
    return o.ts_mean(when_up(o, o.ts_std(o.close, 20)), 20)


def down_spread(o):
    return o.ts_mean(when_not_up(o, o.ts_std(o.close, 20)), 20)


def relative_turnover(o):
    return o.abs(o.close / prev(o, o.close) - 1) / o.volume


def four_means(o):
    return o.ts_mean(o.close, 3) + o.ts_mean(o.close, 6) + o.ts_mean(o.close, 12) + o.ts_mean(o.close, 24)


def three_day_sign(o):
    c1, c2, c3 = prev(o, o.close), prev(o, o.close, 2), prev(o, o.close, 3)
    return o.sign(o.close - c1) + o.sign(c1 - c2) + o.sign(c2 - c3)


def money_flow(o, n):
    t = typical(o)
    up = o.ts_sum(o.if_else(t > prev(o, t), t * o.volume, 0), n)
    down = o.ts_sum(o.if_else(t <= prev(o, t), t * o.volume, 0), n)
    return 100 - 100 / (1 + up / down)


def since(o, place, n):
    return (n - place) / n * 100


# The published formulas, by number.
ALPHA191 = {
    "001": lambda o: -1 * o.correlation(o.cs_rank(o.delta(o.log(o.volume), 1)), o.cs_rank((o.close - o.open) / o.open), 6),
    "002": lambda o: -1 * o.delta(accumulation(o), 1),
    "003": lambda o: o.ts_sum(pressure(o), 6),
    "004": band_signal,
    "005": lambda o: -1 * o.ts_max(o.correlation(o.ts_rank(o.volume, 5), o.ts_rank(o.high, 5), 5), 3),
    "006": lambda o: -1 * o.cs_rank(o.sign(o.delta(o.open * 0.85 + o.high * 0.15, 4))),
    "009": lambda o: mid_shift(o, 7),
    "010": lambda o: o.cs_rank(o.ts_max(o.power(o.if_else(o.returns < 0, o.ts_std(o.returns, 20), o.close), 2), 5)),
    "011": lambda o: o.ts_sum(accumulation(o) * o.volume, 6),
    "014": lambda o: o.close - prev(o, o.close, 5),
    "015": lambda o: o.open / prev(o, o.close) - 1,
    "018": lambda o: o.close / prev(o, o.close, 5),
    "019": lambda o: o.if_else(o.close < prev(o, o.close, 5), change(o, o.close, 5), o.if_else(o.close.equals(prev(o, o.close, 5)), 0, (o.close - prev(o, o.close, 5)) / o.close)),
    "020": lambda o: change(o, o.close, 6) * 100,
    "022": lambda o: o.ts_mean(o.delta(off_mean(o, 6), 3), 12),
    "023": lambda o: up_spread(o) / (up_spread(o) + down_spread(o)) * 100,
    "024": lambda o: o.ts_mean(o.close - prev(o, o.close, 5), 5),
    "025": lambda o: -1 * o.cs_rank(o.delta(o.close, 7) * (1 - o.cs_rank(o.decay_linear(o.volume / adv(o, 20), 9)))) * (1 + o.cs_rank(o.ts_sum(o.returns, 250))),
    "029": lambda o: change(o, o.close, 6) * o.volume,
    "031": lambda o: off_mean(o, 12) * 100,
    "032": lambda o: -1 * o.ts_sum(o.cs_rank(o.correlation(o.cs_rank(o.high), o.cs_rank(o.volume), 3)), 3),
    "033": lambda o: (-1 * o.ts_min(o.low, 5) + o.delay(o.ts_min(o.low, 5), 5)) * o.cs_rank((o.ts_sum(o.returns, 240) - o.ts_sum(o.returns, 20)) / 220) * o.ts_rank(o.volume, 5),
    "034": lambda o: o.ts_mean(o.close, 12) / o.close,
    "035": lambda o: o.min(o.cs_rank(o.decay_linear(o.delta(o.open, 1), 15)), o.cs_rank(o.decay_linear(o.correlation(o.volume, o.open, 17), 7))) * -1,
    "037": lambda o: -1 * o.cs_rank(o.delta(o.ts_sum(o.open, 5) * o.ts_sum(o.returns, 5), 10)),
    "038": lambda o: o.if_else(o.ts_mean(o.high, 20) < o.high, -1 * o.delta(o.high, 2), 0),
    "040": lambda o: o.ts_sum(when_up(o, o.volume), 26) / o.ts_sum(when_not_up(o, o.volume), 26) * 100,
    "042": lambda o: -1 * o.cs_rank(o.ts_std(o.high, 10)) * o.correlation(o.high, o.volume, 10),
    "043": lambda o: o.ts_sum(signed_volume(o), 6),
    "046": lambda o: four_means(o) / (4 * o.close),
    "047": lambda o: from_high(o, 6, 9),
    "048": lambda o: -1 * o.cs_rank(three_day_sign(o)) * o.ts_sum(o.volume, 5) / o.ts_sum(o.volume, 20),
    "049": lambda o: moves_down(o, 12) / (moves_down(o, 12) + moves_up(o, 12)),
    "050": lambda o: (moves_up(o, 12) - moves_down(o, 12)) / (moves_up(o, 12) + moves_down(o, 12)),
    "051": lambda o: moves_up(o, 12) / (moves_up(o, 12) + moves_down(o, 12)),
    "052": lambda o: o.ts_sum(o.max(o.high - prev(o, typical(o)), 0), 26) / o.ts_sum(o.max(prev(o, typical(o)) - o.low, 0), 26) * 100,
    "053": lambda o: o.ts_sum(when_up(o, 1), 12) / 12 * 100,
    "054": lambda o: -1 * o.cs_rank(o.ts_std(o.abs(o.close - o.open), 20) + (o.close - o.open) + o.correlation(o.close, o.open, 10)),
    "056": lambda o: o.if_else(o.cs_rank(o.open - o.ts_min(o.open, 12)) < o.cs_rank(o.power(o.cs_rank(o.correlation(o.ts_sum(mid(o), 19), o.ts_sum(adv(o, 40), 19), 13)), 5)), 1, 0),
    "057": lambda o: from_low(o, 9, 3),
    "058": lambda o: o.ts_sum(when_up(o, 1), 20) / 20 * 100,
    "059": lambda o: o.ts_sum(pressure(o), 20),
    "060": lambda o: o.ts_sum(accumulation(o) * o.volume, 20),
    "062": lambda o: -1 * o.correlation(o.high, o.cs_rank(o.volume), 5),
    "063": lambda o: strength(o, o.close, 6),
    "065": lambda o: o.ts_mean(o.close, 6) / o.close,
    "066": lambda o: off_mean(o, 6) * 100,
    "067": lambda o: strength(o, o.close, 24),
    "068": lambda o: mid_shift(o, 15),
    "069": lambda o: open_balance(o, 20),
    "071": lambda o: off_mean(o, 24) * 100,
    "072": lambda o: from_high(o, 6, 15),
    "076": lambda o: o.ts_std(relative_turnover(o), 20) / o.ts_mean(relative_turnover(o), 20),
    "078": lambda o: (typical(o) - o.ts_mean(typical(o), 12)) / (0.015 * o.ts_mean(o.abs(o.close - o.ts_mean(typical(o), 12)), 12)),
    "079": lambda o: strength(o, o.close, 12),
    "080": lambda o: change(o, o.volume, 5) * 100,
    "081": lambda o: o.ts_mean(o.volume, 21),
    "082": lambda o: from_high(o, 6, 20),
    "083": lambda o: -1 * o.cs_rank(o.covariance(o.cs_rank(o.high), o.cs_rank(o.volume), 5)),
    "084": lambda o: o.ts_sum(signed_volume(o), 20),
    "085": lambda o: o.ts_rank(o.volume / adv(o, 20), 20) * o.ts_rank(-1 * o.delta(o.close, 7), 8),
    "086": lambda o: o.if_else(bend(o) > 0.25, -1, o.if_else(bend(o) < 0, 1, -1 * o.delta(o.close, 1))),
    "088": lambda o: change(o, o.close, 20) * 100,
    "089": lambda o: 2 * gap_of_means(o, o.close, 13, 27, 10),
    "091": lambda o: o.cs_rank(o.close - o.ts_max(o.close, 5)) * o.cs_rank(o.correlation(adv(o, 40), o.low, 5)) * -1,
    "093": lambda o: open_down(o, 20),
    "094": lambda o: o.ts_sum(signed_volume(o), 30),
    "096": lambda o: o.ts_mean(from_low(o, 9, 3), 3),
    "097": lambda o: o.ts_std(o.volume, 10),
    "098": lambda o: o.if_else(o.delta(o.ts_sum(o.close, 100) / 100, 100) / prev(o, o.close, 100) <= 0.05, -1 * (o.close - o.ts_min(o.close, 100)), -1 * o.delta(o.close, 3)),
    "099": lambda o: -1 * o.cs_rank(o.covariance(o.cs_rank(o.close), o.cs_rank(o.volume), 5)),
    "100": lambda o: o.ts_std(o.volume, 20),
    "102": lambda o: strength(o, o.volume, 6),
    "103": lambda o: since(o, o.ts_argmin(o.low, 20), 20),
    "104": lambda o: -1 * o.delta(o.correlation(o.high, o.volume, 5), 5) * o.cs_rank(o.ts_std(o.close, 20)),
    "105": lambda o: -1 * o.correlation(o.cs_rank(o.open), o.cs_rank(o.volume), 10),
    "106": lambda o: o.close - prev(o, o.close, 20),
    "107": lambda o: -1 * o.cs_rank(o.open - prev(o, o.high)) * o.cs_rank(o.open - prev(o, o.close)) * o.cs_rank(o.open - prev(o, o.low)),
    "109": lambda o: o.ts_mean(o.high - o.low, 10) / o.ts_mean(o.ts_mean(o.high - o.low, 10), 10),
    "110": lambda o: o.ts_sum(o.max(o.high - prev(o, o.close), 0), 20) / o.ts_sum(o.max(prev(o, o.close) - o.low, 0), 20) * 100,
    "111": lambda o: o.ts_mean(o.volume * ((o.close - o.low) - (o.high - o.close)) / (o.high - o.low), 11) - o.ts_mean(o.volume * ((o.close - o.low) - (o.high - o.close)) / (o.high - o.low), 4),
    "112": lambda o: (gains(o, 12) - losses(o, 12)) / (gains(o, 12) + losses(o, 12)) * 100,
    "113": lambda o: -1 * o.cs_rank(o.ts_sum(prev(o, o.close, 5), 20) / 20) * o.correlation(o.close, o.volume, 2) * o.cs_rank(o.correlation(o.ts_sum(o.close, 5), o.ts_sum(o.close, 20), 2)),
    "115": lambda o: o.power(o.cs_rank(o.correlation(o.high * 0.9 + o.close * 0.1, adv(o, 30), 10)), o.cs_rank(o.correlation(o.ts_rank(mid(o), 4), o.ts_rank(o.volume, 10), 7))),
    "117": lambda o: o.ts_rank(o.volume, 32) * (1 - o.ts_rank(o.close + o.high - o.low, 16)) * (1 - o.ts_rank(o.returns, 32)),
    "118": lambda o: o.ts_sum(o.high - o.open, 20) / o.ts_sum(o.open - o.low, 20) * 100,
    "122": lambda o: change(o, thrice(o, o.log(o.close), 13), 1),
    "123": lambda o: o.if_else(o.cs_rank(o.correlation(o.ts_sum(mid(o), 20), o.ts_sum(adv(o, 60), 20), 9)) < o.cs_rank(o.correlation(o.low, o.volume, 6)), -1, 0),
    "126": lambda o: (o.close + o.high + o.low) / 3,
    "127": lambda o: o.sqrt(o.ts_mean(o.power(100 * (o.close - o.ts_max(o.close, 12)) / o.ts_max(o.close, 12), 2), 12)),
    "128": lambda o: money_flow(o, 14),
    "129": lambda o: losses(o, 12),
    "133": lambda o: since(o, o.ts_argmax(o.high, 20), 20) - since(o, o.ts_argmin(o.low, 20), 20),
    "134": lambda o: change(o, o.close, 12) * o.volume,
    "135": lambda o: o.ts_mean(prev(o, o.close / prev(o, o.close, 20)), 20),
    "136": lambda o: -1 * o.cs_rank(o.delta(o.returns, 3)) * o.correlation(o.open, o.volume, 10),
    "139": lambda o: -1 * o.correlation(o.open, o.volume, 10),
    "140": lambda o: o.min(o.cs_rank(o.decay_linear(o.cs_rank(o.open) + o.cs_rank(o.low) - o.cs_rank(o.high) - o.cs_rank(o.close), 8)), o.ts_rank(o.decay_linear(o.correlation(o.ts_rank(o.close, 8), o.ts_rank(adv(o, 60), 20), 8), 7), 3)),
    "141": lambda o: o.cs_rank(o.correlation(o.cs_rank(o.high), o.cs_rank(adv(o, 15)), 9)) * -1,
    "142": lambda o: -1 * o.cs_rank(o.ts_rank(o.close, 10)) * o.cs_rank(o.delta(o.delta(o.close, 1), 1)) * o.cs_rank(o.ts_rank(o.volume / adv(o, 20), 5)),
    "145": lambda o: (adv(o, 9) - adv(o, 26)) / adv(o, 12) * 100,
    "148": lambda o: o.if_else(o.cs_rank(o.correlation(o.open, o.ts_sum(adv(o, 60), 9), 6)) < o.cs_rank(o.open - o.ts_min(o.open, 14)), -1, 0),
    "150": lambda o: (o.close + o.high + o.low) / 3 * o.volume,
    "151": lambda o: o.ts_mean(o.close - prev(o, o.close, 20), 20),
    "152": lambda o: lagged_gap(o, prev(o, o.close / prev(o, o.close, 9)), 9),
    "153": lambda o: four_means(o) / 4,
    "155": lambda o: gap_of_means(o, o.volume, 13, 27, 10),
    "157": lambda o: o.ts_min(o.ts_product(o.cs_rank(o.cs_rank(o.log(o.ts_sum(o.ts_min(o.cs_rank(o.cs_rank(-1 * o.cs_rank(o.delta(o.close - 1, 5)))), 2), 1)))), 1), 5) + o.ts_rank(o.delay(-1 * o.returns, 6), 5),
    "158": lambda o: (o.high - o.low) / o.close,
    "160": lambda o: down_spread(o),
    "161": lambda o: true_range(o, 12),
    "167": lambda o: o.ts_sum(when_up(o, o.close - prev(o, o.close)), 12),
    "168": lambda o: -1 * o.volume / adv(o, 20),
    "169": lambda o: lagged_gap(o, o.close - prev(o, o.close), 10),
    "171": lambda o: -1 * (o.low - o.close) * o.power(o.open, 5) / ((o.close - o.high) * o.power(o.close, 5)),
    "173": lambda o: 3 * o.ts_mean(o.close, 13) - 2 * o.ts_mean(o.ts_mean(o.close, 13), 13) + thrice(o, o.log(o.close), 13),
    "174": lambda o: up_spread(o),
    "175": lambda o: true_range(o, 6),
    "176": lambda o: o.correlation(o.cs_rank((o.close - o.ts_min(o.low, 12)) / (o.ts_max(o.high, 12) - o.ts_min(o.low, 12))), o.cs_rank(o.volume), 6),
    "177": lambda o: since(o, o.ts_argmax(o.high, 20), 20),
    "178": lambda o: change(o, o.close, 1) * o.volume,
    "180": lambda o: o.if_else(adv(o, 20) < o.volume, -1 * o.ts_rank(o.abs(o.delta(o.close, 7)), 60) * o.sign(o.delta(o.close, 7)), -1 * o.volume),
    "184": lambda o: o.cs_rank(o.correlation(o.delay(o.open - o.close, 1), o.close, 200)) + o.cs_rank(o.open - o.close),
    "185": lambda o: o.cs_rank(-1 * o.power(1 - o.open / o.close, 2)),
    "187": lambda o: open_up(o, 20),
    "188": lambda o: (o.high - o.low - o.ts_mean(o.high - o.low, 11)) / o.ts_mean(o.high - o.low, 11) * 100,
    "189": lambda o: o.ts_mean(o.abs(o.close - o.ts_mean(o.close, 6)), 6),
    "191": lambda o: o.correlation(adv(o, 20), o.low, 5) + mid(o) - o.close,
}


def alpha191(names=None) -> FactorSet:
    """The set, or a part of it by name (``alpha191_001`` ...)."""
    variables = {"returns": lambda o: o.delta(o.close, 1) / o.delay(o.close, 1)}
    library = FactorSet(variables, {f"alpha191_{n}": f for n, f in ALPHA191.items()})
    return library if names is None else library.only(names)
