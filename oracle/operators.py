"""One check per operator, and the factor libraries in parts."""

from __future__ import annotations

from barley.operators import FactorSet
from barley.plans.alpha101 import ALPHA101, VARIABLES, alpha101
from barley.plans.alpha158 import WINDOWS, alpha158
from barley.plans.alpha191 import ALPHA191, alpha191
from barley.plans.technical import TECHNICAL, technical

from oracle.base import add_factors


def one(formula, variables=None):
    return lambda: FactorSet(variables or {}, {"value": formula})


def change(o):
    return o.delta(o.close, 1) / o.delay(o.close, 1)


ROLLING = {
    "ts_mean": lambda o: o.ts_mean(o.close, 5),
    "ts_sum": lambda o: o.ts_sum(o.volume, 10),
    "ts_std": lambda o: o.ts_std(o.close, 10),
    "ts_min": lambda o: o.ts_min(o.low, 8),
    "ts_max": lambda o: o.ts_max(o.high, 8),
    "ts_rank": lambda o: o.ts_rank(o.close, 10),
    "ts_argmax": lambda o: o.ts_argmax(o.high, 10),
    "ts_argmin": lambda o: o.ts_argmin(o.low, 10),
    "delta": lambda o: o.delta(o.close, 3),
    "delay": lambda o: o.delay(o.close, 4),
    "correlation": lambda o: o.correlation(o.close, o.volume, 10),
    "covariance": lambda o: o.covariance(o.close, o.volume, 10),
    "decay_linear": lambda o: o.decay_linear(o.close, 6),
    "ts_product": lambda o: o.ts_product(o.close / o.delay(o.close, 1), 5),
    "ts_skew": lambda o: o.ts_skew(o.close, 12),
    "ts_slope": lambda o: o.ts_slope(o.close, 10),
    "ts_rsquare": lambda o: o.ts_rsquare(o.close, 10),
    "ts_residual": lambda o: o.ts_residual(o.close, 10),
    "ts_percentile": lambda o: o.ts_percentile(o.close, 10, 0.3),
    "ema": lambda o: o.ema(o.close, 12),
    "wq_ts_rank": lambda o: o.wq_ts_rank(o.volume, 6),
    "wq_ts_argmax": lambda o: o.wq_ts_argmax(o.close, 9),
    "wq_ts_argmin": lambda o: o.wq_ts_argmin(o.close, 9),
    "rolling_selmean_top": lambda o: o.rolling_selmean_top(o.close, o.volume, 10, 3),
    "rolling_selmean_btm": lambda o: o.rolling_selmean_btm(o.close, o.volume, 10, 3),
    "rolling_selmean_diff": lambda o: o.rolling_selmean_diff(o.close, o.volume, 10, 3),
    "ts_max_to_min": lambda o: o.ts_max_to_min(o.close, 10),
    "diff_sign": lambda o: o.diff_sign(o.close, 10),
    "ts_meanrank": lambda o: o.ts_meanrank(o.close, 20),
}

CROSS = {
    "cs_rank": lambda o: o.cs_rank(o.close),
    "cs_zscore": lambda o: o.cs_zscore(o.volume),
    "cs_scale": lambda o: o.cs_scale(o.close - o.open),
    "cs_demean": lambda o: o.cs_demean(o.close),
    "cs_max": lambda o: o.cs_max(o.high),
    "cs_min": lambda o: o.cs_min(o.low),
    "normalize": lambda o: o.normalize(o.close, True, 1.5),
    "winsorize": lambda o: o.winsorize(o.close, 1.2),
    "scale_down": lambda o: o.scale_down(o.volume, 0.5),
    "clip_quantile": lambda o: o.clip_quantile(o.close, 0.2, 0.8),
    "quantile": lambda o: o.quantile(o.close, "gaussian", 1.0),
    "quantile_cauchy": lambda o: o.quantile(o.close, "cauchy", 0.5),
    "quantile_uniform": lambda o: o.quantile(o.close, "uniform"),
    "vector_neut": lambda o: o.vector_neut(o.close, o.volume),
    "scale": lambda o: o.scale(o.close - o.open),
}

SCALAR = {
    "log": lambda o: o.log(o.close - 1000),
    "sign": lambda o: o.sign(o.close - o.open),
    "abs": lambda o: o.abs(o.close - o.open),
    "sqrt": lambda o: o.sqrt(o.close - o.open),
    "power": lambda o: o.power((o.close - o.open) / 1000, 1.5),
    "max_of_two": lambda o: o.max(o.open, o.delay(o.close, 1)),
    "min_of_two": lambda o: o.min(o.open, o.delay(o.close, 1)),
    "exp": lambda o: o.exp(o.close / 1000),
    "floor": lambda o: o.floor(o.close),
    "ceil": lambda o: o.ceil(o.close),
    "round_half_even": lambda o: o.round(o.volume / 2, 0),
    "signed_power": lambda o: o.signed_power((o.close - o.open) / 1000, 0.5),
    "if_else": lambda o: o.if_else(o.close > o.open, o.high, o.low),
    "is_nan": lambda o: o.is_nan(o.close),
    "fill_nan": lambda o: o.fill_nan(o.close, -1),
    "replace_zero": lambda o: o.replace_zero(o.close - o.open, 0.0001),
    "arithmetic": lambda o: -(o.close * 2 - o.open + 1),
    "safe_division": lambda o: o.volume / (o.close - o.open),
    "comparisons": lambda o: (o.close > o.open) + 2 * (o.close < o.open) + 4 * (o.close >= o.low) + 8 * (o.close <= o.high) + 16 * o.close.equals(o.open) + 32 * o.close.differs(o.open),
    "logic": lambda o: ((o.close > o.open) & o.delay(o.close, 1)) + 2 * ((o.close > o.open) | (o.volume > 50)) + 4 * ~(o.close - o.open),
}

for _name, _formula in {**ROLLING, **CROSS}.items():
    add_factors(_name, one(_formula))
for _name, _formula in SCALAR.items():
    add_factors(_name, one(_formula))

add_factors("named_variables", lambda: FactorSet(
    {"returns": VARIABLES["returns"], "calm": lambda o: o.ts_std(o.returns, 5) < 0.2},
    {"signal": lambda o: o.if_else(o.calm, o.cs_rank(o.returns), 0), "smooth": lambda o: o.ts_mean(o.signal, 3)}))


def _parts(names, size):
    names = list(names)
    return [names[i:i + size] for i in range(0, len(names), size)]


# these two rank differences of logarithms of whole-number volumes: full of ties that only rounding noise of the
# logarithm breaks. Their check takes the money volume instead, which has none.
TIED = {"alpha002": alpha101, "alpha191_001": alpha191}
add_factors("alpha_log_volume", lambda: FactorSet({"volume": lambda o: o.quote_volume + 0}, {
    n: library([n]).factors[n] for n, library in TIED.items()}))
for _i, _part in enumerate(_parts([n for n in ALPHA101 if n not in TIED], 14)):
    add_factors(f"alpha101_part{_i + 1}", lambda p=_part: alpha101(p))
for _n in WINDOWS:
    add_factors(f"alpha158_window{_n}", lambda n=_n: alpha158((n,), shapes=False))
add_factors("alpha158_shapes", lambda: alpha158((), shapes=True))
for _i, _part in enumerate(_parts([n for n in ALPHA191 if f"alpha191_{n}" not in TIED], 22)):
    add_factors(f"alpha191_part{_i + 1}", lambda p=_part: alpha191([f"alpha191_{n}" for n in p]))
add_factors("technical", technical)
