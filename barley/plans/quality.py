"""Signal quality of factors.

Tables: ``values(ts, instrument_id, factor, value)``, ``returns(ts, instrument_id, horizon, fwd_ret)``,
``pairs`` = both joined, ``ic(ts, factor, horizon, ic)``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barley.functions.numeric import ratio
from barley.functions.stats import correlate, p_value
from barley.operators.chunks import seconds, with_previous, with_running
from barley.operators.cross import cs_rank_average
from barley.operators.recursive import ema_columns
from barley.operators.spec import BAR, ID, TS, Slice

SERIES = ["factor", "horizon"]


def shifted(panel: DataFrame, fields: list[str], steps: list[int], name: str = "step") -> DataFrame:
    """Long table of ``fields`` of the bar ``step`` bars later, keyed by the earlier bar."""
    moved = panel.select(ID, BAR, *fields, F.explode(F.array(*map(F.lit, steps))).alias(name))
    return moved.select(ID, (F.col(BAR) - F.col(name)).alias(BAR), name, *[F.col(f).alias(f"{f}_later") for f in fields])


def forward_returns(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """Return over the next ``horizon`` bars, seen from each bar."""
    later = shifted(panel, ["close"], horizons, "horizon")
    both = panel.select(ID, TS, BAR, "close").join(later, [ID, BAR])
    value = ratio(F.col("close_later"), F.col("close")) - 1
    return both.select(TS, ID, "horizon", value.alias("fwd_ret")).where("fwd_ret IS NOT NULL")


def pair(values: DataFrame, returns: DataFrame) -> DataFrame:
    return values.join(returns, [TS, ID])


def drop_outliers(pairs: DataFrame, z: float = 20.0, max_loss: float = 0.35, expected: DataFrame | None = None) -> DataFrame:
    """Leave out returns more than ``z`` deviations from their horizon's mean. ``loss`` is the share left out, and
    ``lost_too_much`` marks horizons where it is over the limit. Rows that the join with returns lost count where ``expected(factor, n)`` gives the
    number of values each factor had."""
    stats = pairs.groupBy(*SERIES).agg(F.avg("fwd_ret").alias("m"), F.stddev_samp("fwd_ret").alias("s"), F.count("fwd_ret").alias("n"))
    kept = pairs.join(stats, SERIES).where(F.abs(F.col("fwd_ret") - F.col("m")) <= F.lit(z) * F.col("s"))
    left = kept.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_kept"), F.first("n").alias("_of"))
    if expected is not None:
        left = left.join(expected.select("factor", F.col("n").alias("_all")), "factor").withColumn("_of", F.col("_all"))
    left = left.select(*SERIES, (1 - F.col("_kept") / F.col("_of")).alias("loss"))
    return (kept.drop("m", "s", "n").join(left, SERIES).withColumn("lost_too_much", F.col("loss") > max_loss))


def _fused(a: Column, x: Column, c: Column) -> Column:
    """``a * x + c`` rounded once: the product and the sum keep what their own rounding takes away."""
    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    p, (ah, al), (xh, xl) = a * x, halves(a), halves(x)
    lost = ((ah * xh - p) + ah * xl + al * xh) + al * xl
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p))
    return F.when((F.abs(a) < 1e290) & (F.abs(c) < 1e290), s + (lost + rest)).otherwise(s)


def with_buckets(pairs: DataFrame, buckets: int = 5, by: tuple[str, ...] = (TS, "factor", "horizon")) -> DataFrame:
    """Quantile bucket per time: one more than the number of linear percentile edges below the value.

    An edge between two values is their weighted mean, rounded once, so that it falls the same way between neighbouring doubles in every engine that fuses
    product and sum. The rows are dealt by time once; no list of values is kept in memory.
    """
    group = Window.partitionBy(*by)
    value, n = F.col("value"), F.col("_n")
    placed = pairs.withColumn("_n", F.count("value").over(group)).withColumn("_place", F.row_number().over(group.orderBy(value.asc_nulls_last())) - 1)
    places = {i: (n - 1) * F.lit(i / buckets) for i in range(1, buckets)}
    ends = {f"_{side}{i}": F.max(F.when(F.col("_place") == cut(p), value)).over(group) for i, p in places.items() for side, cut in (("lo", F.floor), ("hi", F.ceil))}
    edged = placed.withColumns(ends)
    below = F.lit(0)
    for i, p in places.items():
        lo, hi, d = F.col(f"_lo{i}"), F.col(f"_hi{i}"), p - F.floor(p)
        edge = F.when(lo == hi, lo).otherwise(_fused(lo, 1.0 - d, hi * d))
        below = below + F.coalesce((edge < value).cast("int"), F.lit(0))
    return edged.withColumn("bucket", below + 1).drop("_n", "_place", *ends)


def information(values: DataFrame, returns: DataFrame, min_assets: int = 5, common: bool = True) -> DataFrame:
    """Rank correlation of value and later return per time, factor and horizon.

    ``common``: rank among the instruments that have both; else each side among all it has.
    """
    if common:
        both = pair(values, returns).where("value IS NOT NULL AND fwd_ret IS NOT NULL")
        place = Slice((TS, *SERIES))
        ranked = both.withColumns({"a": cs_rank_average(F.col("value"), on=place), "b": cs_rank_average(F.col("fwd_ret"), on=place)})
    else:
        a = values.withColumn("a", cs_rank_average(F.col("value"), on=Slice((TS, "factor"))))
        b = returns.withColumn("b", cs_rank_average(F.col("fwd_ret"), on=Slice((TS, "horizon"))))
        ranked = pair(a, b)
    ic = ranked.groupBy(TS, *SERIES).agg(correlate(F.col("a"), F.col("b")).alias("ic"), F.count(F.lit(1)).alias("n"))
    return ic.withColumn("ic", F.when(F.col("n") >= min_assets, F.col("ic"))).drop("n")


def summary(ic: DataFrame) -> DataFrame:
    n = F.count("ic")
    spread = F.stddev_samp("ic")
    return ic.groupBy(*SERIES).agg(
        F.avg("ic").alias("mean"), spread.alias("std"), ratio(F.avg("ic"), spread).alias("icir"),
        ratio(F.avg("ic") * F.sqrt(n), spread).alias("t"), F.skewness("ic").alias("skew"), F.kurtosis("ic").alias("kurt"),
        n.alias("n"), F.count_if(F.col("ic").isNull()).alias("missing"))


def with_p(table: DataFrame, t: str = "t", df: Column | None = None) -> DataFrame:
    """Two-sided p-value of a t column of a metrics table."""
    return table.withColumn("p", p_value(F.col(t), (F.col("n") - 1 if df is None else df).cast("double")))


def bars_per_day(times: DataFrame, by: list[str]) -> DataFrame:
    """From the median step between times, at least 1."""
    step = with_previous(times, [TS], [TS], key=by)
    gap = seconds() - seconds(F.col("previous")[TS])
    median = step.where("previous IS NOT NULL").groupBy(*by).agg(F.median(gap).alias("_step"))
    return median.select(*by, F.greatest(F.lit(1), F.floor(F.lit(86400.0) / F.col("_step"))).cast("int").alias("per_day"))


def _indexed(ic: DataFrame) -> DataFrame:
    line = Window.partitionBy(*SERIES).orderBy(TS)
    return ic.where("ic IS NOT NULL").withColumn("i", F.row_number().over(line))


def _lag_products(series: DataFrame, lags: DataFrame, value: str = "ic") -> DataFrame:
    """Pairs of values ``lag`` steps apart, for the lags of each series."""
    a = series.join(lags, SERIES).select(*SERIES, F.explode(F.sequence(F.lit(1), F.col("lags"))).alias("lag"), "i", F.col(value).alias("x"))
    b = series.select(*SERIES, (F.col("i") + 0).alias("j"), F.col(value).alias("y"))
    return a.withColumn("j", F.col("i") + F.col("lag")).join(b, [*SERIES, "j"])


def newey_west(ic: DataFrame) -> DataFrame:
    """t of the mean under autocorrelation (Bartlett weights), the effective number of observations, and the two-sided p with one degree of freedom
    less than these (one at least)."""
    clean = _indexed(ic)
    stats = clean.groupBy(*SERIES).agg(F.avg("ic").alias("m"), F.var_pop("ic").alias("g0"), F.count(F.lit(1)).alias("n"))
    base = F.greatest(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), F.lit(1))
    limits = stats.join(bars_per_day(clean.select(*SERIES, TS), SERIES), SERIES).withColumn(
        "lags", F.least(F.greatest(base, F.col("per_day") * 10), F.floor(F.col("n") / 3)).cast("int"))
    some = limits.where("lags >= 1")
    centred = clean.join(stats, SERIES).withColumn("e", F.col("ic") - F.col("m"))
    products = _lag_products(centred, some.select(*SERIES, "lags"), "e")
    gammas = products.groupBy(*SERIES, "lag").agg(F.avg(F.col("x") * F.col("y")).alias("g"))
    weighted = gammas.join(some.select(*SERIES, "lags"), SERIES).groupBy(*SERIES).agg(
        F.sum(2 * (1 - F.col("lag") / (F.col("lags") + 1)) * F.col("g")).alias("w"))
    out = limits.join(weighted, SERIES, "left").withColumn("v", F.col("g0") + F.coalesce("w", F.lit(0.0)))
    se = F.when(F.col("v") > 0, F.sqrt(F.col("v") / F.col("n")))
    eff = F.least(F.greatest(F.bround(ratio(F.col("n") * F.col("g0"), F.col("v"))), F.lit(1.0)), F.col("n")).cast("bigint")
    out = out.select(*SERIES, F.when(se >= 1e-15, F.col("m") / se).alias("nw_t"),
                     F.when(se >= 1e-15, F.when(F.col("v") > 1e-15, eff).otherwise(F.col("n"))).alias("n_eff"), "lags")
    return out.withColumn("nw_p", p_value(F.col("nw_t"), F.greatest(F.col("n_eff") - 1, F.lit(1)).cast("double")))


def win_rate(ic: DataFrame) -> DataFrame:
    return ic.groupBy(*SERIES).agg(F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"))


def coverage(pairs: DataFrame, panel: DataFrame) -> DataFrame:
    cells = panel.agg(F.count_distinct(TS) * F.count_distinct(ID)).scalar()
    return pairs.groupBy(*SERIES).agg((F.count(F.lit(1)) / cells).alias("coverage"))


def linearity(ic: DataFrame) -> DataFrame:
    """R2 of the line through the cumulated IC."""
    run = with_running(_indexed(ic), {"cum": F.col("ic")}, [TS], SERIES, seconds())
    return run.groupBy(*SERIES).agg(
        F.when((F.count(F.lit(1)) >= 3) & (F.var_pop("cum") * F.count(F.lit(1)) > 1e-15), F.regr_r2("cum", "i")).alias("linearity"))


def ar1(ic: DataFrame) -> DataFrame:
    prior = with_previous(ic.where("ic IS NOT NULL"), ["ic"], [TS], key=SERIES)
    return prior.groupBy(*SERIES).agg(
        F.when(F.count(F.lit(1)) >= 3, correlate(F.col("ic"), F.col("previous")["ic"])).alias("ar1"))


def autocorrelation(ic: DataFrame) -> DataFrame:
    """``(factor, horizon, lag, acf)`` for lags 1 .. min(n / 4, 100)."""
    clean = _indexed(ic)
    lags = clean.groupBy(*SERIES).agg(F.least(F.floor(F.count(F.lit(1)) / 4), F.lit(100)).cast("int").alias("lags"), F.count(F.lit(1)).alias("n"))
    products = _lag_products(clean, lags.where("n >= 20").select(*SERIES, "lags"))
    return products.groupBy(*SERIES, "lag").agg(correlate(F.col("x"), F.col("y")).alias("acf"))


def _decay_time(lag, acf, longest: float) -> float:
    """Least squares of ``a * exp(-lag / tau)`` with 0 <= a <= 2 and 0.1 <= tau <= longest, by a refined grid over tau."""
    import numpy as np
    low, high = math.log(0.1), math.log(max(longest, 0.2))
    best = None
    for _ in range(12):
        grid = np.linspace(low, high, 60)
        basis = np.exp(-lag[None, :] / np.exp(grid)[:, None])
        norm = np.maximum((basis ** 2).sum(axis=1), 1e-300)
        a = np.clip((basis * acf).sum(axis=1) / norm, 0.0, 2.0)
        error = ((acf - a[:, None] * basis) ** 2).sum(axis=1)
        at = int(error.argmin())
        best = math.exp(grid[at])
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, 59)]
    return best


def half_life(ic: DataFrame) -> DataFrame:
    """Half life of the IC's autocorrelation in bars. Only the small table of autocorrelations is fitted."""
    acf = autocorrelation(ic)
    types = dict(acf.dtypes)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("lag")
        longest = float(group["lag"].max()) * 5
        group = group.dropna(subset=["acf"])
        key = {c: [group[c].iloc[0]] for c in SERIES} if len(group) else None
        if key is None:
            return pd.DataFrame({"factor": [], "horizon": [], "half_life": []})
        value = float("nan")
        if len(group) >= 3 and group["acf"].iloc[0] > 0:
            value = _decay_time(group["lag"].to_numpy(float), group["acf"].to_numpy(float), longest) * math.log(2)
        return pd.DataFrame({**key, "half_life": [value]})

    return acf.groupBy(*SERIES).applyInPandas(fit, f"factor {types['factor']}, horizon {types['horizon']}, half_life double")


def bucket_returns(bucketed: DataFrame, by_time: bool = False) -> DataFrame:
    """Mean return per bucket with its standard error, pooled or by time."""
    keys = [*SERIES, "bucket"] + ([TS] if by_time else [])
    return bucketed.groupBy(*keys).agg(F.avg("fwd_ret").alias("mean_ret"),
                                       ratio(F.stddev_samp("fwd_ret"), F.sqrt(F.count("fwd_ret"))).alias("std_err"))


def monotonicity(bucketed: DataFrame) -> DataFrame:
    """Rank correlation of bucket number and mean return."""
    means = bucket_returns(bucketed)
    ranked = means.withColumns({"a": cs_rank_average(F.col("bucket"), on=Slice(tuple(SERIES))),
                                "b": cs_rank_average(F.col("mean_ret"), on=Slice(tuple(SERIES)))})
    return ranked.groupBy(*SERIES).agg(F.when(F.count(F.lit(1)) >= 3, correlate(F.col("a"), F.col("b"))).alias("monotonicity"))


def cumulative_by_bucket(bucketed: DataFrame) -> DataFrame:
    means = bucket_returns(bucketed, by_time=True)
    run = with_running(means, {"log_sum": F.ln(1 + F.col("mean_ret"))}, [TS], [*SERIES, "bucket"], seconds())
    return run.select(*SERIES, "bucket", TS, (F.exp("log_sum") - 1).alias("cum_ret"))


def spread(bucketed: DataFrame, buckets: int = 5) -> DataFrame:
    """Top bucket less bottom bucket by time."""
    def mean(q: int) -> Column:
        return F.avg(F.when(F.col("bucket") == q, F.col("fwd_ret")))
    return bucketed.groupBy(*SERIES, TS).agg((mean(buckets) - mean(1)).alias("spread"))


def bucket_turnover(bucketed: DataFrame, axis: DataFrame) -> DataFrame:
    """Share of a bucket's members that were not in it one time earlier."""
    now = bucketed.select(*SERIES, TS, ID, "bucket").join(axis, TS)
    before = now.select(*SERIES, ID, "bucket", (F.col(BAR) + 1).alias(BAR), F.lit(1).alias("was"))
    both = now.join(before, [*SERIES, ID, "bucket", BAR], "left")
    share = both.groupBy(*SERIES, "bucket", TS, BAR).agg((1 - F.count("was") / F.count(F.lit(1))).alias("turnover"))
    first = F.col(BAR) > axis.agg(F.min(BAR)).scalar()
    return share.where(first).drop(BAR)


def rank_autocorrelation(values: DataFrame, axis: DataFrame) -> DataFrame:
    """Correlation of a factor's ranks with the ranks one time earlier."""
    ranked = values.withColumn("a", cs_rank_average(F.col("value"), on=Slice((TS, "factor")))).join(axis, TS)
    before = ranked.select("factor", ID, F.col("a").alias("b"), (F.col(BAR) + 1).alias(BAR))
    return ranked.join(before, ["factor", ID, BAR]).groupBy("factor", TS).agg(correlate(F.col("a"), F.col("b")).alias("rank_acf"))


def monthly(ic: DataFrame) -> DataFrame:
    return ic.groupBy(*SERIES, F.date_trunc("month", TS).cast(dict(ic.dtypes)[TS]).alias("month")).agg(F.avg("ic").alias("ic"))


def long_short(pairs: DataFrame) -> DataFrame:
    """Return of the demeaned factor, weights of size one, and its compounded sum."""
    c = Slice((TS, *SERIES)).all()
    off = F.col("value") - F.avg("value").over(c)
    weighted = pairs.withColumn("off", off).groupBy(*SERIES, TS).agg(
        ratio(F.sum(F.col("off") * F.col("fwd_ret")), F.sum(F.abs("off"))).alias("ret"))
    # a running product of factors of either sign: logarithms of sizes, number of sign changes, zeros
    grow = 1 + F.col("ret")
    run = with_running(weighted, {
        "size": F.coalesce(F.ln(F.abs(grow)), F.lit(0.0)), "flips": F.coalesce((grow < 0).cast("int"), F.lit(0)),
        "zeros": F.coalesce((grow == 0).cast("int"), F.lit(0))}, [TS], SERIES, seconds())
    product = F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp("size") * F.when(F.col("flips") % 2 == 1, -1.0).otherwise(1.0))
    return run.select(*SERIES, TS, "ret", (product - 1).alias("cum_ret"))


def alpha_beta(pairs: DataFrame) -> DataFrame:
    """Line of the long-short return on the mean return of all instruments."""
    universe = pairs.groupBy(*SERIES, TS).agg(F.avg("fwd_ret").alias("market"))
    both = long_short(pairs).join(universe, [*SERIES, TS])
    return both.groupBy(*SERIES).agg(F.regr_intercept("ret", "market").alias("alpha"), F.regr_slope("ret", "market").alias("beta"))


def event_study(bucketed: DataFrame, panel: DataFrame, before: int, after: int) -> DataFrame:
    """Mean price path around the time a value was seen, relative to that time, by bucket."""
    offsets = list(range(-before, after + 1))
    paths = panel.select(ID, BAR, "close").join(shifted(panel, ["close"], offsets, "offset"), [ID, BAR])
    paths = paths.withColumn("path", ratio(F.col("close_later"), F.col("close")) - 1)
    seen = bucketed.select("factor", TS, ID, "bucket").distinct().join(panel.select(ID, TS, BAR), [ID, TS])
    return seen.join(paths, [ID, BAR]).groupBy("factor", "bucket", "offset").agg(F.avg("path").alias("path"))


def bucket_statistics(bucketed: DataFrame) -> DataFrame:
    stats = bucketed.groupBy(*SERIES, "bucket").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.count("value").alias("count"))
    return stats.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*SERIES)))


def histogram(table: DataFrame, column: str, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    place = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")
    return table.where(F.col(column).isNotNull()).groupBy(*by, place).agg(F.count(F.lit(1)).alias("count"))


def qq_points(ic: DataFrame, points: int = 9) -> DataFrame:
    """Sample quantiles against normal ones."""
    from barley.functions import normal_inverse
    shares = [i / (points + 1) for i in range(1, points + 1)]
    q = ic.groupBy(*SERIES).agg(F.percentile("ic", F.array(*map(F.lit, shares))).alias("q"))
    rows = q.select(*SERIES, F.posexplode("q").alias("k", "sample"))
    return rows.select(*SERIES, (F.col("k") + 1).alias("k"), "sample", normal_inverse((F.col("k") + 1) / (points + 1.0)).alias("normal"))


def metrics(values: DataFrame, returns: DataFrame, panel: DataFrame, buckets: int = 5) -> DataFrame:
    """One row per factor and horizon: IC summary, significance with and without autocorrelation, win rate, linearity, persistence, half life,
    monotonicity, coverage."""
    pairs = pair(values, returns)
    ic = information(values, returns)
    out = with_p(summary(ic))
    for part in (newey_west(ic), win_rate(ic), linearity(ic), ar1(ic), half_life(ic), monotonicity(with_buckets(pairs, buckets)), coverage(pairs, panel)):
        out = out.join(part, SERIES, "left")
    return out


def registry_rows(table: DataFrame, run_id: str, created) -> DataFrame:
    """Rows of ``metrics`` under the names that the registry's filters and scores read."""
    return table.withColumnsRenamed({"factor": "factor_id", "mean": "ic_mean", "std": "ic_std", "nw_t": "t_nw", "nw_p": "p_nw"}).withColumn(
        "period", F.col("horizon").cast("string")).drop("horizon").withColumns({"run_id": F.lit(run_id), "created": F.lit(created)})


# ---- regimes
def ic_by_regime(ic: DataFrame, labels: DataFrame) -> DataFrame:
    split = ic.join(labels, TS).groupBy(*SERIES, "label").agg(
        F.avg("ic").alias("mean"), ratio(F.avg("ic"), F.stddev_pop("ic")).alias("icir"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("win_rate"), F.count("ic").alias("n"))
    gap = Window.partitionBy(*SERIES)
    return split.withColumn("spread", F.max("icir").over(gap) - F.min("icir").over(gap))


def regime_weights(by_regime: DataFrame, floor: float = 0.0, signed: bool = False) -> DataFrame:
    """Weights within a regime: in proportion to ``max(icir, floor)``; or, signed, to ``max(abs(icir), floor)`` with the ratio's sign (a missing
    ratio counts as 0, zero as positive; equal weights where all sizes are 0)."""
    known = F.coalesce("icir", F.lit(0.0))
    raw = F.greatest(F.abs(known), F.lit(floor)) if signed else F.greatest(F.col("icir"), F.lit(floor))
    group = Window.partitionBy("horizon", "label")
    total = F.sum(F.abs("_raw")).over(group)
    weight = ratio(F.col("_raw"), total)
    if signed:
        weight = F.when(total == 0, 1 / F.count(F.lit(1)).over(group)).otherwise(F.when(known >= 0, weight).otherwise(-weight))
    return by_regime.withColumn("_raw", raw).select(*SERIES, "label", weight.alias("weight"))


def market_regime(panel: DataFrame, span: int) -> DataFrame:
    """Bull or bear by the sign of the bias-corrected exponential mean of the market return."""
    prior = with_previous(panel, ["close"], [BAR], position=F.col(BAR), width=4096)
    ret = ratio(F.col("close"), F.col("previous")["close"]) - 1
    market = prior.withColumn("ret", ret).groupBy(TS, BAR).agg(F.avg("ret").alias("x")).where("x IS NOT NULL")
    # an adjusted average is the ratio of two plain ones, of the values and of ones, both started at zero
    line = market.select(F.lit("market").alias(ID), TS, BAR, "x", F.lit(1.0).alias("one"))
    start = line.agg(F.min(BAR) - 1).scalar()
    head = line.limit(1).select(ID, F.lit(None).cast(dict(line.dtypes)[TS]).alias(TS), start.alias(BAR), F.lit(0.0).alias("x"), F.lit(0.0).alias("one"))
    smooth = ema_columns(head.unionByName(line), {"sx": ("x", span), "s1": ("one", span)})
    level = ratio(F.col("sx"), F.col("s1"))
    return smooth.where(F.col(TS).isNotNull()).select(TS, level.alias("level"), F.when(level > 0, "bull").otherwise("bear").alias("label"))


def change_points(labels: DataFrame) -> DataFrame:
    step = with_previous(labels.withColumn("_all", F.lit(1)), ["label"], [TS], key=["_all"])
    return step.where(F.col("label") != F.col("previous")["label"]).select(TS, F.col("previous")["label"].alias("before"), "label")


def regime_statistics(market: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean, volatility, count and share of the market return per state, and the number of switches."""
    both = market.join(labels, TS)
    switches = change_points(labels).groupBy("label").agg(F.count(F.lit(1)).alias("entries"))
    stats = both.groupBy("label").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), F.count(F.lit(1)).alias("count"))
    total = labels.agg(F.count(F.lit(1))).scalar()
    return stats.withColumn("share", F.col("count") / total).join(switches, "label", "left").fillna(0, ["entries"])


def compare_regimes(ic: DataFrame, first: DataFrame, second: DataFrame, floor: float = 0.0) -> DataFrame:
    """IC tables and weights under two labelings, one below the other."""
    out = None
    for name, labels in (("first", first), ("second", second)):
        table = ic_by_regime(ic, labels)
        part = table.join(regime_weights(table, floor), [*SERIES, "label"]).withColumn("labeling", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def regime_features(o, other=None, spans=(7, 14, 21), down=(30, 126), sortino=(30, 60, 126)) -> dict:
    """Board terms of a market's state: smoothed log return, downside deviation, Sortino ratio, RSI, correlation of return and volume, and,
    with the close of an ``other`` instrument as a term, the smoothed spread of returns.

    Smoothing is bias-corrected: the plain averages of the values and of ones where there is a value, both started at zero (the first bar
    has no return).
    """
    def smooth(x, n):
        return o.ema(o.fill_nan(x, 0), n) / o.ema(1 - o.is_nan(x), n)

    log_ret = o.log(o.close / o.delay(o.close, 1))
    ret = o.close / o.delay(o.close, 1) - 1
    deviation = {n: o.sqrt(o.ts_mean(o.power(o.min(log_ret, 0), 2), n)) for n in {*down, *sortino}}
    out = {f"ema_ret_{n}": smooth(log_ret, n) for n in spans}
    out |= {f"downside_{n}": deviation[n] for n in down}
    out |= {f"sortino_{n}": o.ts_mean(log_ret, n) / deviation[n] for n in sortino}
    step = o.delta(o.close, 1)
    out["rsi"] = 100 - 100 / (1 + o.ts_mean(o.max(step, 0), 14) / o.ts_mean(o.max(-step, 0), 14))
    out["volume_corr"] = o.correlation(ret, o.volume, 20)
    if other is not None:
        out["pair_spread"] = smooth(ret - (other / o.delay(other, 1) - 1), 14)
    return out


# ---- monitoring
def realised_ic(values: DataFrame, panel: DataFrame, axis: DataFrame, min_assets: int = 3) -> DataFrame:
    """IC of the factors of the bar before with the return of the latest bar, at each bar."""
    returns = forward_returns(panel, [1])
    ic = information(values, returns, min_assets)
    later = axis.select(F.col(TS).alias("_ts"), F.col(BAR))
    moved = ic.join(axis, TS).withColumn(BAR, F.col(BAR) + 1).drop(TS).join(later, BAR)
    return moved.select(F.col("_ts").alias(TS), "factor", "ic")


def health(cells: DataFrame, axis: DataFrame) -> DataFrame:
    """Per time and factor: missing or infinite cells, dispersion and kurtosis (population form), values equal to the bar before, and turnover of
    ranks among the names finite at both bars (0 below three of them, null without any or at the first bar).

    ``cells`` holds every instrument, missing values as null.
    """
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    now = cells.join(axis, TS).select(TS, "factor", ID, BAR, finite.alias("now"))
    before = now.select("factor", ID, (F.col(BAR) + 1).alias(BAR), F.col("now").alias("was"))
    both = now.join(before, ["factor", ID, BAR], "left").withColumn("common", F.col("now").isNotNull() & F.col("was").isNotNull())
    group = Slice((TS, "factor", "common"))
    ranked = both.withColumns({n: F.when(F.col("common"), cs_rank_average(F.when(F.col("common"), F.col(c)), on=group)) for n, c in (("a", "now"), ("b", "was"))})
    names, wide = F.count("now"), F.stddev_pop("now")
    shared = F.count_if("common")
    return ranked.groupBy(TS, "factor").agg(
        F.count_if(F.col("now").isNull()).alias("anomalies"), (F.count_if(F.col("now").isNull()) / F.count(F.lit(1))).alias("anomaly_rate"),
        F.when(names >= 2, wide).otherwise(0.0).alias("dispersion"), F.when((names >= 2) & (wide > 1e-12), F.kurtosis("now")).otherwise(0.0).alias("kurt"),
        names.alias("names"), F.when(F.max(BAR) > 0, F.count_if(F.col("common") & (F.col("now") == F.col("was"))).cast("double")).alias("stuck"),
        F.when(shared >= 3, F.coalesce(1 - correlate(F.col("a"), F.col("b")), F.lit(0.0))).when(shared > 0, 0.0).alias("turnover"))


def composite_spread(scores: DataFrame, returns: DataFrame, share: float = 0.2, min_names: int = 20) -> DataFrame:
    """Mean return of the top names less the bottom names of a score, per time."""
    both = scores.join(returns, [TS, ID]).where("score IS NOT NULL AND fwd_ret IS NOT NULL")
    w = Slice((TS, "horizon"))
    place = both.withColumns({
        "n": F.count(F.lit(1)).over(w.all()), "low": F.row_number().over(w.by("score", ID)),
        "high": F.row_number().over(w.by(F.desc("score"), F.desc(ID)))})
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return place.where(F.col("n") >= min_names).groupBy(TS, "horizon").agg(
        (F.avg(F.when(F.col("high") <= k, F.col("fwd_ret"))) - F.avg(F.when(F.col("low") <= k, F.col("fwd_ret")))).alias("spread"))


def weighted_score(wide: DataFrame, weights: dict[str, float] | DataFrame, factors: list[str]) -> DataFrame:
    """Sum of weights times factors standardised by the sample deviation. ``weights`` is fixed, and then a name needs all factors; or it is a table
    ``(ts, factor, weight)``, and the factors a name has are summed."""
    long = wide.unpivot([TS, ID], factors, "factor", "value").where("value IS NOT NULL")
    c = Slice((TS, "factor")).all()
    z = long.withColumn("z", ratio(F.col("value") - F.avg("value").over(c), F.stddev_samp("value").over(c)))
    if isinstance(weights, dict):
        table = F.create_map(*[x for n, v in weights.items() for x in (F.lit(n), F.lit(float(v)))])
        z = z.withColumn("weight", table[F.col("factor")])
    else:
        z = z.join(weights, [TS, "factor"])
    part = F.col("z") * F.col("weight")
    score = F.sum(part)
    if isinstance(weights, dict):
        score = F.when(F.count(part) == len(weights), score)
    return z.groupBy(TS, ID).agg(score.alias("score"))
