"""From factor values to target weights, and monitoring tables of portfolios.

Long tables: ``scores(ts, instrument_id, score)``, ``weights(ts, instrument_id, weight)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barley.functions.numeric import ratio
from barley.operators.chunks import SPAN, seconds, with_last_known, with_previous, with_running
from barley.operators.joins import active_at, as_of, with_label
from barley.operators.spec import ID, TS, Slice

C = Slice((TS,))
#: bars of a stretch of a state machine
STRETCH = 256


def _placed(scores: DataFrame) -> DataFrame:
    """Place from the bottom, from 1, and the number of names, ordered by (score, id). Names without a score stay, without place."""
    known = F.col("score").isNotNull()
    line = Window.partitionBy(TS, known)
    return scores.withColumns({
        "place": F.when(known, F.row_number().over(line.orderBy("score", ID))), "names": F.count("score").over(C.all())})


def _state(df: DataFrame, out: dict[str, Column]) -> DataFrame:
    return with_last_known(df.withColumns(out), list(out), [TS], [ID], seconds())


def sticky_selection(scores: DataFrame, n_long: int, n_short: int) -> DataFrame:
    """Top and bottom names at equal weight, ``scores`` dense. A holding stays until it is selected for the other side; one without a
    score stays too. A name in both lists of a small universe is held on both sides, as two rows."""
    top = F.col("place") > F.col("names") - n_long
    bottom = F.col("place") <= n_short
    held = _state(_placed(scores), {"long": F.when(top, n_long > 0).when(bottom, False), "short": F.when(bottom, n_short > 0).when(top, False)})
    sides = F.filter(F.array(F.when(F.col("long"), 1), F.when(F.col("short"), -1)), lambda x: x.isNotNull())
    rows = held.select(TS, ID, F.explode(sides).alias("side"))
    return rows.select(TS, ID, (F.col("side") / F.count(F.lit(1)).over(C.all())).alias("weight"))


def buffered_selection(scores: DataFrame, n: int, buffer: float, every: int, axis: DataFrame) -> DataFrame:
    """Lowest ``n`` long, highest ``n`` short, every ``every`` bars. A long closes above the buffer rank, a short below it; ranks count from 0.
    A held name without a score stays. ``scores`` is dense."""
    at = _placed(scores).join(axis.where(F.col("bar") % every == 0), TS)
    mid, rank = F.floor(F.col("names") * buffer), F.col("place") - 1
    at = _state(at, {"long": F.when(rank < n, True).when(rank > mid, False),
                     "short": F.when(rank >= F.col("names") - n, True).when(rank < mid, False)})
    side = F.when(F.col("long"), 1).when(F.col("short"), -1)
    return at.withColumn("side", side).where("side IS NOT NULL").select(TS, ID, "side")


def threshold_positions(signals: DataFrame, level: float) -> DataFrame:
    """One position per instrument: flat enters long where the score is +level and short where it is -level; a long ends when the close is below its
    mean, a short when it is above. A bar enters or ends, never both. Columns score, close, mean.

    A bar maps each of the three states to the next one, and maps are put together like numbers are added. Stretches of 256 bars become one map each, only
    these go from stretch to stretch, and each stretch is then gone through from its own first state.
    """
    enter = F.when(F.col("score") == level, 1).when(F.col("score") == -level, -1).otherwise(0)
    below, above = (F.coalesce(x, F.lit(False)) for x in (F.col("close") < F.col("mean"), F.col("close") > F.col("mean")))
    # the states after a bar, from short, flat and long
    step = F.array(F.when(above, 0).otherwise(-1), enter, F.when(below, 0).otherwise(1))
    rows = with_running(signals.select(TS, ID, step.alias("_step")), {"_n": F.lit(1)}, [TS], [ID], seconds())
    parts = rows.groupBy(ID, F.floor((F.col("_n") - 1) / STRETCH).alias("_part")).agg(F.array_sort(F.collect_list(F.struct(TS, "_step"))).alias("_bars"))
    parts = parts.withColumn("_map", F.aggregate("_bars", F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda m, bar: F.transform(m, lambda s: F.get(bar["_step"], s + 1))))

    def walked(maps: Column, first: Column, step) -> Column:
        """The states before the first and after each of ``maps``."""
        return F.aggregate(maps, F.array(first), lambda done, x: F.concat(done, F.array(F.get(step(x), F.element_at(done, -1) + 1))))

    chains = parts.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("_part", "_map"))).alias("_chain"))
    starts = chains.select(ID, F.explode(F.arrays_zip(F.col("_chain")["_part"].alias("_part"), walked(F.col("_chain"), F.lit(0), lambda x: x["_map"]).alias("_first"))).alias("_s"))
    starts = starts.select(ID, F.col("_s")["_part"].alias("_part"), F.col("_s")["_first"].alias("_first")).where("_part IS NOT NULL")
    after = F.slice(walked(F.col("_bars"), F.col("_first"), lambda x: x["_step"]), 2, STRETCH)
    both = parts.join(starts, [ID, "_part"]).select(ID, F.explode(F.arrays_zip(F.col("_bars")[TS].alias("ts"), after.alias("side"))).alias("_x"))
    return both.select(F.col("_x")["ts"].alias(TS), ID, F.col("_x")["side"].alias("side"))


def dropout_selection(scores: DataFrame, k: int, n_drop: int, portfolio: str = "portfolio") -> DataFrame:
    """The ``k`` best names with at most ``n_drop`` replaced per time.

    Of the names held and the best newcomers (``n_drop`` more than there are free places), those held that are among the ``n_drop`` last may leave. Newcomers
    take their places and the free ones; no more leave than are replaced, unless more than ``k`` are held. The holdings are a sequence in time, so one portfolio is one
    task; names that never came near the top are left out before.
    """
    near = Window.partitionBy(portfolio, TS).orderBy(F.desc("score"), F.desc(ID))
    placed = scores.where("score IS NOT NULL").withColumn("place", F.row_number().over(near))
    ever = placed.where(F.col("place") <= 2 * k + n_drop).select(portfolio, ID).distinct()
    rows = placed.join(ever, [portfolio, ID], "left_semi")
    types = dict(rows.dtypes)

    def rotate(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Places kept or taken, of names ordered from the best; ``held`` flags those held before."""
        mine, others = np.flatnonzero(held), np.flatnonzero(~held)
        free = k - len(mine)
        rivals = others[:max(0, free + n_drop)]
        bound = np.sort(np.r_[mine, rivals])[-n_drop] if 0 < n_drop <= len(mine) + len(rivals) else 0 if n_drop else len(ids)
        weak = int((mine >= bound).sum())
        taken = max(0, min(len(rivals), weak + free))
        gone = min(weak, taken + max(0, -free))
        return np.r_[mine[:len(mine) - gone], rivals[:taken]]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group, held, parts = group.sort_values([TS, "place"]), set(), []
        for _, now in group.groupby(TS, sort=False):
            ids = now[ID].to_numpy()
            chosen = now.iloc[rotate(ids, np.isin(ids, list(held)))]
            held = set(chosen[ID])
            parts.append(chosen)
        return pd.concat(parts)[[portfolio, TS, ID]]

    return rows.groupBy(portfolio).applyInPandas(walk, f"{portfolio} {types[portfolio]}, {TS} {types[TS]}, {ID} {types[ID]}")


def _sized(x: Column) -> Column:
    total = F.sum(F.abs(x)).over(C.all())
    return F.when(total == 0, x).otherwise(ratio(x, total))


def alpha_weights(panel: DataFrame, delay: int, decay: int, limit: float, rounds: int = 20, neutral: bool = True) -> DataFrame:
    """Delay, market-neutralise (if ``neutral``), scale, linear decay (absent names count 0), scale, and cap iteratively.

    ``panel(ts, instrument_id, bar, score)`` is dense. The decay looks back on the bars there are: from 1 for the oldest of them to their number.
    History begins at the first bar with any score.
    """
    step = panel
    if delay:
        step = with_previous(panel, ["score"], ["bar"], position=F.col("bar"), width=4096)
        step = step.withColumn("score", F.col("previous")["score"]).drop("previous").where(F.col("bar") >= delay)
    step = step.withColumn("w", F.col("score") - F.avg("score").over(C.all()) if neutral else F.col("score"))
    step = step.withColumn("w", F.coalesce(_sized(F.col("w")), F.lit(0.0)))
    if decay:
        back = step.select(ID, "bar", "w", F.explode(F.sequence(F.lit(0), F.lit(decay - 1))).alias("age"))
        start = F.broadcast(step.where("score IS NOT NULL").agg(F.min("bar").alias("start")))   # one row
        at = F.col("bar") + F.col("age")
        there = F.least(at - F.col("start") + 1, F.lit(decay))
        back = back.join(start).select(ID, at.alias("bar"), (F.col("w") * F.greatest(there - F.col("age"), F.lit(0))).alias("part"))
        mixed = back.groupBy(ID, "bar").agg(F.sum("part").alias("w"))
        step = step.drop("w").join(mixed, [ID, "bar"])
        step = step.withColumn("w", _sized(F.col("w")))
    if limit > 0:
        types = dict(step.dtypes)

        def cap(group: pd.DataFrame) -> pd.DataFrame:
            w = group["w"].to_numpy(float)
            for _ in range(rounds):
                w = w.clip(-limit, limit)
                size = abs(w).sum()
                w = w / size if size else w
                if abs(w).max() <= limit + 1e-10:
                    break
            return group.assign(w=w)[[TS, ID, "w"]]

        step = step.groupBy(TS).applyInPandas(cap, f"{TS} {types[TS]}, {ID} {types[ID]}, w double")
    return step.select(TS, ID, F.col("w").alias("weight"))


def rebalance(held: DataFrame, target: DataFrame, known: DataFrame) -> DataFrame:
    """Orders from held sides to target sides: NEW, HOLD, FLIP, DROPPED or NO_FACTOR_DATA; closing ones have ``first``."""
    both = held.select(ID, F.col("side").alias("was")).join(target.select(ID, F.col("side").alias("goal")), ID, "full_outer")
    both = both.join(known.select(ID, F.lit(True).alias("_known")).distinct(), ID, "left")
    tag = (F.when(F.col("was").isNull(), "NEW").when(F.col("goal") == F.col("was"), "HOLD").when(F.col("goal").isNotNull(), "FLIP")
           .when(F.col("_known"), "DROPPED").otherwise("NO_FACTOR_DATA"))
    return both.select(ID, F.col("was").cast("double").alias("was"), F.col("goal").cast("double").alias("goal"), tag.alias("tag"), tag.isin("FLIP", "DROPPED", "NO_FACTOR_DATA").alias("first"))


def target_value(weights: DataFrame, mode: str, amount: float, long_share: float = 0.5) -> DataFrame:
    """Money per name: a fixed amount, equal inside each side with a share for longs, or by weight."""
    side = F.signum("weight")
    if mode == "fixed":
        value = side * F.lit(amount)
    elif mode == "equal":
        count = F.count(F.lit(1)).over(Window.partitionBy(TS, side))
        value = side * amount * F.when(side > 0, long_share).otherwise(1 - long_share) / count
    else:
        value = F.col("weight") * amount
    return weights.withColumn("value", value)


# ---- monitoring
def concentration(weights: DataFrame) -> DataFrame:
    size = F.sum(F.abs("weight"))
    share2 = ratio(F.sum(F.col("weight") * F.col("weight")), size * size)
    return weights.groupBy(TS).agg(share2.alias("herfindahl"), ratio(F.lit(1.0), share2).alias("effective_n"),
                                   F.max(F.abs("weight")).alias("max_weight"))


def exposure(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy(TS).agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"),
                                   F.sum(F.when(w > 0, w).otherwise(0.0)).alias("long"), F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("short"))


def factor_exposure(weights: DataFrame, values: DataFrame) -> DataFrame:
    """Sum of weight times value per time and factor."""
    return weights.join(values, [TS, ID]).groupBy(TS, "factor").agg(F.sum(F.col("weight") * F.col("value")).alias("exposure"))


def sector_exposure(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    return with_label(weights, sectors, ID, "sector").groupBy(TS, "sector").agg(F.sum("weight").alias("exposure"))


def breaches(exposures: DataFrame, limits: DataFrame, name: str) -> DataFrame:
    """Exposures beyond their limit."""
    return exposures.join(limits, name).where(F.abs("exposure") > F.col("limit")).withColumn("excess", F.abs("exposure") - F.col("limit"))


def attribution(weights: DataFrame, values: DataFrame, factor_returns: DataFrame, returns: DataFrame) -> DataFrame:
    """Portfolio return by factor, and the specific rest."""
    by_factor = factor_exposure(weights, values).join(factor_returns, [TS, "factor"]).select(
        TS, "factor", (F.col("exposure") * F.col("ret")).alias("contribution"))
    total = weights.join(returns, [TS, ID]).groupBy(TS).agg(F.sum(F.col("weight") * F.col("ret")).alias("total"))
    explained = by_factor.groupBy(TS).agg(F.sum("contribution").alias("explained"))
    rest = total.join(explained, TS, "left").select(TS, F.lit("specific").alias("factor"), (F.col("total") - F.coalesce("explained", F.lit(0.0))).alias("contribution"))
    return by_factor.unionByName(rest)


def risk_budget(exposures: DataFrame, covariance: DataFrame, specific: DataFrame, weights: DataFrame) -> DataFrame:
    """Variance share of each factor, ``e_i * (V e)_i``, and of specific risk. ``covariance(i, j, value)``, ``specific(id, var)``."""
    left = exposures.select(TS, F.col("factor").alias("i"), F.col("exposure").alias("ei"))
    right = exposures.select(TS, F.col("factor").alias("j"), F.col("exposure").alias("ej"))
    parts = left.join(covariance, "i").join(right, [TS, "j"]).groupBy(TS, F.col("i").alias("factor")).agg(
        F.sum(F.col("ei") * F.col("value") * F.col("ej")).alias("variance"))
    own = weights.join(specific, ID).groupBy(TS).agg(F.sum(F.col("weight") ** 2 * F.col("var")).alias("variance"))
    both = parts.unionByName(own.select(TS, F.lit("specific").alias("factor"), "variance"))
    return both.withColumn("share", ratio(F.col("variance"), F.sum("variance").over(C.all())))


def value_at_risk(weights: DataFrame, returns: DataFrame, level: float = 0.95, at_least: int = 10, lookback: int | None = None,
                  equity: float | None = None) -> DataFrame:
    """Historical loss quantile and mean loss beyond it of today's ``weights(instrument_id, weight)``.

    ``lookback`` takes the last so many times only; with ``equity`` the losses are also given in money.
    """
    line = returns.join(weights, ID).groupBy(TS).agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    if lookback is not None:
        line = line.orderBy(F.desc(TS)).limit(lookback)
    edge = line.agg(F.percentile("ret", F.lit(1 - level)).alias("edge"), F.count("ret").alias("n"))
    both = line.join(F.broadcast(edge))  # one row
    out = both.groupBy("n").agg(F.when(F.col("n") >= at_least, -F.first("edge")).alias("var"),
                                F.when(F.col("n") >= at_least, -F.avg(F.when(F.col("ret") <= F.col("edge"), F.col("ret")))).alias("cvar"))
    return out if equity is None else out.withColumns({"var_money": F.col("var") * equity, "cvar_money": F.col("cvar") * equity})


# ---- reports
def daily_equity(equity: DataFrame, by: str) -> DataFrame:
    """Last equity of each day, and its return."""
    day = F.date_trunc("day", TS).cast(dict(equity.dtypes)[TS]).alias("day")
    last = equity.groupBy(by, day).agg(F.max_by("equity", TS).alias("equity"))
    step = with_previous(last, ["equity"], ["day"], key=[by], position=seconds("day"))
    return step.select(by, "day", "equity", (ratio(F.col("equity"), F.col("previous")["equity"]) - 1).alias("ret"))


def performance(daily: DataFrame, by: str, days: int = 365) -> DataFrame:
    """Largest drawdown, profit, Sharpe ratio and share of winning days."""
    peak = with_running(daily, {"peak": F.col("equity")}, ["day"], [by], seconds("day"), how=F.max)
    return peak.groupBy(by).agg(
        F.min(ratio(F.col("equity"), F.col("peak")) - 1).alias("max_drawdown"),
        (F.max_by("equity", "day") - F.min_by("equity", "day")).alias("profit"),
        (ratio(F.avg("ret"), F.stddev_samp("ret")) * F.lit(days ** 0.5)).alias("sharpe"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def drawdown_rules(daily: DataFrame, by: str, window_days: int, least_ratio: float, floor: float) -> DataFrame:
    """Days on which equity fell below a share of its peak within the window, or below a floor.

    Only the days of a window are looked back on: chunks of the window's length, each with the chunk before it.
    """
    width = window_days * 86400
    spread = daily.withColumn("_at", F.floor(seconds("day")).cast("bigint")).withColumn("_home", F.floor(F.col("_at") / width))
    spread = spread.withColumn("_chunk", F.explode(F.array("_home", F.col("_home") + 1)))
    w = Window.partitionBy(by, "_chunk").orderBy("_at").rangeBetween(-width, 0)
    seen = spread.withColumn("peak", F.max("equity").over(w)).where("_chunk = _home")
    return seen.select(by, "day", "equity", "peak", (ratio(F.col("equity"), F.col("peak")) < least_ratio).alias("drawdown_hit"),
                       (F.col("equity") < floor).alias("floor_hit"))


def marked_equity(balances: DataFrame, positions: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """Balance plus unrealised profit of open positions."""
    open_profit = positions.join(prices, ID).groupBy(by).agg(F.sum(F.col("quantity") * (F.col("price") - F.col("entry"))).alias("unrealised"))
    return balances.join(open_profit, by, "left").withColumn("equity", F.col("balance") + F.coalesce("unrealised", F.lit(0.0)))


def position_timeline(times: DataFrame, positions: DataFrame) -> DataFrame:
    """Counts and totals of open positions by side at each time."""
    live = active_at(times, positions)
    long, value = F.col("side") == "long", F.col("value")
    return live.groupBy("t").agg(F.count_if(long).alias("longs"), F.count_if(~long).alias("shorts"),
                                 F.sum(F.when(long, value).otherwise(0.0)).alias("long_value"), F.sum(F.when(~long, value).otherwise(0.0)).alias("short_value"))


def execution_report(orders: DataFrame) -> DataFrame:
    """Fill share, slippage against the anchor price in basis points (a cost is positive), and time taken."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    slip = sign * (F.col("fill_price") - F.col("anchor_price"))
    return orders.select("order_id", "side", ratio(F.col("filled"), F.col("quantity")).alias("fill_ratio"), slip.alias("slippage"),
                         (ratio(slip, F.col("anchor_price")) * 10000).alias("slippage_bps"),
                         (seconds("completed") - seconds("created")).alias("elapsed"))


def execution_summary(orders: DataFrame) -> DataFrame:
    """Per venue: completed and failed orders and all others as active, chases, orders that fell back to the market, and the share of limit orders among
    those of a known kind (1 where there is none). ``orders(venue, status, chases, kind, fallback)``."""
    status, limit, market = F.coalesce("status", F.lit("")), F.count_if(F.col("kind") == "limit"), F.count_if(F.col("kind").isin("market", "sweep"))
    return orders.groupBy("venue").agg(
        F.count_if(~status.isin("completed", "failed")).alias("active"), F.count_if(status == "completed").alias("completed"), F.count_if(status == "failed").alias("failed"),
        F.sum("chases").alias("chases"), F.count_if("fallback").alias("fallbacks"), F.coalesce(ratio(limit, limit + market), F.lit(1.0)).alias("limit_share"))


def account_snapshot(positions: DataFrame, by: str) -> DataFrame:
    v = F.col("value")
    return positions.groupBy(by).agg(F.count_if(v > 0).alias("longs"), F.count_if(v < 0).alias("shorts"),
                                     F.sum(F.abs("value")).alias("gross"), F.sum("value").alias("net"))


def factor_snapshot(values: DataFrame, now: Column) -> DataFrame:
    """Newest values with their descending place (ties by id) and their age in seconds."""
    newest = values.groupBy("factor", ID).agg(F.max_by(F.struct(TS, "value"), F.col(TS)).alias("x")).select("factor", ID, "x.*")
    place = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("value"), ID))
    return newest.select("factor", ID, "value", place.alias("place"), (seconds(now) - seconds()).alias("age"))


def common_universe(values: DataFrame, covariance: DataFrame, current: DataFrame) -> DataFrame:
    """Names that have a value and a variance, with their current weight or none."""
    known = covariance.where("i = j").select(F.col("i").alias(ID), F.col("value").alias("variance"))
    return values.join(known, ID).join(current, ID, "left").fillna(0.0, ["weight"])


def snapshot_at(times: DataFrame, snapshots: DataFrame, fields: list[str]) -> DataFrame:
    """The newest risk snapshot at or before each time; each time is looked up once."""
    known = as_of(times.select(TS).distinct().withColumn("_all", F.lit(1)), snapshots.withColumn("_all", F.lit(1)), fields, key=["_all"])
    return times.join(known.select(TS, *fields), TS)


# ---- breakout signal
def breakout(o, k: int, m: int, n: int) -> dict:
    """Board terms of a breakout system: entries beyond the highest or lowest close of the prior ``k`` bars on high volume, exits after ``m`` closes
    beyond the ``n``-bar mean."""
    mean = o.ts_mean(o.close, n)
    busy = o.volume > o.delay(o.ts_max(o.volume, k), 1)
    up = (o.close > o.delay(o.ts_max(o.close, k), 1)) & busy & (o.close > mean)
    down = (o.close < o.delay(o.ts_min(o.close, k), 1)) & busy & (o.close < mean)
    return {"entry_long": up, "entry_short": down,
            "exit_long": o.ts_sum(o.close < mean, m) >= m, "exit_short": o.ts_sum(o.close > mean, m) >= m}
