"""Operators against pandas and literal vectors; results must not depend on the size of the blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barley.operators import OPERATORS, FactorSet
from barley.sources.panel import densify

rng = np.random.default_rng(7)


def frame(bars=90, names=("A", "B", "C", "D", "E", "F"), holes=0.08):
    rows = []
    for n in names:
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, bars)))
        for i in range(bars):
            if rng.random() > holes:
                rows.append((n, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=4 * i), price[i], price[i] * 1.01, price[i] * 0.99, price[i] * (1 + rng.normal(0, 0.003)), float(rng.integers(1, 40))))
    return pd.DataFrame(rows, columns=["instrument_id", "ts", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def data():
    return frame()


@pytest.fixture(scope="module")
def panel(spark, data):
    return densify(spark.createDataFrame(data)).cache()


def wide(data, field):
    return data.pivot(index="ts", columns="instrument_id", values=field)


CASES = {
    "mean": (lambda o: o.ts_mean(o.close, 5), lambda c, v: c.rolling(5).mean()),
    "std": (lambda o: o.stddev(o.close, 7), lambda c, v: c.rolling(7).std()),
    "skew": (lambda o: o.ts_skew(o.close, 9), lambda c, v: c.rolling(9).skew()),
    "corr": (lambda o: o.correlation(o.close, o.volume, 6), lambda c, v: c.rolling(6).corr(v)),
    "cov": (lambda o: o.covariance(o.close, o.volume, 6), lambda c, v: c.rolling(6).cov(v)),
    "rank": (lambda o: o.rank(o.close), lambda c, v: c.rank(axis=1, method="min", pct=True)),
    "rank_of_mean": (lambda o: o.rank(o.round(o.ts_mean(o.rank(o.close), 3), 10)), lambda c, v: c.rank(axis=1, method="min", pct=True).rolling(3).mean().round(10).rank(axis=1, method="min", pct=True)),
    "quantile": (lambda o: o.ts_percentile(o.close, 10, 0.3), lambda c, v: c.rolling(10).quantile(0.3)),
    "ema5": (lambda o: o.ema(o.close, 5), lambda c, v: c.ewm(span=5, adjust=False).mean()),
    "ema1": (lambda o: o.ema(o.close, 1), lambda c, v: c.ewm(span=1, adjust=False).mean()),
    "decay": (lambda o: o.decay_linear(o.close, 4), lambda c, v: c.rolling(4).apply(lambda x: (x * [1, 2, 3, 4]).sum() / 10, raw=True)),
    "scale": (lambda o: o.scale(o.close), lambda c, v: c / c.abs().sum()),
    "slope": (lambda o: o.ts_slope(o.close, 5), lambda c, v: c.rolling(5).apply(lambda x: np.polyfit(range(5), x, 1)[0], raw=True)),
    "resid": (lambda o: o.ts_residual(o.close, 5), lambda c, v: c.rolling(5).apply(lambda x: x[-1] - np.polyval(np.polyfit(range(5), x, 1), 4), raw=True)),
    "argmax": (lambda o: o.ts_argmax(o.close, 6), lambda c, v: c.rolling(6).apply(lambda x: x.argmax() + 1, raw=True)),
    "ts_rank": (lambda o: o.ts_rank(o.close, 6), lambda c, v: c.rolling(6).apply(lambda x: (x < x[-1]).sum() + 1, raw=True)),
}


@pytest.mark.parametrize("block", [4096, 16])
def test_against_pandas(panel, data, block):
    got = FactorSet({}, {n: f for n, (f, _) in CASES.items()}).evaluate(panel, block_bars=block).toPandas()
    c, v = wide(data, "close"), wide(data, "volume")
    for name, (_, want) in CASES.items():
        mine = got.pivot(index="ts", columns="instrument_id", values=name)
        expected = want(c, v)
        np.testing.assert_allclose(mine.to_numpy(float), expected.to_numpy(float), rtol=1e-7, atol=1e-9, err_msg=name)


def test_ema_over_many_blocks(spark):
    x = rng.normal(0, 1, 1500)
    x[rng.random(1500) < 0.3] = np.nan
    x[300:900] = np.nan  # whole blocks without a value
    bars = pd.DataFrame({"instrument_id": "A", "ts": pd.date_range("2024-01-01", periods=1500, freq="min"), "close": x})
    got = FactorSet({}, {"e": lambda o: o.ema(o.close, 9)}).evaluate(densify(spark.createDataFrame(bars))).toPandas().sort_values("ts")
    want = bars.set_index("ts")["close"].ewm(span=9, adjust=False).mean()
    np.testing.assert_allclose(got["e"].to_numpy(float), want.to_numpy(float), rtol=1e-9)


def one_time(spark, values, formula):
    rows = pd.DataFrame({"instrument_id": [f"I{i}" for i in range(len(values))], "ts": pd.Timestamp("2024-01-01"), "x": values})
    out = FactorSet({}, {"y": formula}).evaluate(densify(spark.createDataFrame(rows))).toPandas().sort_values("instrument_id")
    return out["y"].round(4).tolist()


def test_literal_cross_sections(spark):
    assert one_time(spark, [3.0, 5.0, 6.0, 2.0], lambda o: o.normalize(o.x)) == [-1, 1, 2, -2]
    assert one_time(spark, [15.0, 7.0, 0.0, 20.0], lambda o: o.scale_down(o.x)) == [0.75, 0.35, 0, 1]
    assert one_time(spark, [15.0, 7.0, 0.0, 20.0], lambda o: o.scale_down(o.x, 1)) == [-0.25, -0.65, -1, 0]
    assert one_time(spark, [float(i) for i in range(1, 10)] + [10.0], lambda o: o.clip_quantile(o.x)) == [2.8, 2.8, 3, 4, 5, 6, 7, 8, 8.2, 8.2]
    assert one_time(spark, [2.0, 2.0, 2.0], lambda o: o.normalize(o.x, True)) == [0, 0, 0]


def test_division_and_truth(panel):
    out = FactorSet({}, {"z": lambda o: o.is_nan(o.close / (o.close - o.close)), "t": lambda o: o.if_else(o.close / (o.close - o.close), 1, 2)})
    got = out.evaluate(panel).toPandas()
    assert (got["z"] == 1).all() and (got["t"] == 1).all()


def test_registry_knows_names_and_arity(panel):
    assert {"rank", "sma", "ts_corr", "c_residual", "wq_ts_rank", "scale"} <= set(OPERATORS)
    with pytest.raises(TypeError):
        FactorSet({}, {"bad": lambda o: o.ts_mean(o.close)}).evaluate(panel)
    with pytest.raises(AttributeError):
        FactorSet({}, {"bad": lambda o: o.no_such(o.close)}).evaluate(panel)


def test_one_exchange_for_all_rolling_columns(panel):
    many = FactorSet({}, {f"m{n}": (lambda o, n=n: o.ts_mean(o.delta(o.close, 1), n)) for n in range(2, 12)})
    plan = many.evaluate(panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1  # above the cached panel


def broadcast_rows(spark):
    """Rows of each table that the last query broadcast."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    number = runs.apply(runs.size() - 1).executionId()
    nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
    for node in (nodes.apply(i) for i in range(nodes.size())):
        if node.name() == "BroadcastExchange":
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    yield int(values.apply(m.accumulatorId()).replace(",", ""))


def test_densify_broadcasts_no_cells(spark):
    # 300 instruments with one or two of three bars: 900 cells, from runs of 4,096 bar numbers each
    rows = [(f"i{i}", k % 3, float(i)) for i in range(300) for k in (i, i + i % 2)]
    bars = spark.createDataFrame(sorted(set(rows)), "instrument_id string, k int, close double")
    bars = bars.select("instrument_id", F.timestamp_seconds(F.col("k") * 604800).alias("ts"), "close")
    panel = densify(bars)
    out = panel.collect()
    assert max(broadcast_rows(spark)) <= 450   # the bars themselves
    known = {(i, k): x for i, k, x in rows}
    assert {(r.instrument_id, r.bar): r.close for r in out} == {(f"i{i}", k): known.get((f"i{i}", k)) for i in range(300) for k in range(3)}
    assert len(out) == 900
