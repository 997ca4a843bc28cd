"""Look-backs in chunks, joins, repairs, selection and statistics on small fixtures."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barley.functions.stats import student_two_sided
from barley.operators import joins
from barley.operators.chunks import with_last_known, with_previous, with_running
from barley.plans import quality, risk, selection
from barley.plans.portfolio import dropout_selection
from barley.sources import validate

rng = np.random.default_rng(3)


def test_chunked_lookbacks_equal_pandas(spark):
    # one key holds most of the rows
    key = np.where(rng.random(400) < 0.8, "hot", "cold")
    rows = pd.DataFrame({"k": key, "i": np.arange(400), "x": np.where(rng.random(400) < 0.5, np.nan, rng.normal(size=400)), "y": rng.normal(size=400)})
    df = spark.createDataFrame(rows).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    for width in (7, 1000):
        run = with_running(df, {"s": F.col("y")}, ["i"], ["k"], F.col("i"), width)
        run = with_running(run, {"m": F.col("y")}, ["i"], ["k"], F.col("i"), width, how=F.max)
        last = with_last_known(run, ["x"], ["i"], ["k"], F.col("i"), width)
        out = with_previous(last, ["y"], ["i"], ["k"], F.col("i"), width).select("i", "x", "s", "m", F.col("previous.y").alias("p")).toPandas().sort_values("i")
        by = rows.groupby("k")
        np.testing.assert_allclose(out["x"].to_numpy(float), by["x"].ffill())
        np.testing.assert_allclose(out["s"], by["y"].cumsum())
        np.testing.assert_allclose(out["m"], by["y"].cummax())
        np.testing.assert_allclose(out["p"].to_numpy(float), by["y"].shift())


def test_as_of_equals_merge_asof(spark):
    t = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10_000_000, 300), unit="s")
    left = pd.DataFrame({"instrument_id": rng.choice(["a", "a", "b"], 300), "ts": t}).drop_duplicates()
    right = pd.DataFrame({"instrument_id": rng.choice(["a", "a", "b"], 80), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10_000_000, 80), unit="s"), "v": rng.normal(size=80)}).drop_duplicates(["instrument_id", "ts"])
    got = joins.as_of(spark.createDataFrame(left), spark.createDataFrame(right), ["v"], width=86400).toPandas().sort_values(["ts", "instrument_id"])
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="instrument_id").sort_values(["ts", "instrument_id"])
    np.testing.assert_allclose(got["v"].to_numpy(float), want["v"].to_numpy(float))


def test_repair_keeps_first_and_fills(spark):
    hour = 3600
    start = pd.Timestamp("2024-01-01")
    rows = [("a", start, 1.0, 2.0, 0.5, 1.5, 10.0, 0), ("a", start, 9.0, 9.0, 9.0, 9.0, 9.0, 1), ("a", start + pd.Timedelta(hours=3), 1.0, 2.0, 0.5, 1.0, 5.0, 2), ("a", start + pd.Timedelta(hours=4), 1.0, 0.5, 0.7, 1.0, 5.0, 3)]
    raw = spark.createDataFrame(pd.DataFrame(rows, columns=["instrument_id", "ts", "open", "high", "low", "close", "volume", "seq"]))
    out = validate.repair(raw, hour, 5).orderBy("ts").toPandas()
    assert out["close"].tolist() == [1.5, 1.5, 1.5, 1.0] and out["was_filled"].tolist() == [False, True, True, False]
    assert validate.duplicates(raw).count() == 1
    assert {r["rule"] for r in validate.value_issues(raw).collect()} == {"high_below_body", "low_above_high"}


def test_student_tail():
    # table values: two-sided 5% points
    for df, t in ((1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423), (1000, 1.9623)):
        assert student_two_sided(t, df) == pytest.approx(0.05, abs=2e-5)
    assert student_two_sided(0.0, 4) == 1.0


def test_greedy_equals_sequential_walk(spark):
    n = 40
    edges = [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.08]
    place = rng.permutation(n)
    fixed = {3, 7}
    nodes = spark.createDataFrame([(str(i), int(place[i]), i in fixed) for i in range(n)], "id string, place int, fixed boolean")
    table = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "a string, b string")
    got = {r["id"] for r in selection.greedy(nodes, table).where("kept").collect()}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(n)}
    kept = set(fixed)
    for i in sorted(range(n), key=lambda i: place[i]):
        if i not in kept and not near[i] & kept:
            kept.add(i)
    assert got == {str(i) for i in kept}


def test_near_duplicates_keep_smallest(spark):
    rows = [("a", 0.1, 0.2), ("b", 0.1, 0.2), ("c", 0.10005, 0.2), ("d", 0.1002, 0.2), ("e", 0.5, 0.5)]
    out = selection.near_duplicates(spark.createDataFrame(rows, "factor_id string, x double, y double"), ["x", "y"]).toPandas()
    assert set(out[out["kept"]]["factor_id"]) == {"a", "d", "e"}


def test_half_life_recovers_decay():
    lag = np.arange(1.0, 40.0)
    assert quality._decay_time(lag, 0.6 * np.exp(-lag / 7.5), 200.0) == pytest.approx(7.5, rel=1e-4)


def test_orthogonal_factors_are_uncorrelated(spark):
    x = rng.normal(size=(500, 3)) @ np.array([[1, 0.6, 0.2], [0, 1, 0.5], [0, 0, 1]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["p", "q", "r"]))
    turn = selection.orthogonal_transform(df, ["p", "q", "r"])
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(np.corrcoef((z @ turn).T), np.eye(3), atol=1e-8)
    overlap = selection.orthogonal_overlap(df, ["p", "q", "r"], turn).toPandas().set_index("factor_id")["overlap"]
    assert overlap["p"] == pytest.approx(np.corrcoef(x[:, 0], (z @ turn)[:, 0])[0, 1])


def test_factor_correlation_with_holes(spark):
    frame = pd.DataFrame(rng.normal(size=(60, 3)), columns=list("abc"))
    frame["ts"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(60) // 20, unit="D")
    frame["instrument_id"] = [f"i{k % 20}" for k in range(60)]
    frame.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(frame).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    got = selection.factor_correlation(df, list("abc")).toPandas().set_index(["a", "b"])["corr"]
    want = []
    for _, g in frame.groupby("ts"):
        r = g[list("abc")].rank()
        want.append(r["a"].corr(r["b"]))
    assert got[("a", "b")] == pytest.approx(np.mean(want))


def test_dropout_replaces_at_most_n(spark):
    rows = pd.DataFrame([(pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), f"i{k}", float(rng.normal()), "p") for d in range(12) for k in range(20)], columns=["ts", "instrument_id", "score", "portfolio"])
    out = dropout_selection(spark.createDataFrame(rows), 5, 2).toPandas()
    held = [set(g["instrument_id"]) for _, g in out.groupby("ts")]
    first = rows[rows["ts"] == rows["ts"].min()].nlargest(5, "score")
    assert held[0] == set(first["instrument_id"]) and all(len(h) == 5 for h in held)
    assert all(len(b - a) <= 2 for a, b in zip(held, held[1:]))


def test_pca_explains_the_common_part(spark):
    common, load = rng.normal(size=200), rng.uniform(0.5, 1.5, 6)
    x = common[:, None] * load + 0.1 * rng.normal(size=(200, 6))
    rows = pd.DataFrame([(pd.Timestamp("2024-01-01") + pd.Timedelta(days=t), f"i{i}", t, x[t, i] - x[:, i].mean()) for t in range(200) for i in range(6)], columns=["ts", "instrument_id", "bar", "ret"])
    exposure, _ = risk.principal_factors(spark.createDataFrame(rows), 1)
    got = exposure.orderBy("instrument_id").toPandas()
    assert abs(np.corrcoef(got["exposure"], load)[0, 1]) > 0.99 and got["specific"].max() < 0.05


def test_newey_west_matches_numpy(spark):
    x = np.convolve(rng.normal(0.05, 1, 130), np.ones(4) / 4, "valid")
    t = pd.date_range("2024-01-01", periods=len(x), freq="D")
    ic = spark.createDataFrame(pd.DataFrame({"ts": t, "factor": "f", "horizon": 1, "ic": x}))
    got = quality.newey_west(ic).first()
    n, e = len(x), x - x.mean()
    lags = min(max(int(4 * (n / 100) ** (2 / 9)), 10), n // 3)
    v = np.mean(e ** 2) + sum(2 * (1 - j / (lags + 1)) * np.mean(e[j:] * e[:-j]) for j in range(1, lags + 1))
    assert got["nw_t"] == pytest.approx(x.mean() / np.sqrt(v / n)) and got["lags"] == lags


def test_equal_averages_tie_in_any_order_of_rows(spark):
    # two factors with the same autocorrelations in other orders: sums of doubles differ in the last digit
    periods, orders = ["4h", "8h", "24h"], {"a": (0.1, 0.2, 0.3), "b": (0.3, 0.2, 0.1), "c": (0.5, 0.5, 0.5)}
    rows = [(f, p, 0.1, 0.1, 0.1, x) for f, xs in orders.items() for p, x in zip(periods, xs)]
    valid = spark.createDataFrame(rows, "factor_id string, period string, icir double, ic_mean double, monotonicity double, ar1 double").coalesce(1)
    assert (0.1 + 0.2 + 0.3) != (0.3 + 0.2 + 0.1)
    got = {r.factor_id: r.turnover for r in selection.scores(valid).collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 1.0}


def test_registry_averages_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    # summed in these orders they give 0.3 or 0.30000000000000004; eight times their mean is the limit 0.6
    from oracle import registry
    lines = [(1, 4 * k, 3, d, d, 10.0 + d, 20000.0) for k, order in enumerate(((0.06, 0.07, 0.08, 0.09), (0.09, 0.08, 0.07, 0.06), (0.08, 0.06, 0.09, 0.07))) for d in order]
    names = "l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_quantity double, l_extendedprice double"
    for k in range(3):
        spark.createDataFrame(lines[4 * k:4 * k + 4], names).coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
    got = [registry.metrics(spark, f"{tmp_path}/{k}").first() for k in range(3)]
    assert got[0] == got[1] == got[2] and got[0].p_nw == 0.6


def test_report_and_repair_log_make_the_bars_once(spark):
    rows = [("a", d, s, 1.0, 2.0, 0.5, 1.5, v) for d, s, v in ((0, 1, 1.0), (0, 2, 1.0), (7, 3, -1.0), (21, 5, 1.0), (63, 4, 1.0))]
    for made in (lambda raw: validate.report(raw, 604800, 2), lambda raw: validate.repair_log(raw, 604800, 3)):
        seen = spark.sparkContext.accumulator(0)

        def count(row, seen=seen):
            seen.add(1)
            return row

        names = "instrument_id string, day int, seq long, open double, high double, low double, close double, volume double"
        raw = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), names)
        raw = raw.withColumn("ts", F.timestamp_seconds(F.col("day") * 86400)).drop("day")
        got = {r[0] if "passed" in r else r.action: r["count"] for r in made(raw).collect()}
        assert seen.value == len(rows)
        assert got in ({"schema": 0, "duplicate": 1, "gap_error": 1, "gap_warning": 1, "order": 2, "value": 1}, {"drop_duplicate": 1, "fill": 1, "drop_invalid": 1})
