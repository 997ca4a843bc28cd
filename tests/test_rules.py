"""Literal cases for rules that a shared formula in library and SQL would hide."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barley.operators.joins import active_at
from barley.plans import portfolio as P, quality as Q, selection as R

T0 = datetime(2024, 1, 1)


def table(spark, rows, schema):
    return spark.createDataFrame([(T0 + timedelta(days=r[0]), *r[1:]) for r in rows], schema)


def scores(spark, by_day):
    rows = [(d, n, s) for d, day in enumerate(by_day) for n, s in day.items()]
    return table(spark, rows, "ts timestamp_ntz, instrument_id string, score double")


def by_day(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault((r.ts - T0).days, set()).add(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in columns)))
    return out


def test_sticky_keeps_names_without_score(spark):
    got = by_day(P.sticky_selection(scores(spark, [{"a": 1.0, "b": 2.0, "j": 3.0}, {"a": 1.0, "b": 3.0, "j": None}, {"a": 3.0, "b": 1.0, "j": 2.0}]), 1, 1), "instrument_id", "weight")
    third = round(1 / 3, 9)
    assert got[0] == {("a", -0.5), ("j", 0.5)}
    assert got[1] == {("a", -third), ("b", third), ("j", third)}
    assert got[2] == {("a", third), ("b", -third), ("j", third)}


def test_sticky_holds_both_sides(spark):
    got = by_day(P.sticky_selection(scores(spark, [{"a": 1.0}]), 1, 1), "instrument_id", "weight")
    assert got[0] == {("a", 0.5), ("a", -0.5)}


def test_buffer_closes_beyond_the_middle_only(spark):
    axis = table(spark, [(d, d) for d in range(3)], "ts timestamp_ntz, bar bigint")
    days = [{"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}, {"a": 3.0, "b": 1.0, "c": 2.0, "d": 4.0}, {"a": None, "b": 1.0, "c": 2.0, "d": 4.0}]
    got = by_day(P.buffered_selection(scores(spark, days), 1, 0.5, 1, axis), "instrument_id", "side")
    assert got[0] == {("a", 1), ("d", -1)}
    assert got[1] == {("a", 1), ("b", 1), ("d", -1)}   # rank 2 of 4 is the middle: a stays
    assert got[2] == {("a", 1), ("b", 1), ("d", -1)}   # no score: a stays


def test_threshold_enters_only_when_flat(spark):
    rows = [(0, "x", 1.0, 10.0, 9.0), (1, "x", -1.0, 10.0, 9.0), (2, "x", -1.0, 8.0, 9.0), (3, "x", -1.0, 8.0, 9.0), (400, "x", 0.0, 8.0, 9.0), (401, "x", 1.0, 10.0, 9.0), (402, "x", 0.0, 8.0, None)]
    got = by_day(P.threshold_positions(table(spark, rows, "ts timestamp_ntz, instrument_id string, score double, close double, mean double"), 1.0), "side")
    assert [next(iter(got[d]))[0] for d in (0, 1, 2, 3, 400, 401, 402)] == [1, 1, 0, -1, -1, 0, 0]


def test_threshold_repeated_signal_does_not_block_the_exit(spark):
    rows = [(0, "x", 1.0, 10.0, 9.0), (1, "x", 1.0, 8.0, 9.0)]
    got = by_day(P.threshold_positions(table(spark, rows, "ts timestamp_ntz, instrument_id string, score double, close double, mean double"), 1.0), "side")
    assert got == {0: {(1,)}, 1: {(0,)}}


def test_dropout_replaces_the_last(spark):
    days = [{"a": 5.0, "b": 4.0, "c": 3.0, "d": 2.0}, {"a": 1.0, "b": 2.0, "c": 5.0, "d": 4.0}, {"a": 1.0, "b": 2.0, "c": 5.0, "d": 4.0}]
    got = by_day(P.dropout_selection(scores(spark, days).withColumn("portfolio", F.lit("p")), 2, 1), "instrument_id")
    assert got == {0: {("a",), ("b",)}, 1: {("b",), ("c",)}, 2: {("c",), ("d",)}}


def test_decay_warms_up(spark):
    rows = [(0, "a", 0, 3.0), (0, "b", 0, 1.0), (1, "a", 1, 1.0), (1, "b", 1, 3.0)]
    panel = table(spark, rows, "ts timestamp_ntz, instrument_id string, bar bigint, score double")
    got = by_day(P.alpha_weights(panel, 0, 3, 0), "instrument_id", "weight")
    assert got[0] == {("a", 0.5), ("b", -0.5)}
    assert got[1] == {("a", -0.5), ("b", 0.5)}    # 1 * 0.5 + 2 * -0.5 = -0.5, scaled to a sum of sizes of 1


def test_concentration_with_gross_other_than_one(spark):
    got = P.concentration(table(spark, [(0, "a", 0.2), (0, "b", -0.2)], "ts timestamp_ntz, instrument_id string, weight double")).first()
    assert (got.herfindahl, got.effective_n, got.max_weight) == (0.5, 2.0, 0.2)


def test_value_at_risk_looks_back(spark):
    rets = table(spark, [(d, "a", -0.5 if d == 0 else 0.01 * d) for d in range(21)], "ts timestamp_ntz, instrument_id string, ret double")
    w = spark.createDataFrame([("a", 1.0)], "instrument_id string, weight double")
    assert P.value_at_risk(w, rets).first().cvar == pytest.approx(0.245)
    part = P.value_at_risk(w, rets, lookback=20, equity=100.0).first()
    assert part.n == 20 and part["var"] == pytest.approx(-0.0195) and part.var_money == pytest.approx(-1.95)


def test_open_positions_have_no_close(spark):
    times = spark.createDataFrame([(T0 + timedelta(days=d),) for d in (1, 300)], "t timestamp_ntz")
    rows = [("x", T0, T0 + timedelta(days=2)), ("y", T0, None), ("z", T0, datetime(9000, 1, 1)), ("v", T0 + timedelta(days=500), None)]
    got = active_at(times, spark.createDataFrame(rows, "instrument_id string, opened timestamp_ntz, closed timestamp_ntz")).collect()
    assert {((r.t - T0).days, r.instrument_id) for r in got} == {(1, "x"), (1, "y"), (1, "z"), (300, "y"), (300, "z")}


def test_signed_regime_weights_have_a_floor(spark):
    rows = [("f", 1, "bull", 0.5), ("g", 1, "bull", -0.02), ("h", 1, "bull", None)]
    got = {r.factor: r.weight for r in Q.regime_weights(spark.createDataFrame(rows, "factor string, horizon int, label string, icir double"), 0.1, signed=True).collect()}
    assert got == pytest.approx({"f": 0.5 / 0.7, "g": -0.1 / 0.7, "h": 0.1 / 0.7})


def test_health_ranks_common_names(spark):
    axis = table(spark, [(0, 0), (1, 1)], "ts timestamp_ntz, bar bigint")
    day0, day1 = {"a": 1.0, "b": 2.0, "c": 3.0, "d": None}, {"a": 1.0, "b": 5.0, "c": 2.0, "d": float("inf")}
    rows = [(d, n, "f", v) for d, day in ((0, day0), (1, day1)) for n, v in day.items()]
    got = {(r.ts - T0).days: r for r in Q.health(table(spark, rows, "ts timestamp_ntz, instrument_id string, factor string, value double"), axis).collect()}
    assert got[0].stuck is None and got[0].turnover is None and got[0].anomalies == 1
    assert (got[1].anomalies, got[1].anomaly_rate, got[1].names, got[1].stuck) == (1, 0.25, 3, 1)
    assert got[1].dispersion == pytest.approx((26 / 9) ** 0.5) and got[1].turnover == pytest.approx(0.5)


def test_fixed_weights_need_all_factors(spark):
    rows = [(0, "a", 1.0, 1.0), (0, "b", 3.0, 2.0), (0, "c", 5.0, None)]
    got = {r.instrument_id: r.score for r in Q.weighted_score(table(spark, rows, "ts timestamp_ntz, instrument_id string, x double, y double"), {"x": 1.0, "y": 1.0}, ["x", "y"]).collect()}
    assert got == {"a": pytest.approx(-1 - 0.5 ** 0.5), "b": pytest.approx(0.5 ** 0.5), "c": None}


def test_greedy_walks_long_chains(spark, monkeypatch):
    """A chain of 600 nodes in a few rounds, with a branch that waits for two of them."""
    n, cuts = 600, []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    nodes = spark.createDataFrame([(f"n{i:04d}", i, i == 301) for i in range(n)] + [("x", n, False), ("y", n + 1, False)], "id string, place int, fixed boolean")
    pairs = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n - 1)] + [("x", "n0299"), ("x", "n0598"), ("y", "x"), ("y", "n0001")]
    before, kept = {}, {"n0301": True}
    order = {f"n{i:04d}": i for i in range(n)} | {"x": n, "y": n + 1}
    for a, b in pairs:
        for u, v in ((a, b), (b, a)):
            if u != "n0301" and (v == "n0301" or order[v] < order[u]):
                before.setdefault(u, []).append(v)
    for node in sorted(order, key=order.get):
        if node not in kept:
            kept[node] = not any(kept[v] for v in before.get(node, []))
    got = {r.id: r.kept for r in R.greedy(nodes, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == kept and len(cuts) <= 2 + 2 * 9



def test_near_duplicates_on_eight_columns_with_nulls(spark):
    base = [0.1 * k for k in range(8)]
    rows = [("a", *base), ("b", *base), ("c", *[x + 3e-5 for x in base]), ("d", *[x + 1e-3 for x in base]), ("e", None, *base[1:]), ("f", 0.0, *base[1:])]
    rows[4] = ("e", 0.5, None, *base[2:])
    rows[5] = ("f", 0.5, 0.0, *base[2:])
    got = {r.factor_id: r.kept for r in R.near_duplicates(spark.createDataFrame(rows, "factor_id string, " + ", ".join(f"m{k} double" for k in range(8))), [f"m{k}" for k in range(8)]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": True, "f": False}


def test_folds_count_the_bars(spark):
    axis = table(spark, [(d, d) for d in range(200)], "ts timestamp_ntz, bar bigint")
    got = [tuple(r) for r in R.folds(axis, 2, 0.2, 5, 0.1).orderBy("fold").collect()]
    assert got == [(-1, 0, 180, 180, 200), (0, 0, 95, 100, 140), (1, 0, 135, 140, 180)]
    assert R.folds(axis, 5, 0.2, 5, 0.1).count() == 0


def test_bucket_edges_between_neighbouring_doubles(spark):
    """An edge between two values a few units in the last place apart falls where the SQL's does."""
    import duckdb
    import numpy as np

    draw, rows = np.random.default_rng(5), []
    for g in range(300):
        x = float(draw.uniform(-1, 1))
        for k in range(int(draw.integers(4, 12))):
            rows.append((g, f"i{k}", x))
            x = float(np.nextafter(x, 2.0))
    got = {(r.g, r.i): r.bucket for r in Q.with_buckets(spark.createDataFrame(rows, "g int, i string, value double"), by=("g",)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE p (g INT, i VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT g, i, len(list_filter(q, lambda x: x < value)) + 1 FROM p JOIN (SELECT g, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM p GROUP BY 1) USING (g)").fetchall()
    assert {(g, i): b for g, i, b in want} == got
