"""State machines in stretches and near duplicates in crowded cells, against brute force."""

import datetime as dt
import random

import pytest

from barley.plans import portfolio, selection

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_threshold_positions_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "STRETCH", 7)
    rng = random.Random(5)
    rows, want = [], {}
    for name in ("a", "b", "c"):
        state = 0
        for t in range(150 if name != "c" else 3):
            score, close = rng.choice([-2.0, 0.0, 1.0, 2.0, None]), rng.choice([1.0, 2.0, 3.0, None])
            rows.append((name, T0 + dt.timedelta(days=t), score, close, 2.0))
            ends = close is not None and ((state == 1 and close < 2) or (state == -1 and close > 2))
            state = ({2.0: 1, -2.0: -1}.get(score, 0)) if state == 0 else 0 if ends else state
            want[name, t] = state
    frame = spark.createDataFrame(rows, "instrument_id string, ts timestamp, score double, close double, mean double")
    out = portfolio.threshold_positions(frame, 2.0)
    assert {(r.instrument_id, (r.ts - T0).days): r.side for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan


def test_near_duplicates_in_crowded_cells(spark):
    """Vectors without their first metrics all fall in one cell of these; further columns part them."""
    rng = random.Random(6)
    columns = ["p", "q", "r", "s"]
    rows = []
    for i in range(120):
        base = [None, None, rng.choice([0.1, 0.2, 0.3]), rng.uniform(0, 0.002)] if i % 4 else [rng.uniform(0, 0.001) for _ in range(4)]
        rows.append((f"f{i:03d}", *base))
    frame = spark.createDataFrame(rows, "factor_id string, " + ", ".join(f"{c} double" for c in columns))
    vectors = {r[0]: [x or 0.0 for x in r[1:]] for r in rows}
    kept = []
    for name in sorted(vectors):
        if all(sum((x - y) ** 2 for x, y in zip(vectors[name], vectors[k])) ** 0.5 >= 1e-4 for k in kept):
            kept.append(name)
    assert 40 < len(kept) < 118
    for crowd in (2, 64):
        got = {r.factor_id for r in selection.near_duplicates(frame, columns, crowd=crowd).where("kept").collect()}
        assert got == set(kept)
