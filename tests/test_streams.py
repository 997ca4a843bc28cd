"""What a stream carries from batch to batch, and panels that are flushed by the clock."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.joins import as_of, reachable
from barley.operators.spec import ID, TS
from barley.streaming.bars import FactorStream, SnapshotStream
from barley.streaming.panels import flushed_panels

T0 = dt.datetime(2024, 1, 1)
BARS = f"{ID} string, {TS} timestamp, open double, high double, low double, close double, volume double, quote_volume double"


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def bar(name, hour, close):
    return (name, T0 + dt.timedelta(hours=hour), close, close, close, close, 1.0, close)


def test_history_is_bounded_and_late_bars_change_nothing(spark, tmp_path):
    price = {n: [10.0 + ((7 * h + 3 * i) % 11) for h in range(12)] for i, n in enumerate("ABCD")}
    stream = FactorStream(FactorSet({}, {"mean": lambda o: o.ts_mean(o.close, 3)}), str(tmp_path), history_bars=4)
    for number in range(4):
        rows = [bar(n, h, price[n][h]) for n in price for h in range(3 * number, 3 * number + 3)]
        rows += rows[:2] + [bar("A", 3 * number - 2, 999.0)] if number else rows[:1]   # repeated bars, and one of a time that is published
        frame = spark.createDataFrame(rows, BARS)
        stream(frame, number)
        if number == 2:
            stream(frame, number)   # run again after a failure
    kept = sorted(p.name for p in (tmp_path / "history").iterdir())
    assert kept == ["batch=2", "batch=3"]   # no batch reads further back
    assert spark.read.parquet(f"{tmp_path}/history/batch=3").select(TS).distinct().count() == 4
    got = {(r[ID], int((r[TS] - T0).total_seconds() // 3600)): r["value"] for r in stream.published(spark).collect()}
    want = {(n, h): sum(p[h - 2:h + 1]) / 3 for n, p in price.items() for h in range(2, 12)}
    assert {k: v for k, v in got.items() if k[1] >= 2} == pytest.approx(want)
    ic = {int((r[TS] - T0).total_seconds() // 3600) for r in stream.realised(spark).where("ic IS NOT NULL").collect()}
    assert {4, 6, 9, 11} <= ic   # the first bars of a batch meet the values published by the batch before


def test_empty_batches_carry_the_history(spark, tmp_path):
    stream = FactorStream(FactorSet({}, {"last": lambda o: o.close + 0}), str(tmp_path))
    none = spark.createDataFrame([], BARS)
    for number, rows in enumerate([[], [bar("A", 0, 1.0)], [], [], [bar("A", 1, 2.0)]]):
        stream(spark.createDataFrame(rows, BARS) if rows else none, number)
    assert sorted(r["value"] for r in stream.published(spark).collect()) == [1.0, 2.0]
    assert spark.read.parquet(f"{tmp_path}/history/batch=4").count() == 2


def test_snapshots_merge_versions(spark, tmp_path):
    stream = SnapshotStream(str(tmp_path), ["account"], ["version"], lambda state: state.groupBy("account").agg(F.sum("value").alias("value")))
    batches = [[("a", 1, 5.0), ("b", 1, 7.0)], [("a", 2, 6.0), ("a", 2, 6.0)], [("a", 1, 99.0)], [("b", 3, 1.0), ("b", 2, 2.0)]]
    for number, rows in enumerate(batches):
        stream(spark.createDataFrame(rows, "account string, version int, value double"), number)
    got = {(r["batch"], r["account"]): r["value"] for r in stream.written(spark).collect()}
    assert got == {(0, "a"): 5, (0, "b"): 7, (1, "a"): 6, (1, "b"): 7, (2, "a"): 6, (2, "b"): 7, (3, "a"): 6, (3, "b"): 1}
    assert len(list((tmp_path / "state").iterdir())) == 2


def test_partial_panel_comes_out_by_the_clock_once(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    schema = f"{ID} string, {TS} timestamp, close double"

    def send(*rows):
        spark.createDataFrame([(n, T0 + dt.timedelta(hours=h), c) for n, h, c in rows], schema).coalesce(1).write.mode("append").parquet(feed)

    def come():
        try:
            rows = spark.read.parquet(out).collect()
        except Exception:   # nothing is written yet
            return []
        return sorted((int((r[TS] - T0).total_seconds() // 3600), r[ID], r["close"], r["reported"], r["complete"]) for r in rows)

    def until(n):
        end = time.time() + 60
        while len(come()) < n and time.time() < end:
            time.sleep(0.3)
        return come()

    send(("A", 0, 1.0), ("B", 0, 2.0), ("A", 0, 9.0), ("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 3.0))
    stream = spark.readStream.schema(schema).parquet(feed).withWatermark(TS, "10 hours")
    query = flushed_panels(stream, 3, 3.0, ["close"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        whole = [(1, "A", 1.0, 3, True), (1, "B", 2.0, 3, True), (1, "C", 3.0, 3, True)]
        assert [r for r in until(3) if r[0] == 1] == whole
        partial = [(0, "A", 1.0, 2, False), (0, "B", 2.0, 2, False)]   # without new input, the first of repeated bars
        assert until(5) == partial + whole
        send(("C", 0, 3.0), ("A", 2, 1.0), ("B", 2, 1.0), ("C", 2, 1.0))   # the late bar of time 0 does not open it again
        assert until(8)[:5] == partial + whole
        time.sleep(5)
        assert len(come()) == 8
    finally:
        query.stop()


def test_side_rows_that_a_panel_can_meet_give_the_same_join(spark):
    at = [T0 + dt.timedelta(hours=h) for h in range(12)]
    left = spark.createDataFrame([(n, at[h]) for n in "ABC" for h in (4, 6, 9)], f"{ID} string, {TS} timestamp")
    side = spark.createDataFrame([("A", at[1], 1.0, None), ("A", at[2], None, 2.0), ("A", at[4], 3.0, None), ("A", at[5], None, None), ("A", at[7], 4.0, 5.0),
                                  ("A", at[11], 9.0, 9.0), ("B", at[9], 6.0, None), ("B", at[10], 7.0, 7.0)], f"{ID} string, {TS} timestamp, x double, y double")
    low, high = left.agg(F.min(F.unix_micros(TS)), F.max(F.unix_micros(TS))).first()
    some = reachable(side, ["x", "y"], low, high)
    assert some.count() == 4   # one of the rows up to 4 o'clock, no row after 9 o'clock
    want = {(r[ID], r[TS]): (r.x, r.y) for r in as_of(left, side, ["x", "y"]).collect()}
    got = {(r[ID], r[TS]): (r.x, r.y) for r in as_of(left, some, ["x", "y"], width=3600).collect()}
    assert got == want
    assert [want["A", at[h]] for h in (4, 6, 9)] == [(3.0, 2.0), (3.0, 2.0), (4.0, 5.0)] and want["B", at[9]] == (6.0, None) and want["C", at[9]] == (None, None)


@pytest.mark.parametrize("options", [{"refit_every": 1}, {"side_fields": ["rate"], "lead": ("A", "close", "lead")}])
def test_a_small_batch_takes_few_tasks_whatever_the_session_would(spark, tmp_path, options):
    spark.conf.set("spark.sql.shuffle.partitions", "120")
    rows = [bar(n, h, 10.0 + (7 * h + 3 * i) % 11) for i, n in enumerate("ABCD") for h in range(6)]
    side = spark.createDataFrame([(n, T0 + dt.timedelta(hours=h), float(h)) for n in "ABCD" for h in range(6)], f"{ID} string, {TS} timestamp, rate double")
    stream = FactorStream(FactorSet({}, {"mean": lambda o: o.cs_rank(o.ts_mean(o.close, 3))}), str(tmp_path), side=side if "side_fields" in options else None, **options)
    group, context = f"few-{tmp_path.name}", spark.sparkContext
    context.setJobGroup(group, "")
    stream(spark.createDataFrame(rows, BARS).coalesce(1), 0)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    assert max(tracker.getStageInfo(i).numTasks for i in stages if tracker.getStageInfo(i)) < 120   # the panel has 24 cells
    assert spark.conf.get("spark.sql.shuffle.partitions") == "120"
    assert stream.published(spark).count() == 16
