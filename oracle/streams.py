"""Checks of the streaming path: events come in five triggers, with rows far behind the watermark among them."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.spec import BAR, ID, TS
from barley.plans.portfolio import account_snapshot
from barley.sources import io
from barley.sources.panel import bars_from_ticks, tumbling
from barley.streaming.bars import FactorStream, SnapshotStream, completeness, live_bars
from barley.streaming.panels import flushed_panels

from oracle.base import QUERIES, r, rs
from oracle.data import BARS_OUT, EVENT_SQL, bars_out
from oracle.quality import corr, ranked, rounded
from oracle.sqlboard import factor_sql

DONE = f"""WITH {EVENT_SQL.replace('bars AS', 'allbars AS')}, bars AS (SELECT * FROM allbars WHERE ts + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events))"""


SLICES = 5


def sliced(rows, ts=TS):
    """Rows with the number of their slice: five equal stretches of time, by whole microseconds."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    return rows.withColumn("slice", F.expr(f"cast(least({SLICES - 1}, ((unix_micros(cast({ts} as timestamp)) - {low}) * {SLICES}) div {high - low + 1}) as int)"))


def fed(spark, rows, start, late=True, folder=None):
    """Five triggers: the rows come slice by slice into a folder, and ``start(stream)`` starts a query over it that goes on where the last one ended. With each slice comes
    the one two before it once more, far behind the watermark."""
    folder = folder or f"{io.scratch(spark)}/feed"
    parts, schema = sliced(rows), rows.schema
    for k in range(SLICES):
        again = F.col("slice") == k - 2 if late else F.lit(False)
        parts.where((F.col("slice") == k) | again).drop("slice").write.mode("append").parquet(folder)
        start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def ticks(rows):
    return rows.select(F.concat(F.lit("U"), F.col("user_id") % 10).alias(ID), F.col("ts").cast("timestamp").alias(TS), F.col("event_id").alias("seq"),
                       (100 + F.col("value")).alias("price"), (1 + F.col("event_id") % 7).cast("double").alias("size"))


def run(spark, sf, make, mode="append"):
    folder = io.scratch(spark)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    fed(spark, events(spark, sf), lambda rows: make(ticks(rows)).writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    out = spark.read.parquet(f"{folder}/out")
    return out.withColumn(TS, F.col(TS).cast("timestamp_ntz"))


def newest(rows):
    """Update mode: the last state of each open bar."""
    rest = [c for c in rows.columns if c not in (ID, TS, "batch")]
    return rows.groupBy(ID, TS).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(ID, TS, "x.*")


def six(t, key=None):
    return live_bars(t, "6 hours", "2 hours", key)


def factor_stream(spark, sf, factors=None, **options):
    stream = FactorStream(factors or FACTORS, io.scratch(spark), state_tasks=4, **options)   # ten instruments have ten open bars
    fed(spark, events(spark, sf), lambda rows: stream.start(six(ticks(rows)), once=True))
    return stream


FACTORS = FactorSet({}, {"mean": lambda o: o.cs_rank(o.ts_mean(o.close, 5)), "mom": lambda o: o.close / o.delay(o.close, 2) - 1})
_c, _o = factor_sql(FACTORS, ["open", "high", "low", "close", "volume", "quote_volume"])
PANEL = f"""{DONE}, axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM bars)),
  panel AS MATERIALIZED (SELECT i.instrument_id, a.ts, a.bar, b."open", b.high, b.low, b."close", b.volume, b.quote_volume FROM (SELECT DISTINCT instrument_id FROM bars) i CROSS JOIN axis a LEFT JOIN bars b ON b.instrument_id = i.instrument_id AND b.ts = a.ts)"""
OUT = PANEL + ", " + ", ".join(_c) + ", f AS MATERIALIZED (SELECT ts, instrument_id, bar, " + ", ".join(f"{e} AS {n}" for n, e in _o.items()) + """ FROM cells),
  vals AS (SELECT ts, instrument_id, factor, value FROM f UNPIVOT (value FOR factor IN (mean, mom)))"""


def published(s, sf):
    return factor_stream(s, sf).published(s).select(F.col(TS).cast("timestamp_ntz").alias(TS), ID, "factor", r("value").alias("value"))


def carried(s, sf):
    side = events(s, sf).select(F.col("ts").cast("timestamp").alias(TS), F.concat(F.lit("U"), F.col("user_id") % 10).alias(ID), F.col("value").alias("rate"))
    both = FactorSet({}, {"rate_out": lambda o: o.rate + 0, "lead_out": lambda o: o.lead + 0})
    stream = factor_stream(s, sf, both, side=side, side_fields=["rate"], lead=("U3", "close", "lead"))
    return stream.published(s).select(F.col(TS).cast("timestamp_ntz").alias(TS), ID, "factor", r("value").alias("value"))


def refit(s, sf):
    stream = factor_stream(s, sf, refit_every=1)
    last = s.read.parquet(f"{stream.folder}/risk")
    return last.where(F.col("batch") == last.agg(F.max("batch")).scalar()).select("i", "j", r("value").alias("value"))


def ic_live(s, sf):
    return factor_stream(s, sf).realised(s).select(F.col(TS).cast("timestamp_ntz").alias(TS), "factor", r("ic").alias("ic"))


def snapshots(s, sf):
    """Positions are the newest event of an account and type; a snapshot of the accounts after each trigger."""
    stream = SnapshotStream(io.scratch(s), ["account", "event_type"], ["at", "seq"], lambda state: account_snapshot(state, "account"))
    fed(s, events(s, sf), lambda rows: stream.start(rows.select(F.concat(F.lit("U"), F.col("user_id") % 10).alias("account"), "event_type", F.col("ts").alias("at"), F.col("event_id").alias("seq"),
                                                                (F.col("value") - 10).alias("value")), once=True))
    return rounded(stream.written(s).withColumn("trigger", F.col("batch").cast("int")).drop("batch"))


def three_hour_bars(s, sf):
    return bars_from_ticks(ticks(events(s, sf)), tumbling("3 hours"), [TS, "seq"]).select(TS, ID, "close")


def panels(s, sf):
    """Bars of three hours, of which some instruments lack some: what does not get complete comes out by the clock."""
    folder, rows = io.scratch(s), three_hour_bars(s, sf)
    times = rows.select(TS).distinct().count()

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    live, read, sent = [], {}, []

    class Live:
        """One query for all slices; a slice is through when its rows have been read. With alarms by the clock a query always has another batch to run."""

        def __init__(self, stream):
            if not live:
                out = flushed_panels(stream.withWatermark(TS, "12 hours"), 10, 2.0, ["close"])
                live.append(out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="1 second").start())

        def awaitTermination(self):
            sent.append(s.read.parquet(f"{folder}/feed").count())
            wait(lambda: sum(read.values()) >= sent[-1])

    def wait(done):
        for _ in range(600):
            if live[0].exception():
                raise live[0].exception()
            read.update({p["batchId"]: p["numInputRows"] for p in live[0].recentProgress})
            if done():
                return
            time.sleep(0.5)

    fed(s, rows, Live, late=False, folder=f"{folder}/feed")
    # nothing new comes: only the clock goes on
    wait(lambda: s.read.parquet(f"{folder}/out").select(TS).distinct().count() >= times)
    live[0].stop()
    return s.read.parquet(f"{folder}/out").select(F.col(TS).cast("timestamp_ntz").alias(TS), ID, r("close").alias("close"), "reported", "complete")


QUERIES["stream_bars"] = (lambda s, sf: bars_out(run(s, sf, six)), f"{DONE} {BARS_OUT} FROM bars")
QUERIES["stream_bars_open"] = (lambda s, sf: bars_out(newest(run(s, sf, six, "update"))), f"WITH {EVENT_SQL} {BARS_OUT} FROM bars")
QUERIES["stream_deduplicated"] = (lambda s, sf: bars_out(run(s, sf, lambda t: six(t.unionByName(t), ["seq", ID]))), f"{DONE} {BARS_OUT} FROM bars")
QUERIES["stream_completeness"] = (lambda s, sf: completeness(run(s, sf, six), 10), f"{DONE} SELECT ts, count(DISTINCT instrument_id) AS reported, count(DISTINCT instrument_id) >= 10 AS complete FROM bars GROUP BY 1")
QUERIES["stream_factors"] = (published, f"{OUT} SELECT ts, instrument_id, factor, {rs('value')} AS value FROM vals")
QUERIES["stream_side_and_lead"] = (carried, f"""{PANEL}, side AS (SELECT ts, 'U' || (user_id % 10) AS instrument_id, value AS rate FROM events),
  sv AS (SELECT p.ts, p.instrument_id, s.rate, q."close" AS lead FROM panel p ASOF LEFT JOIN side s ON s.instrument_id = p.instrument_id AND s.ts <= p.ts LEFT JOIN panel q ON q.ts = p.ts AND q.instrument_id = 'U3')
  SELECT ts, instrument_id, 'rate_out' AS factor, {rs('rate')} AS value FROM sv WHERE rate IS NOT NULL UNION ALL SELECT ts, instrument_id, 'lead_out', {rs('lead')} FROM sv WHERE lead IS NOT NULL""")
QUERIES["stream_risk_refit"] = (refit, f"""{PANEL}, rr AS (SELECT instrument_id, bar, coalesce("close" / lag("close") OVER (PARTITION BY instrument_id ORDER BY bar) - 1, 0) AS x FROM panel),
  pr AS (SELECT instrument_id, bar, x - avg(x) OVER (PARTITION BY instrument_id) AS ret FROM rr) SELECT i, j, {rs('v')} AS value FROM (SELECT a.instrument_id AS i, b.instrument_id AS j, sum(a.ret * b.ret) / (SELECT count(DISTINCT bar) FROM pr) AS v FROM pr a JOIN pr b USING (bar) GROUP BY 1, 2)""")
QUERIES["stream_realised_ic"] = (ic_live, f"""{OUT}, rets AS (SELECT a.ts, a.instrument_id, b."close" / a."close" - 1 AS fwd_ret FROM panel a JOIN panel b ON b.instrument_id = a.instrument_id AND b.bar = a.bar + 1 WHERE a."close" IS NOT NULL AND b."close" IS NOT NULL),
  ic AS (SELECT ts, factor, CASE WHEN count(*) >= 3 THEN {corr('a', 'b')} END AS ic FROM (SELECT *, {ranked('value', 'ts, factor')} AS a, {ranked('fwd_ret', 'ts, factor')} AS b FROM vals JOIN rets USING (ts, instrument_id)) GROUP BY 1, 2)
  SELECT y.ts, factor, {rs('ic')} AS ic FROM ic JOIN axis x USING (ts) JOIN axis y ON y.bar = x.bar + 1""")
SLICE_SQL = f"""ev AS MATERIALIZED (SELECT *, least({SLICES - 1}, ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * {SLICES}) // (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events))::INT AS slice FROM events)"""
QUERIES["stream_snapshots"] = (snapshots, f"""WITH {SLICE_SQL}, st AS (SELECT k AS trigger, 'U' || (user_id % 10) AS account, event_type, arg_max(value - 10, event_id) AS value
  FROM (SELECT k, ev.*, max(ts) OVER (PARTITION BY k, user_id % 10, event_type) AS newest FROM ev, range({SLICES}) r(k) WHERE slice <= k) WHERE ts = newest GROUP BY 1, 2, 3)
  SELECT trigger::INT AS trigger, account, count(*) FILTER (value > 0) AS longs, count(*) FILTER (value < 0) AS shorts, {rs('sum(abs(value))')} AS gross, {rs('sum(value)')} AS net FROM st GROUP BY 1, 2""")
QUERIES["stream_panels"] = (panels, f"""WITH {EVENT_SQL.replace("INTERVAL '6 hours'", "INTERVAL '3 hours'").replace("INTERVAL 6 HOURS", "INTERVAL 3 HOURS")}
  SELECT ts, instrument_id, {rs('"close"')} AS "close", count(*) OVER (PARTITION BY ts) AS reported, count(*) OVER (PARTITION BY ts) >= 10 AS complete FROM bars""")
