"""Checks of sources, validation, repair and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators import joins as J
from barley.operators.factorset import melt
from barley.operators.spec import ID, TS
from barley.sources import io, panel as P, validate as V

from oracle.base import bars, bars_sql, check, panel, panel_sql, r, rs, table

WEEK = 7 * 86400


# ---- raw bars with faults, derived from the weekly bars
def raw(spark, sf):
    b = bars(spark, sf).withColumn("seq", F.datediff(TS, F.lit("1990-01-01")).cast("bigint") * 4)
    vol = F.col("volume").cast("bigint")
    b = b.withColumn("high", F.when(vol % 11 == 0, F.col("low") - 1).otherwise(F.col("high")))
    b = b.withColumn("open", F.when(vol % 13 == 0, -F.col("open")).otherwise(F.col("open")))
    b = b.withColumn("seq", F.when(vol % 17 == 0, F.col("seq") - 58).otherwise(F.col("seq")))
    again = b.where(vol % 7 == 0).withColumn("seq", F.col("seq") + 1).withColumn("close", F.col("close") * 2)
    return b.unionByName(again)


RAW_SQL = f"""WITH {bars_sql()},
b0 AS (SELECT *, (datediff('day', DATE '1990-01-01', ts::DATE) * 4)::BIGINT AS seq, volume::BIGINT AS vol FROM bars),
b1 AS (SELECT instrument_id, ts, CASE WHEN vol % 13 = 0 THEN -"open" ELSE "open" END AS "open",
  CASE WHEN vol % 11 = 0 THEN low - 1 ELSE high END AS high, low, "close", volume, quote_volume,
  CASE WHEN vol % 17 = 0 THEN seq - 58 ELSE seq END AS seq FROM b0),
raw AS (SELECT * FROM b1 UNION ALL SELECT instrument_id, ts, "open", high, low, "close" * 2, volume, quote_volume, seq + 1
  FROM b1 WHERE volume::BIGINT % 7 = 0)"""

BROKEN_SQL = """list_filter([CASE WHEN high < greatest("open", "close") THEN 'high_below_body' END,
  CASE WHEN low > least("open", "close") THEN 'low_above_body' END, CASE WHEN low > high THEN 'low_above_high' END,
  CASE WHEN least("open", high, low, "close") <= 0 THEN 'price_not_positive' END,
  CASE WHEN volume < 0 THEN 'volume_negative' END], lambda x: x IS NOT NULL)"""
GAP_SQL = """gaps AS (SELECT * FROM (SELECT instrument_id, lag(ts) OVER w AS after, ts AS before,
  (datediff('day', lag(ts) OVER w, ts) // 7 - 1)::BIGINT AS missing FROM (SELECT DISTINCT instrument_id, ts FROM raw)
  WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)) WHERE missing > 0)"""
ORDER_SQL = """disorder AS (SELECT instrument_id, seq, ts, earlier FROM (SELECT *, lag(ts) OVER (PARTITION BY instrument_id
  ORDER BY seq) AS earlier FROM raw) WHERE ts <= earlier)"""
ONCE_SQL = """once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, ts ORDER BY seq) AS rn
  FROM raw) WHERE rn = 1)"""
FILL_SQL = ONCE_SQL + """,
filled AS (SELECT *, false AS was_filled FROM once UNION ALL
  SELECT instrument_id, p + to_days((7 * i)::INT), c, c, c, c, 0, 0, 0, true FROM (
    SELECT instrument_id, p, c, unnest(range(1, n + 1)) AS i FROM (
      SELECT instrument_id, lag(ts) OVER w AS p, lag("close") OVER w AS c, datediff('day', lag(ts) OVER w, ts) // 7 - 1 AS n
      FROM once WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)) WHERE n BETWEEN 1 AND 3))"""


def spoiled(spark, sf):
    b = bars(spark, sf)
    return b.withColumn("close", F.when(F.col("volume").cast("bigint") % 19 == 0, F.lit("n/a"))
                        .otherwise(F.col("close").cast("string")))


check("schema_check", f"""WITH {bars_sql()} SELECT 'close' AS "column", 'type' AS issue,
  count(*) FILTER (volume::BIGINT % 19 = 0) AS "count" FROM bars""")(lambda s, sf: V.schema_issues(spoiled(s, sf)))
check("duplicate_bars", RAW_SQL + " SELECT instrument_id, ts, count(*) AS \"count\" FROM raw GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda s, sf: V.duplicates(raw(s, sf)))
check("bar_gaps", RAW_SQL + f", {GAP_SQL} SELECT *, CASE WHEN missing > 2 THEN 'error' ELSE 'warning' END AS severity FROM gaps")(
    lambda s, sf: V.gaps(raw(s, sf), WEEK, 2))
check("arrival_order", RAW_SQL + f", {ORDER_SQL} SELECT * FROM disorder")(lambda s, sf: V.out_of_order(raw(s, sf), 500))
check("ohlc_rules", RAW_SQL + f" SELECT instrument_id, ts, seq, unnest({BROKEN_SQL}) AS rule FROM raw")(
    lambda s, sf: V.value_issues(raw(s, sf)))
check("validation_report", RAW_SQL + f""", {GAP_SQL}, {ORDER_SQL}, counts AS (
  SELECT 'schema' AS issue, 0::BIGINT AS "count" UNION ALL
  SELECT 'duplicate', count(*) FROM (SELECT 1 FROM raw GROUP BY instrument_id, ts HAVING count(*) > 1) UNION ALL
  SELECT 'gap_error', count(*) FROM gaps WHERE missing > 2 UNION ALL
  SELECT 'gap_warning', count(*) FROM gaps WHERE missing <= 2 UNION ALL
  SELECT 'order', count(*) FROM disorder UNION ALL
  SELECT 'value', count(*) FROM (SELECT unnest({BROKEN_SQL}) FROM raw))
  SELECT *, "count" = 0 OR issue = 'gap_warning' AS passed FROM counts""")(lambda s, sf: V.report(raw(s, sf), WEEK, 2))
check("drop_duplicates", RAW_SQL + f", {ONCE_SQL} SELECT instrument_id, ts, seq, {rs('close')} AS \"close\" FROM once")(
    lambda s, sf: V.drop_duplicates(raw(s, sf)).select(ID, TS, "seq", r("close").alias("close")))
check("fill_gaps", RAW_SQL + f", {FILL_SQL} SELECT instrument_id, ts, {rs('close')} AS \"close\", volume, was_filled FROM filled")(
    lambda s, sf: V.fill_gaps(V.drop_duplicates(raw(s, sf)), WEEK, 3).select(ID, TS, r("close").alias("close"), "volume", "was_filled"))
check("drop_invalid", RAW_SQL + f""" SELECT instrument_id, ts, seq, nullif(array_to_string({BROKEN_SQL}, ';'), '') AS reasons FROM raw""")(
    lambda s, sf: V.split_invalid(raw(s, sf)).select(ID, TS, "seq", "reasons"))
check("repair", RAW_SQL + f""", {FILL_SQL} SELECT instrument_id, ts, {rs('close')} AS "close", was_filled FROM filled
  WHERE len({BROKEN_SQL}) = 0""")(
    lambda s, sf: V.repair(raw(s, sf), WEEK, 3).select(ID, TS, r("close").alias("close"), "was_filled"))
check("repair_log", RAW_SQL + f""", {FILL_SQL}, log AS (
  SELECT instrument_id, 'drop_duplicate' AS action, count(*) - count(DISTINCT ts) AS "count" FROM raw GROUP BY 1 UNION ALL
  SELECT instrument_id, 'fill', count(*) FILTER (was_filled) FROM filled GROUP BY 1 UNION ALL
  SELECT instrument_id, 'drop_invalid', count(*) FILTER (len({BROKEN_SQL}) > 0) FROM filled GROUP BY 1)
  SELECT * FROM log WHERE "count" > 0""")(lambda s, sf: V.repair_log(raw(s, sf), WEEK, 3))
check("coverage", f"""WITH {bars_sql()}, c AS (SELECT instrument_id, count(*) AS "rows", min(ts) AS "first", max(ts) AS "last",
  count(*) / (datediff('day', min(ts), max(ts)) // 7 + 1)::DOUBLE AS share FROM bars GROUP BY 1)
  SELECT instrument_id, "rows", "first", "last", {rs('share')} AS share,
  CASE WHEN share = 1 THEN 'complete' ELSE 'gaps' END AS status FROM c""")(
    lambda s, sf: V.coverage(bars(s, sf), WEEK).withColumn("share", r("share")))


# ---- sources
BAR_COLUMNS = ["open", "high", "low", "close", "volume", "quote_volume"]


def bars_out(df):
    return df.select(ID, TS, *[r(c, 4).alias(c) for c in BAR_COLUMNS])


BARS_OUT = "SELECT instrument_id, ts, " + ", ".join(f'{rs(c, 4)} AS "{c}"' for c in ['"open"', "high", "low", '"close"', "volume", "quote_volume"]).replace('""', '"')
check("bars_from_lines", f"WITH {bars_sql('month')} {BARS_OUT} FROM bars")(lambda s, sf: bars_out(bars(s, sf, "month")))


def event_ticks(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id") % 10).alias(ID), "ts", "event_id", (100 + F.col("value")).alias("price"),
        (1 + F.col("event_id") % 7).cast("double").alias("size"))


EVENT_SQL = """ticks AS (SELECT 'U' || (user_id % 10) AS instrument_id, ts AS happened, event_id, 100 + value AS price,
  (1 + event_id % 7)::DOUBLE AS size, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS ts FROM events),
bars AS (SELECT instrument_id, ts, first(price ORDER BY happened, event_id) AS "open", max(price) AS high, min(price) AS low,
  last(price ORDER BY happened, event_id) AS "close", sum(size) AS volume, sum(price * size) AS quote_volume FROM ticks GROUP BY 1, 2)"""


def event_bars(spark, sf):
    return P.bars_from_ticks(event_ticks(spark, sf), P.tumbling("6 hours"), ["ts", "event_id"])


check("bars_from_ticks", f"WITH {EVENT_SQL} {BARS_OUT} FROM bars")(lambda s, sf: bars_out(event_bars(s, sf)))
check("densify", f"""WITH {EVENT_SQL}, axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM bars))
  SELECT i.instrument_id, a.ts, a.bar, {rs('b."close"')} AS "close" FROM (SELECT DISTINCT instrument_id FROM bars) i
  CROSS JOIN axis a LEFT JOIN bars b ON b.instrument_id = i.instrument_id AND b.ts = a.ts""")(
    lambda s, sf: P.densify(event_bars(s, sf)).select(ID, TS, "bar", r("close").alias("close")))
check("load_bars", f"""WITH {bars_sql()} SELECT instrument_id, ts, {rs('"close"')} AS "close" FROM bars
  WHERE instrument_id IN ('S1', 'S3', 'S7') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""")(
    lambda s, sf: P.load_bars(bars(s, sf), ["S1", "S3", "S7"], "1996-01-01", "1998-12-31").select(ID, TS, r("close").alias("close")))


@check("csv_bars_to_catalog", f"WITH {bars_sql('month')} SELECT instrument_id, ts, " + ", ".join(
    f'{rs(c)} AS {c}' for c in ('"open"', "high", "low", '"close"')) + ", round_even(volume, 3) AS volume FROM bars")
def csv_bars(spark, sf):
    folder, catalog = io.scratch(spark), io.scratch(spark)
    month = bars(spark, sf, "month")
    out = month.select(F.col(ID).alias("symbol"), F.lit("1M").alias("timeframe"), F.unix_millis(F.col(TS).cast("timestamp")).alias("timestamp"),
                       "open", "high", "low", "close", "volume", "quote_volume", F.lit(0).alias("trades_count"),
                       F.lit(0.0).alias("taker_buy_base_volume"), F.lit(0.0).alias("taker_buy_quote_volume"))
    out.write.partitionBy("symbol", "timeframe").option("header", True).csv(folder)
    raw_rows = io.read_bar_csv(spark, folder)
    raw_rows = raw_rows.withColumn("symbol", F.regexp_replace("symbol", "^symbol=", ""))
    io.bars_to_catalog(raw_rows, catalog, price_digits=11)
    return spark.read.parquet(catalog).select(ID, F.col(TS).cast("timestamp_ntz").alias(TS),
                                            *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


def daily_orders(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.concat(F.lit("S"), F.col("o_custkey") % 10).alias(ID), F.col("o_orderdate").alias(TS))
            .agg(F.sum("o_totalprice").alias("interest")))


SIDE_SQL = "side AS (SELECT 'S' || (o_custkey % 10) AS instrument_id, o_orderdate AS ts, sum(o_totalprice) AS interest FROM orders GROUP BY 1, 2)"


def side_file(spark, sf, field, exact):
    csv, out = io.scratch(spark), io.scratch(spark)
    rows = daily_orders(spark, sf).select(
        F.col(ID).alias("symbol"), F.unix_millis(F.col(TS).cast("timestamp")).alias("timestamp"), r("interest", 2).cast("decimal(20,2)").alias("value"))
    rows.write.option("header", True).partitionBy("symbol").csv(csv)
    for _ in range(2):   # a second run does not double the rows
        io.side_to_catalog(spark, csv, out, field, exact=exact)
    return spark.read.parquet(out).select(ID, F.col(TS).cast("timestamp_ntz").alias(TS), F.col(field).cast("double").alias(field))


for _name, _field, _exact in (("funding_rate_csv", "funding_rate", True), ("open_interest_csv", "open_interest", False),
                              ("vendor_metric_csv", "active_users", False)):
    check(_name, f"WITH {SIDE_SQL} SELECT instrument_id, ts, {rs('interest', 2)} AS {_field} FROM side")(
        lambda s, sf, f=_field, e=_exact: side_file(s, sf, f, e))


def tick_file(spark, sf, kind):
    csv, out = io.scratch(spark), io.scratch(spark)
    t = event_ticks(spark, sf)
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    cols = [F.lit("x").alias("exchange"), F.col(ID).alias("symbol"), time.alias("timestamp"), time.alias("local_timestamp")]
    if kind == "trades":
        cols += [F.col("event_id").alias("id"), F.lit("buy").alias("side"), "price", F.col("size").alias("amount")]
    else:
        cols += [F.col("size").alias("ask_amount"), (F.col("price") + 1).alias("ask_price"), "price", F.col("size").alias("bid_amount")]
    t.select(*cols).write.option("header", True).option("compression", "gzip").csv(csv)
    io.ticks_to_catalog(spark, csv, out, kind)
    return spark.read.parquet(out).withColumn(TS, F.col(TS).cast("timestamp_ntz"))


check("trade_ticks", f"WITH {EVENT_SQL} SELECT instrument_id, happened AS ts, {rs('price')} AS price, size AS amount FROM ticks")(
    lambda s, sf: tick_file(s, sf, "trades").select(ID, TS, r("price").alias("price"), "amount"))
check("quote_ticks", f"WITH {EVENT_SQL} SELECT instrument_id, happened AS ts, {rs('price + 1')} AS ask_price, {rs('price')} AS bid_price FROM ticks")(
    lambda s, sf: tick_file(s, sf, "quotes").select(ID, TS, r("ask_price").alias("ask_price"), r("bid_price").alias("bid_price")))

PAIR = {"gap": lambda o: o.close - o.open, "share": lambda o: o.close / o.high}
LONG_SQL = """long AS (SELECT ts, instrument_id, 'gap' AS factor, "close" - "open" AS value FROM panel WHERE "close" IS NOT NULL
  UNION ALL SELECT ts, instrument_id, 'share', "close" / high FROM panel WHERE "close" IS NOT NULL)"""


@check("factor_cache", panel_sql("month") + f", {LONG_SQL} SELECT ts, instrument_id, factor, {rs('value')} AS value FROM long")
def cache(spark, sf):
    path = io.scratch(spark)
    key = io.definition_hash({"gap": "close - open", "share": "close / high"})
    io.write_factors(FactorSet({}, PAIR).long(panel(spark, sf, "month")), path, key)
    assert io.is_stored(spark, path, key) and not io.is_stored(spark, path, "other")
    return io.read_factors(spark, path, key).select(TS, ID, "factor", r("value").alias("value"))


check("factors_to_snapshots", panel_sql("month") + f""" SELECT ts, instrument_id, {rs('"close" - "open"')} AS gap,
  {rs('"close" / high')} AS share FROM panel WHERE "close" IS NOT NULL""")(
    lambda s, sf: io.to_snapshots(FactorSet({}, PAIR).long(panel(s, sf, "month")), ["gap", "share"])
    .select(TS, ID, r("gap").alias("gap"), r("share").alias("share")))


@check("factors_to_csv", panel_sql("month") + f", {LONG_SQL} SELECT ts, instrument_id, factor, {rs('value')} AS value FROM long")
def to_csv(spark, sf):
    path = io.scratch(spark)
    io.write_csv(FactorSet({}, PAIR).long(panel(spark, sf, "month")), path)
    back = spark.read.option("header", True).schema("ts timestamp_ntz, instrument_id string, factor string, value double").csv(path)
    return back.withColumn("value", r("value"))


@check("panel_matrix", panel_sql("month") + f""" SELECT ts, instrument_id, {rs('"close"')} AS "close" FROM panel
  WHERE "close" IS NOT NULL""")
def matrix(spark, sf):
    names = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias(ID))   # the columns of the matrix
    return P.from_matrix(*P.to_matrix(panel(spark, sf, "month"), "close", names), "close").select(TS, ID, r("close").alias("close"))


# ---- joins
AS_OF = "ASOF LEFT JOIN side s ON s.instrument_id = p.instrument_id AND s.ts <= p.ts"
check("as_of_join", panel_sql() + f", {SIDE_SQL} SELECT p.instrument_id, p.ts, {rs('s.interest', 2)} AS interest FROM panel p {AS_OF}")(
    lambda s, sf: J.as_of(panel(s, sf), daily_orders(s, sf), ["interest"]).select(ID, TS, r("interest", 2).alias("interest")))
check("attach_side", panel_sql() + f""", {SIDE_SQL} SELECT p.instrument_id, p.ts, CASE WHEN p.instrument_id IN (SELECT instrument_id FROM side)
  THEN {rs('s.interest', 2)} ELSE 0 END AS interest FROM panel p {AS_OF}""")(
    lambda s, sf: J.attach_side(panel(s, sf), daily_orders(s, sf), "interest").select(ID, TS, r("interest", 2).alias("interest")))
check("attach_exact", panel_sql() + f""", {SIDE_SQL} SELECT p.instrument_id, p.ts, {rs('s.interest', 2)} AS interest
  FROM panel p LEFT JOIN side s USING (instrument_id, ts)""")(
    lambda s, sf: J.attach_side(panel(s, sf), daily_orders(s, sf), "interest", "none").select(ID, TS, r("interest", 2).alias("interest")))
check("attach_bars", panel_sql() + f""", {SIDE_SQL.replace('side AS', 'whole AS')},
  side AS (SELECT * FROM whole WHERE ts BETWEEN (SELECT min(ts) FROM panel) AND (SELECT max(ts) FROM panel))
  SELECT p.instrument_id, p.ts, CASE WHEN p.instrument_id IN (SELECT instrument_id FROM side) THEN {rs('s.interest', 2)} ELSE 0 END AS other
  FROM panel p {AS_OF}""")(
    lambda s, sf: J.attach_bars(panel(s, sf), daily_orders(s, sf), "interest", "other").select(ID, TS, r("other", 2).alias("other")))
check("spread_one", panel_sql() + f""", one AS MATERIALIZED (SELECT ts, "close" FROM panel WHERE instrument_id = 'S5')
  SELECT p.instrument_id, p.ts, {rs('q."close"')} AS lead FROM panel p LEFT JOIN one q USING (ts)""")(
    lambda s, sf: J.spread_one(panel(s, sf), "S5", "close", "lead").select(ID, TS, r("lead").alias("lead")))
check("spread_one_by_prefix", panel_sql() + f""" SELECT p.instrument_id, p.ts, {rs('q."close"')} AS lead FROM panel p
  LEFT JOIN panel q ON q.ts = p.ts AND q.instrument_id = (SELECT min(instrument_id) FROM panel WHERE lower(instrument_id) LIKE 's%')""")(
    lambda s, sf: J.spread_one(panel(s, sf), "s", "close", "lead").select(ID, TS, r("lead").alias("lead")))
check("attach_all", panel_sql() + f""", {SIDE_SQL} SELECT p.instrument_id, p.ts, CASE WHEN p.instrument_id IN (SELECT instrument_id FROM side)
  THEN {rs('s.interest', 2)} ELSE 0 END AS interest, {rs('q."close"')} AS lead FROM panel p {AS_OF}
  LEFT JOIN panel q ON q.ts = p.ts AND q.instrument_id = 'S5'""")(
    lambda s, sf: J.attach_all(panel(s, sf), [
        {"kind": "side", "side": daily_orders(s, sf), "field": "interest"},
        {"kind": "one", "name": "S5", "field": "close", "out": "lead"}])
    .select(ID, TS, r("interest", 2).alias("interest"), r("lead").alias("lead")))
check("time_inner_join", f"""WITH {bars_sql()}, {SIDE_SQL} SELECT b.instrument_id, b.ts, {rs('b."close"')} AS "close", {rs('s.interest', 2)} AS interest
  FROM bars b JOIN side s USING (instrument_id, ts)""")(
    lambda s, sf: J.aligned(bars(s, sf), daily_orders(s, sf)).select(ID, TS, r("close").alias("close"), r("interest", 2).alias("interest")))
check("scheduled_label", panel_sql("month") + """, schedule AS (SELECT o_orderdate AS ts, max(o_orderpriority) AS regime FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-03-05' GROUP BY 1)
  SELECT p.instrument_id, p.ts, coalesce(s.regime, '_default') AS regime FROM panel p ASOF LEFT JOIN schedule s ON s.ts <= p.ts""")(
    lambda s, sf: J.scheduled(panel(s, sf, "month"), table(s, sf, "orders").where("o_orderdate >= '1996-03-05'")
                              .groupBy(F.col("o_orderdate").alias(TS)).agg(F.max("o_orderpriority").alias("regime")), "regime")
    .select(ID, TS, "regime"))


def positions(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey") % 50).alias(ID), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"),
        F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("opened"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 30) * 86400).cast("timestamp_ntz").alias("closed"))


POSITIONS_SQL = """positions AS (SELECT 'C' || (o_custkey % 50) AS instrument_id, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side,
  o_totalprice AS value, o_orderdate AS opened, o_orderdate + to_days((o_orderkey % 30)::INT) AS closed FROM orders),
times AS (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS t FROM orders),
active AS (SELECT * EXCLUDE (rn) FROM (SELECT t, p.*, row_number() OVER (PARTITION BY t, instrument_id ORDER BY opened DESC, o_orderkey DESC) AS rn
  FROM times JOIN positions p ON opened <= t AND t < closed) WHERE rn = 1)"""


def sample_times(spark, sf):
    return table(spark, sf, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("t")).distinct()


check("active_positions", f"WITH {POSITIONS_SQL} SELECT t, instrument_id, o_orderkey, side, {rs('value', 2)} AS value, opened, closed FROM active")(
    lambda s, sf: J.active_at(sample_times(s, sf), positions(s, sf)).withColumn("value", r("value", 2)))
check("latest_snapshot", f"""WITH {POSITIONS_SQL}, {SIDE_SQL} SELECT t AS ts, w.instrument_id, {rs('s.interest', 2)} AS interest
  FROM (SELECT t, 'S' || i AS instrument_id FROM times, range(10) r(i)) w ASOF LEFT JOIN side s ON s.instrument_id = w.instrument_id AND s.ts <= t""")(
    lambda s, sf: J.as_of(sample_times(s, sf).select(F.col("t").alias(TS), F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("S"), i))).alias(ID)),
                          daily_orders(s, sf), ["interest"]).select(TS, ID, r("interest", 2).alias("interest")))
check("held_not_target", f"""WITH {bars_sql('month')} SELECT instrument_id FROM (SELECT DISTINCT instrument_id FROM bars WHERE ts = TIMESTAMP '1996-01-01')
  WHERE instrument_id NOT IN (SELECT instrument_id FROM bars WHERE ts = TIMESTAMP '1996-02-01' AND volume > 150)""")(
    lambda s, sf: J.rebalance_sets(bars(s, sf, "month").where("ts = '1996-01-01'").select(ID),
                                   bars(s, sf, "month").where("ts = '1996-02-01' AND volume > 150")))


def sectors(spark, sf):
    """Region of each supplier; three nations are left unmapped."""
    n = table(spark, sf, "nation").where("n_nationkey > 2").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return table(spark, sf, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias(ID), F.col("r_name").alias("sector"))


SECTOR_SQL = """sectors AS (SELECT 'S' || s_suppkey AS instrument_id, r_name AS sector FROM supplier
  JOIN nation ON s_nationkey = n_nationkey AND n_nationkey > 2 JOIN region ON n_regionkey = r_regionkey)"""
check("sector_lookup", f"""WITH {bars_sql('month')}, {SECTOR_SQL} SELECT b.instrument_id, b.ts, coalesce(sector, 'Other') AS sector FROM bars b
  LEFT JOIN sectors USING (instrument_id)""")(
    lambda s, sf: J.with_label(bars(s, sf, "month").select(ID, TS), sectors(s, sf), ID, "sector"))
