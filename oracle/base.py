"""The test tables as a panel, in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.spec import BAR, ID, TS
from barley.sources.panel import bars_from_ticks, densify

from oracle.sqlboard import factor_sql

FIELDS = ["open", "high", "low", "close", "volume", "quote_volume"]
PLACE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "price"]

#: name -> (Spark query, SQL or None)
QUERIES: dict[str, tuple[Callable, str | None]] = {}

#: added before rounding, so that decimal ties fall the same way in both engines
NUDGE = 1.3e-8


def check(name: str, sql: str | None = None):
    def add(query: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = (query, sql)
        return query
    return add


def r(x: Column | str, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(NUDGE), digits) + F.lit(0.0)


def rs(x: str, digits: int = 6) -> str:
    return f"(round(({x}) + {NUDGE}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as ticks: the supplier is the instrument, the unit price the price."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias(ID), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"))


def bars(spark: SparkSession, sf: str, unit: str = "week") -> DataFrame:
    start = F.date_trunc(unit, F.col("l_shipdate")).cast("timestamp_ntz")
    return bars_from_ticks(line_ticks(spark, sf), start, PLACE)


def panel(spark: SparkSession, sf: str, unit: str = "week") -> DataFrame:
    return densify(bars(spark, sf, unit))


def bars_sql(unit: str = "week") -> str:
    order = ", ".join(PLACE)
    return f"""
ticks AS (SELECT 'S' || l_suppkey AS instrument_id, date_trunc('{unit}', l_shipdate)::TIMESTAMP AS ts, l_shipdate,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS price, l_quantity AS size FROM lineitem),
bars AS (SELECT instrument_id, ts, first(price ORDER BY {order}) AS "open", max(price) AS high, min(price) AS low,
  last(price ORDER BY {order}) AS "close", sum(size) AS volume, sum(price * size) AS quote_volume
  FROM ticks GROUP BY 1, 2)"""


def panel_sql(unit: str = "week") -> str:
    return f"""WITH {bars_sql(unit)},
axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM bars)),
panel AS MATERIALIZED (SELECT i.instrument_id, a.ts, a.bar, b."open", b.high, b.low, b."close", b.volume, b.quote_volume
  FROM (SELECT DISTINCT instrument_id FROM bars) i CROSS JOIN axis a LEFT JOIN bars b
  ON b.instrument_id = i.instrument_id AND b.ts = a.ts)"""


def factor_query(factors: Callable[[], FactorSet], digits: int = 6, unit: str = "week"):
    """A Spark query and its SQL for a factor set over the panel, one column per factor."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        chosen = factors()
        wide = chosen.evaluate(panel(spark, sf, unit))
        return wide.select(ID, TS, *[r(n, digits).alias(n) for n in chosen.factors])

    ctes, out = factor_sql(factors(), FIELDS)
    columns = ", ".join(f'{rs(e, digits)} AS "{n}"' for n, e in out.items())
    sql = panel_sql(unit) + ",\n" + ",\n".join(ctes) + f"\nSELECT instrument_id, ts, {columns} FROM cells"
    return query, sql


def add_factors(name: str, factors: Callable[[], FactorSet], digits: int = 6, unit: str = "week") -> None:
    QUERIES[name] = factor_query(factors, digits, unit)
