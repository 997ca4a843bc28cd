"""Checks of user-made operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.custom import complexity, python_rolling, python_slice
from barley.operators.spec import ID, TS

from oracle.base import QUERIES, panel, panel_sql, r, rs, table
from oracle.registry import REG, factors

python_rolling("ts_span_share", lambda w: (w[-1] - min(w)) / (max(w) - min(w) + 1))


def rolling(s, sf):
    f = FactorSet().add_variable("mid", lambda o: (o.high + o.low) / 2).add("value", lambda o: o.ts_span_share(o.mid, 5))
    return f.evaluate(panel(s, sf, "month")).select(ID, TS, r("value").alias("value"))


QUERIES["user_rolling_function"] = (rolling, panel_sql("month") + f""", m AS (SELECT *, (high + low) / 2 AS x FROM panel)
  SELECT instrument_id, ts, {rs('CASE WHEN count(x) OVER v = 5 THEN (x - min(x) OVER v) / (max(x) OVER v - min(x) OVER v + 1) END')} AS value FROM m WINDOW v AS (PARTITION BY instrument_id ORDER BY bar ROWS 4 PRECEDING)""")
QUERIES["user_slice_function"] = (
    lambda s, sf: python_slice(panel(s, sf, "month"), "close", "value", lambda x: x - x.median()).select(ID, TS, r("value").alias("value")),
    panel_sql("month") + f""" SELECT instrument_id, ts, {rs('"close" - median("close") OVER (PARTITION BY ts)')} AS value FROM panel""")
QUERIES["formula_complexity"] = (
    lambda s, sf: complexity(factors(s, sf).select("part", "expression")).select("part", "nodes", "depth", r("numeric_share").alias("numeric_share")),
    REG + f" SELECT part, 3 AS nodes, 1 AS depth, {rs('1 / 3.0::DOUBLE')} AS numeric_share FROM fac")
