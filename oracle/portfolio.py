"""Checks of weights, risk models and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.factorset import melt
from barley.operators.spec import BAR, ID, TS
from barley.plans.selection import covered
from barley.plans import portfolio as P, risk as K

from oracle.base import FIELDS, QUERIES, add_factors, panel, panel_sql, r, rs, table
from oracle.data import POSITIONS_SQL, SECTOR_SQL, daily_orders, positions, sample_times, sectors
from oracle.quality import rounded
from oracle.sqlboard import factor_sql

SETS = FactorSet({"ret": lambda o: o.close / o.delay(o.close, 1) - 1},
                 {"score": lambda o: o.close - o.ts_mean(o.close, 3), "weight": lambda o: o.cs_scale(o.cs_demean(o.ret)), "mom": lambda o: o.cs_zscore(o.ret), "size": lambda o: o.cs_zscore(o.volume), "r1": lambda o: o.ret + 0})
_c, _o = factor_sql(SETS, FIELDS)
BASE = panel_sql("month") + ",\n" + ",\n".join(_c) + ", w AS MATERIALIZED (SELECT instrument_id, ts, bar, " + ", ".join(f"{e} AS {n}" for n, e in _o.items()) + """ FROM cells),
wt AS MATERIALIZED (SELECT ts, instrument_id, weight FROM w WHERE weight IS NOT NULL), sc AS MATERIALIZED (SELECT ts, instrument_id, score FROM w WHERE score IS NOT NULL),
vals AS MATERIALIZED (SELECT ts, instrument_id, factor, value FROM w UNPIVOT (value FOR factor IN (mom, size))), rt AS MATERIALIZED (SELECT ts, instrument_id, bar, r1 AS ret FROM w)"""


def q(name, sql, query, floats=(), base=None):
    if sql is not None:
        replaced = ", ".join(f'{rs(chr(34) + c + chr(34))} AS "{c}"' for c in floats)
        extra, body = sql if isinstance(sql, tuple) else ("", sql)
        sql = f"{base or BASE}{extra}, out AS ({body}) SELECT * " + (f"REPLACE ({replaced}) " if floats else "") + "FROM out"
    QUERIES[name] = (lambda s, sf: rounded(query(s, sf)), sql)


def cells(s, sf):
    return SETS.evaluate(panel(s, sf, "month"))


def scores(s, sf):
    return cells(s, sf).select(TS, ID, "score")


def weights(s, sf):
    return cells(s, sf).select(TS, ID, "weight").where("weight IS NOT NULL")


def values(s, sf):
    return melt(cells(s, sf), ["mom", "size"])


def rets(s, sf):
    return cells(s, sf).select(TS, ID, BAR, F.col("r1").alias("ret"))


def axis(s, sf):
    return panel(s, sf, "month").select(TS, BAR).distinct()


PLACED = ", pl AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY ts, score IS NULL ORDER BY score, instrument_id) END AS place, count(score) OVER (PARTITION BY ts) AS names FROM w)"
STICKY = PLACED + """, ev AS (SELECT *, coalesce(last_value(CASE WHEN place > names - {long} THEN true WHEN place <= {short} THEN false END IGNORE NULLS) OVER v, false) AS l,
  coalesce(last_value(CASE WHEN place <= {short} THEN true WHEN place > names - {long} THEN false END IGNORE NULLS) OVER v, false) AS sh FROM pl WINDOW v AS (PARTITION BY instrument_id ORDER BY ts)),
  bs AS (SELECT ts, instrument_id, 1 AS side FROM ev WHERE l UNION ALL SELECT ts, instrument_id, -1 FROM ev WHERE sh)"""
q("sticky_selection", (STICKY.format(long=10, short=5), "SELECT ts, instrument_id, side / (count(*) OVER (PARTITION BY ts))::DOUBLE AS weight FROM bs"),
  lambda s, sf: P.sticky_selection(scores(s, sf), 10, 5), ["weight"])
q("buffered_selection", (PLACED + """, rb AS (SELECT pl.*, floor(names * 0.4) AS mid FROM pl WHERE bar % 3 = 0),
  ev AS (SELECT *, coalesce(last_value(CASE WHEN place <= 8 THEN 1 WHEN place - 1 > mid THEN 0 END IGNORE NULLS) OVER v, 0) AS l, coalesce(last_value(CASE WHEN place > names - 8 THEN 1 WHEN place - 1 < mid THEN 0 END IGNORE NULLS) OVER v, 0) AS sh
  FROM rb WINDOW v AS (PARTITION BY instrument_id ORDER BY ts))""", "SELECT ts, instrument_id, CASE WHEN l = 1 THEN 1 ELSE -1 END AS side FROM ev WHERE l = 1 OR sh = 1"),
  lambda s, sf: P.buffered_selection(scores(s, sf), 8, 0.4, 3, axis(s, sf)))


def signals(s, sf):
    f = FactorSet({}, {"score": lambda o: o.if_else(o.close > o.delay(o.ts_max(o.high, 6), 1), 1, o.if_else(o.close < o.delay(o.ts_min(o.low, 6), 1), -1, 0)), "mean": lambda o: o.ts_mean(o.close, 4)})
    return f.evaluate(panel(s, sf, "month"), keep=("close",))


q("threshold_positions", (""", sg AS (SELECT instrument_id, ts, "close", CASE WHEN coalesce("close" > hi, false) THEN 1 WHEN coalesce("close" < lo, false) THEN -1 ELSE 0 END AS score, mean FROM (SELECT *,
   CASE WHEN count(high) OVER p = 6 THEN max(high) OVER p END AS hi, CASE WHEN count(low) OVER p = 6 THEN min(low) OVER p END AS lo, CASE WHEN count("close") OVER m = 4 THEN avg("close") OVER m END AS mean
   FROM panel WINDOW p AS (PARTITION BY instrument_id ORDER BY bar ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY instrument_id ORDER BY bar ROWS 3 PRECEDING))),
  nb AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS k FROM sg),
  st AS (SELECT instrument_id, ts, k, score AS side FROM nb WHERE k = 1 UNION ALL
    SELECT n.instrument_id, n.ts, n.k, CASE WHEN st.side = 0 THEN n.score WHEN st.side = 1 AND coalesce(n."close" < n.mean, false) THEN 0 WHEN st.side = -1 AND coalesce(n."close" > n.mean, false) THEN 0 ELSE st.side END
    FROM st JOIN nb n ON n.instrument_id = st.instrument_id AND n.k = st.k + 1)""", "SELECT ts, instrument_id, side FROM st"),
  lambda s, sf: P.threshold_positions(signals(s, sf), 1.0), base=BASE.replace("WITH", "WITH RECURSIVE", 1))
QUERIES["dropout_selection"] = (lambda s, sf: P.dropout_selection(scores(s, sf).withColumn("portfolio", F.lit("main")), 10, 2), None)


def alpha(delay, decay, limit):
    return lambda s, sf: P.alpha_weights(cells(s, sf).select(TS, ID, BAR, "score"), delay, decay, limit).where("weight <> 0")


ALPHA = """, d0 AS (SELECT *, lag(score) OVER (PARTITION BY instrument_id ORDER BY bar) AS sc1 FROM w), d AS (SELECT instrument_id, ts, bar, sc1 - avg(sc1) OVER (PARTITION BY ts) AS a FROM d0 WHERE bar >= 1),
  e AS (SELECT instrument_id, ts, bar, coalesce(CASE WHEN sum(abs(a)) OVER (PARTITION BY ts) = 0 THEN a ELSE a / sum(abs(a)) OVER (PARTITION BY ts) END, 0) AS a FROM d),
  fb AS (SELECT min(bar) AS b FROM d WHERE a IS NOT NULL), f AS (SELECT instrument_id, ts, bar, greatest(least(bar - b + 1, 3), 0) * a + greatest(least(bar - b + 1, 3) - 1, 0) * coalesce(lag(a, 1) OVER v, 0) + greatest(least(bar - b + 1, 3) - 2, 0) * coalesce(lag(a, 2) OVER v, 0) AS a FROM e, fb WINDOW v AS (PARTITION BY instrument_id ORDER BY bar)),
  t0 AS (SELECT instrument_id, ts, CASE WHEN sum(abs(a)) OVER (PARTITION BY ts) = 0 THEN a ELSE a / sum(abs(a)) OVER (PARTITION BY ts) END AS a, false AS done FROM f)"""
for _i in range(1, 21):
    ALPHA += f""", u{_i} AS (SELECT instrument_id, ts, done, a AS old, greatest(-0.04, least(0.04, a)) AS a FROM t{_i - 1}), t{_i} AS MATERIALIZED (SELECT instrument_id, ts, CASE WHEN done THEN old ELSE n END AS a, done OR max(abs(n)) OVER (PARTITION BY ts) <= 0.04 + 1e-10 AS done
  FROM (SELECT *, CASE WHEN sum(abs(a)) OVER (PARTITION BY ts) = 0 THEN a ELSE a / sum(abs(a)) OVER (PARTITION BY ts) END AS n FROM u{_i}))"""
q("alpha_weights", (ALPHA, "SELECT ts, instrument_id, a AS weight FROM t20 WHERE a <> 0"), alpha(1, 3, 0.04), ["weight"])


def side_at(s, sf, when, top):
    return P.sticky_selection(scores(s, sf).where(F.col(TS) == when), top, top).select(ID, F.signum("weight").cast("int").alias("side"))


SIDES = PLACED + """, was AS (SELECT instrument_id, CASE WHEN place > names - 20 THEN 1 WHEN place <= 20 THEN -1 END AS was FROM pl WHERE ts = TIMESTAMP '1996-05-01' AND (place > names - 20 OR place <= 20)),
  goal AS (SELECT instrument_id, CASE WHEN place > names - 15 THEN 1 WHEN place <= 15 THEN -1 END AS goal FROM pl WHERE ts = TIMESTAMP '1996-07-01' AND (place > names - 15 OR place <= 15)),
  tg AS (SELECT *, CASE WHEN was IS NULL THEN 'NEW' WHEN goal = was THEN 'HOLD' WHEN goal IS NOT NULL THEN 'FLIP' WHEN instrument_id IN (SELECT instrument_id FROM sc WHERE ts = TIMESTAMP '1996-07-01') THEN 'DROPPED' ELSE 'NO_FACTOR_DATA' END AS tag FROM was FULL JOIN goal USING (instrument_id))"""
q("rebalance_tags", (SIDES, "SELECT instrument_id, was::DOUBLE AS was, goal::DOUBLE AS goal, tag, tag IN ('FLIP', 'DROPPED', 'NO_FACTOR_DATA') AS \"first\" FROM tg"),
  lambda s, sf: P.rebalance(side_at(s, sf, "1996-05-01", 20), side_at(s, sf, "1996-07-01", 15), scores(s, sf).where("ts = '1996-07-01' AND score IS NOT NULL")))
q("target_value_equal", "SELECT ts, instrument_id, weight, sign(weight) * 1000 * CASE WHEN weight > 0 THEN 0.6 ELSE 0.4 END / count(*) OVER (PARTITION BY ts, sign(weight)) AS value FROM wt WHERE weight <> 0",
  lambda s, sf: P.target_value(weights(s, sf).where("weight <> 0"), "equal", 1000.0, 0.6), ["weight", "value"])
q("target_value_fixed", "SELECT ts, instrument_id, weight, sign(weight) * 50.0::DOUBLE AS value FROM wt", lambda s, sf: P.target_value(weights(s, sf), "fixed", 50.0), ["weight", "value"])
q("target_value_weighted", "SELECT ts, instrument_id, weight, weight * 1000 AS value FROM wt", lambda s, sf: P.target_value(weights(s, sf), "weighted", 1000.0), ["weight", "value"])
q("concentration", "SELECT ts, sum(weight * weight) / pow(sum(abs(weight)), 2) AS herfindahl, pow(sum(abs(weight)), 2) / sum(weight * weight) AS effective_n, max(abs(weight)) AS max_weight FROM wt GROUP BY 1",
  lambda s, sf: P.concentration(weights(s, sf)), ["herfindahl", "effective_n", "max_weight"])
q("exposure", "SELECT ts, sum(abs(weight)) AS gross, sum(weight) AS net, coalesce(sum(weight) FILTER (weight > 0), 0) AS long, coalesce(-sum(weight) FILTER (weight < 0), 0) AS short FROM wt GROUP BY 1",
  lambda s, sf: P.exposure(weights(s, sf)), ["gross", "net", "long", "short"])
FEXP = ", fe AS (SELECT ts, factor, sum(weight * value) AS exposure FROM wt JOIN vals USING (ts, instrument_id) GROUP BY 1, 2)"
q("factor_exposure", (FEXP, "SELECT * FROM fe"), lambda s, sf: P.factor_exposure(weights(s, sf), values(s, sf)), ["exposure"])
SEXP = f", {SECTOR_SQL}, se AS (SELECT ts, coalesce(sector, 'Other') AS sector, sum(weight) AS exposure FROM wt LEFT JOIN sectors USING (instrument_id) GROUP BY 1, 2)"
q("sector_exposure", (SEXP, "SELECT * FROM se"), lambda s, sf: P.sector_exposure(weights(s, sf), sectors(s, sf)), ["exposure"])


def sector_limits(s, sf):
    return sectors(s, sf).groupBy("sector").agg((F.count(F.lit(1)) / 300).alias("limit"))


q("limit_breaches", (SEXP + ", lm AS (SELECT sector, count(*) / 300.0::DOUBLE AS \"limit\" FROM sectors GROUP BY 1)", "SELECT ts, sector, exposure, \"limit\", abs(exposure) - \"limit\" AS excess FROM se JOIN lm USING (sector) WHERE abs(exposure) > \"limit\""),
  lambda s, sf: P.breaches(P.sector_exposure(weights(s, sf), sectors(s, sf)), sector_limits(s, sf), "sector"), ["exposure", "limit", "excess"])
FRET = ", fr AS (SELECT ts, factor, avg(value * r1) AS ret FROM vals JOIN (SELECT ts, instrument_id, r1 FROM w) USING (ts, instrument_id) WHERE r1 IS NOT NULL GROUP BY 1, 2)"


def factor_returns(s, sf):
    return values(s, sf).join(rets(s, sf), [TS, ID]).where("ret IS NOT NULL").groupBy(TS, "factor").agg(F.avg(F.col("value") * F.col("ret")).alias("ret"))


q("attribution", (FEXP + FRET + """, bf AS (SELECT ts, factor, exposure * ret AS contribution FROM fe JOIN fr USING (ts, factor)), tt AS (SELECT ts, sum(weight * r1) AS total FROM wt JOIN (SELECT ts, instrument_id, r1 FROM w) USING (ts, instrument_id) GROUP BY 1)""",
  "SELECT * FROM bf UNION ALL SELECT ts, 'specific', total - coalesce(x, 0) FROM tt LEFT JOIN (SELECT ts, sum(contribution) AS x FROM bf GROUP BY 1) USING (ts)"),
  lambda s, sf: P.attribution(weights(s, sf), values(s, sf), factor_returns(s, sf), rets(s, sf)), ["contribution"])
FCOV = FRET + ", fp AS (SELECT ts, max(ret) FILTER (factor = 'mom') AS mom, max(ret) FILTER (factor = 'size') AS size FROM fr GROUP BY 1), fcv AS (SELECT 'mom' AS i, 'mom' AS j, var_samp(mom) AS value FROM fp UNION ALL SELECT 'size', 'size', var_samp(size) FROM fp UNION ALL SELECT 'mom', 'size', covar_samp(mom, size) FROM fp UNION ALL SELECT 'size', 'mom', covar_samp(mom, size) FROM fp)"


def factor_cov(s, sf):
    return K.factor_covariance(factor_returns(s, sf).groupBy(TS).pivot("factor", ["mom", "size"]).agg(F.first("ret")), ["mom", "size"])


def specific(s, sf):
    return rets(s, sf).groupBy(ID).agg(F.var_pop("ret").alias("var"))


q("factor_covariance", (FCOV, "SELECT * FROM fcv"), lambda s, sf: factor_cov(s, sf), ["value"])
SPEC = ", sp AS (SELECT instrument_id, var_pop(r1) AS \"var\" FROM w GROUP BY 1)"
q("risk_budget", (FEXP + FCOV + SPEC + """, rb AS (SELECT a.ts, a.factor, sum(a.exposure * c.value * b.exposure) AS variance FROM fe a JOIN fcv c ON c.i = a.factor JOIN fe b ON b.ts = a.ts AND b.factor = c.j GROUP BY 1, 2
  UNION ALL SELECT ts, 'specific', sum(weight * weight * "var") FROM wt JOIN sp USING (instrument_id) GROUP BY 1)""", "SELECT *, variance / sum(variance) OVER (PARTITION BY ts) AS share FROM rb"),
  lambda s, sf: P.risk_budget(P.factor_exposure(weights(s, sf), values(s, sf)), factor_cov(s, sf), specific(s, sf), weights(s, sf)), ["variance", "share"])
q("asset_covariance", (FCOV + SPEC + ", xx AS (SELECT instrument_id, factor, value FROM vals WHERE ts = TIMESTAMP '1998-03-01')",
  "SELECT a.instrument_id AS i, b.instrument_id AS j, sum(a.value * c.value * b.value) + CASE WHEN a.instrument_id = b.instrument_id THEN max(\"var\") ELSE 0 END AS value FROM xx a JOIN fcv c ON c.i = a.factor JOIN xx b ON b.factor = c.j JOIN sp ON sp.instrument_id = a.instrument_id GROUP BY 1, 2, a.instrument_id, b.instrument_id"),
  lambda s, sf: K.asset_covariance(values(s, sf).where("ts = '1998-03-01'"), factor_cov(s, sf), specific(s, sf)), ["value"])
q("value_at_risk", (", ln AS (SELECT ts, sum(x.weight * r1) AS ret FROM w JOIN (SELECT instrument_id, weight FROM wt WHERE ts = TIMESTAMP '1998-03-01') x USING (instrument_id) GROUP BY 1)",
  "SELECT count(ret) AS n, -max(e) AS \"var\", -avg(ret) FILTER (ret <= e) AS cvar FROM ln CROSS JOIN (SELECT quantile_cont(ret, 0.05) AS e FROM ln)"),
  lambda s, sf: P.value_at_risk(weights(s, sf).where("ts = '1998-03-01'").select(ID, "weight"), rets(s, sf).where("ret IS NOT NULL")), ["var", "cvar"])
q("simple_returns", "SELECT ts, instrument_id, bar, ret FROM rt", lambda s, sf: K.simple_returns(panel(s, sf, "month")), ["ret"])
PREP = """, c1 AS (SELECT ts, instrument_id, bar, coalesce(CASE WHEN ret IS NOT NULL THEN greatest(lo, least(hi, ret)) END, 0) * 100 AS x FROM rt JOIN (SELECT instrument_id, quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM rt GROUP BY 1) USING (instrument_id)),
  pr AS MATERIALIZED (SELECT ts, instrument_id, bar, x - avg(x) OVER (PARTITION BY instrument_id) AS ret FROM c1)"""


def prep(s, sf):
    return K.prepared(rets(s, sf), 0.1, True, True, True)


q("prepared_returns", (PREP, "SELECT * FROM pr"), prep, ["ret"])
COV = PREP + ", cv AS MATERIALIZED (SELECT a.instrument_id AS i, b.instrument_id AS j, sum(a.ret * b.ret) / (SELECT count(DISTINCT bar) FROM pr) AS s FROM pr a JOIN pr b USING (bar) GROUP BY 1, 2)"
q("covariance_matrix", (COV, "SELECT i, j, s AS value FROM cv"), lambda s, sf: K.covariance(prep(s, sf)), ["value"])


TARGET = COV + """, mk AS (SELECT bar, avg(ret) AS m FROM pr GROUP BY 1), mv AS (SELECT avg(m * m) AS v FROM mk), cm AS (SELECT instrument_id, sum(ret * m) / (SELECT count(*) FROM mk) AS c FROM pr JOIN mk USING (bar) GROUP BY 1),
  dg AS (SELECT i, s AS v FROM cv WHERE i = j), rbar AS (SELECT avg(s / sqrt(a.v * b.v)) AS r FROM cv JOIN dg a ON a.i = cv.i JOIN dg b ON b.i = cv.j WHERE cv.i <> cv.j),
  tg AS (SELECT cv.i, cv.j, s, CASE WHEN cv.i = cv.j THEN (SELECT avg(v) FROM dg) ELSE 0 END AS constant_variance, CASE WHEN cv.i = cv.j THEN a.v ELSE r * sqrt(a.v * b.v) END AS constant_correlation,
  CASE WHEN cv.i = cv.j THEN a.v ELSE x.c * y.c / (SELECT v FROM mv) END AS single_factor FROM cv JOIN dg a ON a.i = cv.i JOIN dg b ON b.i = cv.j JOIN cm x ON x.instrument_id = cv.i JOIN cm y ON y.instrument_id = cv.j CROSS JOIN rbar)"""
q("shrink_targets", (TARGET, "SELECT * FROM tg"), lambda s, sf: K.targets(prep(s, sf)).select("i", "j", "s", "constant_variance", "constant_correlation", "single_factor"),
  ["s", "constant_variance", "constant_correlation", "single_factor"])
q("shrunk_covariance", (TARGET, "SELECT i, j, 0.7 * s + 0.3 * constant_correlation AS value FROM tg"), lambda s, sf: K.shrunk(K.targets(prep(s, sf)), "constant_correlation", 0.3), ["value"])


q("shrink_intensity", (TARGET + """, sums AS (SELECT sum(s * s) AS tr2, sum(s) FILTER (i = j) AS tr, sqrt(count(*)) AS p FROM cv), T AS (SELECT count(*)::DOUBLE AS n FROM mk),
  ph AS (SELECT a.instrument_id AS i, b.instrument_id AS j, avg(pow(a.ret, 2) * pow(b.ret, 2)) AS y22, avg(pow(a.ret, 3) * b.ret) AS y31, avg(pow(a.ret, 2) * b.ret * m) AS y21m, avg(a.ret * b.ret * m * m) AS y11 FROM pr a JOIN pr b USING (bar) JOIN mk USING (bar) GROUP BY 1, 2),
  al AS (SELECT tg.*, y22, y31, y21m, y11, a.v AS vi, b.v AS vj, x.c AS ci, y.c AS cj FROM tg JOIN ph USING (i, j) JOIN dg a ON a.i = tg.i JOIN dg b ON b.i = tg.j JOIN cm x ON x.instrument_id = tg.i JOIN cm y ON y.instrument_id = tg.j),
  ag AS (SELECT sum(y22 - s * s) AS phi, sum(y22 - s * s) FILTER (i = j) AS phid, sum(sqrt(vj / vi) * (y31 - vi * s)) FILTER (i <> j) AS th, sum((y21m - ci * s) * cj) FILTER (i <> j) AS v1, sum((y11 - (SELECT v FROM mv) * s) * ci * cj) FILTER (i <> j) AS v3,
   sum(pow(s - constant_variance, 2)) AS g1, sum(pow(s - constant_correlation, 2)) AS g2, sum(pow(s - single_factor, 2)) AS g3 FROM al)""",
  """SELECT greatest(0, least(1, (1 - 2 / p) * (tr2 + tr * tr) / ((n + 1 - 2 / p) * (tr2 + tr * tr / p)))) AS oas, greatest(0, least(1, phi / g1 / n)) AS lw_constant_variance,
  greatest(0, least(1, (phi - phid - r * th) / g2 / n)) AS lw_constant_correlation, greatest(0, least(1, (phi - phid - (2 * v1 / v - v3 / (v * v))) / g3 / n)) AS lw_single_factor FROM sums, T, ag, rbar, mv"""),
  lambda s, sf: K.intensity(prep(s, sf)), ["oas", "lw_constant_variance", "lw_constant_correlation", "lw_single_factor"])
QUERIES["pca_risk_model"] = (lambda s, sf: rounded(K.principal_factors(prep(s, sf), 3)[0], 5), None)
q("style_exposures", (", al AS (SELECT ts, instrument_id, factor, coalesce(value, 0) AS x FROM (SELECT ts, instrument_id, mom, size FROM w) UNPIVOT INCLUDE NULLS (value FOR factor IN (mom, size)))",
  "SELECT ts, instrument_id, factor, greatest(-1.5, least(1.5, CASE WHEN stddev_pop(x) OVER c > 0 THEN (x - avg(x) OVER c) / stddev_pop(x) OVER c ELSE 0 END)) AS value FROM al WINDOW c AS (PARTITION BY ts, factor)"),
  lambda s, sf: K.style_exposure(cells(s, sf).unpivot([TS, ID], ["mom", "size"], "factor", "value"), 1.5), ["value"])
_R = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
QUERIES["sector_dummies"] = (lambda s, sf: K.sector_dummies(sectors(s, sf), _R), f"WITH {SECTOR_SQL} SELECT instrument_id, " + ", ".join(f"(sector = '{x}')::DOUBLE AS \"{x}\"" for x in _R) + " FROM sectors")


def regression(s, sf):
    rows = cells(s, sf).join(panel(s, sf, "month").select(TS, ID, F.sqrt("volume").alias("w")), [TS, ID]).withColumn("ret", F.col("r1")).withColumn("one", F.lit(1.0))
    return K.cross_sectional_regression(rows, ["one", "size"])


q("cross_sectional_regression", (""", g AS (SELECT ts, instrument_id, r1 AS y, size AS x, sqrt(volume) AS k FROM w JOIN (SELECT ts, instrument_id, volume FROM panel) USING (ts, instrument_id) WHERE r1 IS NOT NULL AND size IS NOT NULL),
  m AS (SELECT *, sum(k * x) OVER v / sum(k) OVER v AS mx, sum(k * y) OVER v / sum(k) OVER v AS my FROM g WINDOW v AS (PARTITION BY ts)), b AS (SELECT *, sum(k * (x - mx) * (y - my)) OVER v / sum(k * pow(x - mx, 2)) OVER v AS b FROM m WINDOW v AS (PARTITION BY ts))""",
  "SELECT ts, instrument_id, y - my - b * (x - mx) AS residual, my - b * mx AS b_one, b AS b_size FROM b"), regression, ["residual", "b_one", "b_size"])
q("specific_variance", (", rv AS (SELECT instrument_id, var_pop(r1) AS v, sqrt(sum(volume)) AS k FROM w JOIN (SELECT ts, instrument_id, volume FROM panel) USING (ts, instrument_id) GROUP BY 1)",
  "SELECT instrument_id, 0.5 * v + 0.5 * (SELECT sum(v * k) / sum(k) FROM rv) AS \"var\" FROM rv"),
  lambda s, sf: K.specific_variance(rets(s, sf).withColumnRenamed("ret", "residual"), panel(s, sf, "month").groupBy(ID).agg(F.sqrt(F.sum("volume")).alias("w"))), ["var"])

# ---- reports
EQ = """WITH eq AS (SELECT 'A' || (o_custkey % 5) AS account, o_orderdate AS day, max(o_totalprice) + 100000 AS equity FROM orders GROUP BY 1, 2),
  de AS MATERIALIZED (SELECT *, equity / lag(equity) OVER (PARTITION BY account ORDER BY day) - 1 AS ret FROM eq)"""


def daily(s, sf):
    t = table(s, sf, "orders").groupBy(F.concat(F.lit("A"), F.col("o_custkey") % 5).alias("account"), F.col("o_orderdate").alias(TS)).agg((F.max("o_totalprice") + 100000).alias("equity"))
    return P.daily_equity(t, "account")


q("daily_equity", "SELECT * FROM de", daily, ["equity", "ret"], EQ)
q("performance", (", pk AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY day) AS peak FROM de)", "SELECT account, min(equity / peak - 1) AS max_drawdown, last(equity ORDER BY day) - first(equity ORDER BY day) AS profit, avg(ret) / stddev_samp(ret) * sqrt(365) AS sharpe, avg((ret > 0)::INT) AS win_rate FROM pk GROUP BY 1"),
  lambda s, sf: P.performance(daily(s, sf), "account"), ["max_drawdown", "profit", "sharpe", "win_rate"], EQ)
q("drawdown_rules", (", pk AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS peak FROM de)", "SELECT account, day, equity, peak, equity / peak < 0.7 AS drawdown_hit, equity < 200000 AS floor_hit FROM pk"),
  lambda s, sf: P.drawdown_rules(daily(s, sf), "account", 30, 0.7, 200000.0), ["equity", "peak"], EQ)


def marked(s, sf):
    pos = table(s, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("account"), F.concat(F.lit("S"), "l_suppkey").alias(ID), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry"))
    price = table(s, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias(ID), F.abs("s_acctbal").alias("price"))
    balance = table(s, sf, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("balance"))
    return P.marked_equity(balance, pos, price, "account").select("account", "balance", F.round("equity", 3).alias("equity"))


QUERIES["marked_equity"] = (marked, """SELECT account, balance, round(balance + coalesce(u, 0), 3) AS equity FROM (SELECT c_custkey AS account, c_acctbal AS balance FROM customer) LEFT JOIN (
  SELECT l_orderkey % 40 AS account, sum(l_quantity * (abs(s_acctbal) - l_extendedprice / l_quantity)) AS u FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) USING (account)""")
q("position_timeline", "SELECT t, count(*) FILTER (side = 'long') AS longs, count(*) FILTER (side = 'short') AS shorts, coalesce(sum(value) FILTER (side = 'long'), 0) AS long_value, coalesce(sum(value) FILTER (side = 'short'), 0) AS short_value FROM active GROUP BY 1",
  lambda s, sf: P.position_timeline(sample_times(s, sf), positions(s, sf)), ["long_value", "short_value"], f"WITH {POSITIONS_SQL}")


def executions(s, sf):
    k = F.col("l_orderkey")
    return table(s, sf, "lineitem").select(k.alias("order_id"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("filled"),
        F.col("l_extendedprice").alias("anchor_price"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("fill_price"), F.col("l_shipdate").alias("created"),
        F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 60).cast("timestamp_ntz").alias("completed"),
        F.concat(F.lit("V"), F.col("l_suppkey") % 4).alias("venue"), F.element_at(F.array(*map(F.lit, ("active", "completed", "failed"))), (F.col("l_partkey") % 3 + 1).cast("int")).alias("status"),
        F.col("l_linenumber").alias("chases"), F.when(F.col("l_returnflag") == "A", "limit").when(F.col("l_returnflag") == "N", "market").alias("kind"), (F.col("l_linestatus") == "F").alias("fallback"))


q("execution_report", "SELECT l_orderkey AS order_id, CASE WHEN l_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 1 - l_discount AS fill_ratio, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END * l_extendedprice * l_tax AS slippage, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END * l_tax * 10000 AS slippage_bps, l_linenumber * 60.0::DOUBLE AS elapsed FROM lineitem",
  lambda s, sf: P.execution_report(executions(s, sf)), ["fill_ratio", "slippage", "slippage_bps"], "WITH d AS (SELECT 1)")
q("execution_summary", "SELECT 'V' || (l_suppkey % 4) AS venue, count(*) FILTER (l_partkey % 3 = 0) AS active, count(*) FILTER (l_partkey % 3 = 1) AS completed, count(*) FILTER (l_partkey % 3 = 2) AS failed, sum(l_linenumber)::BIGINT AS chases, count(*) FILTER (l_linestatus = 'F') AS fallbacks, coalesce(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag IN ('A', 'N')), 0), 1)::DOUBLE AS limit_share FROM lineitem GROUP BY 1",
  lambda s, sf: P.execution_summary(executions(s, sf)), ["limit_share"], "WITH d AS (SELECT 1)")
q("account_snapshot", "SELECT s_nationkey AS account, count(*) FILTER (s_acctbal > 0) AS longs, count(*) FILTER (s_acctbal < 0) AS shorts, sum(abs(s_acctbal)) AS gross, sum(s_acctbal) AS net FROM supplier GROUP BY 1",
  lambda s, sf: P.account_snapshot(table(s, sf, "supplier").select(F.col("s_nationkey").alias("account"), F.col("s_acctbal").alias("value")), "account"), ["gross", "net"], "WITH d AS (SELECT 1)")
q("factor_snapshot", "SELECT factor, instrument_id, value, row_number() OVER (PARTITION BY factor ORDER BY value DESC, instrument_id)::INT AS place, datediff('day', ts, TIMESTAMP '2002-01-01') * 86400.0::DOUBLE AS age FROM (SELECT factor, instrument_id, last(value ORDER BY ts) AS value, max(ts) AS ts FROM vals GROUP BY 1, 2)",
  lambda s, sf: P.factor_snapshot(values(s, sf), F.lit("2002-01-01").cast("timestamp")), ["value"])
q("common_universe", (COV, "SELECT w.instrument_id, mom AS value, s AS variance, coalesce(x.weight, 0) AS weight FROM (SELECT * FROM w WHERE ts = TIMESTAMP '1998-03-01' AND mom IS NOT NULL) w JOIN cv ON cv.i = w.instrument_id AND cv.j = w.instrument_id LEFT JOIN (SELECT * FROM wt WHERE ts = TIMESTAMP '1998-02-01' AND weight > 0) x USING (instrument_id)"),
  lambda s, sf: P.common_universe(values(s, sf).where("ts = '1998-03-01' AND factor = 'mom'").select(ID, "value"), K.variances(prep(s, sf)), weights(s, sf).where("ts = '1998-02-01' AND weight > 0").select(ID, "weight")), ["value", "variance", "weight"])
_names = ["entry_long", "entry_short", "exit_long", "exit_short"]


class _Breakout(FactorSet):
    def build(self, board):
        return {n: board.name(n, t) for n, t in P.breakout(board, 5, 3, 8).items()}


BREAK = _Breakout({}, {n: None for n in _names})
# by hand: five closes before the bar, the bar's own three-bar mean, eight closes beyond it to leave; see the argument order of the library
QUERIES["breakout_signal"] = (lambda s, sf: BREAK.evaluate(panel(s, sf)).drop(BAR), panel_sql() + """,
b AS (SELECT *, CASE WHEN count("close") OVER p = 5 THEN max("close") OVER p END AS top, CASE WHEN count("close") OVER p = 5 THEN min("close") OVER p END AS low5,
  CASE WHEN count(volume) OVER p = 5 THEN max(volume) OVER p END AS most, CASE WHEN count("close") OVER m = 8 THEN avg("close") OVER m END AS mean
  FROM panel WINDOW p AS (PARTITION BY instrument_id ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY instrument_id ORDER BY bar ROWS 7 PRECEDING)),
x AS (SELECT *, coalesce("close" < mean, false)::INT AS under, coalesce("close" > mean, false)::INT AS over FROM b)
SELECT instrument_id, ts, coalesce("close" > top AND volume > most AND "close" > mean, false)::INT::DOUBLE AS entry_long, coalesce("close" < low5 AND volume > most AND "close" < mean, false)::INT::DOUBLE AS entry_short,
  coalesce(sum(under) OVER e >= 3 AND count(*) OVER e = 3, false)::INT::DOUBLE AS exit_long, coalesce(sum(over) OVER e >= 3 AND count(*) OVER e = 3, false)::INT::DOUBLE AS exit_short
FROM x WINDOW e AS (PARTITION BY instrument_id ORDER BY bar ROWS 2 PRECEDING)""")
q("factor_set_coverage", "SELECT factor, count(*) AS n FROM vals GROUP BY 1 HAVING count(*) >= 0.9 * (SELECT count(*) FROM panel)",
  lambda s, sf: covered(values(s, sf), panel(s, sf, "month").agg(F.count(F.lit(1))).scalar()))
