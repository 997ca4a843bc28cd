"""Checks of signal quality: two factors and two horizons over the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.factorset import melt
from barley.operators.spec import BAR, ID, TS
from barley.plans import quality as Q

from oracle.base import FIELDS, QUERIES, check, panel, panel_sql, r, rs
from oracle.sqlboard import factor_sql

FACTORS = {"mom": lambda o: o.close / o.delay(o.close, 3) - 1, "vol": lambda o: o.volume - o.ts_mean(o.volume, 6)}
STUDY = FactorSet({}, FACTORS)
_ctes, _out = factor_sql(STUDY, FIELDS)
BASE = panel_sql("month") + ",\n" + ",\n".join(_ctes) + f""",
wide AS MATERIALIZED (SELECT instrument_id, ts, bar, {', '.join(f'{e} AS {n}' for n, e in _out.items())} FROM cells),
vals AS MATERIALIZED (SELECT ts, instrument_id, 'mom' AS factor, mom AS value FROM wide WHERE mom IS NOT NULL
  UNION ALL SELECT ts, instrument_id, 'vol', vol FROM wide WHERE vol IS NOT NULL),
rets AS MATERIALIZED (SELECT * FROM (SELECT a.ts, a.instrument_id, h AS horizon, b."close" / a."close" - 1 AS fwd_ret FROM panel a
  CROSS JOIN (SELECT unnest([1, 3]) AS h) JOIN panel b ON b.instrument_id = a.instrument_id AND b.bar = a.bar + h) WHERE fwd_ret IS NOT NULL),
pairs AS MATERIALIZED (SELECT * FROM vals JOIN rets USING (ts, instrument_id))"""


def ranked(x, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE)"


def corr(x, y):
    """With the roles of the guard made explicit."""
    return f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END"


IC = f""", ic AS MATERIALIZED (SELECT ts, factor, horizon, CASE WHEN count(*) >= 5 THEN {corr('a', 'b')} END AS ic FROM (
  SELECT *, {ranked('value', 'ts, factor, horizon')} AS a, {ranked('fwd_ret', 'ts, factor, horizon')} AS b FROM pairs) GROUP BY 1, 2, 3)"""
BUCKETS = """, bucketed AS MATERIALIZED (SELECT p.*, len(list_filter(e.q, lambda x: x < p.value)) + 1 AS bucket FROM pairs p JOIN (
  SELECT ts, factor, horizon, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM pairs GROUP BY 1, 2, 3) e USING (ts, factor, horizon))"""
S = "factor, horizon"


def wide(spark, sf):
    return STUDY.evaluate(panel(spark, sf, "month"))


def values(spark, sf):
    return melt(wide(spark, sf), list(FACTORS))


def returns(spark, sf):
    return Q.forward_returns(panel(spark, sf, "month"), [1, 3])


def pairs(spark, sf):
    return Q.pair(values(spark, sf), returns(spark, sf))


def ic(spark, sf, **k):
    return Q.information(values(spark, sf), returns(spark, sf), **k)


def bucketed(spark, sf):
    return Q.with_buckets(pairs(spark, sf))


def axis(spark, sf):
    return panel(spark, sf, "month").select(TS, BAR).distinct()


def rounded(df, digits=6):
    types = dict(df.dtypes)
    return df.select(*[r(c, digits).alias(c) if types[c] == "double" else F.col(c) for c in df.columns])


def q(name, sql, query, floats):
    """``floats`` are the columns to round in the SQL result ``out``."""
    if sql is not None:
        replaced = ", ".join(f'{rs(chr(34) + c + chr(34))} AS "{c}"' for c in floats)
        sql = f"{BASE} {sql[0]}, out AS ({sql[1]}) SELECT * REPLACE ({replaced}) FROM out" if floats else f"{BASE} {sql[0]}, out AS ({sql[1]}) SELECT * FROM out"
    QUERIES[name] = (lambda s, sf: rounded(query(s, sf)), sql)


q("forward_returns", ("", "SELECT * FROM rets"), returns, ["fwd_ret"])
q("outlier_filter", (f""", st AS (SELECT {S}, avg(fwd_ret) m, stddev_samp(fwd_ret) s, count(*) n FROM pairs GROUP BY 1, 2),
  kept AS (SELECT p.*, n FROM pairs p JOIN st USING ({S}) WHERE abs(fwd_ret - m) <= 2.0 * s)""",
  f"SELECT {S}, ts, instrument_id, value, fwd_ret, loss, loss > 0.04 AS lost_too_much FROM kept JOIN (SELECT {S}, 1 - count(*) / max(n)::DOUBLE AS loss FROM kept GROUP BY 1, 2) USING ({S}) "),
  lambda s, sf: Q.drop_outliers(pairs(s, sf), 2.0, 0.04), ["value", "fwd_ret", "loss"])
q("outlier_filter_with_join_losses", (f""", st AS (SELECT {S}, avg(fwd_ret) m, stddev_samp(fwd_ret) s FROM pairs GROUP BY 1, 2), al AS (SELECT factor, count(*) AS n FROM vals GROUP BY 1),
  kept AS (SELECT p.*, n FROM pairs p JOIN st USING ({S}) JOIN al USING (factor) WHERE abs(fwd_ret - m) <= 2.0 * s)""",
  f"SELECT {S}, count(*) AS n, 1 - count(*) / max(n)::DOUBLE AS loss, 1 - count(*) / max(n)::DOUBLE > 0.06 AS lost_too_much FROM kept GROUP BY 1, 2"),
  lambda s, sf: Q.drop_outliers(pairs(s, sf), 2.0, 0.06, values(s, sf).groupBy("factor").agg(F.count("value").alias("n"))).groupBy("factor", "horizon")
  .agg(F.count(F.lit(1)).alias("n"), F.max("loss").alias("loss"), F.bool_or("lost_too_much").alias("lost_too_much")), ["loss"])
q("quantile_buckets", (BUCKETS, "SELECT * FROM bucketed"), lambda s, sf: bucketed(s, sf), ["value", "fwd_ret"])
q("ic_common_ranks", (IC, "SELECT * FROM ic"), ic, ["ic"])
q("ic_own_ranks", ("", f"""SELECT ts, factor, horizon, CASE WHEN count(*) >= 5 THEN {corr('a', 'b')} END AS ic FROM (
  SELECT *, {ranked('value', 'ts, factor')} AS a FROM vals) JOIN (SELECT *, {ranked('fwd_ret', 'ts, horizon')} AS b FROM rets) USING (ts, instrument_id) GROUP BY 1, 2, 3"""),
  lambda s, sf: ic(s, sf, common=False), ["ic"])
q("ic_summary", (IC, f"""SELECT {S}, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS icir,
  avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t, avg(pow(ic - m, 3)) / pow(stddev_pop(ic), 3) AS skew,
  avg(pow(ic - m, 4)) / pow(stddev_pop(ic), 4) - 3 AS kurt, count(ic) AS n, count(*) - count(ic) AS missing
  FROM (SELECT *, avg(ic) OVER (PARTITION BY {S}) AS m FROM ic) GROUP BY 1, 2"""),
  lambda s, sf: Q.summary(ic(s, sf)), ["mean", "std", "icir", "t", "skew", "kurt"])


def tail(t, df):
    """SQL of the two-sided Student tail for whole degrees of freedom: the finite series in the angle atan(t / sqrt(df))."""
    angle, c2 = f"atan(abs({t}) / sqrt({df}))", f"({df} / ({df} + ({t}) * ({t})))"
    odd = f"exp(lgamma(k + 1.0::DOUBLE) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE) + k * ln({c2}))"
    even = f"exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE) + k * ln({c2}))"
    return (f"CASE WHEN ({df}) % 2 = 1 THEN 1 - 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, (({df}) - 1) // 2), lambda k: {odd})), 0)) "
            f"ELSE 1 - sin({angle}) * list_sum(list_transform(range(0, ({df}) // 2), lambda k: {even})) END")


SUMMARY = f"""SELECT {S}, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS icir, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t,
  avg(pow(ic - m, 3)) / pow(stddev_pop(ic), 3) AS skew, avg(pow(ic - m, 4)) / pow(stddev_pop(ic), 4) - 3 AS kurt, count(ic) AS n, count(*) - count(ic) AS missing
  FROM (SELECT *, avg(ic) OVER (PARTITION BY {S}) AS m FROM ic) GROUP BY 1, 2"""
q("ic_p_value", (IC + f", sm AS ({SUMMARY})", f"SELECT {S}, t, n, {tail('t', '(n - 1)')} AS p FROM sm"),
  lambda s, sf: Q.with_p(Q.summary(ic(s, sf))).select("factor", "horizon", "t", "n", "p"), ["t", "p"])
NW = f"""{IC}, e AS MATERIALIZED (SELECT {S}, ts, ic - avg(ic) OVER (PARTITION BY {S}) AS e, row_number() OVER (PARTITION BY {S} ORDER BY ts) AS i FROM ic WHERE ic IS NOT NULL),
  st AS (SELECT {S}, count(*) AS n, avg(ic) AS m, var_pop(ic) AS g0, least(greatest(floor(4 * pow(count(*) / 100.0, 2.0 / 9)), 10), count(*) // 3)::INT AS lags FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT {S}, l, avg(a.e * b.e) AS g FROM e a JOIN st USING ({S}) CROSS JOIN range(1, 200) t(l) JOIN e b USING ({S}) WHERE l <= lags AND b.i = a.i + l GROUP BY 1, 2, 3),
  v AS (SELECT {S}, g0 + coalesce(sum(2 * (1 - l / (lags + 1.0)) * g), 0) AS v FROM st LEFT JOIN g USING ({S}) GROUP BY {S}, g0),
  nwt AS (SELECT *, least(greatest(round_even(n * g0 / v, 0), 1), n)::BIGINT AS n_eff FROM st JOIN v USING ({S}) WHERE v > 0)"""
q("newey_west", (NW, f"""SELECT {S}, CASE WHEN v > 0 THEN m / sqrt(v / n) END AS nw_t,
  n_eff, lags, {tail('m / sqrt(v / n)', 'greatest(n_eff - 1, 1)')} AS nw_p FROM nwt"""),
  lambda s, sf: Q.newey_west(ic(s, sf)), ["nw_t", "nw_p"])
q("bars_per_day", ("", "SELECT 1 AS per_day, 'all' AS factor"), lambda s, sf: Q.bars_per_day(axis(s, sf).withColumn("factor", F.lit("all")), ["factor"]), [])
q("win_rate", (IC, f"SELECT {S}, avg((ic > 0)::INT) AS win_rate FROM ic GROUP BY 1, 2"), lambda s, sf: Q.win_rate(ic(s, sf)), ["win_rate"])
q("factor_coverage", ("", f"""SELECT {S}, count(*) / (SELECT count(DISTINCT ts) * count(DISTINCT instrument_id) FROM panel)::DOUBLE AS coverage FROM pairs GROUP BY 1, 2"""),
  lambda s, sf: Q.coverage(pairs(s, sf), panel(s, sf, "month")), ["coverage"])
q("ic_linearity", (IC, f"""SELECT {S}, regr_r2(c, i) AS linearity FROM (SELECT {S}, sum(ic) OVER w AS c, row_number() OVER w AS i FROM ic WHERE ic IS NOT NULL
  WINDOW w AS (PARTITION BY {S} ORDER BY ts)) GROUP BY 1, 2"""), lambda s, sf: Q.linearity(ic(s, sf)), ["linearity"])
q("ic_ar1", (IC, f"SELECT {S}, {corr('x', 'y')} AS ar1 FROM (SELECT {S}, CASE WHEN lag(ic) OVER w IS NOT NULL THEN ic END AS x, lag(ic) OVER w AS y FROM ic WHERE ic IS NOT NULL WINDOW w AS (PARTITION BY {S} ORDER BY ts)) GROUP BY 1, 2"),
  lambda s, sf: Q.ar1(ic(s, sf)), ["ar1"])
q("ic_autocorrelation", (NW, f"""SELECT {S}, l::INT AS lag, {corr('a.e', 'b.e')} AS acf FROM e a JOIN st USING ({S}) CROSS JOIN range(1, 101) t(l) JOIN e b USING ({S})
  WHERE l <= least(n // 4, 100) AND b.i = a.i + l GROUP BY 1, 2, 3"""), lambda s, sf: Q.autocorrelation(ic(s, sf)), ["acf"])
QUERIES["ic_half_life"] = (lambda s, sf: rounded(Q.half_life(ic(s, sf)), 4), None)
MEANS = BUCKETS + f", means AS (SELECT {S}, bucket, avg(fwd_ret) AS mean_ret, stddev_samp(fwd_ret) / sqrt(count(*)) AS std_err FROM bucketed GROUP BY 1, 2, 3)"
DAILY = BUCKETS + f", means AS (SELECT {S}, bucket, ts, avg(fwd_ret) AS mean_ret, CASE WHEN count(*) > 1 THEN stddev_samp(fwd_ret) / sqrt(count(*)) END AS std_err FROM bucketed GROUP BY ALL)"
q("bucket_returns", (MEANS, "SELECT * FROM means"), lambda s, sf: Q.bucket_returns(bucketed(s, sf)), ["mean_ret", "std_err"])
q("bucket_returns_by_time", (DAILY, "SELECT * FROM means"), lambda s, sf: Q.bucket_returns(bucketed(s, sf), True), ["mean_ret", "std_err"])
q("monotonicity", (MEANS, f"SELECT {S}, {corr('a', 'b')} AS monotonicity FROM (SELECT {S}, {ranked('bucket', S)} AS a, {ranked('mean_ret', S)} AS b FROM means) GROUP BY 1, 2"),
  lambda s, sf: Q.monotonicity(bucketed(s, sf)), ["monotonicity"])
q("cumulative_by_bucket", (DAILY, f"SELECT {S}, bucket, ts, exp(sum(ln(1 + mean_ret)) OVER (PARTITION BY {S}, bucket ORDER BY ts)) - 1 AS cum_ret FROM means"),
  lambda s, sf: Q.cumulative_by_bucket(bucketed(s, sf)), ["cum_ret"])
q("bucket_spread", (BUCKETS, f"SELECT {S}, ts, avg(fwd_ret) FILTER (bucket = 5) - avg(fwd_ret) FILTER (bucket = 1) AS spread FROM bucketed GROUP BY 1, 2, 3"),
  lambda s, sf: Q.spread(bucketed(s, sf)), ["spread"])
AXIS = ", axis2 AS (SELECT DISTINCT ts, bar FROM panel)"
q("bucket_turnover", (BUCKETS + AXIS, f"""SELECT {S}, a.bucket, a.ts, 1 - count(b.bucket) / count(*)::DOUBLE AS turnover FROM (SELECT * FROM bucketed JOIN axis2 USING (ts)) a
  LEFT JOIN (SELECT * FROM bucketed JOIN axis2 USING (ts)) b USING ({S}, instrument_id) WHERE false GROUP BY 1, 2, 3, 4
  UNION ALL SELECT {S}, bucket, ts, 1 - count(*) FILTER (was) / count(*)::DOUBLE FROM (SELECT x.factor, x.horizon, x.bucket, x.ts, EXISTS (
    SELECT 1 FROM bucketed y JOIN axis2 ay ON ay.ts = y.ts WHERE y.factor = x.factor AND y.horizon = x.horizon AND y.instrument_id = x.instrument_id
    AND y.bucket = x.bucket AND ay.bar = ax.bar - 1) AS was FROM bucketed x JOIN axis2 ax ON ax.ts = x.ts WHERE ax.bar > 0) GROUP BY 1, 2, 3, 4"""),
  lambda s, sf: Q.bucket_turnover(bucketed(s, sf), axis(s, sf)), ["turnover"])
RANKED = f"{AXIS}, rk AS (SELECT v.*, bar, {ranked('value', 'v.ts, factor')} AS a FROM vals v JOIN axis2 USING (ts))"
q("rank_autocorrelation", (RANKED, f"SELECT x.factor, x.ts, {corr('x.a', 'y.a')} AS rank_acf FROM rk x JOIN rk y ON y.factor = x.factor AND y.instrument_id = x.instrument_id AND y.bar = x.bar - 1 GROUP BY 1, 2"),
  lambda s, sf: Q.rank_autocorrelation(values(s, sf), axis(s, sf)), ["rank_acf"])
q("monthly_ic", (IC, f"SELECT {S}, date_trunc('month', ts)::TIMESTAMP AS month, avg(ic) AS ic FROM ic GROUP BY 1, 2, 3"), lambda s, sf: Q.monthly(ic(s, sf)), ["ic"])
LS = f""", ls AS (SELECT {S}, ts, sum(o * fwd_ret) / sum(abs(o)) AS ret FROM (SELECT *, value - avg(value) OVER (PARTITION BY ts, {S}) AS o FROM pairs) GROUP BY 1, 2, 3)"""
q("long_short_return", (LS, f"SELECT {S}, ts, ret, sign(cum) * ln(1 + abs(cum)) AS cum_ret FROM (SELECT {S}, ts, ret, product(1 + ret) OVER (PARTITION BY {S} ORDER BY ts) - 1 AS cum FROM ls)"),
  lambda s, sf: Q.long_short(pairs(s, sf)).withColumn("cum_ret", F.signum("cum_ret") * F.ln(1 + F.abs("cum_ret"))), ["ret", "cum_ret"])
q("alpha_beta", (LS, f"SELECT {S}, regr_intercept(ret, m) AS alpha, regr_slope(ret, m) AS beta FROM ls JOIN (SELECT {S}, ts, avg(fwd_ret) AS m FROM pairs GROUP BY 1, 2, 3) USING ({S}, ts) GROUP BY 1, 2"),
  lambda s, sf: Q.alpha_beta(pairs(s, sf)), ["alpha", "beta"])
q("event_study", (BUCKETS, f"""SELECT factor, bucket, o::INT AS "offset", avg(c."close" / p."close" - 1) AS path FROM (SELECT DISTINCT factor, ts, instrument_id, bucket FROM bucketed) b
  JOIN panel p USING (ts, instrument_id) CROSS JOIN range(-2, 4) t(o) JOIN panel c ON c.instrument_id = p.instrument_id AND c.bar = p.bar + o GROUP BY 1, 2, 3"""),
  lambda s, sf: Q.event_study(bucketed(s, sf), panel(s, sf, "month"), 2, 3), ["path"])
q("bucket_statistics", (BUCKETS, f"""SELECT {S}, bucket, min(value) AS "min", max(value) AS "max", avg(value) AS mean, stddev_samp(value) AS std, count(*) AS "count",
  count(*) / (sum(count(*)) OVER (PARTITION BY {S}))::DOUBLE AS share FROM bucketed GROUP BY 1, 2, 3"""), lambda s, sf: Q.bucket_statistics(bucketed(s, sf)), ["min", "max", "mean", "std", "share"])
q("ic_histogram", (IC, f"SELECT {S}, CASE WHEN ic < -0.5 THEN 0 WHEN ic >= 0.5 THEN 21 ELSE floor((ic + 0.5) / 0.05)::BIGINT + 1 END AS bin, count(*) AS \"count\" FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2, 3"),
  lambda s, sf: Q.histogram(ic(s, sf), "ic", ["factor", "horizon"], -0.5, 0.5, 20), [])
q("factor_distribution", ("", "SELECT factor, CASE WHEN value < -50 THEN 0 WHEN value >= 50 THEN 11 ELSE floor((value + 50) / 10)::BIGINT + 1 END AS bin, count(*) AS \"count\" FROM vals GROUP BY 1, 2"),
  lambda s, sf: Q.histogram(values(s, sf), "value", ["factor"], -50.0, 50.0, 10), [])
QUERIES["qq_points"] = (lambda s, sf: rounded(Q.qq_points(ic(s, sf))), f"""{BASE} {IC}, qs AS (SELECT {S}, k::INT AS k, quantile_cont(ic, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])[k] AS sample FROM ic CROSS JOIN range(1, 10) t(k) GROUP BY {S}, k)
  SELECT {S}, k, {rs('sample')} AS sample, {rs('[-1.2815515655446004, -0.8416212335729143, -0.5244005127080407, -0.2533471031357997, 0.0, 0.2533471031357997, 0.5244005127080407, 0.8416212335729143, 1.2815515655446004][k]::DOUBLE')} AS normal FROM qs""")
ALL_METRICS = NW + MEANS + f""", sm AS ({SUMMARY}), wr AS (SELECT {S}, avg((ic > 0)::INT) AS win_rate FROM ic GROUP BY 1, 2),
  li AS (SELECT {S}, regr_r2(c, i) AS linearity FROM (SELECT {S}, sum(ic) OVER w AS c, row_number() OVER w AS i FROM ic WHERE ic IS NOT NULL WINDOW w AS (PARTITION BY {S} ORDER BY ts)) GROUP BY 1, 2),
  ar AS (SELECT {S}, {corr('x', 'y')} AS ar1 FROM (SELECT {S}, CASE WHEN lag(ic) OVER w IS NOT NULL THEN ic END AS x, lag(ic) OVER w AS y FROM ic WHERE ic IS NOT NULL WINDOW w AS (PARTITION BY {S} ORDER BY ts)) GROUP BY 1, 2),
  mo AS (SELECT {S}, {corr('a', 'b')} AS monotonicity FROM (SELECT {S}, {ranked('bucket', S)} AS a, {ranked('mean_ret', S)} AS b FROM means) GROUP BY 1, 2),
  co AS (SELECT {S}, count(*) / (SELECT count(DISTINCT ts) * count(DISTINCT instrument_id) FROM panel)::DOUBLE AS coverage FROM pairs GROUP BY 1, 2),
  mt AS (SELECT sm.factor, sm.horizon, mean, std, icir, t, skew, kurt, sm.n, missing, {tail('t', '(sm.n - 1)')} AS p, m / sqrt(v / nwt.n) AS nw_t, n_eff,
    {tail('m / sqrt(v / nwt.n)', 'greatest(n_eff - 1, 1)')} AS nw_p, win_rate, linearity, ar1, monotonicity, coverage
    FROM sm LEFT JOIN nwt USING ({S}) LEFT JOIN wr USING ({S}) LEFT JOIN li USING ({S}) LEFT JOIN ar USING ({S}) LEFT JOIN mo USING ({S}) LEFT JOIN co USING ({S}))"""
METRICS = ["mean", "std", "icir", "t", "skew", "kurt", "p", "nw_t", "nw_p", "win_rate", "linearity", "ar1", "monotonicity", "coverage"]
q("metrics_table", (ALL_METRICS, "SELECT * FROM mt"),
  lambda s, sf: Q.metrics(values(s, sf), returns(s, sf), panel(s, sf, "month")).drop("lags", "half_life"), METRICS)

LABELS = ", labels2 AS (SELECT ts, CASE WHEN bar % 7 < 4 THEN 'calm' ELSE 'wild' END AS label FROM (SELECT DISTINCT ts, bar FROM panel))"


def labels(spark, sf, cut=4):
    return axis(spark, sf).select(TS, F.when(F.col(BAR) % 7 < cut, "calm").otherwise("wild").alias("label"))


REGIME = IC + LABELS + f""", split AS (SELECT {S}, label, avg(ic) AS mean, avg(ic) / stddev_pop(ic) AS icir, avg((ic > 0)::INT) AS win_rate, count(ic) AS n FROM ic JOIN labels2 USING (ts) GROUP BY 1, 2, 3),
  bylabel AS (SELECT *, max(icir) OVER w - min(icir) OVER w AS spread FROM split WINDOW w AS (PARTITION BY {S}))"""
q("ic_by_regime", (REGIME, "SELECT * FROM bylabel"), lambda s, sf: Q.ic_by_regime(ic(s, sf), labels(s, sf)), ["mean", "icir", "win_rate", "spread"])
q("regime_weights", (REGIME, f"SELECT {S}, label, greatest(icir, 0.01) / sum(greatest(icir, 0.01)) OVER (PARTITION BY horizon, label) AS weight FROM bylabel"),
  lambda s, sf: Q.regime_weights(Q.ic_by_regime(ic(s, sf), labels(s, sf)), 0.01), ["weight"])
q("regime_weights_signed", (REGIME, f"""SELECT {S}, label, CASE WHEN coalesce(icir, 0) >= 0 THEN 1 ELSE -1 END * greatest(abs(coalesce(icir, 0)), 0.05)
  / sum(greatest(abs(coalesce(icir, 0)), 0.05)) OVER (PARTITION BY horizon, label) AS weight FROM bylabel"""),
  lambda s, sf: Q.regime_weights(Q.ic_by_regime(ic(s, sf), labels(s, sf)), 0.05, signed=True), ["weight"])
MARKET = """, market AS (SELECT ts, bar, avg(ret) AS x FROM (SELECT *, "close" / lag("close") OVER (PARTITION BY instrument_id ORDER BY bar) - 1 AS ret FROM panel) GROUP BY 1, 2 HAVING avg(ret) IS NOT NULL)"""
q("market_regime", (MARKET + ", lv AS (SELECT a.ts, sum(b.x * pow(9.0 / 11, a.bar - b.bar)) / sum(pow(9.0 / 11, a.bar - b.bar)) AS level FROM market a JOIN market b ON b.bar <= a.bar GROUP BY 1)",
  "SELECT ts, level, CASE WHEN level > 0 THEN 'bull' ELSE 'bear' END AS label FROM lv"), lambda s, sf: Q.market_regime(panel(s, sf, "month"), 10), ["level"])
q("regime_change_points", (LABELS, "SELECT * FROM (SELECT ts, lag(label) OVER (ORDER BY ts) AS \"before\", label FROM labels2) WHERE \"before\" <> label"), lambda s, sf: Q.change_points(labels(s, sf)), [])


def market(spark, sf):
    return returns(spark, sf).where("horizon = 1").groupBy(TS).agg(F.avg("fwd_ret").alias("ret"))


q("regime_statistics", (LABELS + ", m AS (SELECT ts, avg(fwd_ret) AS ret FROM rets WHERE horizon = 1 GROUP BY 1), cp AS (SELECT label, count(*) AS entries FROM (SELECT ts, lag(label) OVER (ORDER BY ts) AS b, label FROM labels2) WHERE b <> label GROUP BY 1)",
  "SELECT label, avg(ret) AS mean, stddev_samp(ret) AS vol, count(*) AS \"count\", count(*) / (SELECT count(*) FROM labels2)::DOUBLE AS share, max(coalesce(entries, 0)) AS entries FROM m JOIN labels2 USING (ts) LEFT JOIN cp USING (label) GROUP BY 1"),
  lambda s, sf: Q.regime_statistics(market(s, sf), labels(s, sf)), ["mean", "vol", "share"])
q("compare_regimes", (REGIME + f""", split2 AS (SELECT {S}, l.label, avg(ic) AS mean, avg(ic) / stddev_pop(ic) AS icir, avg((ic > 0)::INT) AS win_rate, count(ic) AS n FROM ic JOIN (
  SELECT ts, CASE WHEN bar % 7 < 2 THEN 'calm' ELSE 'wild' END AS label FROM (SELECT DISTINCT ts, bar FROM panel)) l USING (ts) GROUP BY 1, 2, 3),
  bylabel2 AS (SELECT *, max(icir) OVER w - min(icir) OVER w AS spread FROM split2 WINDOW w AS (PARTITION BY {S})), bothl AS (SELECT *, 'first' AS labeling FROM bylabel UNION ALL SELECT *, 'second' FROM bylabel2)""",
  "SELECT *, greatest(icir, 0.01) / sum(greatest(icir, 0.01)) OVER (PARTITION BY labeling, horizon, label) AS weight FROM bothl"),
  lambda s, sf: Q.compare_regimes(ic(s, sf), labels(s, sf), labels(s, sf, 2), 0.01), ["mean", "icir", "win_rate", "spread", "weight"])


class _Features(FactorSet):
    """The open stands for the close of another instrument."""

    def build(self, board):
        return {n: board.name(n, t) for n, t in Q.regime_features(board, board.open, down=(10, 30), sortino=(10, 20, 30)).items()}


_names = [*(f"ema_ret_{n}" for n in (7, 14, 21)), "downside_10", "downside_30", "sortino_10", "sortino_20", "sortino_30", "rsi", "volume_corr", "pair_spread"]
FEATURES = _Features({}, {n: None for n in _names})
# written from the rules, not from the library's terms
_full = lambda x, n, agg="avg({})": f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg.format(x)} OVER w{n} END"
_decay = lambda n: f"pow({n - 1}.0::DOUBLE / {n + 1}, a.bar - b.bar)"
_mean = lambda x, n: f"sum(b.{x} * {_decay(n)}) / nullif(sum({_decay(n)}) FILTER (b.{x} IS NOT NULL), 0)"
QUERIES["regime_features"] = (
    lambda s, sf: rounded(FEATURES.evaluate(panel(s, sf, "month")).drop(BAR)),
    panel_sql("month") + f""",
f0 AS (SELECT *, ln("close" / lag("close") OVER v) AS lr, "close" / lag("close") OVER v - 1 AS ret, "open" / lag("open") OVER v - 1 AS oret, "close" - lag("close") OVER v AS d
  FROM panel WINDOW v AS (PARTITION BY instrument_id ORDER BY bar)),
f1 AS MATERIALIZED (SELECT *, ret - oret AS gap, CASE WHEN lr < 0 THEN lr * lr WHEN lr IS NOT NULL THEN 0 END AS neg, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up,
  CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS dn, CASE WHEN ret IS NOT NULL AND volume IS NOT NULL THEN 1 END AS two FROM f0),
sm AS (SELECT a.instrument_id, a.ts, {_mean('lr', 7)} AS e7, {_mean('lr', 14)} AS e14, {_mean('lr', 21)} AS e21, {_mean('gap', 14)} AS gp
  FROM f1 a JOIN f1 b ON b.instrument_id = a.instrument_id AND b.bar <= a.bar GROUP BY 1, 2),
f2 AS (SELECT instrument_id, ts, sqrt({_full('neg', 10)}) AS d10, sqrt({_full('neg', 20)}) AS d20, sqrt({_full('neg', 30)}) AS d30, {_full('lr', 10)} AS m10, {_full('lr', 20)} AS m20, {_full('lr', 30)} AS m30,
  {_full('up', 14)} AS up, {_full('dn', 14)} AS dn, CASE WHEN count(two) OVER w20 = 20 THEN corr(ret, volume) OVER w20 END AS vc
  FROM f1 WINDOW {', '.join(f'w{n} AS (PARTITION BY instrument_id ORDER BY bar ROWS {n - 1} PRECEDING)' for n in (10, 14, 20, 30))})
SELECT instrument_id, ts, {rs('e7')} AS ema_ret_7, {rs('e14')} AS ema_ret_14, {rs('e21')} AS ema_ret_21, {rs('d10')} AS downside_10, {rs('d30')} AS downside_30, {rs('m10 / nullif(d10, 0)')} AS sortino_10,
  {rs('m20 / nullif(d20, 0)')} AS sortino_20, {rs('m30 / nullif(d30, 0)')} AS sortino_30, {rs('100 - 100 / (1 + up / nullif(dn, 0))')} AS rsi, {rs('vc')} AS volume_corr, {rs('gp')} AS pair_spread FROM f2 JOIN sm USING (instrument_id, ts)""")
q("realised_ic", (AXIS + f""", ric AS (SELECT ts, factor, CASE WHEN count(*) >= 3 THEN {corr('a', 'b')} END AS ic FROM (SELECT *, {ranked('value', 'ts, factor')} AS a, {ranked('fwd_ret', 'ts, factor')} AS b
  FROM pairs WHERE horizon = 1) GROUP BY 1, 2)""", "SELECT y.ts, factor, ic FROM ric JOIN axis2 x USING (ts) JOIN axis2 y ON y.bar = x.bar + 1"),
  lambda s, sf: Q.realised_ic(values(s, sf), panel(s, sf, "month"), axis(s, sf)), ["ic"])
HEALTH = f"""{AXIS}, allv AS (SELECT ts, instrument_id, bar, 'mom' AS factor, mom AS value FROM wide UNION ALL SELECT ts, instrument_id, bar, 'vol', CASE WHEN instrument_id LIKE '%7' THEN NULL ELSE vol END FROM wide),
  hb AS (SELECT x.*, y.value AS was, x.value IS NOT NULL AND y.value IS NOT NULL AS common FROM allv x LEFT JOIN allv y ON y.factor = x.factor AND y.instrument_id = x.instrument_id AND y.bar = x.bar - 1),
  hr AS (SELECT *, CASE WHEN common THEN {ranked('value', 'ts, factor, common')} END AS a, CASE WHEN common THEN {ranked('was', 'ts, factor, common')} END AS b, avg(value) OVER (PARTITION BY ts, factor) AS mu FROM hb)"""


def sick(spark, sf):
    """Some values of one factor made infinite."""
    cells = wide(spark, sf).unpivot([TS, ID], ["mom", "vol"], "factor", "value")
    return cells.withColumn("value", F.when((F.col("factor") == "vol") & F.col(ID).endswith("7"), float("inf")).otherwise(F.col("value")))


q("factor_health", (HEALTH, f"""SELECT ts, factor, count(*) - count(value) AS anomalies, (count(*) - count(value)) / count(*)::DOUBLE AS anomaly_rate,
  CASE WHEN count(value) >= 2 THEN stddev_pop(value) ELSE 0 END AS dispersion, CASE WHEN count(value) >= 2 AND stddev_pop(value) > 1e-12 THEN avg(pow(value - mu, 4)) / pow(stddev_pop(value), 4) - 3 ELSE 0 END AS kurt,
  count(value) AS names, CASE WHEN max(bar) > 0 THEN (count(*) FILTER (common AND value = was))::DOUBLE END AS stuck,
  CASE WHEN count(*) FILTER (common) >= 3 THEN coalesce(1 - ({corr('a', 'b')}), 0) WHEN count(*) FILTER (common) > 0 THEN 0 END AS turnover FROM hr GROUP BY 1, 2"""),
  lambda s, sf: Q.health(sick(s, sf), axis(s, sf)), ["anomaly_rate", "dispersion", "kurt", "turnover"])
SCORE = """, z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM vals WINDOW w AS (PARTITION BY ts, factor)),
  score AS (SELECT ts, instrument_id, CASE WHEN count(z) = 2 THEN sum(z * CASE factor WHEN 'mom' THEN 0.7 ELSE -0.3 END) END AS score FROM z GROUP BY 1, 2)"""
q("composite_spread", (SCORE + """, pl AS (SELECT *, count(*) OVER (PARTITION BY ts, horizon) AS n, row_number() OVER (PARTITION BY ts, horizon ORDER BY score, instrument_id) AS lo,
  row_number() OVER (PARTITION BY ts, horizon ORDER BY score DESC, instrument_id DESC) AS hi FROM score JOIN rets USING (ts, instrument_id) WHERE score IS NOT NULL)""",
  "SELECT ts, horizon, avg(fwd_ret) FILTER (hi <= greatest(1, floor(n * 0.2))) - avg(fwd_ret) FILTER (lo <= greatest(1, floor(n * 0.2))) AS spread FROM pl WHERE n >= 20 GROUP BY 1, 2"),
  lambda s, sf: Q.composite_spread(Q.weighted_score(wide(s, sf), {"mom": 0.7, "vol": -0.3}, ["mom", "vol"]), returns(s, sf)), ["spread"])
