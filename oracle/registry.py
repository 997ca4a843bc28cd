"""Checks of selection. The registry tables are derived from parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.spec import BAR, ID, TS
from barley.plans import selection as R

from oracle import quality as Q
from oracle.base import FIELDS, QUERIES, panel, panel_sql, r, rs, table
from oracle.quality import IC, BASE, AXIS, LABELS, axis, corr, ic, labels, ranked, rounded, wide
from oracle.sqlboard import factor_sql

LIMITS = {"icir": 0.001, "t_nw": 0.05, "p_nw": 0.6, "win_low": 0.495, "win_high": 0.5, "linearity": 0.02, "coverage": 0.3, "n": 3}
PERIODS = ["4h", "8h", "24h"]


def factors(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("F"), F.floor(k / 5)).alias("factor_id"), F.concat(F.lit("src"), k % 3).alias("source"),
        F.element_at(F.array(*map(F.lit, ("candidate", "active", "archived"))), (k % 3 + 1).cast("int")).alias("status"),
        F.col("p_brand").alias("prototype"), F.concat(F.lit("Rank( close, "), F.col("p_size") % 9, F.lit(")")).alias("expression"),
        F.array(F.col("p_brand"), F.concat(F.lit("t"), k % 4)).alias("tags"), k.alias("part"))


def one_each(df):
    return df.groupBy("factor_id").agg(F.max_by(F.struct("source", "status", "prototype", "expression", "tags"), "part").alias("x")).select("factor_id", "x.*")


def metrics(spark, sf):
    """Averages, rounded to 12 digits: an average of doubles depends in its last digits on the order of the rows, and thresholds and ties would then fall by chance."""
    li = table(spark, sf, "lineitem")
    run = F.col("l_suppkey") % 4
    made = li.groupBy(F.concat(F.lit("R"), run).alias("run_id"), run.alias("created"), F.concat(F.lit("F"), F.floor(F.col("l_partkey") / 5)).alias("factor_id"),
                      F.element_at(F.array(*map(F.lit, PERIODS)), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("period")).agg(
        (F.avg("l_discount") - 0.05).alias("icir"), (F.avg("l_tax") - 0.04).alias("ic_mean"), (F.avg("l_quantity") / 25 - 1).alias("monotonicity"),
        (F.avg("l_tax") * 5 - F.avg("l_discount") * 4).alias("ar1"), (F.avg("l_extendedprice") / 20000 - 1.5).alias("t_nw"), (F.avg("l_discount") * 8).alias("p_nw"),
        (F.avg("l_quantity") / 50).alias("win_rate"), (F.avg("l_tax") * 10).alias("linearity"), F.lit(0.6).alias("coverage"), F.count(F.lit(1)).alias("n"))
    return made.withColumns({c: F.round(c, 12) for c in EIGHT})


EIGHT = ["icir", "ic_mean", "monotonicity", "ar1", "t_nw", "p_nw", "win_rate", "linearity"]
REG = """WITH fac AS MATERIALIZED (SELECT 'F' || (p_partkey // 5) AS factor_id, 'src' || (p_partkey % 3) AS source, ['candidate', 'active', 'archived'][p_partkey % 3 + 1] AS status,
  p_brand AS prototype, 'Rank( close, ' || (p_size % 9) || ')' AS expression, [p_brand, 't' || (p_partkey % 4)] AS tags, p_partkey AS part FROM part),
met AS MATERIALIZED (SELECT 'R' || (l_suppkey % 4) AS run_id, l_suppkey % 4 AS created, 'F' || (l_partkey // 5) AS factor_id, ['4h', '8h', '24h'][l_linenumber % 3 + 1] AS period,
  round(avg(l_discount) - 0.05::DOUBLE, 12) AS icir, round(avg(l_tax) - 0.04::DOUBLE, 12) AS ic_mean, round(avg(l_quantity) / 25 - 1, 12) AS monotonicity,
  round(avg(l_tax) * 5 - avg(l_discount) * 4, 12) AS ar1, round(avg(l_extendedprice) / 20000 - 1.5::DOUBLE, 12) AS t_nw, round(avg(l_discount) * 8, 12) AS p_nw,
  round(avg(l_quantity) / 50, 12) AS win_rate, round(avg(l_tax) * 10, 12) AS linearity, 0.6::DOUBLE AS coverage, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3, 4),
facone AS (SELECT * EXCLUDE (rn, part) FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY part DESC) AS rn FROM fac) WHERE rn = 1),
lastrun AS (SELECT m.* FROM met m JOIN (SELECT factor_id, max(created) AS created FROM met GROUP BY 1) USING (factor_id, created)),
ok AS (SELECT * FROM lastrun WHERE abs(icir) >= 0.001 AND abs(t_nw) >= 0.05 AND p_nw <= 0.6 AND (win_rate > 0.5 OR win_rate < 0.495) AND linearity >= 0.02 AND coverage >= 0.3 AND n >= 3)"""


def q(name, sql, query, floats=(), base=REG):
    if sql is not None:
        replaced = ", ".join(f'{rs(chr(34) + c + chr(34))} AS "{c}"' for c in floats)
        extra, body = sql if isinstance(sql, tuple) else ("", sql)
        sql = f"{base}{extra}, out AS ({body}) SELECT * " + (f"REPLACE ({replaced}) " if floats else "") + "FROM out"
    QUERIES[name] = (lambda s, sf: rounded(query(s, sf)), sql)


def incoming(spark, sf):
    f = one_each(factors(spark, sf)).where("factor_id LIKE 'F1%'")
    f = f.withColumn("status", F.when(F.col("factor_id") < "F11", "active").otherwise(F.col("status")))
    return f.withColumn("factor_id", F.when(F.col("factor_id") == "F19", "F999").otherwise(F.col("factor_id"))).drop("tags")


q("registry_upsert", (""", inc AS (SELECT CASE WHEN factor_id = 'F19' THEN 'F999' ELSE factor_id END AS factor_id, source, CASE WHEN factor_id < 'F11' THEN 'active' ELSE status END AS status, prototype, expression FROM facone WHERE factor_id LIKE 'F1%')""",
  """SELECT factor_id, coalesce(i.source, o.source) AS source, coalesce(i.status, o.status) AS status, coalesce(i.prototype, o.prototype) AS prototype, coalesce(i.expression, o.expression) AS expression,
  CASE WHEN i.source IS NULL THEN 'kept' WHEN o.source IS NULL THEN 'new' WHEN (o.source, o.status, o.prototype, o.expression) = (i.source, i.status, i.prototype, i.expression) THEN 'unchanged' ELSE 'updated' END AS result
  FROM facone o FULL JOIN inc i USING (factor_id)"""), lambda s, sf: R.upsert(one_each(factors(s, sf)).drop("tags"), incoming(s, sf)))
q("registry_list", "SELECT factor_id, source, status, prototype, expression, part FROM fac WHERE source = 'src1' AND status = 'active' AND list_contains(tags, 't2')",
  lambda s, sf: R.listing(factors(s, sf), source="src1", status="active", tag="t2").drop("tags"))
q("best_factors", "SELECT * FROM met ORDER BY abs(icir) DESC NULLS LAST, factor_id, period LIMIT 20", lambda s, sf: R.best(metrics(s, sf), "icir", 20),
  ["icir", "ic_mean", "monotonicity", "ar1", "t_nw", "p_nw", "win_rate", "linearity", "coverage"])
q("latest_metrics", "SELECT factor_id, period, run_id, icir FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, period ORDER BY created DESC) AS rn FROM met) WHERE rn = 1",
  lambda s, sf: R.latest(metrics(s, sf), ["factor_id", "period"]).select("factor_id", "period", "run_id", "icir"), ["icir"])
q("latest_run", "SELECT factor_id, period, run_id, icir FROM lastrun", lambda s, sf: R.latest_run(metrics(s, sf)).select("factor_id", "period", "run_id", "icir"), ["icir"])
q("evict_not_selected", "SELECT factor_id, CASE WHEN status = 'active' AND factor_id NOT IN (SELECT factor_id FROM ok) THEN 'archived' ELSE status END AS status FROM facone",
  lambda s, sf: R.evict(one_each(factors(s, sf)), R.passing(R.latest_run(metrics(s, sf)), LIMITS).select("factor_id").distinct()).select("factor_id", "status"))
q("copy_between_environments", """SELECT factor_id, status FROM facone WHERE factor_id LIKE 'F2%' AND factor_id NOT IN (SELECT factor_id FROM ok)
  UNION ALL SELECT factor_id, 'live' FROM facone WHERE factor_id IN (SELECT factor_id FROM ok)""",
  lambda s, sf: R.copy_to(one_each(factors(s, sf)).where("factor_id LIKE 'F2%'"), one_each(factors(s, sf)).withColumn("status", F.lit("live")),
                          R.passing(R.latest_run(metrics(s, sf)), LIMITS)).select("factor_id", "status"))
q("runs_with_factors", "SELECT run_id, created, array_to_string(list_sort(list(DISTINCT factor_id)), ',') AS factors FROM met GROUP BY 1, 2",
  lambda s, sf: R.run_factors(metrics(s, sf).select("run_id", "created").distinct(), metrics(s, sf)).withColumn("factors", F.array_join("factors", ",")))
q("scoring_table", "SELECT factor_id, " + ", ".join(f"max({c}) FILTER (period = '{p}') AS {c}_{p}" for p in PERIODS for c in ("icir", "ic_mean")) + " FROM lastrun GROUP BY 1",
  lambda s, sf: R.scoring_table(metrics(s, sf), PERIODS, ["icir", "ic_mean"]), [f"{c}_{p}" for p in PERIODS for c in ("icir", "ic_mean")])
q("hard_filters", "SELECT factor_id, array_to_string(list_sort(list(period)), ',') AS valid_periods FROM ok GROUP BY 1 HAVING count(*) >= 2",
  lambda s, sf: R.hard_filter(metrics(s, sf), LIMITS).withColumn("valid_periods", F.array_join("valid_periods", ",")))


def share(x, part):
    return f"coalesce(({ranked(x, part)} - 1) / nullif(count(*) OVER (PARTITION BY {part}) - 1, 0), 0.5)"


q("composite_scores", (f""", rk AS (SELECT *, {share('abs(icir)', 'period')} AS ri, {share('abs(ic_mean)', 'period')} AS rm, {share('abs(monotonicity)', 'period')} AS mono FROM ok),
  pt AS (SELECT *, 0.65 * ri + 0.35 * rm AS pred, 0.4 * (0.65 * ri + 0.35 * rm) + 0.25 * mono AS part FROM rk),
  g AS (SELECT factor_id, avg(part) AS period_score, avg(pred) AS pred_score, avg(mono) AS mono_score, CASE WHEN max(part) > 0 THEN min(part) / max(part) ELSE 0 END AS consistency, sum(abs(ar1)::DECIMAL(20, 12))::DOUBLE / count(ar1) AS a, 1 AS one FROM pt GROUP BY 1),
  gt AS (SELECT * EXCLUDE (a, one), {share('a', 'one')} AS turnover FROM g)""", "SELECT *, 0.65 * period_score + 0.15 * consistency + 0.2 * turnover AS score FROM gt"),
  lambda s, sf: R.scores(R.passing(R.latest_run(metrics(s, sf)), LIMITS)), ["period_score", "pred_score", "mono_score", "consistency", "turnover", "score"])


def fingerprints(spark, sf):
    """Mean metrics per factor, some missing, and for every seventh factor one equal and one near copy."""
    own = R.latest_run(metrics(spark, sf)).groupBy("factor_id").agg(*[F.avg(c).alias(c) for c in EIGHT])
    number = F.substring("factor_id", 2, 20).cast("int")
    own = own.withColumn("ar1", F.when(number % 3 != 0, F.col("ar1")))
    some = own.where(number % 7 == 0)
    equal = some.withColumn("factor_id", F.concat(F.lit("G"), "factor_id"))
    near = some.withColumn("factor_id", F.concat(F.lit("H"), "factor_id")).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) + 3e-5 for c in EIGHT})
    return own.unionByName(equal).unionByName(near)


_mean8 = ", ".join(f"avg({c}) AS {c}" if c != "ar1" else "CASE WHEN substr(factor_id, 2)::INT % 3 <> 0 THEN avg(ar1) END AS ar1" for c in EIGHT)
q("near_duplicates", (f""", fp AS (SELECT factor_id, {_mean8} FROM lastrun GROUP BY 1), f7 AS (SELECT * FROM fp WHERE substr(factor_id, 2)::INT % 7 = 0),
  v AS MATERIALIZED (SELECT factor_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in EIGHT)} FROM (SELECT * FROM fp UNION ALL SELECT * REPLACE ('G' || factor_id AS factor_id) FROM f7
    UNION ALL SELECT 'H' || factor_id, {', '.join(f'coalesce({c}, 0) + 3e-5::DOUBLE' for c in EIGHT)} FROM f7))""",
  f"""SELECT factor_id, NOT EXISTS (SELECT 1 FROM v b WHERE b.factor_id < v.factor_id AND sqrt({' + '.join(f'pow(b.{c} - v.{c}, 2)' for c in EIGHT)}) < 1e-4) AS kept FROM v"""),
  lambda s, sf: R.near_duplicates(fingerprints(s, sf), EIGHT, 1e-4))
q("same_expression", "SELECT first(factor_id ORDER BY source <> 'src2', factor_id) AS kept, count(*) AS size FROM fac GROUP BY lower(replace(expression, ' ', '')) HAVING count(*) > 1",
  lambda s, sf: R.same_expression(factors(s, sf), "src2"))
q("same_template", "SELECT 'rank(close,#)' AS template, count(*) AS size, count(DISTINCT expression) AS variants FROM fac", lambda s, sf: R.same_template(factors(s, sf)))
q("registry_conflicts", "SELECT factor_id, count(DISTINCT expression) AS versions FROM fac GROUP BY 1 HAVING count(DISTINCT expression) > 1", lambda s, sf: R.conflicts(factors(s, sf)))

NAMES = ["a", "b", "c", "d"]
FOUR = FactorSet({}, {"a": lambda o: o.close - o.delay(o.close, 1), "b": lambda o: o.close - o.ts_mean(o.close, 3), "c": lambda o: o.volume - o.ts_mean(o.volume, 4), "d": lambda o: o.high - o.low})
_c, _o = factor_sql(FOUR, FIELDS)
FOURSQL = panel_sql("month") + ",\n" + ",\n".join(_c) + ", wide AS MATERIALIZED (SELECT instrument_id, ts, bar, " + ", ".join(f"{e} AS {n}" for n, e in _o.items()) + " FROM cells)"
LONG4 = ", l4 AS (SELECT ts, instrument_id, factor, value FROM wide UNPIVOT (value FOR factor IN (a, b, c, d)))"
CORR4 = LONG4 + f""", r4 AS (SELECT *, {ranked('value', 'ts, factor')} AS rk FROM l4), pc AS (SELECT x.factor AS a, y.factor AS b, x.ts, CASE WHEN count(*) >= 5 THEN {corr('x.rk', 'y.rk')} END AS c
  FROM r4 x JOIN r4 y ON y.ts = x.ts AND y.instrument_id = x.instrument_id AND x.factor < y.factor GROUP BY 1, 2, 3), fc AS (SELECT a, b, avg(c) AS corr FROM pc GROUP BY 1, 2)"""


def four(spark, sf):
    return FOUR.evaluate(panel(spark, sf, "month"))


q("factor_correlation", (CORR4, "SELECT * FROM fc"), lambda s, sf: R.factor_correlation(four(s, sf), NAMES), ["corr"], FOURSQL)
q("factor_correlation_incremental", (CORR4, "SELECT * FROM fc WHERE a = 'd' OR b = 'd'"), lambda s, sf: R.factor_correlation(four(s, sf), NAMES, new=["d"]), ["corr"], FOURSQL)
q("correlation_distance", (CORR4, "SELECT a, b, 1 - abs(corr) AS distance FROM fc"), lambda s, sf: R.distance(R.factor_correlation(four(s, sf), NAMES)), ["distance"], FOURSQL)


def scored(spark, sf):
    return four(spark, sf).unpivot([TS, ID], NAMES, "factor_id", "v").groupBy("factor_id").agg(F.stddev_pop("v").alias("score"))


q("decorrelated_selection", (CORR4 + """, sc AS (SELECT factor AS f, row_number() OVER (ORDER BY stddev_pop(value) DESC) AS k FROM l4 GROUP BY 1),
  ed AS (SELECT a, b FROM fc WHERE abs(corr) > 0.5 UNION SELECT b, a FROM fc WHERE abs(corr) > 0.5), n1 AS (SELECT f, k, true AS s FROM sc WHERE k = 1),
  n2 AS (SELECT * FROM n1 UNION ALL SELECT f, k, NOT EXISTS (SELECT 1 FROM ed JOIN n1 ON n1.f = ed.b AND n1.s WHERE ed.a = sc.f) FROM sc WHERE k = 2),
  n3 AS (SELECT * FROM n2 UNION ALL SELECT f, k, NOT EXISTS (SELECT 1 FROM ed JOIN n2 ON n2.f = ed.b AND n2.s WHERE ed.a = sc.f) FROM sc WHERE k = 3),
  n4 AS (SELECT * FROM n3 UNION ALL SELECT f, k, NOT EXISTS (SELECT 1 FROM ed JOIN n3 ON n3.f = ed.b AND n3.s WHERE ed.a = sc.f) FROM sc WHERE k = 4)""", "SELECT f AS factor_id, s AS selected FROM n4"),
  lambda s, sf: R.decorrelated(scored(s, sf), R.factor_correlation(four(s, sf), NAMES), 0.5), [], FOURSQL)


def overlap(spark, sf):
    w = four(spark, sf)
    return R.orthogonal_overlap(w, NAMES, R.orthogonal_transform(w, NAMES))


def transformed(spark, sf):
    w = four(spark, sf)
    new = dict(zip(NAMES, R.transformed_weights([0.4, 0.3, 0.2, 0.1], R.orthogonal_transform(w, NAMES))))
    pc = dict(zip(NAMES, R.first_component(w, NAMES)))
    rows = w.unpivot([TS, ID], NAMES, "factor_id", "v").groupBy("factor_id").agg(F.count("v").alias("n"))
    return rows.withColumn("weight", _map(new)).withColumn("component", _map(pc))


def _map(values):
    return F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(float(v)))])[F.col("factor_id")]


QUERIES["orthogonal_overlap"] = (lambda s, sf: rounded(overlap(s, sf)), None)
QUERIES["orthogonal_weights"] = (lambda s, sf: rounded(transformed(s, sf)), None)
for _how, _raw in (("equal", "sign(icir)"), ("icir", "icir")):
    q(f"group_weights_{_how}", f"""SELECT period AS "group", factor_id, {_raw} / sum(abs({_raw})) OVER (PARTITION BY period) AS weight FROM lastrun""",
      lambda s, sf, how=_how: R.group_weights(R.latest_run(metrics(s, sf)).withColumnRenamed("period", "group"), how), ["weight"])
for _t, _strict in (("normalize", False), ("cs_rank", False), ("cs_zscore", True), ("raw", True)):
    _set = FactorSet({"up": FOUR.factors["a"], "busy": FOUR.factors["c"]}, {"composite": lambda o, t=_t, st=_strict: R.composite(o, {"up": 0.6, "busy": -0.4}, t, st)})
    from oracle.base import factor_query as _fq
    QUERIES[f"composite_{_t}"] = _fq(lambda s=_set: s, 6, "month")
q("regime_composite", (LABELS + """, z AS (SELECT *, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM vals WINDOW w AS (PARTITION BY ts, factor)),
  lb AS (SELECT z.*, l.label FROM z JOIN labels2 l USING (ts)),
  wt AS (SELECT *, CASE WHEN label = 'calm' THEN CASE factor WHEN 'mom' THEN 0.8 ELSE -0.2 END ELSE 0.5 END AS w FROM lb WHERE z IS NOT NULL)""",
  "SELECT ts, instrument_id, sum(w * z) / sum(abs(w)) AS composite FROM wt GROUP BY 1, 2"),
  lambda s, sf: R.regime_composite(wide(s, sf), labels(s, sf),
                                   s.createDataFrame([("calm", "mom", 0.8), ("calm", "vol", -0.2)], "label string, factor string, weight double"), ["mom", "vol"]), ["composite"], BASE)
def fold_table(spark, sf):
    return R.folds(axis(spark, sf), 4, 0.15, 2, 0.1)


FOLDS = IC + AXIS + """, fs AS (SELECT bars, bars - floor(bars * 0.1::DOUBLE) AS held, greatest(1, floor(bars * 0.15::DOUBLE)) AS size FROM (SELECT max(bar) + 1 AS bars FROM axis2)),
  fd AS (SELECT i::INT AS fold, held - (4 - i) * size AS lo, held - (3 - i) * size AS hi FROM fs, range(4) t(i) WHERE held > 4 * size UNION ALL SELECT -1, held, bars FROM fs WHERE held > 4 * size),
  pf AS (SELECT ic.*, fold FROM ic JOIN axis2 USING (ts) JOIN fd ON bar >= lo AND bar < hi WHERE ic IS NOT NULL),
  ft AS (SELECT factor, horizon, fold, CASE WHEN count(*) >= 10 THEN avg(ic) / stddev_samp(ic) END AS icir, avg(ic) AS ic_mean, count(*) AS n FROM pf GROUP BY 1, 2, 3)"""
q("walk_forward_icir", (FOLDS, "SELECT * FROM ft"), lambda s, sf: R.fold_icir(ic(s, sf), axis(s, sf), fold_table(s, sf)), ["icir", "ic_mean"], BASE)


HELD = IC.replace("ic AS MATERIALIZED", "ic0 AS MATERIALIZED") + FOLDS[len(IC):].split(",\n  pf AS")[0] + """,
  ic AS MATERIALIZED (SELECT ic0.* FROM ic0 JOIN axis2 USING (ts) JOIN fd ON fold = -1 AND bar >= lo AND bar < hi WHERE ic IS NOT NULL)""" + Q.NW[len(IC):]
q("holdout_metrics", (HELD, f"""SELECT factor, horizon, m AS ic_mean, sqrt(g0 * n / (n - 1)) AS ic_std, CASE WHEN n >= 10 THEN m / sqrt(g0 * n / (n - 1)) END AS icir, n, m / sqrt(v / n) AS nw_t,
  {Q.tail('m / sqrt(v / n)', 'greatest(n_eff - 1, 1)')} AS nw_p, n_eff FROM nwt"""),
  lambda s, sf: R.holdout_metrics(ic(s, sf), axis(s, sf), fold_table(s, sf)), ["ic_mean", "ic_std", "icir", "nw_t", "nw_p"], BASE)


def grid_ic(spark, sf):
    grid = FactorSet({}, {f"n{n:02d}": (lambda o, n=n: o.close / o.ts_mean(o.close, n) - 1) for n in (3, 4, 5, 6, 8)})
    from barley.plans import quality as P
    p = panel(spark, sf, "month")
    return R.fold_icir(P.information(grid.long(p), P.forward_returns(p, [1])), axis(spark, sf), fold_table(spark, sf))


def lattice(spark, sf):
    """Metrics of the registry as a lattice: hours of the period and the run are the parameters, the mean ICIR over factors the value."""
    hours = F.regexp_extract("period", r"^([0-9]+)", 1).cast("int")
    return metrics(spark, sf).groupBy(F.lit(1).alias("horizon"), hours.alias("n"), F.col("created").cast("int").alias("run")).agg(F.avg("icir").alias("icir"))


LATTICE = ", lat AS (SELECT 1 AS horizon, regexp_extract(period, '^([0-9]+)', 1)::INT AS n, created::INT AS run, avg(icir) AS icir FROM met GROUP BY 1, 2, 3)"
_gs = FactorSet({}, {f"n{n:02d}": (lambda o, n=n: o.close / o.ts_mean(o.close, n) - 1) for n in (3, 4, 5, 6, 8)})
_gc, _go = factor_sql(_gs, FIELDS)
GRID = panel_sql("month") + ",\n" + ",\n".join(_gc) + ", gw AS MATERIALIZED (SELECT instrument_id, ts, bar, " + ", ".join(f"{e} AS {n}" for n, e in _go.items()) + f""" FROM cells),
  vals AS MATERIALIZED (SELECT ts, instrument_id, factor, value FROM gw UNPIVOT (value FOR factor IN ({', '.join(_go)}))),
  rets AS MATERIALIZED (SELECT a.ts, a.instrument_id, 1 AS horizon, b."close" / a."close" - 1 AS fwd_ret FROM panel a JOIN panel b ON b.instrument_id = a.instrument_id AND b.bar = a.bar + 1 WHERE a."close" IS NOT NULL AND b."close" IS NOT NULL),
  pairs AS MATERIALIZED (SELECT * FROM vals JOIN rets USING (ts, instrument_id)){FOLDS},
  gm AS (SELECT factor, horizon, avg(icir) AS icir FROM ft WHERE fold >= 0 GROUP BY 1, 2)"""
q("parameter_grid", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY abs(icir) DESC NULLS LAST, factor)::INT AS place FROM gm) WHERE place <= 3", lambda s, sf: R.grid_best(grid_ic(s, sf), 3), ["icir"], GRID)
q("neighbour_stability", "SELECT factor, horizon, icir, place, least(abs(lag(icir) OVER w), abs(lead(icir) OVER w)) / abs(icir) AS stability FROM (SELECT *, row_number() OVER (ORDER BY abs(icir) DESC NULLS LAST, factor)::INT AS place FROM gm) WINDOW w AS (ORDER BY factor)",
  lambda s, sf: R.stability(R.grid_best(grid_ic(s, sf), 99), "factor"), ["icir", "stability"], GRID)
q("lattice_stability", """SELECT a.horizon, a.n::INT AS n, a.run::INT AS run, a.icir, CASE WHEN min(abs(b.icir)) IS NULL THEN 1 ELSE min(abs(b.icir)) / abs(a.icir) END AS stability
  FROM (SELECT *, dense_rank() OVER (ORDER BY n) AS pn, dense_rank() OVER (ORDER BY run) AS pr FROM lat) a
  LEFT JOIN (SELECT *, dense_rank() OVER (ORDER BY n) AS pn, dense_rank() OVER (ORDER BY run) AS pr FROM lat) b ON b.horizon = a.horizon AND abs(a.pn - b.pn) + abs(a.pr - b.pr) = 1 GROUP BY 1, 2, 3, 4""",
  lambda s, sf: R.lattice_stability(lattice(s, sf), ["n", "run"]), ["icir", "stability"], REG + LATTICE)
q("p_value_correction", "SELECT factor_id, period, p_nw, least(1, p_nw * 12) AS p_adjusted FROM lastrun", lambda s, sf: R.corrected(R.latest_run(metrics(s, sf)), 12, "p_nw").select("factor_id", "period", "p_nw", "p_adjusted"), ["p_nw", "p_adjusted"])
q("eligibility", """SELECT factor_id, count(*) AS periods FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, period ORDER BY created DESC) AS rn FROM met) WHERE rn = 1
  AND abs(icir) >= 0.001 AND abs(t_nw) >= 0.05 AND p_nw <= 0.6 AND (win_rate > 0.5 OR win_rate < 0.495) AND linearity >= 0.02 AND coverage >= 0.3 AND n >= 3 GROUP BY 1""", lambda s, sf: R.eligible(metrics(s, sf), LIMITS))
q("prototype_representatives", "SELECT prototype, first(factor_id ORDER BY abs(icir) DESC, factor_id DESC) AS factor_id, max(abs(icir)) AS icir FROM facone JOIN lastrun USING (factor_id) GROUP BY 1",
  lambda s, sf: R.representatives(one_each(factors(s, sf)), R.latest_run(metrics(s, sf))), ["icir"])
q("not_yet_tuned", "SELECT factor_id, prototype FROM facone WHERE prototype NOT IN (SELECT prototype FROM fac GROUP BY 1 HAVING count(*) >= 80)",
  lambda s, sf: R.not_yet_tuned(one_each(factors(s, sf)), factors(s, sf), 80).select("factor_id", "prototype"))
PROMOTED = {"icir": 0.01, "t_nw": 0.1, "p_nw": 0.95, "win_low": 0.495, "win_high": 0.5, "linearity": 0.01, "coverage": 0.2, "n": 10}


def promoted(spark, sf):
    """From panel to selected factors: metrics, registry rows, filters."""
    from barley.plans import quality as P
    rows = P.registry_rows(P.metrics(Q.values(spark, sf), Q.returns(spark, sf), panel(spark, sf, "month")), "R1", 1)
    return R.hard_filter(rows, PROMOTED, 1).withColumn("valid_periods", F.array_join("valid_periods", ","))


q("promoted_factors", (Q.ALL_METRICS, """SELECT factor AS factor_id, array_to_string(list_sort(list(horizon::VARCHAR)), ',') AS valid_periods FROM mt
  WHERE abs(icir) >= 0.01 AND abs(nw_t) >= 0.1 AND nw_p <= 0.95 AND (win_rate > 0.5 OR win_rate < 0.495) AND linearity >= 0.01 AND coverage >= 0.2 AND n >= 10 GROUP BY 1"""),
  promoted, [], BASE)
