"""Registry tables and the choice of factors: filters, scores, duplicates, decorrelation, composites, tuning.

``factors(factor_id, source, status, prototype, expression, tags)``,
``metrics(run_id, created, factor_id, period, icir, ic_mean, ...)``, one row per run, factor and period.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barley.functions.numeric import ratio
from barley.operators.cross import cs_rank_average
from barley.operators.joins import as_of
from barley.operators.spec import BAR, ID, TS, Slice
from barley.plans.gram import by_time, pair_sums
from barley.plans.quality import newey_west
from barley.session import cut_lineage

# Thresholds a period must pass, and the weights of the score.
LIMITS = {"icir": 0.05, "t_nw": 2.0, "p_nw": 0.05, "win_low": 0.45, "win_high": 0.55, "linearity": 0.85, "coverage": 0.5, "n": 3000}
MIN_PERIODS = 2
WEIGHTS = {"predictiveness": 0.40, "monotonicity": 0.25, "consistency": 0.15, "turnover": 0.20}
PREDICTIVE = {"icir": 0.65, "ic_mean": 0.35}
NEUTRAL = {"normalize": 0.0, "raw": 0.0, "cs_rank": 0.5, "cs_zscore": 0.0}


# ---- registry
def upsert(old: DataFrame, new: DataFrame, key: str = "factor_id") -> DataFrame:
    """The merged table with ``result``: new, updated, unchanged, or kept for rows not sent."""
    rest = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*rest).alias("o"))
    b = new.select(key, F.struct(*rest).alias("n"))
    both = a.join(b, key, "full_outer")
    result = (F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "new")
              .when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("updated"))
    return both.select(key, F.coalesce("n", "o").alias("r"), result.alias("result")).select(key, "r.*", "result")


def listing(factors: DataFrame, source=None, status=None, prototype=None, tag=None) -> DataFrame:
    for column, value in (("source", source), ("status", status), ("prototype", prototype)):
        if value is not None:
            factors = factors.where(F.col(column) == value)
    return factors if tag is None else factors.where(F.array_contains("tags", tag))


def best(metrics: DataFrame, metric: str, k: int) -> DataFrame:
    return metrics.orderBy(F.abs(metric).desc_nulls_last(), "factor_id", "period").limit(k)


def latest(metrics: DataFrame, by: list[str]) -> DataFrame:
    """The row of the newest run for each key."""
    rest = [c for c in metrics.columns if c not in by]
    return metrics.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("created", "run_id")).alias("r")).select(*by, "r.*")


def latest_run(metrics: DataFrame) -> DataFrame:
    """All periods of each factor's newest run."""
    runs = metrics.groupBy("factor_id").agg(F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"))
    return metrics.join(runs, ["factor_id", "run_id"])


def set_status(factors: DataFrame, chosen: DataFrame, status: str) -> DataFrame:
    marked = chosen.select("factor_id", F.lit(status).alias("_new"))
    return factors.join(marked, "factor_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def evict(factors: DataFrame, selected: DataFrame, archived: str = "archived") -> DataFrame:
    """Archive active factors that were not selected."""
    return set_status(factors, factors.where("status = 'active'").join(selected, "factor_id", "left_anti"), archived)


def copy_to(target: DataFrame, source: DataFrame, chosen: DataFrame) -> DataFrame:
    """The target environment with the chosen rows of the source, replacing rows of the same id."""
    moved = source.join(chosen.select("factor_id"), "factor_id", "left_semi")
    return target.join(moved.select("factor_id"), "factor_id", "left_anti").unionByName(moved)


def run_factors(runs: DataFrame, links: DataFrame) -> DataFrame:
    names = links.groupBy("run_id").agg(F.sort_array(F.collect_set("factor_id")).alias("factors"))
    return runs.join(names, "run_id", "left")


def scoring_table(metrics: DataFrame, periods: list[str], columns: list[str]) -> DataFrame:
    """One row per factor of its newest run, one column per metric and period."""
    wide = latest_run(metrics).groupBy("factor_id").pivot("period", periods).agg(*[F.first(c).alias(c) for c in columns])
    return wide.select("factor_id", *[F.col(f"`{p}_{c}`" if len(columns) > 1 else f"`{p}`").alias(f"{c}_{p}") for p in periods for c in columns])


# ---- filters and scores
def passing(metrics: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Rows whose period passes every threshold."""
    c = F.col
    return metrics.where(
        (F.abs("icir") >= limits["icir"]) & (F.abs("t_nw") >= limits["t_nw"]) & (c("p_nw") <= limits["p_nw"])
        & ((c("win_rate") > limits["win_high"]) | (c("win_rate") < limits["win_low"]))
        & (c("linearity") >= limits["linearity"]) & (c("coverage") >= limits["coverage"]) & (c("n") >= limits["n"]))


def hard_filter(metrics: DataFrame, limits: dict = LIMITS, at_least: int = MIN_PERIODS) -> DataFrame:
    """``(factor_id, valid_periods)`` of factors with enough passing periods."""
    valid = passing(latest_run(metrics), limits).groupBy("factor_id").agg(F.sort_array(F.collect_list("period")).alias("valid_periods"))
    return valid.where(F.size("valid_periods") >= at_least)


def _share(x: Column, place: Slice) -> Column:
    n = F.count(F.lit(1)).over(place.all())
    return F.coalesce(ratio(cs_rank_average(x, on=place) - 1, n - 1), F.lit(0.5))


def scores(valid: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """Score of factors from their passing periods (long table with icir, ic_mean, monotonicity, ar1)."""
    place = Slice(("period",))
    ranked = valid.withColumns({
        "r_icir": _share(F.abs("icir"), place), "r_mean": _share(F.abs("ic_mean"), place),
        "mono": _share(F.abs("monotonicity"), place)})
    ranked = ranked.withColumn("pred", PREDICTIVE["icir"] * F.col("r_icir") + PREDICTIVE["ic_mean"] * F.col("r_mean"))
    ranked = ranked.withColumn("part", weights["predictiveness"] * F.col("pred") + weights["monotonicity"] * F.col("mono"))
    one = ranked.groupBy("factor_id").agg(
        F.avg("part").alias("period_score"), F.avg("pred").alias("pred_score"), F.avg("mono").alias("mono_score"),
        F.coalesce(F.when(F.max("part") > 0, ratio(F.min("part"), F.max("part"))), F.lit(0.0)).alias("consistency"),
        # an exact sum of 12 digits, so that the order of the rows does not order equal values
        F.coalesce(F.sum(F.abs("ar1").try_cast("decimal(20,12)")).cast("double") / F.count("ar1"), F.lit(0.0)).alias("_ar1"))
    everyone = one.withColumn("_all", F.lit(1))
    ranked_ar1 = everyone.withColumn("turnover", _share(F.col("_ar1"), Slice(("_all",)))).drop("_all", "_ar1")
    both = weights["predictiveness"] + weights["monotonicity"]
    return ranked_ar1.withColumn("score", both * F.col("period_score") + weights["consistency"] * F.col("consistency")
                                 + weights["turnover"] * F.col("turnover"))


# ---- duplicates
def greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walk nodes in the order of ``place`` and keep each that has no kept neighbour before it; with ``kept``.

    The walk is done in rounds over the whole graph: a node is kept once all its earlier neighbours are dropped, and dropped once one of them
    is kept. A node that waits for a single earlier neighbour is the opposite of it, whatever that will be: such nodes point to what they wait for, and
    in each round pointers to pointers become one pointer, so that a chain of n nodes takes log n rounds.
    ``nodes(id, place, fixed)``; fixed nodes are kept from the start.
    """
    e = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    p = nodes.select("id", "place", "fixed")
    before = (e.join(p.select(F.col("id").alias("a"), F.col("place").alias("pa"), F.col("fixed").alias("fa")), "a")
              .join(p.select(F.col("id").alias("b"), F.col("place").alias("pb"), F.col("fixed").alias("fb")), "b")
              .where((~F.col("fa")) & (F.col("fb") | (F.col("pb") < F.col("pa")))).select("a", "b"))
    before = cut_lineage(before)
    waits = before.select("a").distinct()
    state = p.join(waits, p["id"] == waits["a"], "left").select("id", "place", "fixed", F.when(F.col("a").isNull() | F.col("fixed"), F.lit(True)).alias("kept"))
    state = cut_lineage(state)
    links, waiting = None, before   # (a, b, same): an open node and whether it will be as its target or its opposite
    while True:
        known = state.where("kept IS NOT NULL").select(F.col("id").alias("b"), "kept")
        met = waiting.join(known, "b", "left")
        seen = met.groupBy("a").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.count_if(F.col("kept").isNull()).alias("open"),
                                    F.max(F.when(F.col("kept").isNull(), F.col("b"))).alias("b"))
        told = seen.where("hit OR open = 0").select("a", (~F.col("hit")).alias("told"))
        if links is not None:
            # pointers reach what is known, some rounds ahead of the edges
            reached = links.join(known, "b").select("a", (F.col("kept") == F.col("same")).alias("told"))
            told = told.unionByName(reached.join(told.select("a"), "a", "left_anti"))
        state = cut_lineage(state.join(told, state["id"] == told["a"], "left").select("id", "place", "fixed", F.coalesce("kept", "told").alias("kept")))
        open_ = state.where("kept IS NULL").select(F.col("id").alias("a"))
        if open_.isEmpty():
            return state
        single = seen.where("NOT hit AND open = 1").select("a", "b", F.lit(False).alias("same")).join(open_, "a", "left_semi")
        links = single if links is None else links.join(open_, "a", "left_semi").unionByName(single.join(links.select("a"), "a", "left_anti"))
        for _ in range(2):
            further = links.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("same").alias("also"))
            links = links.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.when(F.col("c").isNull(), F.col("same")).otherwise(F.col("same") == F.col("also")).alias("same"))
        links = cut_lineage(links)
        waiting = before.join(open_, "a", "left_semi")


def near_duplicates(table: DataFrame, columns: list[str], tolerance: float = 1e-4, crowd: int = 64) -> DataFrame:
    """Factors whose metric vectors lie within ``tolerance``: ``kept`` marks the smallest ids. A missing metric counts as 0.

    Equal vectors collapse first. Near ones meet in the cells of a grid of that width over the first two columns; a cell with many of them is cut by
    the next column, and so on, so that vectors that agree in some columns do not all meet. The distance takes all columns.
    """
    filled = table.select("factor_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    exact = cut_lineage(filled.groupBy(*columns).agg(F.min("factor_id").alias("id")))
    place = {c: F.floor(F.col(c) / F.lit(tolerance)) for c in columns}

    def about(c: str) -> Column:
        return F.explode(F.array(*[place[c] + s for s in (-1, 0, 1)]))

    grid = columns[:2]
    home = exact.withColumn("_cell", F.array(*[place[c] for c in grid]))
    near = exact
    for i, c in enumerate(grid):
        near = near.withColumn(f"_{i}", about(c))
    near = near.withColumn("_cell", F.array(*[f"_{i}" for i in range(len(grid))])).drop(*[f"_{i}" for i in range(len(grid))])
    meeting: list[tuple[DataFrame, DataFrame]] = []
    for c in columns[2:]:
        full = home.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select("_cell")
        full = cut_lineage(full)
        if full.isEmpty():
            break
        meeting.append((home.join(full, "_cell", "left_anti"), near.join(full, "_cell", "left_anti")))
        home = cut_lineage(home.join(full, "_cell", "left_semi").withColumn("_cell", F.concat("_cell", F.array(place[c]))))
        near = near.join(full, "_cell", "left_semi").withColumn("_next", about(c))
        near = cut_lineage(near.withColumn("_cell", F.concat("_cell", F.array("_next"))).drop("_next"))
    meeting.append((home, near))
    other = [F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns], "_cell"]
    home, near = (reduce(DataFrame.unionByName, [m[k] for m in meeting]) for k in (0, 1))
    near = near.select(*other)
    square = sum(((F.col(c) - F.col(f"{c}_b")) ** 2 for c in columns), F.lit(0.0))
    edges = home.join(near, "_cell").where((F.col("id") < F.col("b")) & (F.sqrt(square) < tolerance))
    kept = greedy(exact.select("id", F.col("id").alias("place"), F.lit(False).alias("fixed")), edges.select(F.col("id").alias("a"), "b"))
    return table.select("factor_id").join(kept.where("kept").select(F.col("id").alias("factor_id"), F.lit(True).alias("kept")),
                                          "factor_id", "left").fillna(False, ["kept"])


def _plain(expression: str) -> Column:
    return F.lower(F.regexp_replace(expression, r"\s+", ""))


def same_expression(factors: DataFrame, preferred: str) -> DataFrame:
    """Groups of equal formulas; the preferred source's factor is kept, then the smallest id."""
    key = F.sha2(_plain("expression"), 256)
    order = F.struct((F.col("source") != preferred).alias("far"), F.col("factor_id"))
    groups = factors.groupBy(key.alias("hash")).agg(F.min_by("factor_id", order).alias("kept"), F.count(F.lit(1)).alias("size"))
    return groups.where("size > 1").select("kept", "size")


def same_template(factors: DataFrame) -> DataFrame:
    """Formulas that differ in numbers only."""
    shape = F.regexp_replace(_plain("expression"), r"\d+(\.\d+)?", "#")
    groups = factors.groupBy(shape.alias("template")).agg(F.count(F.lit(1)).alias("size"), F.count_distinct(_plain("expression")).alias("variants"))
    return groups.where("variants > 1")


def conflicts(factors: DataFrame) -> DataFrame:
    """Ids with more than one content."""
    return factors.groupBy("factor_id").agg(F.count_distinct(_plain("expression")).alias("versions")).where("versions > 1")


# ---- decorrelation
def factor_correlation(wide: DataFrame, names: list[str], new: list[str] | None = None, min_assets: int = 5) -> DataFrame:
    """``(a, b, corr)``: mean over time of the rank correlation of two factors across instruments.

    A task goes through its times one by one and keeps sums of their correlations. With ``new``, only pairs with a new factor are returned.
    """
    wanted = set(names if new is None else new)
    left, right = np.triu_indices(len(names), 1)
    keep = np.array([names[i] in wanted or names[j] in wanted for i, j in zip(left, right)], bool)
    left, right = left[keep], right[keep]

    def correlations(frame: pd.DataFrame) -> np.ndarray:
        x = frame.rank().to_numpy(float)
        there = ~np.isnan(x)
        x = np.where(there, x, 0.0)
        x = np.where(there, x - x.sum(axis=0) / np.maximum(there.sum(axis=0), 1), 0.0)
        m = there.astype(float)
        n, sx, sxy, sxx = m.T @ m, x.T @ m, x.T @ x, (x * x).T @ m
        with np.errstate(all="ignore"):
            cov = sxy - sx * sx.T / n
            corr = cov / np.sqrt((sxx - sx * sx / n) * (sxx.T - sx.T * sx.T / n))
        return np.where((n >= min_assets) & np.isfinite(corr), corr, np.nan)[left, right]

    def summed(times: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(left)), np.zeros(len(left), np.int64)
        for frame in times:
            c = correlations(frame)
            total, n = total + np.nan_to_num(c), n + ~np.isnan(c)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(left[some].astype(np.int32)), pa.array(right[some].astype(np.int32)), pa.array(total[some]), pa.array(n[some])], ["i", "j", "c", "n"])

    sums = by_time(wide, names, summed, "i int, j int, c double, n bigint").groupBy("i", "j").agg((F.sum("c") / F.sum("n")).alias("corr"))
    label = F.array(*map(F.lit, names))
    return sums.select(F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"), "corr")


def decorrelated(scored: DataFrame, correlation: DataFrame, limit: float, gate: list[str] = ()) -> DataFrame:
    """Best-first choice under a highest absolute correlation; ``gate`` factors are in from the start."""
    nodes = scored.select(F.col("factor_id").alias("id"), F.struct(-F.col("score"), F.col("factor_id").alias("f")).alias("place"),
                          F.col("factor_id").isin(list(gate)).alias("fixed"))
    chosen = greedy(nodes, correlation.where(F.abs("corr") > limit))
    return chosen.select(F.col("id").alias("factor_id"), F.col("kept").alias("selected"))


def distance(correlation: DataFrame, signed: bool = False) -> DataFrame:
    return correlation.select("a", "b", (1 - (F.col("corr") if signed else F.abs("corr"))).alias("distance"))


def gram(wide: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Correlation matrix over all complete rows. Each task keeps one K x K matrix of sums; only their total reaches the driver."""
    sums = pair_sums(wide.dropna(subset=names), names).toArrow()
    i, j, n, x, y, xy = (sums.column(c).to_numpy() for c in ("i", "j", "n", "x", "y", "xy"))
    rows = int(n.max(initial=0))
    cov = np.zeros((len(names), len(names)))
    cov[i, j] = cov[j, i] = (xy - x * y / max(rows, 1)) / max(rows, 1)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    with np.errstate(all="ignore"):
        return np.nan_to_num(cov / np.outer(spread, spread), posinf=0.0, neginf=0.0), rows


def orthogonal_transform(wide: DataFrame, names: list[str], smallest: float = 1e-6, most: float = 1e6) -> np.ndarray:
    """Symmetric orthogonalisation: the inverse square root of the correlation matrix."""
    matrix, n = gram(wide, names)
    if n < len(names):
        raise ValueError(f"{n} complete rows are too few for {len(names)} factors")
    values, vectors = np.linalg.eigh(matrix)
    values = np.maximum(values, smallest)
    if values.max() / values.min() > most:
        raise ValueError(f"condition number {values.max() / values.min():.1f} is over {most:.0f}")
    return vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T


def transformed_weights(weights: list[float], transform: np.ndarray) -> list[float]:
    w = transform @ np.asarray(weights, float)
    return list(w / np.abs(w).sum()) if np.abs(w).sum() > 0 else list(w)


def orthogonal_overlap(wide: DataFrame, names: list[str], transform: np.ndarray) -> DataFrame:
    """Correlation of each factor with its orthogonalised form: both are sums of the same standardised columns, so their correlation matrix gives it."""
    matrix, _ = gram(wide, names)
    with np.errstate(all="ignore"):
        overlap = np.diag(matrix @ transform) / np.sqrt(np.diag(transform.T @ matrix @ transform) * np.diag(matrix))
    return wide.sparkSession.createDataFrame([(n, float(v) if np.isfinite(v) else None) for n, v in zip(names, overlap)], "factor_id string, overlap double")


def group_weights(members: DataFrame, how: str = "equal") -> DataFrame:
    """Weights inside each group of ``(group, factor_id, icir)``: equal, or by size of ICIR with its sign."""
    w = Window.partitionBy("group")
    raw = F.signum("icir") if how == "equal" else F.col("icir")
    return members.select("group", "factor_id", ratio(raw, F.sum(F.abs(raw)).over(w)).alias("weight"))


def first_component(wide: DataFrame, names: list[str]) -> list[float]:
    """Loadings of the first principal component, sizes summing to one, the largest positive."""
    matrix, _ = gram(wide, names)
    v = np.linalg.eigh(matrix)[1][:, -1]
    v = v * np.sign(v[np.abs(v).argmax()])
    return list(v / np.abs(v).sum())


# ---- composites
def composite(o, weights: dict[str, float], transform: str = "normalize", strict: bool = False):
    """Board term: weighted sum of transformed factors. A missing factor makes the sum missing (``strict``) or counts as neutral."""
    total = None
    for name, weight in weights.items():
        x = getattr(o, name)
        y = x if transform == "raw" else o.call(transform, x)
        if not strict:
            y = o.fill_nan(y, NEUTRAL[transform])
        total = y * weight if total is None else total + y * weight
    return total


def regime_composite(wide: DataFrame, schedule: DataFrame, weights: DataFrame, names: list[str]) -> DataFrame:
    """Sum of signed weights of the label in force times standardised factors, over the size of the weights present.

    A label without weights takes equal ones.
    """
    # each time is looked up once and joined back, so that no task sorts all instruments' rows
    times = as_of(wide.select(TS).distinct().withColumn("_all", F.lit(1)), schedule.withColumn("_all", F.lit(1)), ["label"], key=["_all"])
    labelled = wide.select(TS, ID, *names).join(times.select(TS, "label"), TS)
    long = labelled.unpivot([TS, ID, "label"], names, "factor", "value").where("value IS NOT NULL AND label IS NOT NULL")
    c = Slice((TS, "factor")).all()
    spread = F.stddev_pop("value").over(c)
    z = long.withColumn("z", F.when((F.count("value").over(c) >= 2) & (spread >= 1e-12), ratio(F.col("value") - F.avg("value").over(c), spread)))
    known = weights.select("label").distinct().withColumn("_known", F.lit(True))
    z = z.join(known, "label", "left").join(weights, ["label", "factor"], "left")
    w = F.when(F.col("_known"), F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(1.0 / len(names)))
    z = z.withColumn("w", w).where("z IS NOT NULL")
    return z.groupBy(TS, ID).agg(ratio(F.sum(F.col("w") * F.col("z")), F.sum(F.abs("w"))).alias("composite"))


# ---- tuning
def folds(axis: DataFrame, n_folds: int, test_share: float, gap: int, holdout_share: float, expanding: bool = True) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) by bar number, ends excluded; the holdout is fold -1.

    The bars are counted on ``axis(ts, bar)``. Test parts of one size lie side by side and end where the holdout begins; a training part ends ``gap`` bars
    before its test part and begins with the first bar or, rolling, two test sizes before. No fold if the test parts would take all bars.
    """
    size = axis.agg((F.max(BAR) + 1).alias("bars")).select(
        "bars", (F.col("bars") - F.floor(F.col("bars") * holdout_share)).alias("held"), F.greatest(F.lit(1), F.floor(F.col("bars") * test_share)).alias("test"))
    size = size.where(F.col("held") > n_folds * F.col("test"))
    test_start = F.expr(f"held - ({n_folds} - fold) * test")
    first = F.lit(0) if expanding else F.greatest(F.lit(0), test_start - 2 * F.col("test"))
    parts = size.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).select(
        "fold", first.alias("train_start"), F.greatest(first + 1, test_start - gap).alias("train_end"), test_start.alias("test_start"), (test_start + F.col("test")).alias("test_end"))
    last = size.select(F.lit(-1).alias("fold"), F.lit(0).alias("train_start"), F.col("held").alias("train_end"), F.col("held").alias("test_start"), F.col("bars").alias("test_end"))
    return parts.select(*[F.col(c).cast("int") for c in parts.columns]).unionByName(last.select(*[F.col(c).cast("int") for c in parts.columns]))


def fold_icir(ic: DataFrame, axis: DataFrame, table: DataFrame, at_least: int = 10) -> DataFrame:
    """ICIR of each factor and horizon on the test bars of each fold of ``folds``. Test parts never overlap, so each bar has one at most."""
    bars = table.where("test_end > test_start").select("fold", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias(BAR))
    placed = ic.where("ic IS NOT NULL").join(axis.join(bars, BAR), TS)
    return placed.groupBy("factor", "horizon", "fold").agg(
        F.when(F.count(F.lit(1)) >= at_least, ratio(F.avg("ic"), F.stddev_samp("ic"))).alias("icir"),
        F.avg("ic").alias("ic_mean"), F.count(F.lit(1)).alias("n"))


def holdout_metrics(ic: DataFrame, axis: DataFrame, table: DataFrame, at_least: int = 10) -> DataFrame:
    """IC of each factor and horizon on the holdout bars (fold -1): mean, deviation, ICIR (from ``at_least`` observations on), count, and the t, p and effective count
    under autocorrelation."""
    held = table.where("fold = -1").select("test_start", "test_end")   # one row
    rows = ic.where("ic IS NOT NULL").join(axis, TS).join(F.broadcast(held), (F.col(BAR) >= F.col("test_start")) & (F.col(BAR) < F.col("test_end"))).select(TS, "factor", "horizon", "ic")
    n, spread = F.count(F.lit(1)), F.stddev_samp("ic")
    plain = rows.groupBy("factor", "horizon").agg(F.avg("ic").alias("ic_mean"), spread.alias("ic_std"), F.when(n >= at_least, ratio(F.avg("ic"), spread)).alias("icir"), n.alias("n"))
    return plain.join(newey_west(rows).select("factor", "horizon", "nw_t", "nw_p", "n_eff"), ["factor", "horizon"], "left")


def grid_best(fold_table: DataFrame, k: int) -> DataFrame:
    """Parameter values (one factor each) by their mean absolute fold ICIR; the best ``k``."""
    means = fold_table.where("fold >= 0").groupBy("factor", "horizon").agg(F.avg("icir").alias("icir"))
    place = F.row_number().over(Window.partitionBy("horizon").orderBy(F.abs("icir").desc_nulls_last(), "factor"))
    return means.withColumn("place", place).where(F.col("place") <= k)


def stability(grid: DataFrame, parameter: str = "parameter") -> DataFrame:
    """Least ICIR of the neighbours on the grid over the value's own; 1 where there is no neighbour."""
    w = Window.partitionBy("horizon").orderBy(parameter)
    low, high = F.abs(F.lag("icir").over(w)), F.abs(F.lead("icir").over(w))
    alone = F.count(F.lit(1)).over(Window.partitionBy("horizon")) == 1
    return grid.withColumn("stability", F.when(alone, 1.0).otherwise(ratio(F.least(low, high), F.abs("icir"))))


def lattice_stability(grid: DataFrame, parameters: list[str]) -> DataFrame:
    """``stability`` of each combination of parameter values: the least absolute ICIR of its neighbours, which differ in one parameter by one step of that
    parameter's own values, over its own; 1 where there is no neighbour, null where its own ICIR is 0 or missing.

    Steps are places in the short tables of a parameter's values. Each combination is handed to its neighbours' places and met there, by key.
    """
    placed = grid.select("horizon", *parameters, "icir")
    for p in parameters:
        values = grid.select(p).where(F.col(p).isNotNull()).distinct()
        placed = placed.join(values.withColumn(f"_{p}", F.row_number().over(Window.orderBy(p))), p)
    own = [f"_{p}" for p in parameters]
    steps = F.array(*[F.array(*[F.lit(s if q == p else 0) for q in parameters]) for p in parameters for s in (-1, 1)])
    handed = placed.where("icir IS NOT NULL").select("horizon", F.abs("icir").alias("_other"), *own, F.explode(steps).alias("_s"))
    handed = handed.select("horizon", "_other", *[(F.col(c) + F.col("_s")[i]).alias(c) for i, c in enumerate(own)])
    least = placed.join(handed, ["horizon", *own]).groupBy("horizon", *own).agg(F.min("_other").alias("_least"))
    size = F.when(F.col("icir") != 0, F.abs("icir"))
    out = placed.join(least, ["horizon", *own], "left")
    return out.select("horizon", *parameters, "icir", F.when(F.col("_least").isNull() & size.isNotNull(), 1.0).otherwise(F.col("_least") / size).alias("stability"))


def covered(values: DataFrame, cells: int, share: float = 0.9) -> DataFrame:
    """``(factor, n)`` of factors with values in at least ``share`` of all cells of the panel."""
    return values.groupBy("factor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * cells)


def corrected(table: DataFrame, tests: int, p: str = "p") -> DataFrame:
    """p-values for ``tests`` trials of which the best is kept (Bonferroni; the false discovery form is the same then)."""
    value = F.least(F.lit(1.0), F.col(p) * tests) if tests > 1 else F.col(p)
    return table.withColumn("p_adjusted", value)


def eligible(metrics: DataFrame, limits: dict, at_least: int = 1) -> DataFrame:
    """Factors whose newest metrics pass the gates in enough periods."""
    ok = passing(latest(metrics, ["factor_id", "period"]), limits)
    return ok.groupBy("factor_id").agg(F.count(F.lit(1)).alias("periods")).where(F.col("periods") >= at_least)


def representatives(factors: DataFrame, metrics: DataFrame) -> DataFrame:
    """The factor with the largest absolute ICIR of each prototype."""
    both = factors.join(metrics, "factor_id")
    return both.groupBy("prototype").agg(F.max_by("factor_id", F.struct(F.abs("icir"), F.col("factor_id"))).alias("factor_id"),
                                         F.max(F.abs("icir")).alias("icir"))


def not_yet_tuned(factors: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    """Factors of prototypes with fewer than ``k`` registered variants."""
    done = variants.groupBy("prototype").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    return factors.join(done, "prototype", "left_anti")
