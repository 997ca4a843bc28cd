"""Moments of many instruments and sums of many factors, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barley.plans import gram, risk, selection

rng = np.random.default_rng(11)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("tile", [3, 256])
def test_moments_by_tiles(spark, tile):
    bars, names = 600, [f"i{k}" for k in range(10)]
    x = rng.normal(size=(bars, 10))
    rows = [(n, b, float(x[b, k])) for k, n in enumerate(names) for b in range(bars) if (b + k) % 9]
    for k in range(10):
        x[[b for b in range(bars) if not (b + k) % 9], k] = np.nan
    m = np.nanmean(x, axis=1)[:, None]
    x = np.nan_to_num(x)
    want = {"s": x.T @ x, "y22": (x ** 2).T @ x ** 2, "y31": (x ** 3).T @ x, "y21m": (x ** 2).T @ (x * m), "y11mm": (x * m).T @ (x * m), "xm": np.repeat((x * m).sum(0)[:, None], 10, 1)}
    frame = spark.createDataFrame(rows, "instrument_id string, bar bigint, ret double")
    got = risk.moments(frame, tile=tile).toPandas().set_index(["i", "j"])
    assert len(got) == 100
    for name, matrix in want.items():
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                assert got.loc[(a, b), name] == pytest.approx(matrix[i, j] / bars, rel=1e-9, abs=1e-12), name
    few = risk.moments(frame, ("s",), tile)
    assert few.columns == ["i", "j", "s"] and few.count() == 100


def test_moments_of_nothing(spark):
    assert risk.moments(spark.createDataFrame([], "instrument_id string, bar bigint, ret double")).count() == 0


def test_pair_sums_with_holes(spark):
    x = rng.normal(5.0, 1.0, (300, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    frame = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], "a double, b double, c double, d double").repartition(5)
    got = risk.factor_covariance(frame, list("abcd")).toPandas().set_index(["i", "j"])["value"]
    want = pd.DataFrame(x, columns=list("abcd")).cov()
    assert all(got[a, b] == pytest.approx(want.loc[a, b]) for a in "abcd" for b in "abcd")
    np.testing.assert_allclose(selection.gram(frame, list("abcd"))[0], np.corrcoef(x[~np.isnan(x).any(axis=1)].T), atol=1e-10)


def test_many_factors_plan_and_run(spark):
    """735 factors: a matrix per task, no expression per pair."""
    k, names = 735, [f"f{i}" for i in range(735)]
    common = rng.normal(size=(160, 5))
    x = common @ rng.normal(size=(5, k)) + rng.normal(size=(160, k))
    frame = pd.DataFrame(x, columns=names)
    frame["ts"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(160) // 40, unit="D")
    frame["instrument_id"] = [f"i{t % 40}" for t in range(160)]
    df = spark.createDataFrame(frame).repartition(3)
    got = selection.factor_correlation(df, names).toPandas().set_index(["a", "b"])["corr"]
    assert len(got) == k * (k - 1) // 2
    for a, b in (("f0", "f1"), ("f3", "f700"), ("f733", "f734")):
        want = np.mean([g[a].rank().corr(g[b].rank()) for _, g in frame.groupby("ts")])
        assert got[a, b] == pytest.approx(want)
    matrix, n = selection.gram(df, names)
    assert n == 160 and np.allclose(matrix, np.corrcoef(x.T), atol=1e-8)


def test_overlap_is_the_correlation_with_the_turned_factor(spark):
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.6, 0.2], [0, 1, 0.5], [0, 0, 1]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["p", "q", "r"]))
    turn = selection.orthogonal_transform(df, ["p", "q", "r"])
    z = (x - x.mean(0)) / x.std(0)
    got = {r.factor_id: r.overlap for r in selection.orthogonal_overlap(df, ["p", "q", "r"], turn).collect()}
    assert all(got[n] == pytest.approx(np.corrcoef(z[:, i], (z @ turn)[:, i])[0, 1]) for i, n in enumerate("pqr"))
    assert np.allclose(turn @ selection.gram(df, ["p", "q", "r"])[0] @ turn, np.eye(3), atol=1e-8)   # W S W = I


def gaps(bars: int, names: int) -> tuple[np.ndarray, list]:
    x = rng.normal(size=(bars, 1)) * rng.uniform(0.5, 1.5, names) + rng.normal(size=(bars, names))
    return x, [((pd.Timestamp("2024-01-01") + pd.Timedelta(days=b)).to_pydatetime(), f"i{k:03d}", b, float(x[b, k])) for b in range(bars) for k in range(names)]


def by_pairs(x: np.ndarray) -> tuple[dict, dict]:
    """Targets and intensities from the K x K matrices themselves."""
    n, p = x.shape
    m = x.mean(axis=1)
    v, c, s = (m ** 2).mean(), x.T @ m / n, x.T @ x / n
    vi = np.diag(s)
    off = ~np.eye(p, dtype=bool)
    sd = np.sqrt(np.outer(vi, vi))
    r = (s / sd)[off].mean()
    own = np.diag(vi)
    goal = {"constant_variance": np.eye(p) * vi.mean(), "constant_correlation": np.where(off, r * sd, own), "single_factor": np.where(off, np.outer(c, c) / v, own)}
    y22, y31 = (x ** 2).T @ x ** 2 / n, (x ** 3).T @ x / n
    y21m, y11mm = (x ** 2).T @ (x * m[:, None]) / n, (x * m[:, None]).T @ (x * m[:, None]) / n
    phi, phid = (y22 - s ** 2).sum(), np.diag(y22 - s ** 2).sum()
    theta = (np.sqrt(vi[None, :] / vi[:, None]) * (y31 - vi[:, None] * s))[off].sum()
    v1, v3 = ((y21m - c[:, None] * s) * c[None, :])[off].sum() / v, ((y11mm - v * s) * np.outer(c, c))[off].sum() / v ** 2
    tr2, tr = (s ** 2).sum(), vi.sum()
    raw = {"oas": (1 - 2 / p) * (tr2 + tr ** 2) / ((n + 1 - 2 / p) * (tr2 + tr ** 2 / p)), "lw_constant_variance": phi / ((s - goal["constant_variance"]) ** 2).sum() / n,
           "lw_constant_correlation": (phi - phid - r * theta) / ((s - goal["constant_correlation"]) ** 2).sum() / n,
           "lw_single_factor": (phi - phid - (2 * v1 - v3)) / ((s - goal["single_factor"]) ** 2).sum() / n}
    return goal, {k: min(1.0, max(0.0, a)) for k, a in raw.items()}


@pytest.mark.parametrize("bars, names", [(12, 30), (50, 9)])
def test_intensity_without_pairs(spark, bars, names, monkeypatch):
    """Both sides of the matrix; fewer bars than instruments never make a row per pair."""
    x, rows = gaps(bars, names)
    seen, real = [], risk.moments
    monkeypatch.setattr(risk, "moments", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    got = risk.intensity(spark.createDataFrame(rows, "ts timestamp_ntz, instrument_id string, bar bigint, ret double")).first().asDict()
    assert got == pytest.approx(by_pairs(x)[1])
    assert [m.count() for m in seen] == [min(bars, names) ** 2]


def test_targets_against_pairs(spark):
    x, rows = gaps(40, 11)
    got = risk.targets(spark.createDataFrame(rows, "ts timestamp_ntz, instrument_id string, bar bigint, ret double")).toPandas()
    assert len(got) == 121
    for name, matrix in by_pairs(x)[0].items():
        assert got.sort_values(["i", "j"])[name].to_numpy().reshape(11, 11) == pytest.approx(matrix), name


def test_pairs_of_tiles_are_not_exchanged(spark):
    """Rows of pairs come out of the task that makes them: behind the products there is no exchange."""
    _, rows = gaps(20, 12)
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, instrument_id string, bar bigint, ret double")
    for df in (risk.moments(frame, ("s",), tile=3), risk.targets(frame)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.index("MapInArrow")]


def test_variances_are_the_diagonal(spark):
    x, rows = gaps(20, 7)
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, instrument_id string, bar bigint, ret double")
    got = risk.variances(frame).toPandas()
    assert (got["i"] == got["j"]).all() and got.sort_values("i")["value"].to_numpy() == pytest.approx((x ** 2).mean(axis=0))


def test_moments_of_many_chunks(spark):
    x, rows = gaps(90, 6)
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, instrument_id string, bar bigint, ret double")
    got = risk.moments(frame, ("s",), tile=2, chunk=4).toPandas().sort_values(["i", "j"])["s"].to_numpy().reshape(6, 6)
    assert got == pytest.approx(x.T @ x / 90)


def test_pca_with_more_instruments_than_bars(spark, monkeypatch):
    """No vector of the driver is as long as the list of instruments; both decompositions agree with numpy."""
    x, rows = gaps(14, 40)
    x = x - x.mean(axis=0)
    axis = np.linalg.svd(x, full_matrices=False)[2][:2]
    axis = axis * np.sign(axis[np.arange(2), np.abs(axis).argmax(axis=1)])[:, None]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, instrument_id string, bar bigint, ret double")
    for few in (1024, 3):
        monkeypatch.setattr(risk, "FEW_BARS", few)
        got = risk.principal_factors(frame, 2)[0].toPandas().pivot(index="instrument_id", columns="factor", values="exposure")
        np.testing.assert_allclose(got.to_numpy(), axis.T, atol=1e-6)


def test_asset_covariance_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(risk, "TILE", 3)
    x, v, d = rng.normal(size=(10, 2)), np.array([[2.0, 0.5], [0.5, 1.0]]), rng.uniform(size=10)
    x[4, 1] = np.nan   # no row for this factor
    exposures = spark.createDataFrame([(f"i{k}", "ab"[f], float(x[k, f])) for k in range(10) for f in range(2) if not np.isnan(x[k, f])], "instrument_id string, factor string, value double")
    cov = spark.createDataFrame([("ab"[i], "ab"[j], float(v[i, j])) for i in range(2) for j in range(2)], "i string, j string, value double")
    specific = spark.createDataFrame([(f"i{k}", float(d[k])) for k in range(9)], "instrument_id string, var double")
    df = risk.asset_covariance(exposures, cov, specific)
    got = df.toPandas().sort_values(["i", "j"])["value"].to_numpy().reshape(10, 10)
    z = np.nan_to_num(x)
    assert got == pytest.approx(z @ v @ z.T + np.diag(np.append(d[:9], 0.0)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")]
