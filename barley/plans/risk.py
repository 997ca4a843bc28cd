"""Risk models on long tables: ``returns(ts, instrument_id, bar, ret)``, matrices as ``(i, j, value)``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barley.functions.numeric import ratio
from barley.operators.chunks import with_previous
from barley.operators.spec import BAR, ID, TS, Slice
from barley.plans.gram import pair_sums
from barley.session import cut_lineage, forget, write_apart

#: bars and instruments of a matrix, chunks of bars that a task adds up, and partitions of a side whose tiles all meet
CHUNK, TILE, RUN, SIDES = 4096, 256, 16, 64
#: up to this many bars their products are decomposed on the driver, at full precision
FEW_BARS = 1024


def simple_returns(panel: DataFrame) -> DataFrame:
    step = with_previous(panel, ["close"], [BAR], position=F.col(BAR), width=4096)
    return step.select(TS, ID, BAR, (ratio(F.col("close"), F.col("previous")["close"]) - 1).alias("ret"))


def prepared(returns: DataFrame, tail: float = 0.0, fill: bool = True, percent: bool = False, centre: bool = True) -> DataFrame:
    """Clip each instrument's tails over time, fill gaps with 0, scale by 100, take the mean out.

    The limits and means are aggregates with partial sums, joined back by instrument.
    """
    ret = F.col("ret")
    if tail > 0:
        edges = returns.groupBy(ID).agg(F.percentile("ret", F.array(F.lit(tail), F.lit(1 - tail))).alias("_e"))
        returns = returns.join(edges, ID).withColumn("ret", F.when(ret.isNotNull(), F.greatest(F.col("_e")[0], F.least(F.col("_e")[1], ret)))).drop("_e")
    if fill:
        returns = returns.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    if percent:
        returns = returns.withColumn("ret", ret * 100)
    if centre:
        means = returns.groupBy(ID).agg(F.avg("ret").alias("_m"))
        returns = returns.join(means, ID).withColumn("ret", ret - F.col("_m")).drop("_m")
    return returns


#: all moments: mean products over time of order (1,1), (2,2), (3,1), and those with the market return; variances and market products of both sides
MOMENTS = ("s", "y22", "y31", "y21m", "y11mm", "xm")


def _products(wanted: tuple[str, ...], x: np.ndarray, y: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
    """Products over bars of the columns of ``x`` with those of ``y``; ``m`` is the market return of each bar."""
    def down(v: np.ndarray) -> np.ndarray:
        return np.repeat(v.sum(axis=0)[:, None], y.shape[1], axis=1)

    def across(v: np.ndarray) -> np.ndarray:
        return np.repeat(v.sum(axis=0)[None, :], x.shape[1], axis=0)

    makes = {"s": lambda: x.T @ y, "y22": lambda: (x ** 2).T @ y ** 2, "y31": lambda: (x ** 3).T @ y, "y21m": lambda: (x ** 2).T @ (y * m),
             "y11mm": lambda: (x * m).T @ (y * m), "xm": lambda: down(x * m), "ym": lambda: across(y * m), "xx": lambda: down(x * x), "yy": lambda: across(y * y)}
    return {name: makes[name]() for name in wanted}


def _packed(wide: int, deep: int):
    """Cells of one tile and chunk of bars to one row: a matrix of bars by places, and the market of each bar."""
    def run(table: pa.Table) -> pa.Table:
        at, place = (table.column(c).to_numpy() for c in ("at", "place"))
        x, m = np.zeros((deep, wide)), np.zeros(deep)
        x[at, place] = table.column("ret").to_numpy()
        m[at] = table.column("mkt").to_numpy()
        return pa.table({"tile": table.column("tile").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "x": pa.array([x.tobytes()]), "m": pa.array([m.tobytes()])})
    return run


def cells_of(own: pa.Array, other: pa.Array, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Matrices of one pair of tiles as rows ``(i, j, ...)``."""
    i, j = np.divmod(np.arange(len(own) * len(other)), len(other))
    return pa.RecordBatch.from_arrays([own.take(pa.array(i)), other.take(pa.array(j)), *(pa.array(v.ravel()) for v in columns.values())], ["i", "j", *columns])


def _summed(wanted: tuple[str, ...], wide: int, deep: int):
    """Products of tile pairs, added up over the chunks that a task gets in order, as rows of the pair both ways."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, names, sums, turned = None, None, {}, {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (own, other), found in ((names, sums), (names[::-1], turned)):
                if found:
                    yield cells_of(own, other, {n: found[n][:len(own), :len(other)] for n in wanted})

        for batch in batches:
            at = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                a, b = at["ti"][k].as_py(), at["tj"][k].as_py()
                if (a, b) != pair:
                    yield from rows() if pair else ()
                    pair, names, sums, turned = (a, b), (at["ni"][k].values, at["nj"][k].values), {}, {}
                x, y, m, other = (np.frombuffer(v) if v is not None else np.zeros(size) for v, size in
                                  ((at["x"][k].as_py(), deep * wide), (at["y"][k].as_py(), deep * wide), (at["m"][k].as_py(), deep), (at["my"][k].as_py(), deep)))
                # a tile knows the market of the bars at which it has returns
                x, y, m = x.reshape(deep, wide), y.reshape(deep, wide), np.where(m != 0, m, other)[:, None]
                for total, new in ((sums, _products(wanted, x, y, m)), (turned, _products(wanted, y, x, m) if a != b else {})):
                    for name, value in new.items():
                        total[name] = total[name] + value if name in total else value
        yield from rows() if pair else ()
    return run


def _dealt(names: DataFrame, tile: int) -> tuple[DataFrame, int]:
    """Instruments in tiles, with their place inside; and the number of tiles."""
    tiles = max(1, -(-names.count() // tile))
    names = names.withColumn("tile", F.pmod(F.xxhash64(ID), F.lit(tiles)).cast("int"))
    return cut_lineage(names.withColumn("place", F.row_number().over(Window.partitionBy("tile").orderBy(ID)) - 1)), tiles


def _labels(names: DataFrame) -> DataFrame:
    """(tile, names of its places)."""
    return names.groupBy("tile").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", ID))), lambda v: v[ID]).alias("names"))


def _all_pairs(left: DataFrame, right: DataFrame, tiles: int) -> DataFrame:
    """Every tile of one side with every tile of the other. No exchange: a task reads a part of each side."""
    sides = min(SIDES, tiles)
    return left.repartition(sides, "ti").crossJoin(right.repartition(sides, "tj")).where("ti <= tj")


def moments(returns: DataFrame, wanted: tuple[str, ...] = MOMENTS, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """(i, j, and the moments ``wanted``), complete: means over all bars, a missing return counts 0.

    Instruments are dealt to tiles. A tile's returns of up to 4,096 bars are one matrix; a task multiplies the matrices of two tiles and gives the rows of
    the pair away, names and all. Only histories of more bars are exchanged by pair. Rows of pairs never wait on disk, but for histories of more than 16 chunks.
    """
    returns = write_apart(returns.select(ID, F.col(BAR).cast("bigint").alias(BAR), F.col("ret").cast("double").alias("ret")), "returns")
    names, tiles = _dealt(returns.select(ID).distinct(), tile)
    wide = names.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0] + 1
    bars, last = returns.agg(F.count_distinct(BAR), F.coalesce(F.max(BAR), F.lit(0))).first()
    deep = min(chunk, last + 1)
    chunks = last // deep + 1
    if any("m" in m for m in wanted):
        rows = returns.join(returns.groupBy(BAR).agg(F.avg("ret").alias("mkt")), BAR)
    else:
        rows = returns.withColumn("mkt", F.lit(0.0))
    cells = rows.join(names, ID).where("ret IS NOT NULL").select(
        "tile", "place", F.floor(F.col(BAR) / deep).alias("chunk"), F.pmod(F.col(BAR), F.lit(deep)).cast("int").alias("at"), "ret", F.coalesce("mkt", F.lit(0.0)).alias("mkt"))
    blocks = cells.groupBy("tile", "chunk").applyInArrow(_packed(wide, deep), "tile int, chunk bigint, x binary, m binary")
    # a tile without any return has a row, too
    blocks = write_apart(_labels(names).join(blocks, "tile", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("bigint"))), "blocks")
    forget(returns)
    first = blocks.select("chunk", F.col("tile").alias("ti"), F.col("names").alias("ni"), "x", "m")
    second = blocks.select("chunk", F.col("tile").alias("tj"), F.col("names").alias("nj"), F.col("x").alias("y"), F.col("m").alias("my"))
    if chunks == 1:
        pairs = _all_pairs(first.drop("chunk"), second.drop("chunk"), tiles)
    else:
        pairs = first.join(second, "chunk").where("ti <= tj").repartition("ti", "tj", F.floor(F.col("chunk") / RUN)).sortWithinPartitions("ti", "tj", "chunk")
    sums = pairs.mapInArrow(_summed(wanted, wide, deep), "i string, j string, " + ", ".join(f"{m} double" for m in wanted))
    if chunks > RUN:
        sums = sums.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in wanted])
    return sums.select("i", "j", *[(F.col(m) / bars).alias(m) for m in wanted])


def covariance(returns: DataFrame) -> DataFrame:
    """Mean products with 1/T; returns are centred before."""
    return moments(returns, ("s",)).select("i", "j", F.col("s").alias("value"))


def variances(returns: DataFrame) -> DataFrame:
    """The diagonal of ``covariance`` as ``(i, j, value)``: one row per instrument, no pairs."""
    bars = returns.agg(F.count_distinct(BAR)).scalar()
    own = returns.groupBy(ID).agg(F.sum(F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0))).alias("q"))
    return own.select(F.col(ID).alias("i"), F.col(ID).alias("j"), (F.col("q") / bars).alias("value"))


def _square_sum(returns: DataFrame, names: int, bars: int) -> float:
    """Sum of all squared covariances, from the smaller of the two matrices of products: instruments by instruments, or bars by bars."""
    if bars > names:
        return moments(returns, ("s",)).agg(F.sum(F.col("s") ** 2)).first()[0]
    dealt, tiles = _dealt(returns.select(ID).distinct(), TILE)
    number = (F.col("place") * tiles + F.col("tile")).cast("bigint")
    turned = returns.join(dealt, ID).select(F.col(BAR).cast("string").alias(ID), number.alias(BAR), "ret")
    return moments(turned, ("s",)).agg(F.sum((F.col("s") * (names / bars)) ** 2)).first()[0]


def facts(returns: DataFrame) -> dict[str, float]:
    """Sums over all pairs of instruments that the targets and intensities need, from sums per instrument and per bar.

    A sum over pairs of products is a product of sums: none of them needs the pairs. ``all_*`` are sums over all pairs, ``own_*`` over equal ones.
    """
    c = F.col
    x = F.coalesce(c("ret"), F.lit(0.0))
    market = returns.groupBy(BAR).agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("m"))
    n, v = market.agg(F.count(F.lit(1)), F.avg(c("m") ** 2)).first()
    cells = returns.join(market, BAR).select(ID, BAR, "m", x.alias("x"))
    own = cells.groupBy(ID).agg(*[(F.sum(value) / n).alias(name) for name, value in {
        "v": c("x") ** 2, "c": c("x") * c("m"), "x4": c("x") ** 4, "x3m": c("x") ** 3 * c("m"), "x2m2": (c("x") * c("m")) ** 2}.items()])
    own = write_apart(own, "instruments")
    sums = {"tr": c("v"), "own_ss": c("v") ** 2, "moving": (c("v") > 0).cast("double"), "own_y22": c("x4"), "cc": c("c") ** 2, "c4": c("c") ** 4, "own_scc": c("v") * c("c") ** 2,
            "own_y21m": c("x3m") * c("c"), "own_y11mm": c("x2m2") * c("c") ** 2}
    found = own.agg(F.count(F.lit(1)).cast("double").alias("p"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("spread"), *[F.coalesce(F.sum(e), F.lit(0.0)).alias(k) for k, e in sums.items()]).first().asDict()
    sd = F.sqrt("v")
    per_bar = cells.join(own.select(ID, "v", "c"), ID).groupBy(BAR).agg(
        F.first("m").alias("m"), F.sum(c("x") ** 2).alias("q"), F.sum(ratio(c("x"), sd)).alias("z"), F.sum(sd * c("x")).alias("w"), F.sum(ratio(c("x") ** 3, sd)).alias("k"), F.sum(c("c") * c("x")).alias("u"))
    over = {"all_y22": c("q") ** 2, "all_corr": c("z") ** 2, "all_svv": c("w") ** 2, "all_y31": c("k") * c("w"), "all_scc": c("u") ** 2, "all_y21m": c("m") * c("q") * c("u"), "all_y11mm": (c("m") * c("u")) ** 2}
    found |= per_bar.agg(*[F.coalesce(F.sum(e) / n, F.lit(0.0)).alias(k) for k, e in over.items()]).first().asDict()
    forget(own)
    q = found["moving"]
    return found | {"n": float(n), "v": v, "mean_var": found["tr"] / found["p"] if found["p"] else None, "mean_corr": (found["all_corr"] - q) / (q * (q - 1)) if q > 1 else None}


def targets(returns: DataFrame) -> DataFrame:
    """The three targets to shrink to, beside the covariances ``s``. All that concerns the pair alone comes with its products; the rest are three numbers."""
    returns = write_apart(returns.select(ID, BAR, "ret"), "returns")
    f, m = facts(returns), moments(returns, ("s", "xx", "yy", "xm", "ym"))
    forget(returns)
    same, vi, vj = F.col("i") == F.col("j"), F.col("xx"), F.col("yy")
    return m.withColumns({
        "constant_variance": F.when(same, F.lit(f["mean_var"])).otherwise(F.lit(0.0)),
        "constant_correlation": F.when(same, vi).otherwise(F.lit(f["mean_corr"]).cast("double") * F.sqrt(vi * vj)),
        "single_factor": F.when(same, vi).otherwise(ratio(F.col("xm") * F.col("ym"), F.lit(f["v"]).cast("double"))),
    })


def intensity(returns: DataFrame) -> DataFrame:
    """Shrink intensities: OAS, and the Ledoit-Wolf form for each of the three targets, between 0 and 1. Work and disk follow the returns, not their pairs."""
    returns = write_apart(returns.select(ID, BAR, "ret"), "returns")
    f = facts(returns)
    p, n, v, r = f["p"], f["n"], f["v"], f["mean_corr"]
    tr2 = _square_sum(returns, int(p), int(n)) or 0.0
    forget(returns)
    off = tr2 - f["own_ss"]
    phi, phi_d = f["all_y22"] - tr2, f["own_y22"] - f["own_ss"]
    theta = f["all_y31"] - f["all_svv"] - phi_d
    spread = {"constant_variance": off + f["spread"] * p, "constant_correlation": None, "single_factor": None}
    noise = {"constant_variance": phi, "constant_correlation": None, "single_factor": None}
    if r is not None:
        spread["constant_correlation"] = off - 2 * r * (f["all_svv"] - f["own_ss"]) + r * r * (f["tr"] ** 2 - f["own_ss"])
        noise["constant_correlation"] = phi - phi_d - r * theta
    if v:
        v1 = (f["all_y21m"] - f["all_scc"] - f["own_y21m"] + f["own_scc"]) / v
        v3 = (f["all_y11mm"] - v * f["all_scc"] - f["own_y11mm"] + v * f["own_scc"]) / (v * v)
        spread["single_factor"] = off - 2 / v * (f["all_scc"] - f["own_scc"]) + (f["cc"] ** 2 - f["c4"]) / (v * v)
        noise["single_factor"] = phi - phi_d - (2 * v1 - v3)

    def unit(a: float | None, b: float | None) -> float:
        return max(0.0, min(1.0, a / b)) if a is not None and b else 0.0

    row = [unit((1 - 2 / p) * (tr2 + f["tr"] ** 2), (n + 1 - 2 / p) * (tr2 + f["tr"] ** 2 / p)) if p else 0.0, *[unit(noise[k], (spread[k] or 0.0) * n) for k in spread]]
    return returns.sparkSession.createDataFrame([row], "oas double, " + ", ".join(f"lw_{k} double" for k in spread))


def shrunk(t: DataFrame, target: str, alpha: float) -> DataFrame:
    return t.select("i", "j", (F.col("s") * (1 - alpha) + F.col(target) * alpha).alias("value"))


def principal_factors(returns: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """PCA risk model: ``(instrument_id, factor, exposure, specific)`` and ``(ts, factor, score)``.

    The library's matrix holds one row per instrument, so that the driver holds products of bars (up to 1,024 of them, else ``k`` vectors over time) and
    nothing of the instruments' number.
    """
    returns = write_apart(returns.select(TS, ID, "ret", F.coalesce("ret", F.lit(0.0)).alias("x")), "returns")
    lines = returns.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct(TS, "x"))).alias("cells"), F.avg("x").alias("mean"))
    lines = write_apart(lines.select(ID, F.transform("cells", lambda v: v["x"] - F.col("mean")).alias("x")), "lines")
    matrix = RowMatrix(lines.select("x").rdd.map(lambda row: Vectors.dense(row[0])))
    if matrix.numCols() <= FEW_BARS:
        values, vectors = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
        size, axes = np.sqrt(np.maximum(values[::-1][:k], 0.0)), vectors[:, ::-1][:, :k]
    else:
        found = matrix.computeSVD(k)
        size, axes = found.s.toArray(), found.V.toArray()
    axes = axes / np.where(size > 0, size, 1.0)
    factors = range(axes.shape[1])
    weights = returns.sparkSession.createDataFrame([([axes[:, f].tolist() for f in factors],)], "_w array<array<double>>")
    products = F.transform("_w", lambda w: F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    exposure = lines.crossJoin(F.broadcast(weights)).select(ID, F.posexplode(products).alias("factor", "exposure"))   # one row
    exposure = write_apart(exposure, "exposure")
    forget(lines)
    # the largest exposure of a factor is positive
    most = exposure.groupBy("factor").agg(F.max(F.abs("exposure")).alias("_most"))
    sign = exposure.join(most, "factor").where(F.abs("exposure") == F.col("_most")).groupBy("factor").agg(F.signum(F.min_by("exposure", ID)).alias("_sign"))
    signs = {row["factor"]: row["_sign"] for row in sign.collect()}   # k numbers
    signed = F.array(*[F.lit(signs[f] or 1.0) for f in factors])
    exposure = exposure.select(ID, "factor", (F.col("exposure") * F.get(signed, F.col("factor"))).alias("exposure"))
    rows = exposure.groupBy(ID).agg(F.transform(F.sort_array(F.collect_list(F.struct("factor", "exposure"))), lambda v: v["exposure"]).alias("_e"))
    both = returns.join(rows, ID)
    scores = both.groupBy(TS).agg(F.array(*[F.sum(F.col("ret") * F.col("_e")[f]) for f in factors]).alias("_s"))
    fit = F.aggregate(F.zip_with("_e", "_s", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rest = both.join(scores, TS).groupBy(ID).agg(F.var_pop(F.col("ret") - fit).alias("specific"))
    return exposure.join(rest, ID), scores.select(TS, F.posexplode("_s").alias("factor", "score"))


def style_exposure(values: DataFrame, limit: float = 3.0) -> DataFrame:
    """Missing to 0, standardised per time by the population deviation, clipped."""
    c = Slice((TS, "factor")).all()
    x = F.col("x")
    z = F.coalesce(ratio(x - F.avg("x").over(c), F.stddev_pop("x").over(c)), F.lit(0.0))
    return values.withColumn("x", F.coalesce("value", F.lit(0.0))).select(
        TS, ID, "factor", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)).alias("value"))


def sector_dummies(sectors: DataFrame, names: list[str]) -> DataFrame:
    return sectors.groupBy(ID).pivot("sector", names).agg(F.lit(1.0)).fillna(0.0, names)


def cross_sectional_regression(rows: DataFrame, exposures: list[str], weight: str = "w") -> DataFrame:
    """Weighted least squares of ``ret`` on exposures at each time (minimum norm): factor returns and residuals.

    One task holds one time.
    """
    types = dict(rows.dtypes)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        good = group.dropna(subset=["ret", weight, *exposures])
        if not len(good):
            return good[[TS, ID]].assign(residual=0.0, **{f"b_{e}": 0.0 for e in exposures})
        x, y, s = good[exposures].to_numpy(float), good["ret"].to_numpy(float), np.sqrt(good[weight].to_numpy(float))
        b = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]
        return pd.DataFrame({TS: good[TS], ID: good[ID], "residual": y - x @ b, **{f"b_{e}": b[i] for i, e in enumerate(exposures)}})

    schema = f"{TS} {types[TS]}, {ID} string, residual double, " + ", ".join(f"b_{e} double" for e in exposures)
    return rows.select(TS, ID, "ret", weight, *exposures).groupBy(TS).applyInPandas(fit, schema)


def specific_variance(residuals: DataFrame, weights: DataFrame, share: float = 0.5) -> DataFrame:
    """Residual variance per instrument, drawn by ``share`` to the weighted mean."""
    own = residuals.groupBy(ID).agg(F.var_pop("residual").alias("var")).join(weights, ID)
    mean = own.agg(ratio(F.sum(F.col("var") * F.col("w")), F.sum("w"))).scalar()
    return own.select(ID, (F.col("var") * (1 - share) + mean * share).alias("var"))


def factor_covariance(factor_returns: DataFrame, names: list[str]) -> DataFrame:
    """Sample covariance of factor returns over the times that have both; a matrix of sums per task, added up."""
    n = F.col("n")
    half = pair_sums(factor_returns, names).select("i", "j", ratio(F.col("xy") - F.col("x") * F.col("y") / n, n - 1).alias("value"))
    full = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    label = F.array(*map(F.lit, names))
    return full.select(F.get(label, F.col("i")).alias("i"), F.get(label, F.col("j")).alias("j"), "value")


def _exposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two tiles: products of the one's exposures times factor covariances with the other's exposures."""
    def matrix(scalar: pa.Scalar, rows: int) -> np.ndarray:
        return scalar.values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)

    for batch in batches:
        at = {n: batch.column(n) for n in batch.schema.names}
        for k in range(batch.num_rows):
            ni, nj = at["ni"][k].values, at["nj"][k].values
            ties = [(ni, nj, "i", "j")] if at["ti"][k] == at["tj"][k] else [(ni, nj, "i", "j"), (nj, ni, "j", "i")]
            for own, other, a, b in ties:
                left, right = (matrix(at[n][k], len(of)) for n, of in ((f"l{a}", own), (f"x{b}", other)))
                there_l, there_r = (matrix(at[n][k], len(of)).astype(float) for n, of in ((f"p{a}", own), (f"q{b}", other)))
                value = np.nan_to_num(left) @ np.nan_to_num(right).T
                some = (~np.isnan(left)).astype(float) @ (~np.isnan(right)).astype(float).T > 0
                if a + b == "ij" and len(ties) == 1:
                    np.fill_diagonal(value, np.diag(value) + np.nan_to_num(at["d"][k].values.to_numpy(zero_copy_only=False)))
                i, j = np.nonzero(there_l @ there_r.T > 0)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(i)), other.take(pa.array(j)), pa.array(value[i, j], mask=~some[i, j])], ["i", "j", "value"])


def asset_covariance(exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """``X V X' + D`` over ``(instrument_id, factor, value)`` exposures.

    Instruments are dealt to tiles, and every two tiles meet in one task; no row of a pair waits on disk. Factors are the few columns of the matrices.
    """
    cov = {(row.i, row.j): row.value for row in factor_cov.select("i", "j", "value").collect()}   # a few factors
    names = sorted({f for pair in cov for f in pair})
    cells = exposures.join(specific.select(ID, "var"), ID, "left").where(F.col("factor").isin(names))
    own = cells.groupBy(ID).agg(F.first("var", ignorenulls=True).alias("var"), *[F.max(F.when(F.col("factor") == f, F.col("value"))).alias(f"_x{k}") for k, f in enumerate(names)],
                                *[F.max((F.col("factor") == f).cast("double")).alias(f"_p{k}") for k, f in enumerate(names)])
    own = write_apart(own, "exposures")
    dealt, tiles = _dealt(own.select(ID), TILE)
    rows = own.join(dealt, ID)
    xs, ps = [F.col(f"_x{k}") for k in range(len(names))], [F.col(f"_p{k}") for k in range(len(names))]

    def total(b: str, of: list[Column], weigh: bool) -> Column:
        parts = [(x * F.lit(cov[a, b]).cast("double") if weigh else x) for x, a in zip(of, names) if (a, b) in cov]
        there = [p.isNotNull() for p in parts]
        return F.when(reduce(lambda u, w: u | w, there), reduce(lambda u, w: u + w, [F.coalesce(p, F.lit(0.0)) for p in parts])) if parts else F.lit(None).cast("double")

    rows = rows.select("tile", "place", ID, "var", F.array(*xs).alias("x"), F.array(*[total(b, xs, True) for b in names]).alias("l"), F.array(*ps).alias("q"),
                       F.array(*[F.greatest(*[p for p, a in zip(ps, names) if (a, b) in cov], F.lit(0.0)) for b in names]).alias("p"))
    blocks = rows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("place", ID, "var", "x", "l", "q", "p"))).alias("_r"))
    blocks = write_apart(blocks.select("tile", *[F.col("_r")[c].alias(c) for c in (ID, "var", "x", "l", "q", "p")]), "blocks")
    forget(own)
    first = blocks.select(F.col("tile").alias("ti"), F.col(ID).alias("ni"), F.col("x").alias("xi"), F.col("l").alias("li"), F.col("q").alias("qi"), F.col("p").alias("pi"), F.col("var").alias("d"))
    second = blocks.select(F.col("tile").alias("tj"), F.col(ID).alias("nj"), F.col("x").alias("xj"), F.col("l").alias("lj"), F.col("q").alias("qj"), F.col("p").alias("pj"))
    return _all_pairs(first, second, tiles).mapInArrow(_exposed, "i string, j string, value double")
