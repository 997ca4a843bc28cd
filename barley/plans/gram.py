"""Sums of products of many columns: each task keeps one matrix of sums over its Arrow batches, and only these matrices are added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barley.operators.spec import TS

PAIR = "i int, j int, n bigint, x double, y double, xy double"


def as_matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Rows by columns; missing values are NaN."""
    return np.column_stack([batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in names]) if batch.num_rows else np.zeros((0, len(names)))


def column_means(wide: DataFrame, names: list[str]) -> np.ndarray:
    """Means of the columns, missing values left out; 0 for a column without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(names), np.int64), np.zeros(len(names))
        for batch in batches:
            x = as_matrix(batch, names)
            n += (~np.isnan(x)).sum(axis=0)
            total += np.nansum(x, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(n), pa.array(total)], ["i", "n", "x"])

    rows = wide.select(*names).mapInArrow(run, "i int, n bigint, x double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
    means = np.zeros(len(names))
    means[rows.column("i").to_numpy()] = rows.column("x").to_numpy() / np.maximum(rows.column("n").to_numpy(), 1)
    return means


def pair_sums(wide: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, n, x, y, xy) for columns i <= j by number: over rows that have both, their count, and sums of both and of their product, each column
    less its mean. One matrix per task, whatever its rows; K * K / 2 rows in the end."""
    centre = column_means(wide, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        n, x, xy = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            own = as_matrix(batch, names) - centre
            there = (~np.isnan(own)).astype(float)
            own = np.nan_to_num(own)
            n, x, xy = n + there.T @ there, x + own.T @ there, xy + own.T @ own
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[i, j].astype(np.int64)), pa.array(x[i, j]),
                                          pa.array(x[j, i]), pa.array(xy[i, j])], ["i", "j", "n", "x", "y", "xy"])

    return wide.select(*names).mapInArrow(run, PAIR).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy")])


def by_time(wide: DataFrame, names: list[str], one_time, schema: str) -> DataFrame:
    """Rows of ``one_time`` over tasks that see their times one by one: it gets an iterator over the values of each time, as a pandas frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def times() -> Iterator[pd.DataFrame]:
            held, at = [], None
            for batch in batches:
                ts = batch.column(TS)
                cuts = np.flatnonzero(np.append(True, pc.not_equal(ts[1:], ts[:-1]).to_numpy(zero_copy_only=False))) if len(ts) else []
                for low, high in zip(cuts, [*cuts[1:], len(ts)]):
                    if held and ts[int(low)] != at:
                        yield pd.DataFrame(np.concatenate(held), columns=names)
                        held = []
                    at = ts[int(low)]
                    held.append(as_matrix(batch.slice(low, high - low), names))
            if held:
                yield pd.DataFrame(np.concatenate(held), columns=names)
        yield from one_time(times())

    return wide.where(F.col(TS).isNotNull()).select(TS, *names).repartition(TS).sortWithinPartitions(TS).mapInArrow(run, schema)
