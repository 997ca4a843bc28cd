"""From ticks to bars, and from bars to the dense panel the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barley.functions import clean
from barley.operators.spec import BAR, ID, TS

PRICES = ("open", "high", "low", "close")


def bars_from_ticks(ticks: DataFrame, bar: Column, order: list[str], price: str = "price", size: str = "size") -> DataFrame:
    """OHLCV per instrument and bar. ``bar`` maps a tick to its bar start; ``order`` sorts ticks inside a bar.

    One aggregation with partial sums before the exchange, so that a hot instrument costs its number of
    bars, not of ticks.
    """
    place = F.struct(*[F.col(c) for c in order])
    return ticks.groupBy(F.col(ID), bar.alias(TS)).agg(
        F.min_by(price, place).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, place).alias("close"),
        F.sum(size).alias("volume"),
        F.sum(F.col(price) * F.col(size)).alias("quote_volume"),
    )


def tumbling(width: str, ts: str = TS) -> Column:
    """Start of the fixed-width bar a timestamp falls into, such as ``"6 hours"``."""
    return F.window(F.col(ts), width)["start"]


def time_axis(bars: DataFrame) -> DataFrame:
    """``(ts, bar)``: all timestamps of all instruments, numbered from 0.

    Numbers are made in two levels, inside each hour and over the hours, so that no task sorts the
    whole axis. Only the one-row-per-hour counts go through a single task.
    """
    hour = F.date_trunc("hour", F.col(TS))
    axis = bars.select(TS).distinct().withColumn("_hour", hour)
    counts = axis.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_hour").orderBy(TS)) - 1
    return (axis.withColumn("_place", inside).join(offsets, "_hour")
            .select(TS, (F.col("_offset") + F.col("_place")).cast("bigint").alias(BAR)))


def densify(bars: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Every instrument at every timestamp of the union axis; missing cells are null, NaN becomes null.

    The axis is cut into runs of 4,096 bars. Instruments unroll the numbers of their runs and meet the bars of a run by key, so that both sides of the
    join are as small as the planner takes them for: a side that is unrolled before it joins would be broadcast by the size of what it came from.
    """
    axis = time_axis(bars) if axis is None else axis
    values = [c for c in bars.columns if c not in (ID, TS, BAR)]
    types = dict(bars.dtypes)
    last = axis.agg(F.max(BAR)).scalar()
    step = 4096
    runs = bars.select(ID).distinct().withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / F.lit(step)))))
    # few bytes here, many cells after the join: the tasks are not merged by bytes
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(tasks, ID, "_run")
    times = axis.select(TS, BAR, F.floor(F.col(BAR) / F.lit(step)).alias("_run")).repartition(tasks, BAR)
    cells = runs.join(times, "_run").drop("_run")
    known = bars.select(ID, TS, *[clean(F.col(c)).alias(c) if types[c] in ("double", "float") else F.col(c)
                                  for c in values])
    return cells.join(known, [ID, TS], "left").select(ID, TS, BAR, *values)


def to_wide(panel: DataFrame, field: str, instruments: list[str]) -> DataFrame:
    """Matrix form: one row per timestamp and one column per listed instrument."""
    return panel.groupBy(TS).pivot(ID, instruments).agg(F.first(field, ignorenulls=True))


def to_long(wide: DataFrame, field: str) -> DataFrame:
    """Back from the matrix form; missing cells are left out."""
    names = [c for c in wide.columns if c != TS]
    return wide.unpivot([TS], names, ID, field).where(F.col(field).isNotNull())


def to_matrix(panel: DataFrame, field: str, instruments: DataFrame, width: int = 256) -> tuple[DataFrame, DataFrame]:
    """Matrix form for any number of instruments: ``(ts, block, cells)`` and ``(block, names)``. ``cells`` holds a value or null per name of its block.

    ``to_wide`` has a column per instrument, which plans and rows carry to some hundreds. Blocks hold about ``width`` of the listed instruments each.
    """
    listed = instruments.select(ID).distinct()
    block = F.pmod(F.xxhash64(ID), F.lit(max(1, -(-listed.count() // width)))).alias("block")
    labels = listed.groupBy(block).agg(F.sort_array(F.collect_list(ID)).alias("names"))
    known = F.collect_list(F.when(F.col(field).isNotNull(), F.struct(F.col(ID), F.col(field))))
    rows = panel.groupBy(TS, block).agg(F.map_from_entries(known).alias("_known")).join(labels, "block")
    return rows.select(TS, "block", F.transform("names", lambda n: F.try_element_at("_known", n)).alias("cells")), labels


def from_matrix(rows: DataFrame, labels: DataFrame, field: str) -> DataFrame:
    """Back from blocks; missing cells are left out."""
    cells = rows.join(labels, "block").select(TS, F.explode(F.arrays_zip("names", "cells")).alias("_c"))
    return cells.select(TS, F.col("_c.names").alias(ID), F.col("_c.cells").alias(field)).where(F.col(field).isNotNull())


def load_bars(folder_or_df, instruments: list | None = None, start=None, end=None) -> DataFrame:
    """Bars of some instruments between two times, both inclusive. The filters reach the scan."""
    df = folder_or_df
    if instruments is not None:
        df = df.where(F.col(ID).isin(instruments))
    if start is not None:
        df = df.where(F.col(TS) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(TS) <= F.lit(end))
    return df
