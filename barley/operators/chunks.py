"""Look back over a series of any length without putting a whole series into one task.

A series is cut into chunks of a position. Inside a chunk a window does the work; between chunks only one summary row
per chunk moves. A hot series therefore spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barley.operators.spec import ID, TS

#: one chunk of time, in seconds
SPAN = 180 * 86400


def seconds(ts: str | Column = TS) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def _cut(df: DataFrame, position: Column, width: float) -> DataFrame:
    return df.withColumn("_chunk", F.floor(position / F.lit(float(width))))


def with_previous(df: DataFrame, fields: list[str], order: list[str], key: list[str] | None = None,
                  position: Column | None = None, width: float = SPAN, out: str = "previous") -> DataFrame:
    """Add ``out``, a struct of ``fields`` of the row before this one. ``position`` must grow with ``order``."""
    key = [ID] if key is None else key
    df = _cut(df, seconds() if position is None else position, width)
    row = F.struct(*[F.col(f) for f in fields])
    inside = F.lag(row).over(Window.partitionBy(*key, "_chunk").orderBy(*order))
    ends = df.groupBy(*key, "_chunk").agg(F.max_by(row, F.struct(*order)).alias("_end"))
    carried = F.lag("_end").over(Window.partitionBy(*key).orderBy("_chunk"))
    ends = ends.select(*key, "_chunk", carried.alias("_carried"))
    df = df.withColumn("_inside", inside).join(ends, [*key, "_chunk"], "left")
    return df.withColumn(out, F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_chunk")


def with_last_known(df: DataFrame, fields: list[str], order: list[str], key: list[str],
                    position: Column, width: float = SPAN) -> DataFrame:
    """Replace each field by its last non-null value so far, this row included."""
    df = _cut(df, position, width)
    line = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = df.groupBy(*key, "_chunk").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f"_{f}") for f in fields])
    ends = ends.select(*key, "_chunk", *[F.last(f"_{f}", ignorenulls=True).over(before).alias(f"_{f}") for f in fields])
    inside = {f: F.last(f, ignorenulls=True).over(line) for f in fields}
    df = df.withColumns(inside).join(ends, [*key, "_chunk"], "left")
    return df.withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).drop("_chunk", *[f"_{f}" for f in fields])


def with_running(df: DataFrame, sums: dict[str, Column], order: list[str], key: list[str],
                 position: Column, width: float = SPAN, how=F.sum) -> DataFrame:
    """Running sums (or maxima, with ``how=F.max``) from the start of each series, this row included."""
    df = _cut(df, position, width).withColumns({f"_v_{n}": c for n, c in sums.items()})
    line = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*key, "_chunk").agg(*[how(f"_v_{n}").alias(f"_e_{n}") for n in sums])
    ends = ends.select(*key, "_chunk", *[how(f"_e_{n}").over(before).alias(f"_b_{n}") for n in sums])
    df = df.withColumns({n: how(f"_v_{n}").over(line) for n in sums}).join(ends, [*key, "_chunk"], "left")
    if how is F.sum:
        whole = {n: F.coalesce(F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)), F.col(f"_b_{n}")) for n in sums}
    else:
        whole = {n: F.greatest(n, f"_b_{n}") for n in sums}
    return df.withColumns(whole).drop("_chunk", *[f"_{p}_{n}" for n in sums for p in "vb"])
