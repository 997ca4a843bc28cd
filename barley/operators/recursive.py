"""Exponential averages over histories of any length.

The average is a chain of affine steps ``y -> c * y + d``, one for each observation. Inside a block of bars the
chain has a closed form in running sums. The block's effect on an incoming value is again affine, so that
only one small row per block goes through a sequential pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barley.functions import clean
from barley.operators.registry import operator
from barley.operators.spec import BAR, ID

#: short enough that the inverse weights of a block stay inside the double range for every span from 2 up
EMA_BLOCK = 256
_B = "_ema_block"


@operator("smooth", "ema", extra=1)
def ema(*args, **kwargs):
    """Exponential average with span ``n``: not adjusted, no warm-up, gaps decay the old weight."""
    raise TypeError("ema is recursive: use it in a FactorSet, or call ema_columns")


def ema_columns(df: DataFrame, spans: dict[str, tuple[str, float]], key: str = ID, bar: str = BAR) -> DataFrame:
    """Add a column per entry of ``spans``: name -> (input column, span). ``bar`` counts every row, gaps too."""
    columns = df.columns
    alphas = {n: min(1.0, 2.0 / (span + 1.0)) for n, (_, span) in spans.items()}
    inputs = {n: F.col(source) for n, (source, _) in spans.items()}
    df = df.withColumn(_B, F.floor(F.col(bar) / F.lit(EMA_BLOCK)))
    line = Window.partitionBy(key, _B).orderBy(bar)
    upto, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)

    # bar of the observation before this one, inside the block
    df = df.withColumns({f"{n}_at": F.last(F.when(x.isNotNull(), F.col(bar)), ignorenulls=True).over(before)
                         for n, x in inputs.items()})
    logs, adds = {}, {}
    for n, x in inputs.items():
        # weight left to the old average after the gap; span 1 keeps nothing of it and is handled by `last`
        old = F.exp(F.lit(math.log1p(-min(alphas[n], 0.5))) * (F.col(bar) - F.col(f"{n}_at")))
        if alphas[n] > 0.5:
            old = F.pow(F.lit(1.0 - alphas[n]), F.col(bar) - F.col(f"{n}_at"))
        chained = x.isNotNull() & F.col(f"{n}_at").isNotNull() & F.lit(alphas[n] < 1.0)
        logs[f"{n}_c"] = F.when(chained, F.ln(old / (old + alphas[n])))
        adds[f"{n}_d"] = F.when(chained, x * F.lit(alphas[n]) / (old + alphas[n]))
    df = df.withColumns({**logs, **adds})
    df = df.withColumns({f"{n}_l": F.coalesce(F.sum(f"{n}_c").over(upto), F.lit(0.0)) for n in inputs})
    running = {}
    for n, x in inputs.items():
        shifted = F.col(f"{n}_d") * F.exp(-F.col(f"{n}_l"))
        running[f"{n}_s"] = F.coalesce(F.sum(shifted).over(upto), F.lit(0.0))
        running[f"{n}_f"] = F.first(F.when(x.isNotNull(), F.struct(F.col(bar).alias("bar"), x.alias("x"))),
                                    ignorenulls=True).over(upto)
        running[f"{n}_z"] = F.last(x, ignorenulls=True).over(upto)
    df = df.withColumns(running)

    parts = ("first_bar", "first_x", "last_bar", "last_x", "l", "s")
    at_end = {"first_bar": "_f.bar", "first_x": "_f.x", "last_x": "_z", "l": "_l", "s": "_s"}
    aggregates = []
    for n, x in inputs.items():
        aggregates += [F.max_by(F.col(f"{n}{c}"), F.col(bar)).alias(f"{n}__{p}") for p, c in at_end.items()]
        aggregates.append(F.max(F.when(x.isNotNull(), F.col(bar))).alias(f"{n}__last_bar"))
    summary = df.groupBy(key, _B).agg(*aggregates)

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(_B)
        out = {key: group[key], _B: group[_B]}
        for n in spans:
            rows = zip(*(group[f"{n}__{p}"].tolist() for p in parts))
            states = list(_states(rows, alphas[n]))
            out[f"{n}_in"], out[f"{n}_start"] = [s[0] for s in states], [s[1] for s in states]
        return pd.DataFrame(out)

    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {_B} {types[_B]}, " + ", ".join(f"`{n}_in` double, `{n}_start` double" for n in spans)
    df = df.join(summary.groupBy(key).applyInPandas(chain, schema), [key, _B])
    final = {}
    for n in inputs:
        if alphas[n] < 1.0:
            moved = F.exp(F.col(f"{n}_l")) * (F.col(f"{n}_start") + F.col(f"{n}_s"))
        else:
            moved = F.col(f"{n}_z")
        # before the block's first observation the incoming average stands still
        final[n] = clean(F.when(F.col(f"{n}_f").isNotNull(), moved).otherwise(F.col(f"{n}_in")))
    return df.withColumns(final).select(*columns, *spans)


def _states(blocks: Iterator[tuple], alpha: float) -> Iterator[tuple]:
    """For each block: the average coming in, and the average after the block's first observation."""
    y, seen = None, None
    for first_bar, first_x, last_bar, last_x, log_sum, shifted in blocks:
        if first_x is None or first_x != first_x:
            yield y, None
            continue
        if y is None:
            start = first_x
        else:
            old = (1.0 - alpha) ** (first_bar - seen)
            start = (old * y + alpha * first_x) / (old + alpha)
        yield y, start
        y, seen = (math.exp(log_sum) * (start + shifted) if alpha < 1.0 else last_x), last_bar
