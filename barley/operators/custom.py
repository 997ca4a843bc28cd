"""User functions as operators: a Python function of a window, or of a cross-section."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barley.operators.registry import operator
from barley.operators.rolling import _window
from barley.operators.spec import BY_INSTRUMENT, ID, TS, Track


def python_rolling(name: str, function: Callable) -> None:
    """Register ``function(values) -> float`` as a rolling operator. Windows are bounded arrays, sent in Arrow batches."""
    def over(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: None if w is None else float(function(w))).astype("float64")

    @operator("rolling", name, extra=1)
    def build(x: Column, n: int, on: Track = BY_INSTRUMENT) -> Column:
        return F.pandas_udf(over, "double")(_window(x, n, on))


def python_slice(panel: DataFrame, column: str, out: str, function: Callable) -> DataFrame:
    """Add ``out`` from ``function(series indexed by instrument) -> series`` at each time. One task holds one time."""
    types = dict(panel.dtypes)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        result = function(group.set_index(ID)[column])
        return pd.DataFrame({TS: group[TS], ID: group[ID], out: result.reindex(group[ID]).to_numpy(float)})

    made = panel.select(TS, ID, column).groupBy(TS).applyInPandas(one, f"{TS} {types[TS]}, {ID} {types[ID]}, {out} double")
    return panel.join(made, [TS, ID])


def complexity(formulas: DataFrame, column: str = "expression") -> DataFrame:
    """Size measures of formula texts: calls and operands, nesting depth, share of numbers."""
    tokens = F.regexp_extract_all(F.col(column), F.lit(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|[-+*/^<>=!&|?:]+"), F.lit(0))
    numbers = F.size(F.filter("tokens", lambda t: t.rlike(r"^\d")))
    signs = F.filter(F.split(F.regexp_replace(column, r"[^()]", ""), ""), lambda c: c != "")
    level = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda s, c: F.struct(
        (s["now"] + F.when(c == "(", 1).otherwise(-1)).alias("now"),
        F.greatest(s["top"], s["now"] + F.when(c == "(", 1).otherwise(-1)).alias("top")))
    return formulas.withColumn("tokens", tokens).withColumns({
        "nodes": F.size("tokens"), "depth": level["top"], "numeric_share": F.try_divide(numbers, F.size("tokens"))}).drop("tokens")
