"""What passes over large panels leave on disk, and the ranks they compute on Arrow batches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from barley.operators import FactorSet
from barley.operators.factorset import rank_shares
from barley.operators.spec import BAR, ID, TS
from barley.session import shared_folder


def files(folder: str) -> set[str]:
    return {os.path.join(at, f) for at, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.startswith(("part", ".part"))}


def panel(spark, times: int, names: int):
    cells = spark.range(times).select(F.col("id").alias(BAR)).crossJoin(spark.range(names).select(F.concat(F.lit("i"), "id").alias(ID), F.col("id").alias("k")))
    x = F.pmod(F.xxhash64(BAR, "k"), F.lit(97)).cast("double")
    return cells.select(ID, F.timestamp_seconds(F.col(BAR) * 86400).cast("timestamp_ntz").alias(TS), BAR, F.when(x > 5, x).alias("close"), (x + 1).alias("open"))


def four(o):
    return o.rank(o.close) + o.rank(o.open) + o.rank(o.close - o.open) + o.rank(o.close * o.open)


def test_a_set_of_many_passes_keeps_one_table(spark):
    folder = shared_folder(spark)
    before = files(folder)
    chosen = FactorSet({}, {"a": lambda o: o.ts_mean(o.rank(o.ts_mean(four(o), 2)), 3), "b": lambda o: four(o)})
    df = chosen.evaluate(panel(spark, 40, 30))
    assert df.count() == 1200
    new = files(folder) - before
    tables = {os.path.dirname(f) for f in new}
    assert len(tables) == 1 and all(f.endswith(".parquet") for f in new if not f.endswith(".crc")), sorted(tables)


def test_ranks_together_equal_ranks_apart(spark):
    few = {f"r{k}": f for k, f in enumerate([lambda o: o.rank(o.close), lambda o: o.rank(o.open), lambda o: o.rank(o.close - o.open), lambda o: o.rank(o.rank(o.close) * o.open)])}
    cells = panel(spark, 30, 700).cache()   # a time is spread over several Arrow batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    try:
        together = {(r[ID], r[BAR]): tuple(r)[3:] for r in FactorSet({}, few).evaluate(cells).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, formula in few.items():
        for r in FactorSet({}, {k: formula}).evaluate(cells).collect():
            assert together[r[ID], r[BAR]][int(k[1])] == r[k]
    assert len(together) == 21_000


def test_rank_shares_by_group():
    x = np.array([3.0, np.nan, 1.0, np.nan, 1.0, -0.0, 0.0, np.inf])
    groups = np.array([0, 0, 0, 0, 0, 1, 1, 1])
    assert rank_shares(groups, x) == pytest.approx([3 / 5, 4 / 5, 1 / 5, 4 / 5, 1 / 5, 1 / 3, 1 / 3, 1.0])
    assert len(rank_shares(groups[:0], x[:0])) == 0


def test_matrix_in_blocks_equals_the_wide_one(spark):
    from barley.sources.panel import from_matrix, to_long, to_matrix, to_wide

    cells = panel(spark, 6, 40).where("k <> 7")
    names = spark.createDataFrame([(f"i{k}",) for k in range(38)], f"{ID} string")   # two have no column, one has no bar
    rows, labels = to_matrix(cells, "close", names, 8)
    assert labels.count() > 1 and rows.count() == 6 * labels.count() and {len(r.cells) - len(r.names) for r in rows.join(labels, "block").collect()} == {0}
    back = {tuple(r) for r in from_matrix(rows, labels, "close").select(TS, ID, "close").collect()}
    wide = to_wide(cells, "close", [f"i{k}" for k in range(38)])
    assert back == {tuple(r) for r in to_long(wide, "close").select(TS, ID, "close").collect()}
