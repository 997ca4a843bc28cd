"""Registered queries against DuckDB on the smallest tables: a sample of every part."""

import os

import pytest

import __spark_entry__ as entry
from oracle.run import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ("cs_rank", "ema", "scale", "named_variables", "alpha101_part1", "alpha191_part3", "alpha158_window10", "technical", "as_of_join", "repair", "fill_gaps",
        "factor_cache", "active_positions", "ic_common_ranks", "newey_west", "bucket_turnover", "composite_scores", "walk_forward_icir",
        "alpha_weights", "risk_budget", "stream_factors", "user_rolling_function", "formula_complexity", "user_slice_function")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    result, *_ = compare(spark, connect(SF), SF, query, sql)
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).columns == ["instrument_id", "ts", "value"]
