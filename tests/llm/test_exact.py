"""Exact groups of texts against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from barley.llm import exact_dedup as E
from barley.llm.shared import stash
from tests.llm import fixtures as X

SCHEMA = "doc_id bigint, text string"


def groups(rows):
    """Sorted (id, keep_id, size) and per text the number of kept rows, always one."""
    by = {}
    for i, text, *_ in rows:
        by.setdefault(text or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted((str(i), str(best[t]), len(ids)) for t, ids in by.items() for i in ids)


def got(frame, **options):
    out = E.exact_groups(frame, **options).collect()
    kept = {}
    for r in out:
        kept.setdefault(r.text_sha256, []).append(r)
    for own in kept.values():
        assert sum(r.kept for r in own) == 1 and next(r for r in own if r.kept).doc_id == own[0].keep_id
        assert {r.group_size for r in own} == {len(own)}
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out)


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n, span in ((1, 1), (1, 1 << 40), (5, 6), (1000, 1 << 33), (4000, 4001)):
        values = np.unique(rng.integers(0, span, n).astype(np.uint64))
        gaps = np.diff(values, prepend=np.uint64(0))
        for shift in {0 if span < 10_000 else 20, E.best_shift(span, len(values))}:
            back = E.golomb_decoded(*E.golomb(gaps, shift), len(gaps), shift)
            assert (np.cumsum(back, dtype=np.uint64) == values).all()
    values = np.unique(rng.integers(0, 1 << 30, 10_000).astype(np.uint64))
    code = E.golomb(np.diff(values, prepend=np.uint64(0)), E.best_shift(1 << 30, len(values)))
    assert sum(map(len, code)) * 8 / len(values) < 1.1 * (np.log2((1 << 30) / len(values)) + 1.5)   # near the bound of random sets


def test_exact_groups(spark):
    rows = [(r[0], r[1]) for r in X.documents(3, 80)]
    rows += [(500, None), (501, ""), (None, "one"), (None, "alone"), (None, "alone"), (7, "one"), (7, "one"), (7, "ONE"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "x" * 299_999 + "y")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS hash", "3 AS run", "4 AS place", "'x' AS text_sha256")
    for parts in (1, 5, 23):
        assert got(frame.repartition(parts)) == groups(rows)
    assert E.exact_groups(frame.where("false")).count() == 0


def test_clashing_fingerprints(spark):
    """Texts of one fingerprint are told apart by their bytes."""
    rows = [(r[0], r[1]) for r in X.documents(4, 80)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for clash in (F.lit(5).cast("bigint"), F.xxhash64(F.coalesce("text", F.lit(""))) % 3, (F.length(F.coalesce("text", F.lit(""))) % 7).cast("bigint") * (1 << 50)):
        assert got(frame, fingerprint=clash) == groups(rows)


def test_one_large_group(spark):
    rng = random.Random(1)
    rows = [(i, "copy" if i % 3 else f"text {rng.random()}") for i in range(4000)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(12)) == groups(rows)


def test_texts_stay_where_they_are(spark, monkeypatch):
    """No exchange below the join of the table with its marks: it is read by its buckets."""
    tables = []
    monkeypatch.setattr(E, "stash", lambda df, name: tables.append(df) or stash(df, name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        E.exact_groups(spark.range(3000).select((F.col("id") % 2000).alias("doc_id"), (F.col("id") % 2000).cast("string").alias("text"))).count()
        plan = next(t for t in tables if "group_size" in t.columns)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    below = plan[plan.index("ShuffledHashJoin"):]
    assert "Bucketed: true" in below and below.count("Exchange") <= 1   # of the marks
