"""Rows without an id, rows that share one, and texts that only stress an operator's machinery."""

import random

import pytest

import corpus_pipeline as P
from barley.llm import decontamination, ngram_join, packing, pii, substring_dedup
from pyspark.sql import functions as F
from tests.llm import fixtures as X
from tests.llm.test_texts import SCHEMA

TWO = "doc_id bigint, text string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))


def test_substring_dedup_by_row(spark):
    a, b, shared = words(60, 1), words(70, 2), words(55, 3)
    rows = [(1, a), (2, a), (2, b), (3, shared), (4, words(9, 4) + " " + shared), (4, words(70, 5)), (4, "short"), (4, "short"), (5, b), (5, b)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, TWO).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [
        (1, 60, 0), (2, 60, 60), (2, 70, 0), (3, 55, 0), (4, 1, 0), (4, 1, 0), (4, 64, 55), (4, 70, 0), (5, 70, 70), (5, 70, 70)]


def test_ngram_join_by_row(spark):
    b, c, d = words(60, 1), words(60, 2), words(60, 3)
    rows = [(5, c), (5, b), (6, b + " z"), (7, c + " z"), (8, d), (9, d), (9, d), (9, ""), (None, d), (None, ""), (4, words(8, 5))]
    for order in (rows, rows[::-1]):
        got = ngram_join.similar_components(spark.createDataFrame(order, TWO).repartition(4)).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([
            ("5", 57, "5"), ("5", 57, "5"), ("6", 58, "5"), ("7", 58, "5"), ("8", 57, "8"), ("9", 57, "8"), ("9", 57, "8"), ("9", 0, "9"), ("None", 57, "None"), ("None", 0, "None"), ("4", 5, "4")])


@pytest.mark.parametrize("changes", [3, 6])
def test_near_copies_of_one_text_meet_without_all_pairs(spark, monkeypatch, changes):
    """300 near copies of a text: all links of brute force, and far fewer compared pairs than there are."""
    rng = random.Random(changes)
    base = words(150, 9).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = list(base)
        for _ in range(rng.randint(1, changes)):
            own[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    compared = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, TWO).repartition(4)).collect()}
    assert got == X.similar(rows)
    assert sum(compared) < 300 * 299 / 2 / 5, compared


def test_decontamination_blocks_by_row(spark):
    hit, clean = words(30, 1), words(30, 2)
    bench = spark.createDataFrame([("i1", hit), ("i2", words(40, 3)), ("i3", hit + " " + words(5, 4))], "item_id string, text string")
    rows = [(1, hit), (1, clean), (None, hit), (None, clean), (2, None), (2, hit + " and " + hit)]
    frame = spark.createDataFrame(rows, TWO)
    for block in (4_000_000, 40):
        got = decontamination.find_leaks(frame, bench, block_words=block).collect()
        assert sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in got) == sorted([
            ("1", 30, [(0, 30)], ["i1", "i3"]), ("1", 30, [], []), ("None", 30, [(0, 30)], ["i1", "i3"]), ("None", 30, [], []), ("2", 0, [], []), ("2", 61, [(0, 30), (31, 61)], ["i1", "i3"])])
        kept = decontamination.find_leaks(frame, bench, block_words=block, carry=["text", "doc_id"])
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.where("size(spans) = 0").collect()) == sorted([("1", clean), ("None", clean), ("2", "None")])


def test_pii_of_very_long_entities(spark):
    many = 400
    texts = ["x@a" + ".b" * many, "a" * many + "@b.com", "password=" + "q" * many, "sk-" + "k" * many, "1" * many, "f" * many, "AB12" + "C" * many, "1." * many, "+1 " + "22 " * many,
             "Mr. " + "A" + "b" * many, "Mr. " + "Ab " * many, "." * many, "-" * many, "password=" + "*" * many]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "k").collect()}
    assert [p.type for p in got[0].pii] == ["email"] and texts[0] != got[0].text and len(got) == len(texts)


def test_entity_pattern_needs_no_deep_stack(spark):
    found = F.size(F.regexp_extract_all(F.concat(F.lit("x@a"), F.repeat(F.lit(".b"), F.col("id").cast("int"))), F.lit(pii.ENTITY), F.lit(0)))
    assert [r.n for r in spark.range(200_000, 200_003).select(found.alias("n")).collect()] == [1, 1, 1]


def test_packing_of_few_long_texts(spark):
    frame = spark.createDataFrame([(i, 40_000) for i in range(3)], "doc_id bigint, n bigint")
    got = packing.pack(frame, F.col("n"), lengths=(64, 128), shard_pieces=100).collect()
    assert len({r.bin >> 32 for r in got}) > 5 and sum(r.length for r in got) == 120_000


def test_pipeline_filters_act_on_rows(spark, tmp_path):
    bench, one, two = words(30, 1), words(60, 2), words(60, 3)
    spark.createDataFrame([("i", bench)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, bench), (1, bench), (1, one), (None, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = P.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", one), ("None", two)]
    rows = [(1, one), (2, one), (3, two), (3, two), (3, one + " z"), (None, two), (None, bench), (None, bench), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = P.keep_one_of_similar(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect() if r.text != two) == sorted([("1", one), ("4", "None"), ("5", ""), ("None", bench)])
    assert sum(r.text == two for r in left.collect()) == 1
