"""The corpus pipeline: from a documents table to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. Null texts pass the filters (nothing speaks against them) and end in no sequence. Filters act on rows, so that null
and repeated ids neither save a row nor cost one: rows that agree in id and text are copies of each other, all else is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.decontamination import find_leaks
from barley.llm.ngram_join import similar_components
from barley.llm.packing import n_words, pack
from barley.llm.pii import replace_pii
from barley.llm.shared import stash
from barley.llm.toxicity import score_toxicity

KEY = "barley"
#: near copies of the stage: five-word shingles, similarity 0.8 (op2's contract of four words and 0.85 is that query's alone)
WORDS, PERCENT = 5, 80


#: keys from here on belong to rows whose id is null or repeated
ODD = 1 << 62


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below the threshold, whatever their id."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=docs.columns)
    return scored.where("predicted = 0").select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id.

    A row whose id is null or repeated is a document of its own text: it comes after all others, and rows that agree in id and text are one.
    """
    repeated = stash(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id", F.lit(True).alias("_odd")), "repeated")
    odd = not repeated.isEmpty()
    keyed = docs.withColumn("_key", F.col("doc_id").cast("bigint"))
    if odd:
        own = F.lit(ODD) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(ODD))
        keyed = docs.join(repeated, "doc_id", "left").withColumn("_key", F.when(F.col("doc_id").isNull() | F.col("_odd"), own).otherwise(F.col("doc_id").cast("bigint"))).drop("_odd")
    # written, so that its size is known where it is joined to the texts
    left_out = stash(similar_components(keyed.select("_key", "text"), WORDS, PERCENT, "_key").where("component_id < _key").select("_key").distinct(), "left_out")
    kept = keyed.join(left_out, "_key", "left_anti")
    if odd:
        kept = kept.where(F.col("_key") < ODD).unionByName(kept.where(F.col("_key") >= ODD).dropDuplicates(["_key"]))
    return kept.select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item, whatever their id."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return leaks.where(F.size("spans") == 0).select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in the place of personal data, and n_chars counted anew."""
    done = replace_pii(docs, KEY).drop("pii")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in sequences of the permitted lengths: one row per piece."""
    return pack(docs, n_words(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: the first stage is a fitted model, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
