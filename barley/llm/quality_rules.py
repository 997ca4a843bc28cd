"""Quality rules as a ledger: every rule is judged once, a row keeps its failures as bits beside the measurements.

The ledger is the costly pass over the texts. Policies are masks over its bits, with a version; they, and the question what
each rule does to the kept set, need only the bits: a table of at most 2**rules patterns with their counts.

A null text is an empty one. Ids may be null or repeated; each row is judged by itself. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.words import SPACE, chunks, mix, prefix_sums, run_hash, runs, _BYTES

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LINE_FEED = np.zeros(256, bool)
LINE_FEED[10] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capital_bytes")


@dataclass(frozen=True)
class Rule:
    """A row fails where ``fails`` is true. The place in the ledger's tuple is the bit."""
    name: str
    fails: str


#: Bits never change their meaning; new rules are added at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("capitals", "2 * n_capital_bytes > word_chars"),
)

#: version -> names of the rules that reject
POLICIES = {
    "base": ("few_words", "repeated_trigrams"),
    "v1": ("few_words", "repeated_trigrams", "symbols", "repeated_lines", "short_words", "long_words", "capitals"),
}


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << i for i, r in enumerate(rules) if r.name in names)


def ledger(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, measurements, failures), one row per row of ``df``; failures holds bit i where rule i failed. Nothing is shuffled."""
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    ids = rows.schema["id"].dataType.simpleString()
    measured = rows.mapInArrow(_measure, f"id {ids}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(0).cast("bigint") for i, r in enumerate(rules)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.select(F.col("id").alias(id_column), *MEASURES, failures.alias("failures"))


def passes(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy, rules))) == 0


def ablations(books: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, rule, failed, failed_alone, kept, kept_without): what each rule of a policy does to the kept set.

    One aggregation to the distinct bit patterns, then a few rows per rule. An empty ledger gives zeros.
    """
    whole = mask(policy, rules)
    patterns = books.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).count()
    counts = []
    for i, rule in enumerate(rules):
        if whole >> i & 1:
            bit, rest = F.col("bits").bitwiseAND(F.lit(1 << i)), F.col("bits").bitwiseAND(F.lit(whole & ~(1 << i)))
            counts.append(F.struct(
                F.lit(rule.name).alias("rule"), _sum(bit != 0).alias("failed"), _sum((bit != 0) & (rest == 0)).alias("failed_alone"),
                _sum(F.col("bits") == 0).alias("kept"), _sum(rest == 0).alias("kept_without")))
    return patterns.agg(F.array(*counts).alias("rules")).select(F.lit(policy).alias("policy"), F.inline("rules"))


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("count")).otherwise(0)), F.lit(0))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        n = len(c)
        in_word = ~SPACE[c.data]
        sums = prefix_sums(_BYTES[c.data])
        words = run_hash(sums, c.start, c.end)
        line_start, line_end = runs(c.data, c.edges, LINE_FEED)
        line_first = np.searchsorted(line_start, c.edges)
        line_doc = np.repeat(np.arange(n), np.diff(line_first))
        # a line counts where a word starts in it; words hold no line feed
        worded = np.searchsorted(c.start, line_end) > np.searchsorted(c.start, line_start)
        n_lines = np.bincount(line_doc[worded], minlength=n)
        keys = _own(run_hash(sums, line_start[worded], line_end[worded]), line_doc[worded])
        n_distinct = np.bincount(line_doc[worded][np.unique(keys, return_index=True)[1]], minlength=n)
        yield pa.RecordBatch.from_arrays(
            [c.rows.column("id")] + [pa.array(x, pa.int64()) for x in (
                c.n_words, c.per_text(in_word & ((c.data & 0xC0) != 0x80)), c.per_text(SYMBOLS[c.data]), n_lines, n_lines - n_distinct,
                _repeated(words, c.doc, n), c.per_text((c.data >= 65) & (c.data <= 90)))],
            ["id", *MEASURES])


def _own(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between the texts of a chunk."""
    return mix(keys + mix(doc.astype(np.uint64) + np.uint64(1)))


def _repeated(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text in a window of three that the text holds twice or more."""
    if len(words) < 3:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    keys = _own(run_hash(prefix_sums(words), at, at + 3), doc[at])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[at[twice] + k] = True
    return np.bincount(doc[hit], minlength=n)


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    books = ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    return books.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failures")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1) GROUP BY 1),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN h USING (doc_id)),
b AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > n_words AS f2,
  n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines AS f3, word_chars < 2 * n_words AS f4, word_chars > 20 * n_words AS f5, 2 * n_capitals > word_chars AS f6 FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
  (f0::BIGINT + 2 * f1::BIGINT + 4 * f2::BIGINT + 8 * f3::BIGINT + 16 * f4::BIGINT + 32 * f5::BIGINT + 64 * f6::BIGINT)::BIGINT AS failures FROM b
"""
