"""Removal of long passages that an earlier document holds: seeds by winnowing, extended both ways, joined to maximal repeats.

**Copies.** Documents with the same word sequence are one class; only its first document goes on. A later member is covered whole.

**Seeds.** Of every ``window`` consecutive words, the k-gram with the smallest hash is the anchor. The choice depends on these words
alone, so equal windows have the same anchor at the same place, and each window belongs to one anchor. The windows of one anchor
occurrence are consecutive; the words they span are its reach. Anchors are joined over all documents by counting them; an anchor that only one
document holds starts no repeat.

**Extension, whole reach first.** Occurrences of an anchor whose reach is the same word sequence are extended both ways at once: all but the
first document's are covered by the whole reach. This takes the bulk of long matches and of hot groups, with one row per occurrence.

**Extension, word by word.** The first occurrence of each distinct reach can still share a part of it with others of the same anchor. For
these only, each split of the remaining words into a left and a right extension is a key beside the anchor, and the key's first document wins.
Keys are aggregated, never paired, so that a group of m occurrences costs m rows times the bounded number of splits.

**Repeats.** Matched windows of a document that touch are joined: the spans are the maximal runs of repeated windows.

Nothing is kept per group: each step is a minimum by key with partial sums, or a join whose large keys Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.shared import stash
from barley.llm.words import chunks, prefix_sums, run_hash, signed

GRAM = 14
SPANS = "array<struct<start:int,end:int>>"


def repeated_spans(df: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM) -> DataFrame:
    """(id, row, whole, places, starts): documents with words in a window that starts in a document of a smaller id.

    ``whole`` marks documents that repeat an earlier one word by word; their places and starts are null. Else all windows
    of the anchors at ``places`` and those at ``starts`` are repeats. Null texts have no words, documents below ``window`` words no windows. Null ids are left
    out: they stand in no order. Rows that share an id do not cover each other, and each is judged by its own text: ``row``, the hash of id and text, tells them
    apart (rows that agree in both have the same result).
    """
    gram = min(gram, window)
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")).dropna().withColumn("row", F.xxhash64("id", "text"))
    whole = stash(rows.mapInArrow(_whole_texts(window), "id bigint, row bigint, whole_hash bigint, n_words bigint"), "texts")
    classes = whole.groupBy("whole_hash", "n_words").agg(F.min("id").alias("first"))
    copies = whole.join(classes, ["whole_hash", "n_words"]).where("id > first").select("id", "row").distinct()

    seeds = stash(rows.mapInArrow(_seeds(window, gram), "id bigint, row bigint, place int, anchor bigint, reach bigint"), "seeds")
    seeds = seeds.join(copies, ["id", "row"], "left_anti")
    # minima by key are written before they are joined back: beside a plain shuffle Spark may split a large key
    met = seeds.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    shared = stash(seeds.join(stash(met, "met"), "anchor", "left_semi"), "shared")
    reaches = stash(shared.groupBy("anchor", "reach").agg(F.min("id").alias("first")), "reaches")
    several = stash(reaches.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
    met = shared.join(reaches, ["anchor", "reach"])
    covered = met.where("id > first").select("id", "row", "place", F.lit(-1).alias("start"))
    # every first occurrence of a reach, where its anchor has other reaches
    open_ = met.where("id = first").join(several, "anchor", "left_semi")

    places = open_.groupBy("id", "row").agg(F.collect_list("place").alias("places"))
    splits = stash(rows.join(places, ["id", "row"]).mapInArrow(_splits(window, gram), "id bigint, row bigint, start int, anchor bigint, split bigint"), "splits")
    firsts = stash(splits.groupBy("anchor", "split").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "firsts")
    matched = splits.join(firsts.drop("last"), ["anchor", "split"]).where("id > first").select("id", "row", F.lit(-1).alias("place"), "start")

    found = covered.unionByName(matched).groupBy("id", "row").agg(
        F.collect_list(F.when(F.col("place") >= 0, F.col("place"))).alias("places"),
        F.collect_list(F.when(F.col("start") >= 0, F.col("start"))).alias("starts"))
    return found.select("id", "row", F.lit(False).alias("whole"), "places", "starts").unionByName(
        copies.select("id", "row", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<int>").alias("starts")))


def remove_repeats(df: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, spans, kept): every row of ``df`` with the repeated words taken out; ``kept`` joins the rest by one space.

    See ``repeated_spans``; a row with a null id loses nothing.
    """
    found = repeated_spans(df, window, id_column, text_column, gram)
    ids = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(id_column).alias("own_id"), F.col(text_column).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "text"))
    out = rows.join(found, ["id", "row"], "left").mapInArrow(
        _remove(window, min(gram, window)), f"own_id {ids}, n_words bigint, n_removed bigint, spans {SPANS}, kept string")
    return out.withColumnRenamed("own_id", id_column)


def _names(c, doc: np.ndarray) -> list[pa.Array]:
    """Id and row of texts of a chunk."""
    return [c.rows.column(name).take(pa.array(doc)) for name in ("id", "row")]


def _whole_texts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            whole = run_hash(prefix_sums(c.words_hash()), c.first[:-1], c.first[1:])
            long = np.flatnonzero(c.n_words >= window)
            yield pa.RecordBatch.from_arrays(
                [*_names(c, long), pa.array(signed(whole[long])), pa.array(c.n_words[long])], ["id", "row", "whole_hash", "n_words"])
    return run


def _anchors(c, window: int, gram: int):
    """The anchor of each window of a chunk: starts of the windows, their anchors' places, hashes of k-grams, sums over words."""
    sums = prefix_sums(c.words_hash())
    n = len(c.doc)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    at = np.arange(n - gram + 1)
    grams = run_hash(sums, at, at + gram)
    start = np.flatnonzero(c.doc[window - 1:] == c.doc[:n - window + 1])
    width = window - gram + 1
    return start, start + _leftmost_minimum(grams, width)[start], grams, sums


def _leftmost_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """For each place, how far on the leftmost smallest of the next ``width`` values stands."""
    n = len(x) - width + 1
    best, offset, have = x.copy(), np.zeros(len(x), np.int64), 1
    while have < width:
        step = min(have, width - have)
        other, far = best[step:], offset[step:] + step
        m = len(other)
        better = other < best[:m]
        best, offset = np.where(better, other, best[:m]), np.where(better, far, offset[:m])
        have += step
    return offset[:n]


def _occurrences(c, window: int, gram: int):
    """Anchor occurrences of a chunk: place in the chunk, first and last window start, and the arrays behind them."""
    start, anchor, grams, sums = _anchors(c, window, gram)
    if not len(start):
        return start, start, start, start, anchor, grams, sums
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (c.doc[start[1:]] != c.doc[start[:-1]])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1
    return anchor[begin], start[begin], start[last], start, anchor, grams, sums


def _seeds(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            place, low, high, _, _, grams, sums = _occurrences(c, window, gram)
            doc = c.doc[place]
            yield pa.RecordBatch.from_arrays(
                [*_names(c, doc), pa.array((place - c.first[doc]).astype(np.int32)),
                 pa.array(signed(grams[place])), pa.array(signed(run_hash(sums, low, high + window)))], ["id", "row", "place", "anchor", "reach"])
    return run


def _listed(c, column: str):
    """Values of a list column with the text each stands in."""
    lists = c.rows.column(column)
    flat, parents = lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_parent_indices(lists).to_numpy()
    return flat.astype(np.int64), parents


def _splits(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            _, _, _, start, anchor, grams, sums = _occurrences(c, window, gram)
            places, parents = _listed(c, "places")
            wanted = np.zeros(len(c.doc) + 1, bool)
            wanted[np.minimum(c.first[parents] + places, len(c.doc))] = True
            own = wanted[anchor] if len(anchor) else np.zeros(0, bool)
            start, anchor = start[own], anchor[own]
            doc = c.doc[start]
            for at in range(0, max(1, len(start)), 100_000):
                s, d, a = start[at:at + 100_000], doc[at:at + 100_000], anchor[at:at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [*_names(c, d), pa.array((s - c.first[d]).astype(np.int32)), pa.array(signed(grams[a])),
                     pa.array(signed(run_hash(sums, s, s + window)))], ["id", "row", "start", "anchor", "split"])
    return run


def _remove(window: int, gram: int):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            n = len(c.doc)
            edge = np.zeros(n + 1, np.int64)   # +1 where a covered run begins, -1 after its end
            starts, parents = _listed(c, "starts")
            matched = c.first[parents] + starts
            if c.rows.column("places").null_count < len(c) and pa.compute.sum(pa.compute.list_value_length(c.rows.column("places"))).as_py():
                places, parents = _listed(c, "places")
                place, low, high, *_ = _occurrences(c, window, gram)
                at = np.searchsorted(place, np.sort(c.first[parents] + places))
                np.add.at(edge, low[at], 1)
                np.add.at(edge, high[at] + window, -1)
            np.add.at(edge, matched, 1)
            np.add.at(edge, matched + window, -1)
            gone = np.cumsum(edge)[:n] > 0
            whole = c.rows.column("whole").fill_null(False).to_numpy(zero_copy_only=False)
            gone |= whole[c.doc]
            removed = np.bincount(c.doc[gone], minlength=len(c))
            before = np.zeros(n, bool)
            before[1:] = gone[:-1] & (c.doc[1:] == c.doc[:-1])
            after = np.zeros(n, bool)
            after[:-1] = gone[1:] & (c.doc[1:] == c.doc[:-1])
            begin, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
            data = c.data.tobytes()
            spans, kept = [[] for _ in range(len(c))], []
            for d, a, b in zip(c.doc[begin].tolist(), begin.tolist(), end.tolist()):
                spans[d].append((a, b))
            first, edges, start, stop = c.first.tolist(), c.edges.tolist(), c.start, c.end
            for d in range(len(c)):
                parts, at = [], first[d]
                for a, b in spans[d] + [(first[d + 1], first[d + 1])]:
                    if a > at:
                        parts += data[start[at]:stop[a - 1]].split()
                    at = b
                kept.append(b" ".join(parts).decode())
            spans = [[{"start": a - first[d], "end": b - first[d]} for a, b in s] for d, s in enumerate(spans)]
            yield pa.RecordBatch.from_arrays(
                [c.rows.column("own_id"), pa.array(c.n_words), pa.array(removed), pa.array(spans, spans_type), pa.array(kept, pa.string())],
                ["own_id", "n_words", "n_removed", "spans", "kept"])
    return run


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, p, hash(array_to_string(words[p:p + 49], ' ')) AS h, md5(array_to_string(words[p:p + 49], ' ')) AS m
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM d WHERE len(words) >= 50)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY h, m) AS first FROM w),
g AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM f WHERE first < doc_id)),
k AS (SELECT d.doc_id, q, words[q] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS q FROM d) d
  ANTI JOIN g USING (doc_id, q)),
a AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
