"""Benchmark decontamination: runs of benchmark words found in documents by Wu-Manber search over words.

**Tables.** Benchmark items are cut into windows of ten words (a shorter item is one window). Windows of one length share a table:
a block is the last two words looked at, and its shift says how far the search may jump because no window holds the block
nearer to its end. A block that ends some window has shift 0 and names a bucket of windows by their suffix; a window of the bucket
is compared word by word.

**Blocks of items.** The tables are sent to the tasks, so their size is checked: items are dealt to as many blocks as keep each
below ``block_words`` words, and the documents are searched once per block. Rows are then written with a place of their own, and the
blocks' spans are put together by it.

Null texts have no words. An item without id or without words is no item; an item id that comes twice is one item with the windows of
both rows. Document ids may be null or repeat; each row is judged by itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.shared import Carried, give_back, stash

WINDOW = 10

#: A to Z to lower case; all ASCII but letters and digits parts words
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(TABLE).split()


class Tables:
    """Shift tables and suffix buckets for windows of each length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = split_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i:i + window])].add(item)
        self.items = {w: tuple(ids) for w, ids in owners.items()}
        lengths: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for w in self.items:
            lengths[len(w)].append(w)
        self.tables = []
        for m, windows in sorted(lengths.items()):
            block = min(2, m)
            shift: dict = {}
            buckets = defaultdict(list)
            for w in windows:
                for end in range(block, m + 1):
                    key = w[end - block:end] if block == 2 else w[end - 1]
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[w[m - block:] if block == 2 else w[m - 1]].append(w)
            self.tables.append((m, block, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of occurrences, and the items that own them."""
        spans, found = [], set()
        n = len(words)
        for m, block, shift, buckets in self.tables:
            jump, get = m - block + 1, shift.get
            at = m   # the window tried ends before this place
            if block == 1:
                while at <= n:
                    if words[at - 1] in shift:
                        spans.append((at - 1, at))
                        found.update(self.items[(words[at - 1],)])
                    at += 1
                continue
            while at <= n:
                key = (words[at - 2], words[at - 1])
                step = get(key, jump)
                if step:
                    at += step
                    continue
                begin, first = at - m, words[at - m]
                for w in buckets[key]:
                    if w[0] == first and tuple(words[begin:at]) == w:
                        spans.append((begin, at))
                        found.update(self.items[w])
                        break
                at += 1
        return spans, found


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_leaks(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
               item_text_column: str = "text", block_words: int = 4_000_000, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, spans, items) per row of ``df``: joined word spans that benchmark windows cover, and the sorted ids of their items.

    ``carry`` names columns of ``df`` that come through instead of the id, so that a verdict stays on its row.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text_column).cast("string").alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // (2 * block_words)))   # a word and its gap are two bytes at least
    carried = Carried(df, id_column, text_column, carry)
    with_text = carried.with_text
    rows = carried.rows
    if blocks > 1:
        rows = stash(rows.withColumn("place", F.monotonically_increasing_id()), "rows")
    schema = carried.schema(rows, f"n_words bigint, spans {SPANS}, items array<string>")
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        tables = spark.sparkContext.broadcast(Tables([(r.item, r.text) for r in own.collect()]))
        parts.append(rows.mapInArrow(lambda batches, tables=tables: _search(batches, tables, with_text), schema))
    found = parts[0]
    if blocks > 1:
        hits = reduce(DataFrame.unionByName, [part.where(F.size("spans") > 0).select("place", "spans", "items") for part in parts])
        hits = hits.groupBy("place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.drop("spans", "items").join(hits, "place", "left").drop("place")
        found = found.withColumn("spans", _joined(F.coalesce("all", F.array().cast(SPANS)))).withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).drop("all")
    return found.select(*carried.columns(), "n_words", "spans", "items")


def _joined(spans: Column) -> Column:
    """Sorted spans with those that touch put together."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.array().cast(SPANS), add)


def _search(batches: Iterator[pa.RecordBatch], tables, with_text: bool) -> Iterator[pa.RecordBatch]:
    search = tables.value.search
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            counts, spans, items = [], [], []
            for text in part.column("text").to_pylist():
                words = split_words(text)
                hits, found = search(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in join_spans(hits)])
                items.append(sorted(found))
            own = [c for c in part.schema.names if c != "text" or with_text]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(counts, pa.int64()), pa.array(spans, _SPANS),
                                              pa.array(items, pa.list_(pa.string()))], [*own, "n_words", "spans", "items"])
    give_back()


def op7_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP7_SQL = r"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, array_to_string(words[p:p + 9], ' ') AS gram, least(len(words), 10) AS m
  FROM (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS p FROM i WHERE len(words) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT doc_id, m, p, array_to_string(words[p:p + m - 1], ' ') AS gram
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(words) >= m)),
hit AS (SELECT doc_id, p, dw.m, item FROM dw JOIN iw ON iw.gram = dw.gram AND iw.m = dw.m),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY 1),
k AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
