"""Groups of equal texts by an exchange of Golomb-coded fingerprints; only suspects' texts are moved and compared byte by byte.

**Runs.** The rows are written once, as they stand, to a table bucketed by run (at most 65,536 rows of one task), each with a 64-bit hash of its text.

**Messages.** A run sends the first ``bits`` bits of its distinct hashes, sorted, to the owners of their ranges: the gaps between them as Golomb codes
(divisor a power of two near 0.69 times the mean gap). ``bits`` grows with the count of rows, so that about one row in 2**spare is a false suspect.

**Bitmaps.** An owner decodes what it got (its range holds a bounded number of hashes) and answers each run with one bit per hash: sent by another
run too. Rows whose hash is marked, or comes twice within their run, are suspects. The table's buckets meet the answers where they are, without
moving texts.

**Verification.** Suspects are grouped by hash and whole text, with partial groups in every task, so that a group of copies shrinks to one row per task.
Where texts of one hash differ, their rows are told apart by the text; else the hash suffices to hand the group back to its rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.shared import shared_folder, stash, tasks

RUN_BITS = 16
#: distinct hashes of an owner's range, at most and (while there are fewer owners than tasks) at least
MOST, LEAST = 1 << 23, 1 << 14
#: Spark's own limit of buckets
MOST_BUCKETS = 100_000


def golomb(gaps: np.ndarray, shift: int) -> tuple[bytes, bytes]:
    """Quotients in unary (that many zeros and a one), remainders in ``shift`` bits each."""
    ends = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1)
    unary = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decoded(unary: bytes, rest: bytes, n: int, shift: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[:n * shift].reshape(n, shift).astype(np.uint64)
    return (quotients << np.uint64(shift)) + (bits << np.arange(shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def best_shift(span: int, n: int) -> int:
    return max(0, int(0.69 * span / n).bit_length() - 1)


class Ranges:
    """The owners' ranges of hashes cut to ``bits`` bits."""

    def __init__(self, bits: int, owners: int):
        self.bits, self.owners = bits, owners
        self.starts = np.array([-(-(o << bits) // owners) for o in range(owners + 1)], np.uint64)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.uint64) >> np.uint64(64 - self.bits)

    def edges(self, values: np.ndarray) -> np.ndarray:
        """Where each owner's values begin among sorted ``values``."""
        return np.searchsorted(values, self.starts)


def exact_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", spare: int = 7, fingerprint: Column | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``df``: of equal texts the row with the largest id is kept.

    A null text counts as empty. A null id is below all others; of rows with equal text and id one is kept. Texts of any length are compared whole.
    ``fingerprint`` replaces the 64-bit hash of the text (any bigint that equal texts share gives the same result).
    """
    spark, name = df.sparkSession, f"barley_{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    place = F.monotonically_increasing_id()
    rows = df.select(F.col(id_column).alias("id"), text.alias("text"), (F.xxhash64(text) if fingerprint is None else fingerprint).alias("hash"),
                     F.sha2(text, 256).alias("text_sha256"), place.alias("place"))
    rows = rows.withColumn("run", F.shiftright("place", RUN_BITS))
    rows.write.bucketBy(min(tasks(spark), MOST_BUCKETS), "run").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")   # the name only: the files stay in the shared folder

    n = table.count()
    ranges = Ranges(max(1, (max(1, n) - 1).bit_length() + spare), max(-(-n // MOST), min(tasks(spark), -(-n // LEAST)), 1))
    hashes = table.select("run", "place", "hash")
    messages = hashes.groupBy("run").applyInArrow(_send(ranges), "run bigint, owner int, n int, shift int, unary binary, rest binary")
    replies = messages.groupBy("owner").applyInArrow(_answer(ranges), "run bigint, owner int, marks binary")
    marks = stash(hashes.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(_marks(ranges), "run bigint, marks array<bigint>"), "marks")

    # joined by the buckets' key alone, so that the table stays where it is; a hash table of marks holds 8 KB a run
    at = F.col("place").bitwiseAND(F.lit((1 << RUN_BITS) - 1))
    word = F.coalesce(F.get("marks", (at / 64).cast("int")), F.lit(0).cast("bigint"))
    marked = table.join(marks.hint("shuffle_hash"), "run", "left").withColumn("suspect", F.call_function("getbit", word, (at % 64).cast("int")) == 1).drop("marks")
    light = marked.drop("text")
    single = light.where("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    moved = marked.where("suspect").select("place", "id", "text", "hash")
    groups = stash(moved.groupBy("hash", "text").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"), F.max("place").alias("last")), "groups")
    per_hash = groups.groupBy("hash").agg(F.count("*").alias("texts"), F.max("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"), F.max("last").alias("last"))
    per_hash = stash(per_hash, "hashes")
    met = light.where("suspect").join(per_hash.where("texts = 1").drop("texts"), "hash")
    met = met.select("place", "id", "text_sha256", "group_size", "keep_id", "last")
    clashes = per_hash.where("texts > 1").select("hash")
    if not clashes.isEmpty():
        told = moved.join(clashes, "hash", "left_semi").join(groups, ["hash", "text"])
        met = met.unionByName(told.select("place", "id", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id", "last"))
    met = stash(met, "met")
    # of rows that share text and id the first is kept
    best = met.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("last").agg(F.min("place").alias("place"))
    several = met.join(best.select("place", F.lit(True).alias("best")), "place", "left")
    several = several.select("id", "keep_id", "group_size", F.coalesce("best", F.lit(False)).alias("kept"), "text_sha256")
    return single.unionByName(several).withColumnRenamed("id", id_column)


def _send(ranges: Ranges):
    def run(table: pa.Table) -> pa.Table:
        values = np.unique(ranges.cut(table.column("hash").to_numpy()))
        edges, out = ranges.edges(values), []
        for owner in np.flatnonzero(np.diff(edges)).tolist():
            low, high = int(ranges.starts[owner]), int(ranges.starts[owner + 1])
            own = values[edges[owner]:edges[owner + 1]] - np.uint64(low)
            shift = best_shift(high - low, len(own))
            out.append((owner, len(own), shift, *golomb(np.diff(own, prepend=np.uint64(0)), shift)))
        owner, n, shift, unary, rest = zip(*out)
        return pa.table({"run": pa.array([table.column("run")[0].as_py()] * len(out), pa.int64()), "owner": pa.array(owner, pa.int32()), "n": pa.array(n, pa.int32()),
                         "shift": pa.array(shift, pa.int32()), "unary": pa.array(unary, pa.binary()), "rest": pa.array(rest, pa.binary())})
    return run


def _answer(ranges: Ranges):
    def run(table: pa.Table) -> pa.Table:
        sent = [np.cumsum(golomb_decoded(m["unary"], m["rest"], m["n"], m["shift"]), dtype=np.uint64) for m in
                (row for batch in table.to_batches(1024) for row in batch.to_pylist())]
        every = np.sort(np.concatenate(sent))
        twice = every[1:][every[1:] == every[:-1]]
        marks = [np.isin(values, twice, assume_unique=False) for values in sent]
        some = np.array([m.any() for m in marks], bool)
        kept = table.select(["run", "owner"]).filter(pa.array(some))
        return kept.append_column("marks", pa.array([np.packbits(m).tobytes() for m in marks if m.any()], pa.binary()))
    return run


def _marks(ranges: Ranges):
    """One bit for each row of a run, in words of 64: its hash is marked by an owner or comes twice in the run."""
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        values, at, counts = np.unique(ranges.cut(table.column("hash").to_numpy()), return_inverse=True, return_counts=True)
        marked, edges = counts > 1, ranges.edges(values)
        for owner, marks in zip(replies.column("owner").to_pylist(), replies.column("marks").to_pylist()):
            a, b = edges[owner], edges[owner + 1]
            marked[a:b] |= np.unpackbits(np.frombuffer(marks, np.uint8))[:b - a].astype(bool)
        bits = np.zeros(1 << RUN_BITS, np.uint8)
        bits[(table.column("place").to_numpy() & ((1 << RUN_BITS) - 1))[marked[at]]] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        last = int(np.flatnonzero(words).max(initial=-1)) + 1
        return pa.table({"run": table.column("run").slice(0, 1), "marks": pa.array([words[:last]], pa.list_(pa.int64()))})
    return run


def op13_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf}/documents.parquet"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
