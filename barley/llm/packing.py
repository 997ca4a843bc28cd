"""Best-fit packing of texts into sequences of several permitted lengths.

Pieces of at most the longest permitted length are packed together, largest first. A piece goes to the open bin in which the least room is left
(best fit). If none takes it, a new bin is opened at the permitted length with the least cost per unit filled, where each length is filled in trial with
the largest waiting pieces that still fit. At the end each bin is downsized to the smallest permitted length that holds its contents.

**Cost.** A bin of length c costs ``overhead + c * (1 + c / attention)``: the work on each position, and attention between positions, which costs as much as the
rest at the length ``attention``. With an infinite ``attention`` costs are linear; where each length is twice the one before, the longest is then always the
cheapest to open, for it takes the contents of two shorter bins at one overhead.

**Joint choice.** Trial fillings look at one bin. So each shard is also packed with a single length for new bins (longer only where a piece asks for it), once
for each permitted length, and the cheapest of these plans after downsizing is the shard's. No shard costs more than best fit of one length.

Pieces are dealt to shards by a hash of their text's id and number; a shard is packed in one task and holds about ``shard_pieces`` pieces whatever the
input's size. Only ids and lengths move. What sharding costs is at most the last bins of each shard.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.shared import stash

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD, ATTENTION = 16.0, 6144.0
SHARD_PIECES = 8192


def n_words(text: Column) -> Column:
    """Words parted by the bytes 0x20 and 0x09 to 0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def cut_pieces(df: DataFrame, length: Column, id_column: str, longest: int) -> DataFrame:
    """(id, piece, start, length): texts in pieces of ``longest``, the last one shorter. Texts of length 0 or null have no piece."""
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), length.cast("bigint").alias("n")).where("n > 0")
    pieces = rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / longest).cast("bigint"))).alias("piece"))
    return pieces.select("id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("length"))


def pack(df: DataFrame, length: Column, id_column: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD,
         attention: float = ATTENTION, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(id, piece, start, length, bin, capacity, offset), one row per piece; every unit of every text is in exactly one piece.

    ``bin`` is unique over all shards. ``overhead`` and ``attention`` make the cost of a bin (see above), in units of length. An id may be null or repeated: the rows' pieces are
    packed like any others. An empty table gives an empty result. The same input in any order gives the same bins: equal pieces are interchanged only
    when they agree in id, number and length.
    """
    lengths = tuple(sorted(set(lengths)))
    pieces = stash(cut_pieces(df, length, id_column, lengths[-1]), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))   # long texts make many pieces, so these are counted, not rows
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    schema = "id bigint, piece bigint, start bigint, length bigint, bin bigint, capacity bigint, offset bigint"
    packed = dealt.groupBy("shard").applyInPandas(lambda own: _pack_shard(own, lengths, bin_cost(overhead, attention)), schema)
    return packed.withColumnRenamed("id", id_column)


def bin_cost(overhead: float = OVERHEAD, attention: float = ATTENTION) -> Callable[[int], float]:
    return lambda c: overhead + c * (1.0 + c / attention)


def _pack_shard(own: pd.DataFrame, lengths: tuple[int, ...], cost: Callable[[int], float]) -> pd.DataFrame:
    own = own.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable", na_position="last", ignore_index=True)
    plan = best_fit(own["length"].tolist(), lengths, cost)
    own["bin"] = plan.bin + own["shard"].to_numpy() * (1 << 32)
    own["capacity"], own["offset"] = plan.capacity[plan.bin], plan.offset
    return own[["id", "piece", "start", "length", "bin", "capacity", "offset"]]


class Plan(NamedTuple):
    cost: float             # of all bins, downsized
    bin: np.ndarray         # of each piece
    offset: np.ndarray      # of each piece in its bin
    opened: np.ndarray      # length of each bin when it was opened
    capacity: np.ndarray    # length of each bin at the end


def best_fit(sizes: list[int], lengths: tuple[int, ...], cost: Callable[[int], float]) -> Plan:
    """The cheapest plan for pieces that come largest first; among equals that of trial fillings, then that of the longest length."""
    return min((_plan(sizes, lengths, cost, only) for only in (None, *reversed(lengths))), key=lambda plan: plan.cost)


def _plan(sizes: list[int], lengths: tuple[int, ...], cost: Callable[[int], float], only: int | None) -> Plan:
    """Best fit with new bins of the length ``only`` (the next that holds the piece, if it is too long for it), by trial fillings if that is None."""
    falling = [-s for s in sizes]
    ends = np.searchsorted(falling, falling, side="right").tolist()   # where the run of equal pieces ends
    rooms: list[tuple[int, int]] = []     # (room left, bin) of the open bins, sorted
    used: list[int] = []
    opened: list[int] = []
    of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fit = [c for c in lengths if c >= max(size, only or 0)]
            room = fit[0] if only else min(fit, key=lambda c: (cost(c) / _filled(c, i, sizes, falling, ends), -c))
            b = len(used)
            used.append(0)
            opened.append(room)
        of[i], offset[i] = b, used[b]
        used[b] += size
        if room > size:
            bisect.insort(rooms, (room - size, b))
    capacity = [lengths[bisect.bisect_left(lengths, u)] for u in used]
    return Plan(sum(map(cost, capacity)), of, offset, np.array(opened, np.int64), np.array(capacity, np.int64))


def _filled(c: int, at: int, sizes: list[int], falling: list[int], ends: list[int]) -> int:
    """What the piece ``at`` and the largest pieces after it that still fit fill of a bin of length c."""
    room, i = c - sizes[at], at + 1
    while room > 0:
        i = bisect.bisect_left(falling, -room, i)
        if i == len(sizes):
            break
        room -= sizes[i] * min(ends[i] - i, room // sizes[i])
        i = ends[i]
    return c - room


def bins_of(packed: DataFrame) -> DataFrame:
    """(bin, capacity, filled, n_pieces) per bin."""
    return packed.groupBy("bin").agg(F.max("capacity").alias("capacity"), F.sum("length").alias("filled"), F.count("*").alias("n_pieces"))


def op6_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf}/documents.parquet"), n_words(F.col("text")))
