"""The trie of all beginnings of conversations: members, children, leaves and what sharing saves, from balanced parentheses.

**Nodes.** A turn's place in the trie is its depth and two running sums of 60-bit hashes of (depth, turn), so that the beginnings of a conversation of any
length are named without bringing it together: sums run inside stretches of turns, and only one sum per stretch moves on. A node is named by its
smallest member and its depth.

**Chains.** Nodes below each other with the same members are one chain, named by smallest member and number of members. A path of chains is as long as
there are branchings on it, so it is short wherever a table holds few conversations that part on the way.

**Shards.** Distinct paths, sorted, are cut into ranges. Each range is read as a stream and encoded as balanced parentheses, a shard at a time: a
conversation's open chains are its left spine. ``close_of`` finds a subtree's end through the minima of excess in blocks and a tree above them, leaf
pairs are counted by rank, savings by cumulative sums. Chains on the spine of several shards get one row from each; these rows are added.

A chain's savings count where its smallest member's path is read, so that no shard counts it twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.shared import stash
from barley.operators.chunks import with_running

BLOCK = 256
#: opened chains after which a shard is closed
SHARD = 1 << 18
#: bytes of a piece of joined ids
PIECE = 1 << 16
#: turns of a stretch in which sums run
STRETCH = 4096
WORD = r"[^\x20\x09-\x0D]+"


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with the minimum of excess per block and a binary tree of minima above."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[:len(bits)] = self.excess
        self.levels = [padded.reshape(blocks, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append(np.minimum(low[::2], np.append(low[1::2], np.iinfo(np.int32).max)[:len(low[::2])]))

    def close_of(self, at: int) -> int:
        """The place of the parenthesis that closes the one at ``at``: the next place whose excess is one below."""
        target = self.excess[at] - 1
        block = at // BLOCK
        inside = self.excess[at + 1:(block + 1) * BLOCK] <= target
        if inside.any():
            return at + 1 + int(inside.argmax())
        level, i = 0, block + 1   # the first block from here on with an excess as low
        while self.levels[level][i] > target:
            if i % 2:
                level, i = level + 1, (i + 1) // 2
            else:
                i += 1
        while level:
            level, i = level - 1, 2 * i
            i += int(self.levels[level][i] > target)
        return i * BLOCK + int((self.excess[i * BLOCK:(i + 1) * BLOCK] <= target).argmax())


class Shard:
    """The paths of one range, one after the other in order."""

    def __init__(self):
        self.bits, self.opens, self.chains, self.weights, self.leaf = [], [], [], [], []
        self.path, self.open = [], []   # the path read last, and the numbers of its chains

    def add(self, path: list[tuple], weights: list[int], leaf: bool) -> None:
        shared = 0
        while shared < min(len(path), len(self.path)) and path[shared] == self.path[shared]:
            shared += 1
        self.bits += [0] * (len(self.path) - shared)
        del self.open[shared:]
        for chain in path[shared:]:
            self.open.append(len(self.chains))
            self.opens.append(len(self.bits))
            self.bits.append(1)
            self.chains.append(chain)
            self.weights.append(0)
            self.leaf.append(False)
        for number, weight in zip(self.open, weights):
            self.weights[number] += weight
        self.leaf[self.open[-1]] = leaf
        self.path = path

    def rows(self) -> pa.RecordBatch:
        bits = np.array(self.bits + [0] * len(self.path), np.uint8)
        opens = np.array(self.opens, np.int64)
        parens = Parentheses(bits)
        closes = np.array([parens.close_of(at) for at in self.opens], np.int64)
        # a path that goes on in the next shard looks like a leaf here, but is none
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[opens + 1] = (bits[opens + 1] == 0) & np.array(self.leaf, bool)
        saved = np.zeros(len(bits) + 1, np.int64)
        saved[opens + 1] = self.weights
        pair, saved = np.cumsum(pair), np.cumsum(saved)
        conv, n = zip(*self.chains)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(pair[closes] - pair[opens]),
                                           pa.array(saved[closes] - saved[opens])], ["conv", "n", "leaves", "saved"])


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            paths, weights, leaf = (batch.column(c).to_pylist() for c in ("path", "weights", "leaf"))
            for path, own, end in zip(paths, weights, leaf):
                shard.add([(x["conv"], x["n"]) for x in path], own, end)
                if len(shard.chains) >= limit:
                    yield shard.rows()
                    shard = Shard()
        if shard.chains:
            yield shard.rows()
    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, depth, id) to comma-joined pieces of bounded size."""
    node, first, ids, size = None, None, [], 0

    def row():
        return pa.RecordBatch.from_pylist([{"conv": node[0], "depth": node[1], "first": first, "piece": ",".join(ids)}] if ids else [], SCHEMA)
    for batch in batches:
        done = []
        for conv, depth, own in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "id"))):
            if ids and ((conv, depth) != node or size >= PIECE):
                done.append({"conv": node[0], "depth": node[1], "first": first, "piece": ",".join(ids)})
                ids, size = [], 0
            if not ids:
                node, first = (conv, depth), own
            ids.append(str(own))
            size += len(ids[-1]) + 1
        if done:
            yield pa.RecordBatch.from_pylist(done, SCHEMA)
    yield row()


SCHEMA = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_HASHED = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one hash per node; a hash goes on from batch to batch."""
    node, state = None, None
    for batch in batches:
        done = []
        for conv, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "piece"))):
            if (conv, depth) != node:
                if node:
                    done.append({"conv": node[0], "depth": node[1], "ends_sha256": state.hexdigest()})
                node, state = (conv, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, _HASHED)
    if node:
        yield pa.RecordBatch.from_pylist([{"conv": node[0], "depth": node[1], "ends_sha256": state.hexdigest()}], _HASHED)


def ends_hash(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of (conv, depth, id): a node's ids in ascending order, joined by commas. Sorted ranges, so that a node with many ids is joined by
    several tasks; only its bounded pieces meet in one."""
    order = ["conv", "depth", "id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "conv bigint, depth bigint, first bigint, piece string")
    return pieces.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(_hashed, "conv bigint, depth bigint, ends_sha256 string")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", depth, *sums), 256), 1, 32))


def turns(df: DataFrame) -> DataFrame:
    """(conv, place, turn hash, words) of (conv_id, turn, role, text): turns numbered from 1, null turns first, ties by role, by
    the text's first 64 characters and by hash. Null roles and texts are empty,
    rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("conv", "turn", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("hash"), F.struct("role", F.substring("text", 1, 64)).alias("near"),
                       F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    return with_running(rows, {"place": F.lit(1).cast("bigint")}, ["turn", "near", "hash"], ["conv"], F.col("turn"), STRETCH).select("conv", "place", "hash", "words")


def rebuilt(own: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The first h turns of conversation c - c % every, then c's own after its first h; h = crc32(decimal c) % heads. (conv, depth, hash, words), and one row of
    depth 0 for each conversation, turnless ones too."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = own.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("source"))
    first = stash(own.where((F.col("conv") % every == 0) & (F.col("place") < heads)).withColumnRenamed("conv", "source"), "heads")
    have = first.groupBy("source").agg(F.count("*").alias("have"))
    convs = stash(convs.join(have, "source", "left").select("conv", "h", "source", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")), "convs")
    head = convs.join(first, "source").where("place <= h").select("conv", F.col("place").alias("depth"), "hash", "words")
    rest = own.join(convs, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "hash", "words")
    root = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("hash"), F.lit(0).cast("bigint").alias("words"))
    return root.unionByName(head).unionByName(rest)


def prefix_trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node, of (conv, depth, hash, words): a conversation has
    one row for each depth from 0 (its hash is null) to its last. No rows, no nodes."""
    lanes = F.sha2(F.concat_ws(":", "depth", "hash"), 256)
    lane = lambda i: F.coalesce(F.conv(F.substring(lanes, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"), F.lit(0))
    rows = rows.withColumns({"l0": F.when(F.col("depth") > 0, lane(0)).otherwise(0), "l1": F.when(F.col("depth") > 0, lane(1)).otherwise(0)})
    sums = with_running(rows, {"s0": F.col("l0"), "s1": F.col("l1")}, ["depth"], ["conv"], F.col("depth"), STRETCH)
    members = stash(sums.select("conv", "depth", "words", _key(F.col("depth"), [F.col("s0"), F.col("s1")]).alias("key"),
                                _key(F.col("depth") - 1, [F.col("s0") - F.col("l0"), F.col("s1") - F.col("l1")]).alias("above")), "members")
    deep = members.where("depth > 0")
    by_key = stash(deep.groupBy("key").agg(F.min("conv").alias("least"), F.count("*").alias("n")), "by_key")
    top = members.where("depth = 0").agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()   # the root: every conversation
    root = [F.lit(top.least).cast("bigint"), F.lit(top.n).cast("bigint")]
    on_path = deep.join(by_key, "key").select("conv", "depth", "words", "least", "n", "key", "above")
    on_path = stash(on_path.unionByName(members.where("depth = 0").select("conv", "depth", "words", root[0].alias("least"), root[1].alias("n"), "key", "above")), "on_path")

    # nodes, each from its smallest member's row
    own = on_path.where("conv = least")
    upper = by_key.select(F.col("key").alias("above"), F.col("least").alias("parent"))
    nodes = own.where("depth > 1").join(upper, "above").select("conv", "depth", "words", "n", "parent")
    nodes = stash(nodes.unionByName(own.where("depth <= 1").select("conv", "depth", "words", "n", F.when(F.col("depth") > 0, root[0]).alias("parent"))), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    last = on_path.groupBy("conv").agg(F.max("depth").alias("depth"))
    ends = stash(on_path.join(last, ["conv", "depth"]).select(F.col("least").alias("conv"), "depth", F.col("conv").alias("id")), "ends")
    nodes = stash(nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "counted")

    # distinct paths of chains, in order
    paths = ends.groupBy("conv", "depth").agg(F.min("id").alias("id")).join(nodes.select("conv", "depth", (F.col("n_children") == 0).alias("leaf")), ["conv", "depth"])
    pairs = on_path.groupBy("conv", "least", "n").agg(F.min("depth").alias("top"), F.sum(F.when(F.col("conv") == F.col("least"), (F.col("n") - 1) * F.col("words")).otherwise(0)).alias("weight"))
    chains = pairs.groupBy(F.col("conv").alias("id")).agg(F.array_sort(F.collect_list(F.struct("top", F.col("least").alias("conv"), "n", "weight"))).alias("chains"))
    paths = stash(paths.select("id", "leaf").join(chains, "id").select(
        "leaf", F.transform("chains", lambda x: F.struct(x["top"].alias("top"), x["conv"].alias("conv"), x["n"].alias("n"))).alias("path"),
        F.col("chains")["weight"].alias("weights")), "paths")
    parts = paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_shards(shard), "conv bigint, n bigint, leaves bigint, saved bigint")
    total = stash(parts.groupBy("conv", "n").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved")), "chain_totals")

    # inside a chain the nodes above no longer count; where one conversation is alone nothing is saved
    passed = with_running(nodes.where("n > 1"), {"passed": (F.col("n") - 1) * F.col("words")}, ["depth"], ["conv", "n"], F.col("depth"), STRETCH)
    passed = passed.withColumn("passed", F.col("passed") - (F.col("n") - 1) * F.col("words"))
    nodes = stash(passed.unionByName(nodes.where("n = 1").withColumn("passed", F.lit(0).cast("bigint"))), "passed")
    nothing = hashlib.sha256(b"").hexdigest()
    hashes = stash(ends_hash(ends), "hashes")
    return nodes.join(total, ["conv", "n"]).join(hashes, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("saved") - F.col("passed")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op11_conversation_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(rebuilt(stash(turns(spark.read.parquet(f"{sf}/conversations.parquet")), "turns")))


OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT DISTINCT c, c - c % 20 AS s FROM t),
-- crc32 of the decimal: each character is mixed in, then eight shifts
h AS MATERIALIZED (SELECT c, s, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1),
   lambda i: [ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT + 1000, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS r FROM c),
g AS MATERIALIZED (SELECT c, s, xor(r, 4294967295::BIGINT) % 4 AS h FROM h),
k AS (SELECT g.c, g.s, g.h, least(g.h, (SELECT count(*) FROM t WHERE t.c = g.s)) AS taken FROM g),
x AS (SELECT k.c, t.p AS d, role, text FROM k JOIN t ON t.c = k.s AND t.p <= k.h UNION ALL SELECT k.c, t.p - k.h + k.taken, role, text FROM k JOIN t ON t.c = k.c AND t.p > k.h),
m AS MATERIALIZED (SELECT c, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM x
  UNION ALL SELECT c, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT key, d, min(c) AS conv, count(*) AS n, max(words) AS words FROM m GROUP BY 1, 2),
v AS MATERIALIZED (SELECT n.*, left(key, greatest(0, length(key) - 64)) AS above FROM n),
ch AS (SELECT above AS key, count(*) AS children FROM v WHERE d > 0 GROUP BY 1),
w AS MATERIALIZED (SELECT v.*, coalesce(children, 0) AS children FROM v LEFT JOIN ch USING (key)),
-- a node is in the subtree of every node on its smallest member's path down to it
sub AS (SELECT m.key, sum((w.n - 1) * w.words) AS saved, count(*) FILTER (w.children = 0) AS leaves FROM w JOIN m ON m.c = w.conv AND m.d <= w.d GROUP BY 1),
e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM m JOIN (SELECT c, max(d) AS d FROM m GROUP BY 1) USING (c, d) GROUP BY 1)
SELECT w.conv AS conv_id, w.d::BIGINT AS depth, CASE WHEN w.d > 0 THEN u.conv END AS parent_conv_id, w.n::BIGINT AS n_convs, w.children::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN w u ON u.key = w.above JOIN sub ON sub.key = w.key LEFT JOIN e ON e.key = w.key
"""
