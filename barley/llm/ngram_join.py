"""Components of documents whose word n-gram sets reach a Jaccard similarity: a size-aware heavy-light join.

**Sets.** A document's set is its distinct n-word shingles, as 64-bit hashes. Documents with equal sets are one class; one of each goes on.

**Light sets** (at most x shingles). Sets of a and b shingles link when they share c(a, b) of them. Each light set lists all its subsets of every
size c(a, b) that a partner could ask for; sets in one list share that subset, so the list's smallest set links to all that any two of
it could link. A list gives one link per member, not one per pair.

**Heavy sets** (more than x). An order of all shingles puts those first that few documents hold. A set that links with another shares one of its
first shingles, so only these are put into inverted lists. The lists of heavy sets are scanned in rounds. In the first each member meets four
members of about its size, the same for all of its list; one of them is the set that holds the list's shingle earliest in the order, thus has the fewest
shingles of its own: a group of near copies meets there. Components of what links are formed. Where many pairs are left, the members of a list meet such middle sets
of its first and its last component in further rounds, as long as that adds links. Then members of components that are still different meet, if place, size and a bound from 128
counts of each set allow the overlap; the sets are compared whole at the end. Members of one component need no further link, so a group
of copies costs its members, not its pairs.

**Boundary.** x is where the cost of listing subsets passes that of scanning, from the counts of sets by size and the measured length of lists.

The order puts shingles first that a sixteenth of the documents (by the hash of their id) holds at most once; the others follow by their counts there, in
2**21 cells. Any order gives the same result, so this sample decides the length of lists, not what is found.

A class is named by the hash of its set, so that copies need not be told from first documents before the lists are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.components import components
from barley.llm.shared import drop, few, give_back, stash
from barley.llm.words import chunks, lower_ascii, mix, prefix_sums, run_hash, signed

CELLS = 1 << 21
SAMPLE = 16
#: bits of the filter that keeps sets which no pair asks for from being moved
FILTER_BITS = 1 << 27
COUNTS = 128
#: a further round is worth its jobs if it costs this much less than the last step
ROUND = 4
#: bytes of text that a task looks at together
CHUNK = 1 << 19
LARGEST_LIGHT = 24
#: a turn of the order of hashes
TURN = 0x2545F4914F6CDD1D


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shingles that sets of a and b must share: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def partners(a: int, percent: int) -> range:
    """Sizes of sets that a set of ``a`` can link with."""
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def subset_sizes(a: int, percent: int) -> list[int]:
    return sorted({least_overlap(a, b, percent) for b in partners(a, percent)} & set(range(1, a + 1)))


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest size whose sets are light: the least total cost of subsets below and scans above.

    A subset is a row. A scanned shingle is a row and, for each further set in its list, a comparison of the set's size.
    """
    best, cost, gain = 0, 0.0, 0.0
    for a in range(1, LARGEST_LIGHT + 1):
        subsets = sum(comb(a, c) for c in subset_sizes(a, percent))
        scans = (a - -(-percent * a // 100) + 1) * (1 + (list_length - 1) * a)
        gain += sizes.get(a, 0) * (subsets - scans)
        if gain < cost:
            best, cost = a, gain
    return best


def similar_components(df: DataFrame, words: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``df``.

    Words are lower-cased (A to Z) and parted by white space. A text with fewer than ``words`` words, but not none, is one shingle; one without
    words (or null) is an empty set and its own component. Rows with a null id get their count and a null component. Rows that share an id have
    their own counts and fall in one component, with all that any of them links to; those among them without words stand alone.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    seen = stash(rows.mapInArrow(_sets(words), "id bigint, n int, whole bigint, counts binary, item bigint, held bigint, different bigint"), "sets")
    docs = seen.where("item is null and held is null").select("id", "n", "whole", "counts")
    full = docs.where("id is not null and n > 0")
    total = seen.agg(F.sum("held").alias("held"), F.sum("different").alias("different"), F.count("n").alias("docs")).first()
    classes = stash(few(full.groupBy("whole").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("counts").alias("counts")), total.docs), "classes")

    sizes = {r.n: r["count"] for r in classes.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}
    x = boundary(sizes, (total.held or 1) / (total.different or 1), percent)
    often = seen.where("item is not null").groupBy("item").count().where("count > 1")
    often = often.groupBy(F.expr(f"item & {CELLS - 1}").cast("int").alias("cell")).agg(F.sum("count").alias("n")).toArrow()
    cells = np.zeros(CELLS, np.int32)   # a fixed size, whatever the input
    cells[often.column("cell").to_numpy()] = np.minimum(often.column("n").to_numpy(), (1 << 31) - 1)
    order = df.sparkSession.sparkContext.broadcast(cells)

    keys = stash(rows.where("id is not null and text is not null").mapInArrow(
        _keys(words, percent, x, order), "whole bigint, n int, key bigint, place int, subset int"), "keys")
    listed = keys.count()
    near = stash(_light(keys.where("subset > 0"), percent, listed), "light")
    heavy = keys.where("subset = 0").select("whole", "n", "key", "place")
    several = stash(few(heavy.groupBy("key").agg(F.min("whole").alias("l"), F.max("whole").alias("h")), listed).where("l < h").select("key"), "several")
    band = F.floor(F.log("n") / float(np.log(100 / percent)))
    lists = stash(few(few(heavy.join(several, "key", "left_semi"), listed).distinct(), listed).withColumn("band", band), "lists")
    drop(keys, several)
    # what is made from the lists and the classes takes as many tasks as the larger of the two needs
    size = max(lists.count(), total.docs)

    # rows of one id hang together, whatever they hold
    same = few(full.groupBy("id").agg(F.min("whole").alias("a"), F.max("whole").alias("h")), total.docs).where("a < h").select("id", "a")
    near = near.unionByName(few(full.join(same, "id"), total.docs).where("whole <> a").select("a", F.col("whole").alias("b")))

    # members that all others of a list meet: a group whose sets just reach the similarity is then seldom left in many parts
    turned = F.col("whole").bitwiseXOR(F.lit(TURN))
    met = F.array(F.min_by("whole", F.struct("place", "whole")), F.min("whole"), F.max("whole"), F.min(turned).bitwiseXOR(F.lit(TURN)))
    firsts = stash(few(lists.groupBy("key", "band").agg(met.alias("met")), size), "firsts")
    rays = few(lists.join(firsts, ["key", "band"]), size).select("whole", F.explode("met").alias("other"))
    done = stash(few(_pairs(rays), size), "stars")
    near = stash(near.unionByName(_verified(done, classes, rows, words, percent, size)), "near")
    drop(firsts)
    while True:
        groups = components(near).withColumnRenamed("id", "whole")
        # from here on the components stand for the links that made them
        near = groups.where("whole <> component").select(F.col("whole").alias("a"), F.col("component").alias("b"))
        grouped = stash(few(lists.join(groups, "whole", "left"), size).withColumn("component", F.coalesce("component", "whole")), "grouped")
        mixed = stash(few(grouped.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")), size).where("l < h").select("key"), "mixed")
        open_ = stash(few(grouped.join(mixed, "key", "left_semi"), size), "open")
        drop(grouped, mixed)
        # another round costs two comparisons a member, the last step all pairs of different components; up to the size of the input these cost less than a round's jobs
        parts = few(open_.groupBy("key", "component").agg(F.count("*").alias("n")), size)
        parts = few(parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")), size)
        cost = parts.agg(F.sum("n").alias("members"), F.sum(((F.col("n") * F.col("n") - F.col("own")) / 2).cast("double")).alias("pairs")).first()
        if (cost.pairs or 0) <= max(2 * ROUND * (cost.members or 0), size):
            break
        middle = few(open_.groupBy("key", "band", "component").agg(F.min_by("whole", F.struct("place", "whole")).alias("middle")), size)
        ends = few(middle.groupBy("key", "band").agg(F.min_by("middle", "component").alias("x"), F.max_by("middle", "component").alias("y")), size).where("x <> y")
        # a middle set may lie in the next band of sizes
        ends = ends.select("key", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "x", "y")
        rays = few(open_.join(stash(ends, "ends"), ["key", "band"]), size).select("whole", F.explode(F.array("x", "y")).alias("other"))
        fresh = stash(few(few(_pairs(rays), size).join(done, ["a", "b"], "left_anti"), size), "fresh")
        links = _verified(fresh, classes, rows, words, percent, size)
        done = done.unionByName(fresh)
        if links.isEmpty():
            break
        near = near.unionByName(links)

    other = open_.select("key", *[F.col(c).alias(f"{c}2") for c in ("whole", "n", "place", "component")])
    # different components, sizes that can link, and enough shingles left from here on, were this the first that both hold
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    fits = ((F.col("component") < F.col("component2")) & (100 * F.col("n") >= percent * F.col("n2")) & (100 * F.col("n2") >= percent * F.col("n"))
            & ((100 + percent) * left >= percent * (F.col("n") + F.col("n2"))))
    # members of a list may meet in many pairs: these are dealt to all tasks, and counted when they are written
    pairs = _pairs(open_.join(other, (open_.key == other.key) & fits).select("whole", F.col("whole2").alias("other")))
    rest = stash(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    groups = components(near.unionByName(_verified(rest, classes, rows, words, percent, max(size, rest.count()))))

    # the smallest document of each component, then of each class
    linked = stash(few(classes.select(F.col("whole").alias("id"), "first").join(groups, "id"), total.docs), "linked")
    least = stash(few(linked.groupBy("component").agg(F.min("first").alias("least")), total.docs), "least")
    named = few(linked.join(least, "component"), total.docs).select(F.col("id").alias("whole"), "least")
    label = stash(few(classes.select("whole", "first").join(named, "whole", "left"), total.docs).select("whole", F.coalesce("least", "first").alias("c")), "label")
    # an empty set is its own component
    return few(docs.join(label, "whole", "left"), total.docs).select(
        F.col("id").cast(df.schema[id_column].dataType).alias(id_column), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("c", "id")).otherwise(F.col("id"))).alias("component_id"))


def _pairs(rays: DataFrame) -> DataFrame:
    return rays.where("whole <> other").select(F.least("whole", "other").alias("a"), F.greatest("whole", "other").alias("b")).distinct()


def _light(keys: DataFrame, percent: int, size: int) -> DataFrame:
    """Links of light sets, from ``size`` keys: in each list the smallest set with all that fit it."""
    least = few(keys.groupBy("key").agg(F.min(F.struct("n", "whole")).alias("m"), F.max("whole").alias("h"), F.min("whole").alias("l")), size).where("l < h")
    met = few(keys.join(stash(least.select("key", "m"), "least"), "key"), size).where(
        (F.col("whole") != F.col("m.whole")) & (percent * (F.col("n") + F.col("m.n")) <= (100 + percent) * F.col("subset")))
    return few(met.select(F.least("whole", "m.whole").alias("a"), F.greatest("whole", "m.whole").alias("b")).distinct(), size)


#: rows with whole sets, or with counts, that a task gets at least
WIDE = 10_000


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int, size: int) -> DataFrame:
    """The pairs of classes whose sets reach the similarity, after the bound of the counts. Sets are made anew from the texts of first documents, and
    those that the filter shows not to be asked for go no further. ``size``: rows of the larger of pairs' origin and classes."""
    a, b = (classes.select(F.col("whole").alias(c), F.col("first").alias(f"first_{c}"), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}")) for c in "ab")
    met = few(few(pairs.join(a, "a"), size, WIDE).join(b, "b"), size, WIDE)
    possible = stash(met.mapInArrow(_bound(percent), "a bigint, b bigint, first_a bigint, first_b bigint"), "possible")
    asking = 2 * possible.count()
    if not asking:
        return possible.select("a", "b")
    wanted = possible.select(F.explode(F.array("first_a", "first_b")).alias("id"))
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = wanted.groupBy((bit / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 64 as int))")).alias("bits"))
    bits = few(bits, asking).toArrow()
    filter_ = np.zeros(FILTER_BITS // 64, np.int64)   # a fixed size, whatever the input
    filter_[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    asked = rows.sparkSession.sparkContext.broadcast(filter_)
    hashed = rows.where("id is not null").select("id", "text", bit.alias("bit"))
    made = stash(hashed.mapInArrow(_whole_sets(words, asked), "whole bigint, part int, items binary"), "made")
    # one row of each class: a task gives a class once, and of the tasks the first counts
    held = made.count()
    first = few(made.groupBy("whole").agg(F.min("part").alias("part")), held)
    sets = few(made.join(first, ["whole", "part"]), held, WIDE).drop("part")
    a, b = (sets.select(F.col("whole").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    most = max(held, asking)
    both = few(few(possible.select("a", "b").join(a, "a"), most, WIDE).join(b, "b"), most, WIDE)
    near = stash(both.mapInArrow(_compare(percent), "a bigint, b bigint"), "near")
    drop(made, possible)
    return near


def _shingles(c, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk, sorted by text: (shingle, text)."""
    sums = prefix_sums(c.words_hash())
    at = np.arange(max(0, len(c.doc) - words + 1))
    at = at[c.doc[at] == c.doc[at + words - 1]]
    short = np.flatnonzero((c.n_words > 0) & (c.n_words < words))
    items = np.concatenate([run_hash(sums, at, at + words), run_hash(sums, c.first[short], c.first[short + 1])])
    doc = np.concatenate([c.doc[at], short])
    by = np.lexsort((items, doc))
    items, doc = items[by], doc[by]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])
    return items[new], doc[new]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _whole(items: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The hash of each set."""
    return signed(mix(_sums(mix(items), edges) + np.diff(edges).astype(np.uint64)))


def _sets(words: int):
    types = {"id": pa.int64(), "n": pa.int32(), "whole": pa.int64(), "counts": pa.binary(), "item": pa.int64(), "held": pa.int64(), "different": pa.int64()}

    def rows(length: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(length, t) for k, t in types.items()], list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = different = 0
        for c in chunks(batches, fold=lower_ascii(), limit=CHUNK):
            items, doc = _shingles(c, words)
            edges = np.searchsorted(doc, np.arange(len(c) + 1))
            held, different = held + len(items), different + len(np.unique(items))
            counts = np.bincount(doc * COUNTS + (items >> np.uint64(57)).astype(np.int64), minlength=len(c) * COUNTS)
            # counts beyond 255 would only weaken the bound: they are kept as 255 and read as unbounded
            counts = np.minimum(counts, 255).astype(np.uint8).tobytes()
            ids = c.rows.column("id")
            yield rows(len(c), id=ids, n=pa.array(np.diff(edges).astype(np.int32)), whole=pa.array(_whole(items, edges)),
                       counts=pa.array([counts[i * COUNTS:(i + 1) * COUNTS] for i in range(len(c))], pa.binary()))
            some = mix(ids.fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(SAMPLE) == 0
            own = signed(items[some[doc]])
            if len(own):
                yield rows(len(own), item=pa.array(own))
        yield rows(1, held=pa.array([held]), different=pa.array([different]))
        give_back()
    return run


@lru_cache(None)
def _left_out(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)


def _keys(words: int, percent: int, x: int, order):
    smallest_listed = -(-percent * (x + 1) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = order.value
        names = ["whole", "n", "key", "place", "subset"]
        for c in chunks(batches, fold=lower_ascii(), limit=CHUNK):
            items, doc = _shingles(c, words)
            edges = np.searchsorted(doc, np.arange(len(c) + 1))
            size, whole = np.diff(edges).astype(np.int32), _whole(items, edges)
            # inverted lists: the first shingles in the order of all
            own = size[doc] >= smallest_listed
            some, at = items[own], doc[own]
            by = np.lexsort((some, cells[(some & np.uint64(CELLS - 1)).astype(np.int64)], at))
            some, at = some[by], at[by]
            place = np.arange(len(some)) - np.searchsorted(at, at)
            first = place < size[at] - -(-percent * size[at].astype(np.int64) // 100) + 1
            some, at, place = some[first], at[first], place[first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(whole[at]), pa.array(size[at]), pa.array(signed(some)), pa.array(place),
                                              pa.array(np.zeros(len(some), np.int32))], names)
            out = []
            for d in np.flatnonzero((size > 0) & (size <= x)).tolist():
                own, a = mix(items[edges[d]:edges[d + 1]]), int(size[d])
                total = own.sum(dtype=np.uint64)
                for k in subset_sizes(a, percent):
                    sums = total - own[_left_out(a, a - k)].sum(axis=1, dtype=np.uint64)
                    keys = mix(sums + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
                    out.append((np.full(len(keys), whole[d]), np.full(len(keys), a, np.int32), signed(keys), np.zeros(len(keys), np.int32), np.full(len(keys), k, np.int32)))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)
        give_back()
    return run


def _bound(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("n_a").to_numpy().astype(np.int64), batch.column("n_b").to_numpy().astype(np.int64)
            x, y = (np.frombuffer(b"".join(batch.column(f"counts_{s}").to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int64) for s in "ab")
            both = np.where((x == 255) | (y == 255), np.maximum(x, y) + (1 << 40), np.minimum(x, y)).sum(axis=1)
            overlap = np.minimum(both, np.minimum(a, b))
            yield batch.select(["a", "b", "first_a", "first_b"]).filter(pa.array((100 + percent) * overlap >= percent * (a + b)))
    return run


def _whole_sets(words: int, asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, part, seen = asked.value, TaskContext.get().partitionId(), set()
        for c in chunks(_asked(batches, filter_), fold=lower_ascii(), limit=CHUNK):
            items, doc = _shingles(c, words)
            edges = np.searchsorted(doc, np.arange(len(c) + 1))
            found, data = [], items.tobytes()
            for whole, i, j in zip(_whole(items, edges).tolist(), (8 * edges[:-1]).tolist(), (8 * edges[1:]).tolist()):
                if i < j and whole not in seen:
                    seen.add(whole)
                    found.append((whole, data[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array([part] * len(found), pa.int32()),
                                              pa.array([x for _, x in found], pa.binary())], ["whole", "part", "items"])
        give_back()
    return run


def _asked(batches: Iterator[pa.RecordBatch], filter_: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = batch.column("bit").to_numpy()
        yield batch.filter(pa.array(filter_[bit >> 6] >> (bit & 63) & 1 == 1))


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                overlap = int((both[1:] == both[:-1]).sum())
                keep.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()
    return run


def op2_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(words[p:p + 3], ' ')) AS item
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS p FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY 1) c ON c.node = d.doc_id
"""
