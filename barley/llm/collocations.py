"""Phrases of two to four words that occur together more often than their parts let expect, per language.

**Counts.** Each task counts hashed phrases of its texts in sorted arrays and sends one row per phrase and array; Spark adds them. Words and pairs come first.
A longer phrase can only be frequent if all its pairs are, so three and four words are counted where a filter of fixed size holds all pairs. With each
count goes the smallest text hash of those that hold the phrase. The texts named so give frequent phrases their words, nearly each phrase once, and
from here on phrases are compared by words.

**Streams.** Frequent phrases are kept in two orders, by words from the front (prefix order) and from the back (suffix order), cut into ranges. In prefix order
every phrase comes right after its own beginnings: one pass with a stack of at most four phrases merges the streams of all lengths in lockstep and
gives each phrase the counts of its beginnings and its most frequent extension by a word on the right. In suffix order the same pass gives the counts
of its ends and the extension on the left. A beginning whose extensions lie in further ranges is handed to these as well.

A longer phrase that holds a shorter one inside holds an extension of it by one word that is at least as frequent, so one word on either side suffices.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barley.llm.shared import stash, tasks
from barley.llm.words import chunks, lower_ascii, mix, prefix_sums, run_hash, signed

LONGEST = 4
FILTER_BITS = 1 << 27
#: phrases that a task gathers before it sorts and counts them, and bytes of text that it looks at together
GATHERED = 1 << 21
CHUNK = 1 << 19
#: keys drawn for each range when ranges are cut
DRAWN = 50

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
PARTS = BREAK.copy()
PARTS[[0x20, 0x09]] = True


def _phrases(c, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the first words of phrases within a piece, and the phrases' hashes with their language."""
    breaks = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(BREAK[c.data], out=breaks[1:])
    piece = breaks[c.start]
    goes_on = (piece[1:] == piece[:-1]) & (c.doc[1:] == c.doc[:-1])
    sums, lang = prefix_sums(c.words_hash()), c.rows.column("lang_hash").to_numpy().view(np.uint64)
    fits = np.ones(len(c.doc), bool)
    for n in range(1, longest + 1):
        at = np.flatnonzero(fits)
        yield n, at, mix(run_hash(sums, at, at + n) ^ lang[c.doc[at]])
        fits = fits[:-1] & goes_on[n - 1:] if len(fits) else fits


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


class _Counts:
    """Hashed phrases and the hashes of their texts, sorted and counted array by array."""

    def __init__(self):
        self.keys, self.texts, self.size = [], [], 0

    def add(self, c, at: np.ndarray, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.texts.append(c.rows.column("text_hash").to_numpy()[c.doc[at]])
        self.size += len(keys)

    def counted(self) -> pa.RecordBatch:
        keys, texts = np.concatenate(self.keys), np.concatenate(self.texts)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n, least = np.diff(np.append(first, len(keys))), np.minimum.reduceat(texts[order], first)
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(signed(keys[first])), pa.array(n), pa.array(least)], ["key", "n", "text_hash"])


COUNTED = "key bigint, n bigint, text_hash int"


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs; a language's hash counts all its words."""
    counts, totals = _Counts(), {}
    for c in chunks(batches, parts=PARTS, fold=lower_ascii(), limit=CHUNK):
        for lang, n in zip(c.rows.column("lang_hash").to_pylist(), c.n_words.tolist()):
            totals[lang] = totals.get(lang, 0) + n
        for n, at, keys in _phrases(c, 2):
            counts.add(c, at, keys)
        if counts.size >= GATHERED:
            yield counts.counted()
    if counts.size:
        yield counts.counted()
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64()), pa.array([0] * len(totals), pa.int32())], ["key", "n", "text_hash"])


def _long(filter_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = filter_.value, _Counts()
        for c in chunks(batches, parts=PARTS, fold=lower_ascii(), limit=CHUNK):
            pair = np.zeros(len(c.doc) + LONGEST, bool)
            for n, at, keys in _phrases(c):
                if n == 2:
                    pair[at] = _in(bits, keys)
                elif n > 2:
                    own = np.logical_and.reduce([pair[at + i] for i in range(n - 1)])
                    counts.add(c, at[own], keys[own])
            if counts.size >= GATHERED:
                yield counts.counted()
        if counts.size:
            yield counts.counted()
    return run


def _named(keys: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The hash of a phrase in a text."""
    return mix(keys ^ mix(texts.astype(np.uint64)))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(signed(_named(b.column("key").to_numpy().view(np.uint64), b.column("text_hash").to_numpy())))], ["key"])


def _spelled(filter_):
    """The words of each phrase in the texts that are named for it; a text that comes again in the task is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = filter_.value, set()
        for c in chunks(batches, parts=PARTS, fold=lower_ascii(), limit=CHUNK):
            hashes = c.rows.column("text_hash").to_numpy()
            new = np.array([not (h in seen or seen.add(h)) for h in hashes.tolist()], bool)
            found, first, lengths = [], [], []
            for n, at, keys in _phrases(c):
                own = np.flatnonzero(_in(bits, _named(keys, hashes[c.doc[at]])) & new[c.doc[at]])
                keys, where = np.unique(keys[own], return_index=True)
                found.append(keys)
                first.append(at[own][where])
                lengths.append(np.full(len(keys), n))
            found, first, lengths = np.concatenate(found), np.concatenate(first), np.concatenate(lengths)
            data, start, end = c.data.tobytes(), c.start, c.end
            text = [[data[a:b].decode() for a, b in zip(start[i:i + n].tolist(), end[i:i + n].tolist())] for i, n in zip(first.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), c.rows.column("lang").take(pa.array(c.doc[first])), pa.array(text, pa.list_(pa.string()))], ["key", "lang", "words"])
    return run


def _filter(keys: DataFrame):
    """A bit for each key; its size is fixed, whatever the input."""
    bit = f"(key & {FILTER_BITS - 1})"
    rows = keys.groupBy(F.expr(f"cast({bit} div 64 as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits)


def frequent_phrases(df: DataFrame, least: int, lang_column: str = "lang", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, words, a) of phrases of one to four words that occur ``least`` times, and (lang_hash, n) of all words."""
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    rows = df.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.hash(lang, text_column).alias("text_hash"), F.col(text_column).cast("string").alias("text"))
    langs = rows.select("lang_hash").distinct()

    def summed(counted: DataFrame) -> DataFrame:
        return counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("text_hash").alias("text_hash"))

    texts = rows.select("lang_hash", "text_hash", "text")
    short = stash(summed(texts.mapInArrow(_short, COUNTED)), "short")
    totals = short.join(langs, short.key == langs.lang_hash).select("lang_hash", "n")
    frequent = short.where(F.col("n") >= least)
    long = summed(texts.mapInArrow(_long(_filter(frequent.select("key"))), COUNTED)).where(F.col("n") >= least)
    frequent = stash(frequent.unionByName(long), "frequent")
    named = _filter(frequent.select("key", "text_hash").mapInArrow(_names, "key bigint"))
    phrases = rows.mapInArrow(_spelled(named), "key bigint, lang string, words array<string>").join(frequent, "key")
    phrases = phrases.groupBy("key").agg(F.first("lang").alias("lang"), F.first("words").alias("words"), F.first("n").alias("a"))
    return stash(phrases.drop("key"), "phrases"), totals


class _Last:
    """Above every word."""

    def __gt__(self, other):
        return True

    def __lt__(self, other):
        return False


def _places(bounds: list[tuple]):
    """The ranges that need a phrase: its own, and those where its extensions lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, home, row = [], [], []
            for i, key in enumerate(batch.column("by").to_pylist()):
                own = bisect_right(bounds, tuple(key))
                last = bisect_right(bounds, (*key, _Last())) if len(key) <= LONGEST else own
                part += range(own, last + 1)
                home += [True] + [False] * (last - own)
                row += [i] * (last - own + 1)
            rows = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(home, pa.bool_()), *rows.columns], ["part", "home", *batch.schema.names])
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each phrase with the counts of its beginnings, shortest first, and its most frequent extension."""
    part, stack = None, []   # of the phrases open: [key, home, count, counts of its beginnings, best extension]
    done = []

    def close(length: int) -> None:
        while len(stack) > length:
            key, home, a, before, best = stack.pop()
            if len(key) > 2 and (home or best):
                done.append({"by": key, "home": home, "a": a, "before": before, "best": best})
    for batch in batches:
        for own, home, by, a in zip(*(batch.column(c).to_pylist() for c in ("part", "home", "by", "a"))):
            if own != part:
                close(0)
                part = own
            depth = 0
            while depth < len(stack) and len(stack[depth][0]) < len(by) and stack[depth][0] == by[:len(stack[depth][0])]:
                depth += 1
            close(depth)
            before = []
            if stack:
                stack[-1][4] = max(stack[-1][4], a)
                before = [*stack[-1][3], stack[-1][2]]
            stack.append([by, home, a, before, 0])
        if done:
            yield pa.RecordBatch.from_pylist(done, _OUT)
            done = []
    close(0)
    yield pa.RecordBatch.from_pylist(done, _OUT)


_OUT = pa.schema([("by", pa.list_(pa.string())), ("home", pa.bool_()), ("a", pa.int64()), ("before", pa.list_(pa.int64())), ("best", pa.int64())])


def stream(phrases: DataFrame, order: Column, ranges: int) -> DataFrame:
    """(by, a, before, best) of phrases of two and more words; ``order`` is the language, then the words from the front or from the back."""
    keyed = phrases.select(order.alias("by"), "a")
    total = phrases.count()
    drawn = sorted(tuple(r.by) for r in keyed.sample(min(1.0, DRAWN * ranges / max(1, total)), seed=1).select("by").collect()) if ranges > 1 else []
    bounds = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []
    rows = keyed.mapInArrow(_places(bounds), "part int, home boolean, by array<string>, a bigint")
    rows = rows.repartition("part").sortWithinPartitions("part", "by")
    merged = stash(rows.mapInArrow(_merged, "by array<string>, home boolean, a bigint, before array<bigint>, best bigint"), "merged")
    further = merged.where("not home").groupBy("by").agg(F.max("best").alias("further"))
    return merged.where("home").join(further, "by", "left").select("by", "a", "before", F.greatest("best", F.coalesce("further", F.lit(0))).alias("best"))


def collocations(df: DataFrame, least: int = 30, share: int = 80, top: int = 2000, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words that occur ``least`` times.

    A to Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. The cut of a phrase with the lowest score counts, of equal ones the
    first; score is floor(2,000,000 * a / (l + r)). A phrase is left out if a longer one around it occurs at least ``share`` % as often. A null
    language is ``und``; null and empty texts have no words. Ties go by count, then by the phrase's bytes. Texts of any length are read whole.
    """
    phrases, totals = frequent_phrases(df, least, lang_column, text_column)
    ranges = tasks(df.sparkSession)
    lang = F.array("lang")
    front = stream(phrases, F.concat(lang, "words"), ranges).withColumnRenamed("best", "right")
    back = stream(phrases, F.concat(lang, F.reverse("words")), ranges).select(
        F.concat(F.slice("by", 1, 1), F.reverse(F.expr("slice(by, 2, size(by) - 1)"))).alias("by"), F.col("before").alias("after"), F.col("best").alias("left"))
    # the two streams meet in prefix order
    both = front.hint("merge").join(back, "by").where("100 * cast(greatest(left, right) as decimal(20,0)) < {} * cast(a as decimal(20,0))".format(share))
    cut = F.transform(F.sequence(F.lit(1), F.size("before")), lambda k: F.struct(k.alias("k"), F.get("before", k - 1).alias("l"), F.get("after", F.size("after") - k).alias("r")))
    scored = F.expr("transform(cuts, x -> struct(2000000 * cast(a as decimal(20,0)) div (cast(x.l as decimal(20,0)) + cast(x.r as decimal(20,0))) as score, x.k as k, x.l as l, x.r as r))")
    best = both.withColumn("cuts", cut).withColumn("best", F.array_min(scored)).select(
        F.element_at("by", 1).alias("lang"), F.array_join(F.expr("slice(by, 2, size(by) - 1)"), " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
    line = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)
    return ranked.join(totals, F.xxhash64("lang") == F.col("lang_hash")).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS MATERIALIZED (SELECT lang, k, gram, count(*) AS f FROM (SELECT lang, k, array_to_string(words[p:p + k - 1], ' ') AS gram
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k)) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT *, string_split(gram, ' ') AS ws FROM g WHERE k >= 2),
s AS (SELECT c.lang, c.k, c.gram, c.f AS a, q, x.f AS l, y.f AS r, 2000000::HUGEINT * c.f // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS q FROM c) c JOIN g x ON x.lang = c.lang AND x.gram = array_to_string(ws[1:q], ' ') JOIN g y ON y.lang = c.lang AND y.gram = array_to_string(ws[q + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, q) = 1),
parts AS (SELECT lang, array_to_string(ws[i:j], ' ') AS gram, max(f) AS f FROM (SELECT lang, k, f, ws, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.gram) AS rank FROM b LEFT JOIN parts p ON p.lang = b.lang AND p.gram = b.gram
  WHERE p.f IS NULL OR 100 * p.f < 80 * a)
SELECT o.lang, rank::BIGINT AS rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
