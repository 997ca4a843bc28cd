"""Toxicity of whole texts: misspelled terms by Levenshtein automata over a lexicon trie, weighed by the words around them.

**Lexicon.** Words and word beginnings that mark toxic rows in one half of the labelled training rows (a likelihood-ratio test, strict enough for the
number of terms tried). A beginning is listed in the place of its words where no one word makes up half of it. Words stand in a trie; a
beginning is a node of the trie at which any further letters are accepted. Its words (those of two label-1 rows and more with high odds) stay in the trie
as targets of misspellings, which weigh as the beginning does.

**Search.** For a word of a text, the Levenshtein automaton of distance one runs along the trie: only branches on which it is alive are followed. A word is
looked up once per task and then remembered. Words of fewer than five letters are matched as they are. A digit or sign between letters, and a digit, @, $ or *
before or after them, parts words; where no part is a hit, the automaton reads them as one word with that sign (id1ot, st*pid). As it allows one edit, one sign is enough.

**Context.** A hit between quotation marks or near a word that reports speech counts as quotation; one near a second person is directed abuse. Both
have features of their own, beside the plain hits, so that quoting a term and using it are scored apart.

**Score.** A logistic regression over these few features, fitted on the other half of the training rows, so that the lexicon's own rows do not flatter it.
At most ``most_rows`` labelled rows (those with the smallest hashes of their ids) are used; they are the only rows that are sampled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.shared import Carried, give_back, stash

MOST_ROWS = 6_000
MOST_TERMS = 4_000
BEGINNINGS = (4, 5, 6)
WINDOW = 6
LEAST_SCORE = 0.3

#: letters (all bytes from 0x80 on count as such) in lower case, the rest parts words
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: letters with one digit or sign that may stand for a letter, in lower case
MASKED = re.compile(rb"(?<![a-z\x80-\xff])(?:[a-z\x80-\xff]+[!-@\[-`{-~][a-z\x80-\xff]+|[0-9@$*][a-z\x80-\xff]{4,}|[a-z\x80-\xff]{4,}[0-9@$*](?![a-z0-9\x80-\xff]))")
QUOTES = tuple(q.encode() for q in ('"', "“", "”", "„", "«", "»", "‹", "›"))
REPORTS = frozenset(w.encode() for w in "said says say wrote writes quote quoted quoting called reported dit écrit appelé sagte schrieb nannte zitat zitiert dijo escribió llamó cita".split())
SECOND = frozenset(w.encode() for w in "you your yours du dich dir dein ihr euch tu te toi vous votre tú usted ustedes vosotros".split())
FEATURES = 9


def split_words(text: str | None) -> list[bytes]:
    return [] if not text else text.lower().encode().translate(TABLE).split()


class Trie:
    """Lexicon terms as nested dictionaries of letters; key 0 holds a word's weight, key 1 a beginning's, key 2 that of a word below a beginning."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], targets: dict[str, float] | None = None):
        self.root: dict = {}
        targets = targets or {}
        self.terms = (*words, *beginnings, *targets)
        for mark, terms in ((0, words), (1, beginnings), (2, targets)):
            for term, weight in terms.items():
                node = self.root
                for letter in term:
                    node = node.setdefault(letter, {})
                node[mark] = weight
        # with one edit, a term's first two letters or its last three stay as they are, and its length changes by one at most
        self.heads = {(w[:2], len(w) + d) for w in (*words, *targets) for d in (-1, 0, 1)}
        self.tails = {(w[-3:], len(w) + d) for w in (*words, *targets) for d in (-1, 0, 1)}
        self.seen = None

    def __getstate__(self):
        return self.__dict__ | {"seen": None}

    def matches(self) -> _Seen:
        """What words match, shared by the tasks of a Python worker."""
        if self.seen is None:
            self.seen = _Seen(self)
        return self.seen

    def exact(self, word: str) -> tuple[float, bool] | None:
        """Weight of the word itself or its longest listed beginning, and whether it is a beginning's."""
        node, found = self.root, None
        for letter in word:
            node = node.get(letter)
            if node is None:
                return found
            if 1 in node:
                found = (node[1], True)
        return (node[0], False) if 0 in node else found

    def near(self, word: str) -> float | None:
        """The highest weight of a listed word, or of a word below a beginning, at distance one."""
        best, n = None, len(word)
        if n < 5 or not ((word[:2], n) in self.heads or (word[-3:], n) in self.tails):
            return None
        # states of the automaton: (place in the word, edits so far) sets, kept as costs by place within reach
        stack = [(self.root, 0, {0: 0, 1: 1})]
        while stack:
            node, depth, states = stack.pop()
            if (0 in node or 2 in node) and depth >= 5:
                cost = min((c + n - p for p, c in states.items() if c + n - p <= 1), default=2)
                weight = node.get(0, node.get(2))
                if cost == 1 and (best is None or weight > best):
                    best = weight
            for letter, child in node.items():
                if letter in (0, 1, 2):
                    continue
                after: dict[int, int] = {}
                for p, c in states.items():
                    if p < n and word[p] == letter:
                        after[p + 1] = min(c, after.get(p + 1, 2))
                    if c == 0:
                        for q in (p, p + 1):   # a letter of the term left out, or another in its place
                            if q <= n:
                                after[q] = min(1, after.get(q, 2))
                for p in sorted(after):        # a letter too many in the word
                    if after[p] == 0 and p < n:
                        after[p + 1] = min(1, after.get(p + 1, 2))
                if after:
                    stack.append((child, depth + 1, after))
        return best


class _Seen(dict):
    """What each word matches: None, or (weight, kind) with kind 0 word, 1 beginning, 2 misspelled."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie
        # what is listed or at distance one shares its first two letters or its last three with a term
        self.starts, self.ends = {t.encode()[:2] for t in trie.terms}, {t.encode()[-3:] for t in trie.terms}

    def __missing__(self, word: bytes):
        if len(self) > 500_000:
            self.clear()
        out = None
        if word[:2] in self.starts or word[-3:] in self.ends:
            text = word.decode(errors="replace")
            exact = self.trie.exact(text)
            if exact:
                out = (exact[0], 1 if exact[1] else 0)
            else:
                near = self.trie.near(text)
                out = None if near is None else (near, 2)
        self[word] = out
        return out


def _masked(low: bytes, seen: _Seen) -> list[tuple[float, int]]:
    """Hits of words with a digit or sign for a letter, where no part of them is a hit."""
    return [h for m in MASKED.findall(low) if len(m) > 4 and (h := seen[m]) and not any(seen[w] for w in m.translate(TABLE).split())]


def _contexts(text: str, seen: _Seen) -> tuple[int, int]:
    """Hits in quotation, and hits near a second person."""
    quoted = directed = 0
    tokens = text.lower().encode().split()
    words = [t.translate(TABLE).split() for t in tokens]
    open_, inside = False, []
    for t in tokens:
        marks = sum(t.count(q) for q in QUOTES)
        inside.append(open_ or marks > 0)
        open_ ^= marks % 2 == 1
    for i, own in enumerate(words):
        if any(seen[w] for w in own) or _masked(tokens[i], seen):
            near = {w for other in words[max(0, i - WINDOW):i + WINDOW + 1] for w in other}
            quoted += inside[i] or not near.isdisjoint(REPORTS)
            directed += not near.isdisjoint(SECOND)
    return quoted, directed


def features(text: str | None, seen: _Seen) -> list[float]:
    words = split_words(text)
    hits = [h for h in map(seen.__getitem__, words) if h]
    if words:
        hits += _masked(text.lower().encode(), seen)
    if not hits:
        return [1.0] + [0.0] * (FEATURES - 1)
    kinds = [sum(1 for h in hits if h[1] == k) for k in range(3)]
    quoted, directed = _contexts(text, seen)
    return [1.0, *(math.log1p(k) for k in kinds), max(h[0] for h in hits), min(1.0, 10 * len(hits) / len(words)),
            math.log1p(max(0, len(hits) - quoted)), math.log1p(quoted), math.log1p(directed)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton steps; the first column is the intercept and is not shrunk."""
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(df: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most_rows: int) -> DataFrame:
    """(id, text, label, half): labelled rows outside the held-out quarter, at most ``most_rows``. A label that comes twice is 1 if either is."""
    own = labels.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("int").alias("label")).dropna()
    own = own.where(F.crc32(F.col("id").cast("string")) % 4 != 2).groupBy("id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    # at most most_rows ids and labels: small enough for every task
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(own), "id").withColumn("half", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int"))


def _begun(n: int):
    """The first ``n`` letters of each longer word, marked."""
    return F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def _terms(rows: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Words and beginnings that mark label 1, with their log odds, and the words below these beginnings with the beginnings' log odds."""
    letters = F.regexp_replace(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+", " ")
    words = F.array_distinct(F.filter(F.split(letters, " "), lambda w: F.length(w) > 2))
    begun = [_begun(n) for n in BEGINNINGS]
    terms = rows.where("half = 0").select("label", words.alias("words")).select("label", F.explode(F.array_distinct(F.concat("words", *begun))).alias("term"))
    totals = {r.label: r["count"] for r in rows.where("half = 0").groupBy("label").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}, {}, {}
    counts = terms.groupBy("term").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).where("p >= 2")
    base = pos / (pos + neg)
    total = F.col("p") + F.col("n")
    ratio = 2 * (F.col("p") * F.log(F.col("p") / (total * base)) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (total * (1 - base)))).otherwise(0.0))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    scored = counts.select("term", "p", ratio.alias("ratio"), odds.alias("odds")).where("odds > 1.5")
    tried = max(2, scored.count())
    best = scored.where(F.col("ratio") > 2 * math.log(2 * tried)).orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).collect()
    words, begun = [r for r in best if r.term[-1] != "*"], sorted((r for r in best if r.term[-1] == "*"), key=lambda r: (len(r.term), r.term))
    most: dict[str, int] = {}   # rows of the commonest word by its beginning
    for r in words:
        for n in BEGINNINGS:
            most[r.term[:n]] = max(most.get(r.term[:n], 0), r.p)
    listed: dict[str, float] = {}
    for r in begun:
        start = r.term[:-1]
        if 2 * most.get(start, 0) < r.p and not any(start[:n] in listed for n in BEGINNINGS):
            listed[start] = r.odds
    below = [F.substring("term", 1, n).isin([b for b in listed if len(b) == n]) for n in BEGINNINGS]
    # of the training rows' words, thus few
    family = [r.term for r in scored.where(~F.col("term").endswith("*") & (below[0] | below[1] | below[2])).select("term").collect()] if listed else []
    targets = {t: max(listed[t[:n]] for n in BEGINNINGS if t[:n] in listed) for t in family}
    return {r.term: r.odds for r in words if not any(r.term[:n] in listed for n in BEGINNINGS)}, listed, targets


def train(rows: DataFrame) -> tuple[Trie, np.ndarray]:
    """Lexicon and weights. Without labels of both kinds, the lexicon is empty and the score the share of label 1 (or 0)."""
    rows = stash(rows, "labelled")
    trie = Trie(*_terms(rows))
    spread = rows.sparkSession.sparkContext.broadcast(trie)
    found = rows.where("half = 1").select("label", "text").mapInArrow(lambda batches: _features(batches, spread), "label int, x array<double>").collect()
    y = np.array([r.label for r in found], float)
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()) if len(y) else 0.001))
        return trie, np.array([math.log(share / (1 - share))] + [0.0] * (FEATURES - 1))
    return trie, fit_logistic(np.array([r.x for r in found]), y)


def _features(batches: Iterator[pa.RecordBatch], spread) -> Iterator[pa.RecordBatch]:
    seen = spread.value.matches()
    for batch in batches:
        x = [features(t, seen) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])


def score_toxicity(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
                   most_rows: int = MOST_ROWS, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted), one row per row of ``df``; nothing but the lexicon, the weights and the training rows moves.

    Null and empty texts have no hits and score as such. Rows without label are scored like all others; a null id is never held out. ``carry`` names columns
    of ``df`` that come through instead of the id, so that a verdict stays on its row.
    """
    model = train(training_rows(df, labels, id_column, text_column, label_column, most_rows))
    spread = df.sparkSession.sparkContext.broadcast(model)
    carried = Carried(df, id_column, text_column, carry)
    with_text = carried.with_text
    scored = carried.rows.mapInArrow(lambda batches: _score(batches, spread, with_text), carried.schema(carried.rows, "score double"))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select(*carried.columns(), held.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def _score(batches: Iterator[pa.RecordBatch], spread, with_text: bool) -> Iterator[pa.RecordBatch]:
    trie, weights = spread.value
    seen = trie.matches()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x = np.array([features(t, seen) for t in part.column("text").to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            own = [c for c in part.schema.names if c != "text" or with_text]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(score)], [*own, "score"])
    del seen
    give_back()


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
