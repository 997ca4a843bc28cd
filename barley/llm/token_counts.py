"""Token counts of whole texts: strings that are known to be one token are counted, only the rest is merged.

**Proof, once, before the job.** Each string of the vocabulary is given to the tokenizer alone. Those that come back as one token
form the table of whole tokens; it has at most the vocabulary's size. A vocabulary entry that does not survive its own merges
(or is not valid text) is not in the table.

**Count.** A text is cut at each single space or line feed between two characters that are not white space. The tokenizer's own
first cut always cuts there, before the space or line feed, so that the pieces can be counted apart. A piece in the table counts
one, a piece seen before counts what it did then. A new piece is cut by the tokenizer's pattern into words, numbers and signs;
those in the table count one, and only the distinct rest is merged. A special token's string holds no white space and so stays in
one piece; such pieces, and those beyond the Latin letters, go to the tokenizer whole, which treats them as it does by default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: characters of the pieces whose counts a task keeps; beyond this it forgets them all and goes on
KEPT_CHARACTERS = 8_000_000
#: fixed values: the published first cut of byte-level tokenizers
FIRST_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pieces with later characters are left to the tokenizer whole
LAST_LATIN = "\u024f"


def unlimited(definition: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts_before_spaces(definition: str) -> bool:
    """Whether pieces may be counted apart: byte-level cutting with its own pattern, and nothing that rewrites the text."""
    own = json.loads(definition)
    first = own.get("pre_tokenizer") or {}
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in own.get("added_tokens", []))
    return (first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
            and own.get("normalizer") is None and plain)


def whole_tokens(definition: str) -> frozenset[str]:
    """The vocabulary's strings that the tokenizer, given them alone, returns as one token."""
    tokenizer = unlimited(definition)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings = [s for s in tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False)
               if s and "�" not in s and s not in special]
    return frozenset(s for s, e in zip(strings, tokenizer.encode_batch_fast(strings, add_special_tokens=False)) if len(e.ids) == 1)


def count_tokens(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of ``df``, in any number of partitions; nothing is shuffled.

    A null text counts as empty: no bytes, no tokens. Ids may be null or repeated; each row is counted by itself, and further
    columns are not read. A tokenizer whose first cut is not known to cut before single spaces is used on whole texts.
    ``path`` is read on the driver only.
    """
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    apart = cuts_before_spaces(definition)
    known = df.sparkSession.sparkContext.broadcast(Known(definition, whole_tokens(definition) if apart else frozenset()))
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    ids = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(lambda batches: _count(batches, known, apart), f"id {ids}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _count(batches: Iterator[pa.RecordBatch], known, apart: bool) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
    counter = known.value.counter()
    cut = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))").split if apart else lambda text: [text]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = pc.fill_null(part.column("text"), "")
            counts = counter.count([cut(t) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])


class Known:
    """The proven table, and in each Python worker one counter that its tasks share."""

    def __init__(self, definition: str, whole: frozenset[str]):
        self.definition, self.whole, self.shared = definition, whole, None

    def __reduce__(self):
        return Known, (self.definition, self.whole)

    def counter(self) -> _Counter:
        if self.shared is None:
            self.shared = _Counter(unlimited(self.definition), self.whole)
        return self.shared


class _Counter:
    """Counts of pieces at the start of a text and after a cut, kept until they hold too many characters."""

    def __init__(self, tokenizer: Tokenizer, whole: frozenset[str]):
        self.tokenizer, self.whole = tokenizer, whole
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)").search
        self.words = regex.compile(FIRST_CUT).findall
        self.forget()

    def forget(self) -> None:
        self.first, self.later, self.merged, self.held = {}, {}, {}, 0

    def count(self, texts: list[list[str]]) -> list[int]:
        if self.held > KEPT_CHARACTERS:
            self.forget()
        self.learn(self.first, {p[0] for p in texts}, lambda p: p)
        self.learn(self.later, {x for p in texts for x in p[1:]}, lambda p: p if p[0] == "\n" else " " + p)
        return [self.first[p[0]] + sum(map(self.later.__getitem__, p[1:])) for p in texts]

    def learn(self, kept: dict[str, int], pieces: set[str], whole_piece) -> None:
        new = [p for p in pieces if p not in kept]
        self.held += sum(map(len, new))
        cuts = {}
        for p in new:
            piece = whole_piece(p)
            if piece in self.whole:
                kept[p] = 1
            elif piece and (max(piece) > LAST_LATIN or self.special(piece)):
                cuts[p] = [piece]
            else:
                cuts[p] = self.words(piece)
        rest = list({w for words in cuts.values() for w in words if w not in self.whole and w not in self.merged})
        self.held += sum(map(len, rest))
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            self.merged.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        for p, words in cuts.items():
            kept[p] = sum(1 if w in self.whole else self.merged[w] for w in words)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from public_tokenizers import path
    return count_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path("byte_bpe_50k.json"))
