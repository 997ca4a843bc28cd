"""Words, lines and hashes of whole texts, one Arrow batch at a time, without a loop over the words.

A batch is cut into chunks of a few megabytes, so that the helper arrays of a task stay small whatever the texts hold.
Texts of a chunk stand one after the other in one byte array; a word or line never crosses the edge of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

#: the bytes 0x20 and 0x09 to 0x0D part the words of most contracts
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)


class _Tables(dict):
    """Tables of powers of this process; they do not travel with a job."""

    def __reduce__(self):
        return _Tables, ()


_POWERS = _Tables()


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) <= n:
        table = np.full(max(n + 1, 1 << 16, 0 if have is None else 2 * len(have)), base, np.uint64)
        table[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(table)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i modulo 2**64, so that any run of values can be hashed by a difference."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run [start, end); equal runs hash alike wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + np.uint64(1) * (end - start).astype(np.uint64))


@dataclass
class Chunk:
    """Some texts, and where their words are. ``doc`` numbers the texts of the chunk from 0."""
    rows: pa.RecordBatch
    data: np.ndarray      # bytes of all texts
    edges: np.ndarray     # text i is data[edges[i]:edges[i + 1]]
    start: np.ndarray     # of each word, in bytes
    end: np.ndarray
    doc: np.ndarray       # text of each word
    first: np.ndarray     # words of text i are first[i] .. first[i + 1]

    def __len__(self) -> int:
        return len(self.edges) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def words_hash(self) -> np.ndarray:
        return run_hash(prefix_sums(_BYTES[self.data]), self.start, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.edges[1:]] - total[self.edges[:-1]]


def runs(data: np.ndarray, edges: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of bytes that ``parts`` does not flag, text by text."""
    inside = ~parts[data]
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges[:-1][edges[:-1] < len(inside)]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and edges of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[edges[0]:edges[-1]], edges - edges[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", parts: np.ndarray = SPACE,
           fold: np.ndarray | None = None, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into chunks of about ``limit`` bytes (one text at least). ``fold`` replaces bytes before all else."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, edges = text_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(edges, edges[row] + limit, "right")) - 1)
            stop = min(stop, batch.num_rows)
            own = data[edges[row]:edges[stop]]
            own = own if fold is None else fold[own]
            cut = edges[row:stop + 1] - edges[row]
            start, end = runs(own, cut, parts)
            first = np.searchsorted(start, cut)
            doc = np.repeat(np.arange(stop - row), np.diff(first))
            yield Chunk(batch.slice(row, stop - row), own, cut, start, end, doc, first)
            row = stop


def lower_ascii() -> np.ndarray:
    """Bytes with A to Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return x.view(np.int64)
