"""Texts as byte arrays inside Arrow batches: spans, hashes, hashed feature counts.

Everything here works on a slice of rows at a time (about ``SLICE_BYTES`` of text, or
one longer text), so memory follows the slice and not the batch or the table.
Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_MASK = (1 << 64) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = np.asarray(values, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random-looking 64-bit values."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + mix(np.array([seed], np.uint64)))


_BYTE = seeds(256, 1)
_STEP = 0x9E3779B97F4A7C15 | 1


def byte_table(test) -> np.ndarray:
    """A 256-entry table of ``test(byte)``."""
    return np.array([bool(test(b)) for b in range(256)])


#: Word bytes of the class [^\x20\x09-\x0D].
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = byte_table(lambda b: chr(b).isalnum() if b < 128 else True)
NOT_NEWLINE = byte_table(lambda b: b != 0x0A)
#: Bytes that begin a code point.
POINT = byte_table(lambda b: b & 0xC0 != 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def row_slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each."""
    if len(offsets) < 2:
        return
    bucket = (offsets[:-1] - offsets[0]) // size
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(offsets) - 1]
    yield from zip(cuts[:-1], cuts[1:])


class Texts:
    """A slice of texts: ``data`` bytes and ``bounds`` that start at 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self.rows = len(offsets) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per row, the sum of a value per byte."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(total[self.bounds])


class Spans:
    """Maximal runs of bytes that ``inside`` (a 256-entry table) accepts; rows part them."""

    def __init__(self, texts: Texts, inside: np.ndarray):
        self.texts = texts
        flags = inside[texts.data]
        cut = np.zeros(len(flags) + 1, bool)
        cut[texts.bounds] = True
        before = np.concatenate(([False], flags[:-1])) if len(flags) else flags
        after = np.concatenate((flags[1:], [False])) if len(flags) else flags
        self.flags = flags
        self.starts = np.flatnonzero(flags & (~before | cut[:-1]))
        self.ends = np.flatnonzero(flags & (~after | cut[1:])) + 1
        # Spans of row r are first[r]:first[r + 1].
        self.first = np.searchsorted(self.starts, texts.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of every span."""
        return np.repeat(np.arange(self.texts.rows), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash of each span's bytes, A-Z lower-cased if asked."""
        if not len(self):
            return np.zeros(0, np.uint64)
        table = _BYTE[LOWER] if lower else _BYTE
        lengths = self.ends - self.starts
        heads = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        powers = np.full(int(lengths.max()), _STEP & _MASK, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        values = table[self.texts.data[self.flags]] * powers[place]
        return mix(np.add.reduceat(values, heads))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of spans that start a window of ``width`` spans of one row, and its hash."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.first[1:], self.counts()) - np.arange(n)
        at = np.flatnonzero(left >= width)
        odd = seeds(width, 2) | np.uint64(1)
        value = np.zeros(len(at), np.uint64)
        for k in range(width):
            value += hashes[at + k] * odd[k]
        return at, mix(value)


def hashed_counts(rows: np.ndarray, hashes: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """How often each row has each of ``size`` hash buckets, as float32."""
    bucket = (hashes & np.uint64(size - 1)).astype(np.int64)
    return (
        np.bincount(rows * size + bucket, minlength=n_rows * size)
        .reshape(n_rows, size)
        .astype(np.float32)
    )


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Rows of dampened counts scaled to length 1; empty rows stay 0."""
    x = np.log1p(counts)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))
