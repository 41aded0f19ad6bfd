"""Benchmark decontamination by edit distance.

Texts and benchmark items are word sequences (A-Z lower-cased). An item leaks into a text
if some stretch of the text is within edit distance ``words - PERCENT % of words`` (rounded down) of it.

Candidates are windows of an item's size. By the pigeonhole rule one of ``limit + 1``
pieces of the item stands unchanged in every leak, so only windows around such a piece
are looked at. A window and its item are embedded by CGK random walks: a walk copies the
word it stands on and steps on or stays by a random bit of that word, so sequences of
small edit distance come out with small Hamming distance. Bit-sampling LSH compares
``BITS`` random places of the two walks, ``TABLES`` times on each of ``WALKS`` walks; a
pair that agrees in one table is verified by the exact edit distance of the item to the
best stretch around the window. (tests/llm/test_leaks.py measures the recall of the
search against brute force; the target is 0.99.)

Defined cases: null and empty texts have no leak; items of fewer than ``MIN_WORDS``
words, or of null text, are not searched for; an item that leaks several times into a
text is reported once, at its closest and then first place; extra columns are ignored;
repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm import textbytes as tb

PERCENT = 80
MIN_WORDS = 5
WALKS, TABLES, BITS = 4, 24, 2
#: Items are taken in blocks of about so many characters, each broadcast and compared
#: with all documents.
BLOCK_CHARS = 20_000_000
#: Windows that are embedded together.
SEEDS_AT_ONCE = 2_000

SCHEMA = (
    "doc_id long, item_id long, start_word long, end_word long, edits long, similarity double"
)


def word_hashes(texts: tb.Texts) -> tuple[tb.Spans, np.ndarray]:
    words = tb.Spans(texts, tb.ALNUM)
    return words, words.hashes(lower=True)


def limit_of(n: int) -> int:
    return n - -(-PERCENT * n // 100)


def embed(tokens: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """CGK walks over rows of ``tokens``, the first ``sizes`` of each: 3 places per token.

    Places after the end of a row's sequence hold 0; those beyond 3 * its size mean nothing.
    """
    rows, width = tokens.shape
    coins = tb.seeds(3 * width, 1000 + walk)
    at = np.zeros(rows, np.int64)
    out = np.zeros((rows, 3 * width), np.uint64)
    padded = np.hstack((tokens, np.zeros((rows, 1), np.uint64)))
    padded[np.arange(width + 1) >= sizes[:, None]] = 0
    flat, base = padded.ravel(), np.arange(rows) * (width + 1)
    one, shift = np.uint64(1), np.uint64(32)
    for j in range(3 * width):
        word = flat[base + at]
        out[:, j] = word
        # The coin of a word at this step: a bit of the scrambled product.
        step = ((word ^ coins[j]) * (coins[j] | one) >> shift) & one
        at = np.minimum(at + step.astype(np.int64), sizes)
    return out


def collides(windows: np.ndarray, items: np.ndarray, which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each window agrees with its item (a row of ``items``) in one of the LSH tables."""
    found = np.zeros(len(windows), bool)
    item_sizes = np.zeros(len(items), np.int64)
    item_sizes[which] = sizes
    for walk in range(WALKS):
        left = np.flatnonzero(~found)
        if not len(left):
            break
        own = embed(items, item_sizes, walk)[which[left]]
        same = embed(windows[left], sizes[left], walk) == own
        picks = tb.seeds(TABLES * BITS, 2000 + walk)
        places = (picks[None, :] % (3 * sizes[left]).astype(np.uint64)[:, None]).astype(np.int64)
        agree = np.take_along_axis(same, places, 1)
        found[left] = agree.reshape(len(left), TABLES, BITS).all(2).any(1)
    return found


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``text``, and the first end of one."""
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item):
        step = np.empty_like(row)
        step[0] = k + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(step - places) + places
    end = int(row.argmin())
    return int(row[end]), end


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` that is closest to ``item``."""
    edits, end = infix_distance(item, text)
    _, back = infix_distance(item[::-1], text[:end][::-1])
    return edits, end - back, end


@dataclass
class Items:
    """A block of items and the table of their pieces."""

    ids: list[int]
    words: list[np.ndarray]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width -> hashes, item, offset


def make_items(rows: list[tuple[int, str]]) -> Items:
    ids, words = [], []
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    for item_id, text in rows:
        spans, hashes = word_hashes(tb.Texts(*tb.buffers(pa.array([text]))))
        n = len(hashes)
        if n < MIN_WORDS:
            continue
        cuts = np.linspace(0, n, limit_of(n) + 2).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            at, value = spans.windows(hashes, int(b - a))
            pieces.setdefault(int(b - a), []).append((int(value[a]), len(ids), int(a)))
        ids.append(item_id)
        words.append(hashes)
    tables = {}
    for width, found in pieces.items():
        found.sort()
        tables[width] = (
            np.array([f[0] for f in found], np.uint64),
            np.array([f[1] for f in found], np.int64),
            np.array([f[2] for f in found], np.int64),
        )
    return Items(ids, words, tables)


def seeds_in(words: tb.Spans, hashes: np.ndarray, items: Items) -> np.ndarray:
    """Rows (text, item, start of the item's window) where a piece stands in a text."""
    row_of = words.rows()
    found = [np.zeros((0, 3), np.int64)]
    for width, (table, item, offset) in items.pieces.items():
        at, value = words.windows(hashes, width)
        lo = np.searchsorted(table, value, "left")
        hit = lo < len(table)
        hit[hit] = table[lo[hit]] == value[hit]
        at, value, lo = at[hit], value[hit], lo[hit]
        n = np.searchsorted(table, value, "right") - lo
        every = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(at, n)
        found.append(np.stack((row_of[place], item[every], place - offset[every]), 1))
    return np.unique(np.concatenate(found), axis=0)


def find_leaks(words: tb.Spans, hashes: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the leaks into a slice of texts."""
    seeds = seeds_in(words, hashes, items)
    if not len(seeds):
        return []
    first = words.first
    involved, which = np.unique(seeds[:, 1], return_inverse=True)
    sizes = np.array([len(items.words[k]) for k in involved])
    width = int(sizes.max())
    matrix = np.zeros((len(involved), width), np.uint64)
    for k, item in enumerate(involved):
        matrix[k, : sizes[k]] = items.words[item]
    survivors = []
    for at in range(0, len(seeds), SEEDS_AT_ONCE):
        group, own = seeds[at : at + SEEDS_AT_ONCE], which[at : at + SEEDS_AT_ONCE]
        place = group[:, 2][:, None] + np.arange(width)
        lo, hi = first[group[:, 0]][:, None], first[group[:, 0] + 1][:, None]
        # A window that leaves its text is shorter; its words move to the front.
        inside = (place >= lo) & (place < hi) & (np.arange(width) < sizes[own][:, None])
        tokens = np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(0))
        outside = np.flatnonzero(group[:, 2] < lo[:, 0])
        if len(outside):
            order = np.argsort(~inside[outside], axis=1, kind="stable")
            tokens[outside] = np.take_along_axis(tokens[outside], order, 1)
        survivors.append(group[collides(tokens, matrix, own, sizes[own])])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for text, item, start in np.concatenate(survivors).tolist():
        limit = limit_of(len(items.words[item]))
        # A window a few words on is searched with the one before.
        if (text, item) in done and start <= done[text, item]:
            continue
        done[text, item] = start + limit
        lo = max(int(first[text]), start - limit)
        hi = min(int(first[text + 1]), start + 2 * limit + len(items.words[item]))
        edits, a, b = best_stretch(items.words[item], hashes[lo:hi])
        if edits <= limit:
            at = lo - int(first[text])
            found = (edits, at + a, at + b)
            best[text, item] = min(found, best.get((text, item), found))
    return [(t, i, a, b, e) for (t, i), (e, a, b) in sorted(best.items())]


def _blocks(benchmark: DataFrame):
    """Items in blocks of bounded size, split by a hash of the item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield make_items(sorted(tuple(r) for r in part.collect()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that leaks into it; word places are from 0, end exclusive."""
    found = None
    for items in _blocks(benchmark):
        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search(items), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def _search(items: Items):
    def rows(batches):
        for batch in batches:
            data, offsets = tb.buffers(tb.column(batch, "text"))
            ids = tb.column(batch, "doc_id")
            for lo, hi in tb.row_slices(offsets, 1 << 20):
                words, hashes = word_hashes(tb.Texts(data, offsets[lo : hi + 1]))
                found = find_leaks(words, hashes, items)
                if not found:
                    continue
                text, item, start, end, edits = (list(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(text)),
                        pa.array([items.ids[k] for k in item], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()),
                        pa.array(edits, pa.int64()),
                        pa.array([1 - e / len(items.words[k]) for e, k in zip(edits, item)], pa.float64()),
                    ],
                    ["doc_id", "item_id", "start_word", "end_word", "edits", "similarity"],
                )

    return rows


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks, with their columns."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = dict(docs.dtypes)
    kept = docs.select(*names)
    for items in _blocks(benchmark):
        kept = kept.mapInArrow(_clean_rows(items), ", ".join(f"{n} {kinds[n]}" for n in names))
    return kept


def _clean_rows(items: Items):
    def rows(batches):
        for batch in batches:
            data, offsets = tb.buffers(tb.column(batch, "text"))
            clean = np.ones(batch.num_rows, bool)
            for lo, hi in tb.row_slices(offsets, 1 << 20):
                words, hashes = word_hashes(tb.Texts(data, offsets[lo : hi + 1]))
                for found in find_leaks(words, hashes, items):
                    clean[lo + found[0]] = False
            yield batch.filter(pa.array(clean))

    return rows
