"""Near copies by SimHash fingerprints, compared bit-sliced.

A fingerprint has a bit for every bit of XXH64 that is set in over half of a text's 3-word
shingles, repeats included. Texts whose fingerprints differ in at most two bits link.

*Search.* Equal fingerprints are one node, so copies cost nothing further. The 64 bits are
four blocks; two fingerprints within two bits agree on two whole blocks at least, so
every node goes into six buckets, one for each two blocks. A bucket that is too large is
split the same way by the quarters of its other two blocks, six finer buckets that
fix 48 bits: a finer bucket can have at most 2**16 different fingerprints, which bounds
every task whatever the data. Buckets are found to be large in two ways, neither of which
drops a pair: those of blocks with more nodes than a task should sort (counts of 16-bit block
values, at most 2**18 of them) are split before the shuffle, others while they stream by.

*Comparison.* The fingerprints of a batch of buckets are stored as 64 bit planes, one bit
of 64 fingerprints to a word. A fingerprint is compared with 64 others at a time: a plane XOR
its bit gives their differences there, added to carry-save counters (one word for each
binary digit of 64 counts). Every few planes the words all of whose counts exceed the
radius are abandoned; what survives all planes are the links.

The links of a bucket leave it as a spanning forest of small fan-out, and components are
label propagation over all buckets' forests.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a
text of one or two words has one shingle, the whole sequence. A null doc_id keeps its row
and its links but names no component (a component of null ids alone has a null name); rows
that share a doc_id keep a row each. Empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm import textbytes as tb
from tillroll.llm.components import components
from tillroll.operators.scratch import materialize
from tillroll.operators.skew import ROWS_PER_TASK

WORDS = 3
SEED = 42
RADIUS = 2
#: A bucket of more nodes than this is split; steers work only.
BUCKET = 4_096
#: Rows that are compared together, and word comparisons held at a time.
ROWS = 1 << 15
LIVE = 1 << 17
FAN_OUT = 16

_BLOCK = 16
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ZERO = np.uint64(0)
#: A byte's bits, each in a byte of its own.
_LANES = np.array([sum((v >> k & 1) << 8 * k for k in range(8)) for v in range(256)], np.uint64)


def _mask(part: int, bits: int) -> int:
    return ((1 << bits) - 1) << part * bits


def _bucket_masks() -> tuple[list[int], list[list[int]]]:
    """The bits that are equal in each of the six buckets, and in the six finer ones of each."""
    coarse, fine = [], []
    for equal in combinations(range(4), 4 - RADIUS):
        fixed = sum(_mask(b, _BLOCK) for b in equal)
        rest = [2 * b + half for b in range(4) if b not in equal for half in (0, 1)]
        coarse.append(fixed)
        fine.append([fixed + sum(_mask(q, _BLOCK // 2) for q in some) for some in combinations(rest, 4 - RADIUS)])
    return coarse, fine


COARSE, FINE = _bucket_masks()


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of every shingle of a text in UTF-8."""
    words = text.lower().split()  # ASCII only, both
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of rows with ``counts`` of the hashes each."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    held = counts[some]
    # Sums of up to 255 hashes fit in the lanes of a word.
    pieces = -(-held // 255)
    first = np.cumsum(held) - held
    lead = np.cumsum(pieces) - pieces
    step = np.arange(int(pieces.sum())) - np.repeat(lead, pieces)
    starts = np.repeat(first, pieces) + 255 * step
    data = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(some), 64), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[data[:, k]], starts)
        per_bit = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(per_bit, lead, axis=0) > held[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches):
        for batch in batches:
            data, offsets = tb.buffers(tb.column(batch, "text"))
            for first, end in tb.row_slices(offsets):
                hashes = [shingle_hashes(data[a:b].tobytes()) for a, b in zip(offsets[first:end], offsets[first + 1 :])]
                counts = np.array([len(h) for h in hashes], np.int64)
                flat = np.fromiter((x for of in hashes for x in of), np.uint64, int(counts.sum()))
                ids = tb.column(batch, "doc_id").slice(first, end - first)
                found = pa.array(majority(flat, counts).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, found], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, fingerprint long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i % 64 of word i // 64 of row b is bit b of value i."""
    width = -(-len(values) // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[: len(values)] = values
    planes = np.empty((64, width), np.uint64)
    for b in range(64):
        bits = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[b] = np.packbits(bits, bitorder="little").view("<u8")
    return planes


#: Planes of different blocks in turn, since two blocks of a bucket are equal.
_PLANES = [_BLOCK * block + bit for bit in range(_BLOCK) for block in range(4)]


def _from_bit(n: np.ndarray) -> np.ndarray:
    """Words with the bits n to 63 set; none for 64 and more."""
    return np.where(n < 64, _FULL << np.minimum(n, 63).astype(np.uint64), _ZERO)


def near_pairs(values: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of the values that differ in at most ``radius`` bits, j before
    ``ends[i]``, the end of i's run."""
    planes = bit_planes(values)
    at = np.arange(len(values))
    words = np.where(ends > at + 1, (ends - 1) // 64 - (at + 1) // 64 + 1, 0)
    before = np.concatenate(([0], np.cumsum(words)))
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(before, before[first] + LIVE, "right")) - 1)
        some = words[first:last]
        query = np.repeat(at[first:last], some)
        word = np.arange(len(query)) - np.repeat(np.cumsum(some) - some, some) + (query + 1) // 64
        # Lanes outside (i, end of i's run) are out from the start.
        low, high = query + 1 - 64 * word, ends[query] - 64 * word
        out = ~_from_bit(np.maximum(low, 0)) | _from_bit(np.minimum(high, 64))
        yield from _survivors(planes, values, query, word, out, radius)
        first = last


def _survivors(planes, values, query, word, out, radius):
    digits = [np.zeros(len(query), np.uint64) for _ in range(max(radius.bit_length(), 1))]
    for k, b in enumerate(_PLANES):
        bit = _ZERO - ((values[query] >> np.uint64(b)) & np.uint64(1))  # 0 or all ones
        carry = planes[b][word] ^ bit
        for d, digit in enumerate(digits):
            digits[d], carry = digit ^ carry, digit & carry
        out |= carry  # past the highest digit
        if k % 4 == 3:
            out |= _exceeds(digits, radius)
            live = np.flatnonzero(out != _FULL)
            if len(live) < 0.75 * len(out):
                query, word, out = query[live], word[live], out[live]
                digits = [digit[live] for digit in digits]
    live = np.flatnonzero(out != _FULL)
    if len(live):
        lanes = np.unpackbits((~out[live]).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        of, lane = np.nonzero(lanes)
        yield query[live][of], 64 * word[live][of] + lane


def _exceeds(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose counter is above the radius."""
    above, equal = np.zeros_like(digits[0]), np.full_like(digits[0], _FULL)
    for d in reversed(range(len(digits))):
        if radius >> d & 1:
            equal &= digits[d]
        else:
            above |= equal & digits[d]
            equal &= ~digits[d]
    return above


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of a spanning forest of the pairs, ``FAN_OUT`` children a node."""
    label = np.arange(n)
    for a, b in pairs:
        a, b = label[a], label[b]
        while len(apart := np.flatnonzero(a != b)):
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(further := label[label], label):
                label = further
            a, b = label[a], label[b]
    order = np.argsort(label, kind="stable")
    size = np.bincount(label, minlength=n)
    head = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(n) - head
    child = np.flatnonzero(place)
    return order[child], order[head[child] + (place[child] - 1) // FAN_OUT]


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _compared(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Edges within the buckets of a sorted stream of (bucket, key, fp).

    A bucket of more than ``most`` rows is handed on: its rows come out with a null
    ``near``. Not more than ``most`` rows of a bucket are ever held.
    """
    names = ["bucket", "fp", "near"]
    kinds = [pa.int32(), pa.int64(), pa.int64()]

    def out(bucket, fp, near):
        columns = [pa.array(c, k) for c, k in zip((bucket, fp, near), kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    def handed(bucket, fp):
        return out(bucket, fp, pa.nulls(len(fp), pa.int64()))

    def done(bucket, key, fp):
        """Whole runs."""
        starts = _runs([bucket, key])
        ends = np.append(starts[1:], len(fp))
        size = ends - starts
        if most is not None:
            large = np.repeat(size > most, size)
            if large.any():
                yield handed(bucket[large], fp[large])
        compared = np.repeat((size > 1) & (size <= (most or len(fp))), size)
        fp, runs = fp[compared], size[(size > 1) & (size <= (most or len(fp)))]
        if len(fp):
            child, parent = forest(len(fp), near_pairs(fp.view(np.uint64), np.repeat(np.cumsum(runs), runs)))
            yield out(bucket[compared][child], fp[child], fp[parent])

    held: list[tuple[np.ndarray, ...]] = []
    large = None  # the bucket that is being handed on
    for batch in batches:
        bucket, key, fp = (tb.column(batch, c).to_numpy() for c in ("bucket", "key", "fp"))
        if large is not None:
            same = int(np.argmin(np.append((bucket == large[0]) & (key == large[1]), False)))
            if same:
                yield handed(bucket[:same], fp[:same])
                bucket, key, fp = bucket[same:], key[same:], fp[same:]
            if not len(fp):
                continue
            large = None
        held.append((bucket, key, fp))
        if sum(len(h[2]) for h in held) < ROWS:
            continue
        bucket, key, fp = (np.concatenate(c) for c in zip(*held))
        last = int(_runs([bucket, key])[-1])
        yield from done(bucket[:last], key[:last], fp[:last])
        bucket, key, fp = bucket[last:], key[last:], fp[last:]
        held = [(bucket, key, fp)]
        if most is not None and len(fp) > most:
            yield handed(bucket, fp)
            held, large = [], (bucket[0], key[0])
    if held:
        yield from done(*(np.concatenate(c) for c in zip(*held)))


def _links_in(keyed: DataFrame, most: int | None) -> DataFrame:
    """(bucket, fp, near) of rows (bucket, key, fp); null ``near``: the bucket was too large."""
    dealt = keyed.repartition("bucket", "key").sortWithinPartitions("bucket", "key")
    return dealt.mapInArrow(lambda batches: _compared(batches, most), "bucket int, fp long, near long")


def _fine_key(bucket: Column) -> Column:
    """The rows of a finer bucket: coarse bucket c has the finer ones 6c to 6c + 5."""
    made = [
        F.struct(F.lit(len(fine) * c + d).cast("int").alias("bucket"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for c, fine in enumerate(FINE)
        for d, m in enumerate(fine)
    ]
    width = len(FINE[0])
    return F.slice(F.array(*made), bucket * width + 1, width)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_counts(nodes: DataFrame) -> DataFrame:
    """(block, value, n): nodes by the value of each 16-bit block, at most 2**18 rows."""
    values = [
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", _BLOCK * b).bitwiseAND(F.lit(_mask(0, _BLOCK))).alias("value"))
        for b in range(4)
    ]
    return nodes.select(F.inline(F.array(*values))).groupBy("block", "value").agg(F.count("*").alias("n"))


def links(nodes: DataFrame, bucket: int = BUCKET, task_rows: int = ROWS_PER_TASK) -> DataFrame:
    """(a, b): a spanning forest of all links between the distinct ``fp`` of ``nodes``."""
    hot = np.zeros((4, 1 << _BLOCK), bool)
    if nodes.count() > task_rows:
        frequent = block_counts(nodes).where(F.col("n") > task_rows).toArrow()
        hot[frequent.column("block").to_numpy(), frequent.column("value").to_numpy()] = True

    def keyed(batches):
        for batch in batches:
            fp = tb.column(batch, "fp").to_numpy()
            value = [(fp.view(np.uint64) >> np.uint64(_BLOCK * b)) & np.uint64(_mask(0, _BLOCK)) for b in range(4)]
            large = [hot[b][v.astype(np.int64)] for b, v in enumerate(value)]
            for c, (x, y) in enumerate(combinations(range(4), 4 - RADIUS)):
                key = (fp.view(np.uint64) & np.uint64(COARSE[c])).view(np.int64)
                split = large[x] & large[y]  # the same for all rows of a bucket
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), c, np.int32)), pa.array(key), pa.array(fp), pa.array(split)],
                    ["bucket", "key", "fp", "split"],
                )

    rows = nodes.select("fp").mapInArrow(keyed, "bucket int, key long, fp long, split boolean")
    coarse = materialize(_links_in(rows.where("not split").drop("split"), bucket), "bucket-links")
    handed = coarse.where("near is null").select("bucket", "fp")
    if hot.any():
        handed = handed.unionByName(rows.where("split").select("bucket", "fp"))
    fine = handed.select("fp", F.inline(_fine_key(F.col("bucket"))))
    fine = materialize(_links_in(fine, None), "fine-links")
    return coarse.where("near is not null").unionByName(fine).select(F.col("fp").alias("a"), F.col("near").alias("b"))


def simhash_components(docs: DataFrame, bucket: int = BUCKET, task_rows: int = ROWS_PER_TASK) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id
    that links reach."""
    rows = materialize(fingerprints(docs), "fingerprints").withColumnRenamed("fingerprint", "fp")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    labels = components(links(nodes, bucket, task_rows)).withColumnRenamed("id", "fp")
    linked = materialize(nodes.select("fp", "least").join(labels, "fp"), "linked")
    names = linked.groupBy("label").agg(F.min("least").alias("name"))
    named = linked.select("fp", "label").join(names, "label").select("fp", "name")
    named = materialize(
        nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("name", "least").alias("component_id")), "named"
    )
    # Nodes of more rows than a task should take are at most rows / task_rows: broadcast.
    hot = named.where(F.col("n") > task_rows).select("fp", "component_id")
    rest = rows
    parts = []
    if rows.count() > task_rows:
        parts.append(rows.join(F.broadcast(hot), "fp"))
        rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti")
    parts.append(rest.join(named.select("fp", "component_id"), "fp"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
