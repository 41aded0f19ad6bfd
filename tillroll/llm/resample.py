"""Importance resampling of documents towards a target distribution.

Texts are bags of hashed word n-grams (1 to 3 words). A bucket's gain is the log ratio of
its smoothed share in the target texts to its share in all documents; a document's weight is
the sum of the gains of its n-grams, and Gumbel noise fixed by its doc_id turns the highest
scores into a weighted draw without replacement.

The n-grams never become strings. Per slice of texts Arrow lower-cases A-Z, splits at
non-words and encodes the words as a dictionary; two shifted columns of dictionary indices
make a pair, which is encoded in its turn, and a pair with the next word's index makes a
triple. Only the distinct ones get a CRC-32, put together from those of their parts
(``crc_join``), and a bucket; counts and gains come back to the words by taking from the
distinct ones, and are reduced by document.

The documents are read twice: once for the buckets' counts, added up per task before they
are shuffled, once for the weights. The table of gains has one number per bucket and is
all that reaches the driver and every task. Ranks come from range partitioning
(``positions``) over rows of five numbers.

Defined cases: a text that is null, empty or without a word has no features, weight 0 and is
never drawn; a null doc_id gets the noise of an empty id and comes last among ties, rows
that share a doc_id are documents of their own. An empty target is one without features,
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm import textbytes as tb
from tillroll.operators.positions import positions
from tillroll.operators.scratch import materialize

BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42
#: Bytes of text that share one dictionary, or one longer text.
SLICE = 1 << 20

#: What parts words once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = np.uint32(zlib.crc32(b" "))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as four tables by byte."""
    out = tables[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _zero_byte() -> np.ndarray:
    """The map that appends a zero byte to what a CRC has seen."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    tables = np.zeros((4, 256), np.uint32)
    for k in range(32):
        table = tables[k // 8]
        table[(np.arange(256) >> (k % 8)) & 1 == 1] ^= bits[k]
    return tables


def _doublings(n: int) -> list[np.ndarray]:
    found = [_zero_byte()]
    for _ in range(n - 1):
        last = found[-1]
        found.append(np.stack([_apply(last, last[k]) for k in range(4)]))
    return found


#: Appending 2**k zero bytes, for parts of up to 2**31 bytes.
_ZEROS = _doublings(31)


def crc_join(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of their parts; lengths are of the right ones."""
    out = np.array(left, np.uint32)
    for k in range(int(right_bytes.max(initial=0)).bit_length()):
        chosen = np.flatnonzero((right_bytes >> k) & 1)
        out[chosen] = _apply(_ZEROS[k], out[chosen])
    return out ^ right


def _encoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into the distinct codes, and these."""
    found = pc.dictionary_encode(pa.array(codes))
    return found.indices.to_numpy(), found.dictionary.to_numpy()


class Features:
    """The hashed n-grams of a slice of texts.

    ``grams`` has, for 1, 2 and 3 words, the position of each n-gram's first word, its index
    among the distinct n-grams, and the buckets of these. ``words`` counts words by row.
    """

    def __init__(self, texts: pa.Array, buckets: int):
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), _BETWEEN)
        flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
        held = pc.not_equal(flat, "")
        found = pc.dictionary_encode(pc.filter(flat, held))
        rows = pc.filter(rows, held).to_numpy()
        word, names = found.indices.to_numpy().astype(np.int64), found.dictionary
        self.words = np.bincount(rows, minlength=len(texts))
        self.first = np.cumsum(self.words) - self.words
        many = len(names)
        crc = np.array([zlib.crc32(w) for w in names.cast(pa.large_binary()).to_pylist()], np.uint32)
        size = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        after = crc_join(np.full(many, _SPACE), crc, size)  # a space and the word
        size += 1
        self.grams = [(np.arange(len(word)), word, crc % buckets)]
        index = word
        for shift in (1, 2):
            at = np.flatnonzero(rows[:-shift] == rows[shift:]) if len(rows) > shift else np.zeros(0, np.int64)
            chosen, codes = _encoded(index[at] * many + word[at + shift])
            head, tail = codes // max(many, 1), codes % max(many, 1)
            crc = crc_join(crc[head], after[tail], size[tail])
            self.grams.append((at, chosen, crc % buckets))
            index = np.zeros(len(word), np.int64)
            index[at] = chosen

    def counts(self, buckets: int) -> np.ndarray:
        """Features per bucket."""
        total = np.zeros(buckets, np.int64)
        for _, chosen, bucket in self.grams:
            np.add.at(total, bucket, np.bincount(chosen, minlength=len(bucket)))
        return total

    def features(self) -> np.ndarray:
        """Features per row."""
        return sum(np.maximum(self.words - k, 0) for k in range(3))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Per row the sum of its features' gains."""
        at_word = np.zeros(len(self.grams[0][0]), np.int64)
        for at, chosen, bucket in self.grams:
            at_word[at] += gains[bucket][chosen]
        total = np.concatenate(([0], np.cumsum(at_word)))
        return total[self.first + self.words] - total[self.first]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        texts = pc.fill_null(tb.column(batch, "text").cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for first, end in tb.row_slices(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), SLICE):
            yield batch.slice(first, end - first), texts.slice(first, end - first)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of the column ``text`` fall into each bucket."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for _, part in _slices(batches):
            total += Features(part, buckets).counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(counted, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket."""
    spark = docs.sparkSession
    sides = bucket_counts(docs, buckets).withColumn("wanted", F.lit(False))
    sides = sides.unionByName(bucket_counts(target, buckets).withColumn("wanted", F.lit(True)))
    sides = sides.unionByName(spark.range(buckets).selectExpr("id as bucket", "0L as n", "false as wanted"))
    n = lambda wanted: F.coalesce(F.sum(F.when(F.col("wanted") == wanted, F.col("n"))), F.lit(0)).cast("double")
    # One row per bucket, so that a single task may hold them all.
    counts = materialize(sides.groupBy("bucket").agg(n(False).alias("s"), n(True).alias("t")), "buckets")
    total = counts.agg(F.sum("s"), F.sum("t")).first()
    held, wanted = F.lit(total[0] + buckets), F.lit(total[1] + buckets)
    ratio = ((F.col("t") + 1) * held) / ((F.col("s") + 1) * wanted)
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for a doc_id on every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) with ``table`` as the gain of every bucket."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weighed(batches):
        for rows, part in _slices(batches):
            found = Features(part, len(table))
            columns = [tb.column(rows, "doc_id"), found.words, found.features(), found.sums(table)]
            columns = [c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    schema = f"doc_id {kind}, n_words long, n_features long, weight long"
    return docs.select("doc_id", "text").mapInArrow(weighed, schema)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = DRAWN_PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank among the drawn (else null).

    Of the documents with ``min_words`` words or more, ``percent`` per cent are drawn.
    """
    found = gains(docs.select("text"), target.select("text"), buckets).orderBy("bucket").toArrow()
    table = found.column("gain").to_numpy().astype(np.int64)
    scored = weights(docs, table).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("enough", F.col("n_words") >= min_words), "scores")
    drawn = percent * scored.where("enough").count() // 100
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    placed = positions(scored, [], order, "scores-ordered")
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents drawn, with all their columns; a doc_id that repeats is drawn whole."""
    drawn = importance_resample(docs, target, **how).where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi")
