"""Language identification by nearest centroid.

A text is a unit vector of TF-IDF weights over hashed byte n-grams of its letters. Each
language has a few centroids (spherical k-means); a text gets the language of the
centroid with the largest cosine. A text that is too far from every centroid is
rejected: its cosine is below ``REJECT_SHARE`` of the least cosines usual for texts of
its length around that centroid, or it has no letter. Texts of fewer than 32 n-grams say
too little for a distance and are not rejected for it.

Defined cases: null and letterless texts get `und`, score 0 and are rejected; ties go to
the centroid listed first (languages in order of name); rows with a null language or
doc_id are predicted but not learned from; without any learnable row everything is
`und`; extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillroll.llm import textbytes as tb

UNKNOWN = "und"
BUCKETS = 4096
GRAMS = (2, 3, 4)
CENTROIDS = 3
#: Centroids are fitted on at most so many rows of a language (least hash of doc_id);
#: document frequencies count all learnable rows.
SAMPLE_PER_LANGUAGE = 400
FOLDS = 5
REJECT_SHARE = 0.5

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    least: np.ndarray  # usual least cosine of each centroid, by length class


_LETTER = tb.byte_table(lambda b: b >= 128 or chr(b).isalpha())
#: Upper bounds in letters of the length classes of the rejection distance.
LENGTHS = np.array([8, 32, 128, 512])
#: The first length class whose texts can be too far.
JUDGED = 2


def letter_texts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts with everything but letters as blanks; which have a letter."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    lettered = pc.match_substring_regex(lowered, r"\p{L}").to_numpy(zero_copy_only=False)
    blanked = pc.replace_substring_regex(lowered, r"[^\p{L}]+", " ")
    data, offsets = tb.buffers(blanked)
    return data, offsets, lettered.astype(bool)


def gram_counts(texts: tb.Texts) -> np.ndarray:
    """Hashed counts of the n-grams whose bytes are not only blanks."""
    data, n = texts.data, len(texts.data)
    row = np.repeat(np.arange(texts.rows), np.diff(texts.bounds))
    rows, codes = [], []
    wide = data.astype(np.uint64)
    for g in GRAMS:
        if n < g:
            continue
        size = n - g + 1
        code = np.zeros(size, np.uint64)
        for k in range(g):
            code |= wide[k : k + size] << np.uint64(8 * k)
        use = (row[:size] == row[g - 1 :]) & _LETTER[data[g // 2 : g // 2 + size]]
        rows.append(row[:size][use])
        codes.append(tb.mix(code[use] | np.uint64(g << 56)))
    if not rows:
        return np.zeros((texts.rows, BUCKETS), np.float32)
    return tb.hashed_counts(np.concatenate(rows), np.concatenate(codes), texts.rows, BUCKETS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def letter_slices(column) -> Iterator[tuple[int, int, tb.Texts, np.ndarray]]:
    """Slices of a column as ``letter_texts``: first row, end, texts, which have a letter."""
    _, offsets = tb.buffers(column)
    for lo, hi in tb.row_slices(offsets):
        data, bounds, lettered = letter_texts(column.slice(lo, hi - lo))
        yield lo, hi, tb.Texts(data, bounds), lettered


def _frequencies(batches):
    """Per partition, in how many rows each bucket occurs, as one row of chunks."""
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for lo, hi, texts, _ in letter_slices(tb.column(batch, "text")):
            total += (gram_counts(texts) > 0).sum(0)
            rows += hi - lo
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(BUCKETS), -1)), pa.array(np.append(total, rows))],
            ["bucket", "n"],
        )


def _sample_counts(batches):
    for batch in batches:
        lang = tb.column(batch, "lang")
        for lo, hi, texts, lettered in letter_slices(tb.column(batch, "text")):
            packed = [np.minimum(c, 65504).astype(np.float16).tobytes() for c in gram_counts(texts)]
            part = pa.RecordBatch.from_arrays(
                [lang.slice(lo, hi - lo), pa.array(packed, pa.binary())], ["lang", "x"]
            )
            yield part.filter(pa.array(lettered))


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows spread by farthest-first choice."""
    mean = x.mean(0)
    centers = [x[np.argmax(x @ mean)]]
    while len(centers) < min(k, len(x)):
        nearest = (x @ np.stack(centers).T).max(1)
        centers.append(x[np.argmin(nearest)])
    c = np.stack(centers)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].sum(0)
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def _learn_one(sample: pa.Table, idf: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """A language's centroids, and the least cosines usual for texts of each length."""
    counts = np.stack([np.frombuffer(b, np.float16) for b in sorted(sample.column("x").to_pylist())])
    counts = counts.astype(np.float32)
    centroids = np.stack(cluster(vectors(counts, idf), CENTROIDS)).astype(np.float32)
    # The distance at which a text is rejected, by its length: cosines of cut training texts.
    least, rng = [], np.random.default_rng(0)
    for grams in (*LENGTHS, None):
        part = counts
        if grams is not None:
            share = np.minimum(1, grams / np.maximum(counts.sum(1, keepdims=True), 1))
            part = rng.poisson(counts * share).astype(np.float32)
            part = part[part.sum(1) > 0]
        best = (vectors(part, idf) @ centroids.T).max(1) if len(part) else np.zeros(1)
        least.append(float(np.quantile(best, 0.01)))
    return centroids, least


def train_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Centroids are fitted in one task per language, on at most ``per_language`` of its rows;
    the driver gets the centroids, three vectors a language."""
    learn = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & (fold(F.col("doc_id"), FOLDS) != 0)
    )
    frequency = dict(
        learn.select("text")
        .mapInArrow(_frequencies, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    if not frequency:
        return None
    rows = frequency.pop(-1)
    df = np.array([frequency.get(b, 0) for b in range(BUCKETS)])
    idf = (np.log((1 + rows) / (1 + df)) + 0.1).astype(np.float32)

    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # The rank limit also runs before the shuffle: so many ids of a language and map task.
    picked = learn.select("doc_id", "lang").withColumn("place", F.row_number().over(first))
    picked = picked.where(F.col("place") <= per_language).select(F.col("doc_id").alias("id"))
    # At most per_language ids of each language are broadcast. Rows that repeat an id are
    # limited once more.
    chosen = learn.join(F.broadcast(picked.distinct()), F.col("doc_id") == F.col("id"), "left_semi")
    chosen = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language)
    sample = chosen.select("text", "lang").mapInArrow(_sample_counts, "lang string, x binary")

    def learned(table: pa.Table) -> pa.Table:
        centroids, least = _learn_one(table, idf)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "c": [centroids.tobytes()], "least": [least]})

    fitted = sample.groupBy("lang").applyInArrow(learned, "lang string, c binary, least array<double>").collect()
    if not fitted:
        return None
    fitted.sort(key=lambda r: r["lang"])
    each = [np.frombuffer(r["c"], np.float32).reshape(-1, BUCKETS) for r in fitted]
    owner = np.repeat(np.arange(len(each)), [len(c) for c in each])
    return LanguageModel(
        idf, [r["lang"] for r in fitted], owner, np.concatenate(each), np.array([r["least"] for r in fitted])
    )


def predict_language(docs: DataFrame, model: LanguageModel | None, *more: str) -> DataFrame:
    """One row per document; columns named in ``more`` are carried along."""

    def rows(batches):
        for batch in batches:
            n = batch.num_rows
            names = np.full(n, UNKNOWN, object)
            score, rejected = np.zeros(n), np.ones(n, bool)
            for lo, hi, texts, use in letter_slices(tb.column(batch, "text")) if model is not None else ():
                counts = gram_counts(texts)
                cosine = vectors(counts, model.idf) @ model.centroids.T
                best = cosine.argmax(1)
                lang = model.owner[best]
                length = np.searchsorted(LENGTHS, counts.sum(1))
                top = np.clip(cosine[np.arange(hi - lo), best], 0, 1)
                names[lo:hi][use] = np.array(model.languages, object)[lang[use]]
                score[lo:hi][use] = top[use]
                far = top < REJECT_SHARE * model.least[lang, length]
                rejected[lo:hi] = ~use | (far & (length >= JUDGED))
            yield pa.RecordBatch.from_arrays(
                [
                    tb.column(batch, "doc_id"),
                    tb.column(batch, "held_out"),
                    pa.array(names, pa.string()),
                    pa.array(score),
                    pa.array(rejected),
                    *(tb.column(batch, m if m == "text" else "_" + m) for m in more),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "rejected", *("_" + m for m in more)],
            )

    kinds = dict(docs.dtypes)
    schema = SCHEMA + "".join(f", _{m} {kinds[m]}" for m in more)
    return docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        *(F.col(m).alias("_" + m) for m in more if m != "text"),
    ).mapInArrow(rows, schema)


def language_id(docs: DataFrame) -> DataFrame:
    return predict_language(docs, train_language(docs))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    told = predict_language(docs, train_language(docs), "text", "lang", "source", "n_chars")
    return told.where(~F.col("rejected")).select(
        "doc_id", *(F.col("_" + c).alias(c) for c in ("text", "lang", "source", "n_chars"))
    )
