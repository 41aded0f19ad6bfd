"""Quality rules and a trained quality score.

A logistic regression over hashed word and character n-grams, fitted on labelled
rows, calibrated on a part of them that the fit did not see, and scored in Arrow
batches against fixed thresholds. Two rules reject a text whatever its score.

Defined cases: a null text counts as an empty one (0 words, so a rule rejects it);
a null or repeated doc_id is kept as it is, one result row per input row; labels that
are null or not 0/1 are ignored; without labels of both kinds the score is 0.5 and the
rules alone decide; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm import textbytes as tb

#: At most so many labelled rows of each kind train the model (those with the least
#: hash of doc_id), so the matrix that the driver fits is bounded.
SAMPLE_PER_LABEL = 1000
BUCKETS = 2048
CHAR_GRAM = 4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5

_SYMBOL = tb.byte_table(lambda b: chr(b) in "#*$%&|<>")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, score double"
)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def features(texts: tb.Texts, words: tb.Spans, hashes: np.ndarray) -> np.ndarray:
    """Word 1- and 2-grams and 4-byte grams, hashed into two unit vectors side by side."""
    rows = words.rows()
    at, pairs = words.windows(hashes, 2)
    grams = tb.hashed_counts(
        np.concatenate((rows, rows[at])), np.concatenate((hashes, pairs)), texts.rows, BUCKETS
    )
    size = len(texts.data) - CHAR_GRAM + 1
    if size > 0:
        code = np.zeros(size, np.uint64)
        for k in range(CHAR_GRAM):
            code |= texts.data[k : k + size].astype(np.uint64) << np.uint64(8 * k)
        row = np.repeat(np.arange(texts.rows), np.diff(texts.bounds))
        whole = row[:size] == row[CHAR_GRAM - 1 :]
        chars = tb.hashed_counts(row[:size][whole], tb.mix(code[whole]), texts.rows, BUCKETS)
    else:
        chars = np.zeros((texts.rows, BUCKETS), np.float32)
    return np.hstack((tb.unit_rows(grams), tb.unit_rows(chars)))


def repeated_words(words: tb.Spans, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Per row, the words that lie in a window of ``width`` words found twice or more."""
    at, window = words.windows(hashes, width)
    if not len(at):
        return np.zeros(words.texts.rows, np.int64)
    row = words.rows()[at]
    order = np.lexsort((window, row))
    same = (window[order][1:] == window[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[at[again] + k] = True
    total = np.concatenate(([0], np.cumsum(covered)))
    return np.diff(total[words.first])


def repeated_lines(texts: tb.Texts) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    lines = tb.Spans(texts, tb.NOT_NEWLINE)
    if not len(lines):
        return np.zeros(texts.rows, np.int64)
    inked = np.concatenate(([0], np.cumsum(tb.NOT_SPACE[texts.data])))
    worded = inked[lines.ends] > inked[lines.starts]
    row, hashed = lines.rows()[worded], lines.hashes()[worded]
    order = np.lexsort((hashed, row))
    same = (hashed[order][1:] == hashed[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=texts.rows)


def measure(texts: tb.Texts, model: QualityModel | None) -> dict[str, np.ndarray]:
    words = tb.Spans(texts, tb.NOT_SPACE)
    hashes = words.hashes()
    n_words = words.counts()
    repeats = repeated_words(words, hashes)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    if model is None:
        score = np.full(texts.rows, 0.5)
    else:
        score = model.probability(features(texts, words, hashes)).astype(float)
    return {
        "n_words": n_words,
        "word_chars": texts.sums(tb.NOT_SPACE[texts.data] & tb.POINT[texts.data]),
        "n_symbols": texts.sums(_SYMBOL[texts.data]),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & (score >= KEEP_AT),
        "score": score,
    }


def _feature_rows(batches):
    for batch in batches:
        data, offsets = tb.buffers(tb.column(batch, "text"))
        label = tb.column(batch, "label")
        for lo, hi in tb.row_slices(offsets):
            texts = tb.Texts(data, offsets[lo : hi + 1])
            words = tb.Spans(texts, tb.NOT_SPACE)
            x = features(texts, words, words.hashes()).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [label.slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())],
                ["label", "x"],
            )


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4):
    """Class-balanced logistic regression by accelerated gradient descent."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.shape[1] + 1, np.float64)
    ahead, step = w.copy(), 2.0
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1].astype(np.float32) + ahead[-1], -30, 30)))
        error = weight * (p - y)
        slope = np.append(error.astype(np.float32) @ x, error.sum()) + ridge * np.append(ahead[:-1], 0)
        following = ahead - step * slope
        ahead = following + k / (k + 3) * (following - w)
        w = following
    return w[:-1].astype(np.float32), float(w[-1])


def fit_platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to labels, by damped Newton steps.

    The targets are pulled in from 0 and 1 as by one more row of each kind.
    """
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.array([1.0, 0.0])
    design = np.stack((margin, np.ones_like(margin)), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, design.T @ (p - target))
        a -= np.clip(move, -2, 2)
    return float(a[0]), float(a[1])


def train_quality(
    docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL
) -> QualityModel | None:
    """Fit on a bounded sample of labelled rows; None without rows of both kinds."""
    known = labels.select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")
    ).where("id is not null and label in (0, 1)")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_label ids are broadcast.
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id")
    rows = (
        texts.select("text", "label").mapInArrow(_feature_rows, "label int, x binary").collect()
    )
    rows.sort(key=lambda r: (r["label"], r["x"]))
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    w, b = fit_logistic(x[~held], y[~held])
    check = held if held.any() else ~held
    slope, shift = fit_platt((x[check] @ w + b).astype(float), y[check])
    return QualityModel(w, b, slope, shift)


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """One row per document: its measures, rule verdict, score and whether it is kept."""

    def rows(batches):
        for batch in batches:
            data, offsets = tb.buffers(tb.column(batch, "text"))
            ids = tb.column(batch, "doc_id")
            for lo, hi in tb.row_slices(offsets):
                found = measure(tb.Texts(data, offsets[lo : hi + 1]), model)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *(pa.array(v) for v in found.values())],
                    ["doc_id", *found],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, train_quality(docs, labels))
