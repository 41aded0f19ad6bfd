"""Toxicity by a support vector machine over a gapped subsequence kernel.

The unit of a sentence is a word without its non-letters, or a run of spaced-out single
letters. The kernel of two units sums, over the subsequences of four letters that both
hold, ``DECAY`` to the power of the letters spanned in both, scaled so that a unit has 1
with itself; an inserted or left-out letter only weakens it. Kernels with a few landmark
units, whitened, are the Nyström features of a linear SVM. It is trained on labelled sentences:
those of a toxic text name the units that hold a letter piece far commoner in toxic
texts, and clean texts are searched for their most suspicious units, round by round.
A second machine is trained for the toxic texts that the first does not find: there each
text names its own telling units, those commoner in toxic texts as a whole.
Since a landmark has few subsequences, the trained machine is one weight per subsequence, which is how texts are
scored: the same value, without a kernel per landmark.

A text's margin is that of its most toxic unit; for the second machine that of its second
one, or of its third with what that many are worth more, since one unit that is no word of
its own may stand in a clean text. A logistic curve, fitted on training texts that the machine did not
see, turns it into a score, and a text has the larger of its two scores.

Defined cases: null, empty and letterless texts have the least margin and so the least
score; without labels of both kinds every score is 0; labels that are null or not 0/1
are ignored; a unit of over ``WINDOW`` letters is read in overlapping windows; extra
columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tillroll.llm import textbytes as tb
from tillroll.llm.language import fold
from tillroll.llm.quality import fit_platt

FOLDS, HELD_OUT = 4, 2
PREDICT_AT = 0.3
DECAY = 0.6
LANDMARKS = 192
ROUNDS = 4
#: Lengths of the letter pieces by which toxic texts name units, and how much commoner (as
#: a logarithm) a piece must be in toxic texts: the first that half of the texts meet.
PIECES = (4, 5)
NAMED_ODDS = (3.5, 2.5, 1.5)
#: For the second machine a unit is telling if so many toxic texts hold it, and it is so much
#: commoner in them. Fewer missed texts than ``MISSED`` are no second machine's work.
TELLING_TEXTS, TELLING_ODDS, MISSED = 3, 1.5, 8
#: At most so many clean and toxic labelled texts train the machine (least hash of doc_id).
SAMPLE = {0: 1600, 1: 800}
#: So many of a text's most toxic units count, and what the third may be worth more.
TOP = 3
LIFTS = np.arange(0, 2.6, 0.25)
NEVER = -1e9
ORDER = 4
WINDOW, STRIDE = 16, 8
#: Units whose margin a worker remembers; emptied when full.
REMEMBERED = 300_000

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_LETTERS = 40  # letter codes: 1-26 for a-z, the rest shared by other letters
_CODE = np.array(
    [c - 96 if 97 <= c <= 122 else 27 + c % 13 for c in range(0x250)], np.int64
)
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)")
_NO_LETTER = re.compile(r"[\W\d_]+")


def units_of(text: str) -> list[str]:
    """Lower-case chunks of a text, and its runs of spaced-out letters joined."""
    lowered = text.lower()
    chunks = lowered.split()
    for run in _SPACED.findall(lowered):
        chunks.append("".join(run.split()))
    return chunks


def letters_of(chunk: str) -> str:
    return chunk if chunk.isalpha() else _NO_LETTER.sub("", chunk)


def _windows(letters: str) -> list[str]:
    if len(letters) <= WINDOW:
        return [letters]
    last = len(letters) - WINDOW
    return [letters[k : k + WINDOW] for k in (*range(0, last, STRIDE), last)]


def codes(units: list[str]) -> np.ndarray:
    """Letter codes of units of one length, a row each."""
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    found = np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 27 + points % 13)
    return found.reshape(len(units), -1)


def subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index tuples of a unit of this length and their decayed weights."""
    index = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return index, (DECAY ** (index[:, -1] - index[:, 0] + 1)).astype(np.float32)


def keys(code: np.ndarray, index: np.ndarray) -> np.ndarray:
    found = code[:, index[:, 0]]
    for k in range(1, ORDER):
        found = found * _LETTERS + code[:, index[:, k]]
    return found


def self_kernel(code: np.ndarray) -> np.ndarray:
    """The kernel of each unit with itself, by decayed prefix sums."""
    n, length = code.shape
    same = (code[:, :, None] == code[:, None, :]).astype(np.float32) * DECAY**2
    level = same
    for _ in range(ORDER - 1):
        sums = level.copy()
        for k in range(1, length):
            sums[:, k, :] += DECAY * sums[:, k - 1, :]
        for k in range(1, length):
            sums[:, :, k] += DECAY * sums[:, :, k - 1]
        level = np.zeros_like(same)
        level[:, 1:, 1:] = same[:, 1:, 1:] * sums[:, :-1, :-1]
    return level.sum((1, 2))


def by_length(units: list[str]):
    """(length, places, units) of the units that have a subsequence."""
    groups: dict[int, list[int]] = {}
    for k, u in enumerate(units):
        if len(u) >= ORDER:
            groups.setdefault(len(u), []).append(k)
    for length, at in groups.items():
        size = max(1, 400_000 // max(comb(length, ORDER), length * length))
        for lo in range(0, len(at), size):
            part = at[lo : lo + size]
            yield length, part, [units[k] for k in part]


@dataclass
class ToxicModel:
    weights: np.ndarray  # per subsequence
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    lifts: tuple[float, ...] = (0.0,) * TOP

    def margins(self, units: list[str]) -> np.ndarray:
        """Margin of each unit of at most WINDOW letters."""
        out = np.full(len(units), self.bias)
        for length, at, part in by_length(units):
            code = codes(part)
            index, decay = subsequences(length)
            total = self.weights[keys(code, index)] @ decay
            out[at] += total / np.sqrt(np.maximum(self_kernel(code), 1e-12))
        return out

    def top(self, margins) -> list[float]:
        """The largest margins of a text's units, as if it had enough of the least."""
        least = min(self.bias, 0.0)
        found = heapq.nlargest(TOP, margins)
        return found + [least] * (TOP - len(found))

    def score(self, top: np.ndarray) -> np.ndarray:
        """From rows of the largest margins."""
        margin = (top + np.array(self.lifts)).max(1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


@dataclass
class Committee:
    machines: list[ToxicModel]

    def margins(self, units: list[str]) -> np.ndarray:
        """A row per machine."""
        out = np.array([[m.bias] * len(units) for m in self.machines])
        for length, at, part in by_length(units):
            code = codes(part)
            index, decay = subsequences(length)
            found, norm = keys(code, index), np.sqrt(np.maximum(self_kernel(code), 1e-12))
            for row, m in zip(out, self.machines):
                row[at] += m.weights[found] @ decay / norm
        return out

    def score(self, units: list[np.ndarray]) -> float:
        """The score of a text from the margins of its units, an array per unit."""
        each = zip(*units) if units else [()] * len(self.machines)
        return max(float(m.score(np.array([m.top(row)]))[0]) for m, row in zip(self.machines, each))


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Scaled kernels of units and landmarks."""
    held = []
    for length, at, part in by_length(landmarks):
        code = codes(part)
        index, decay = subsequences(length)
        held.append((at, keys(code, index), decay / np.sqrt(np.maximum(self_kernel(code), 1e-12))[:, None]))
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *(k.ravel() for _, k, _ in held)]))
    place = np.zeros(_LETTERS**ORDER, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    # Row 0 stands for all subsequences that no landmark has.
    narrow = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for at, found, weight in held:
        np.add.at(narrow, (place[found], np.array(at)[:, None]), weight)
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for length, at, part in by_length(units):
        code = codes(part)
        index, decay = subsequences(length)
        found = place[keys(code, index)]
        norm = np.sqrt(np.maximum(self_kernel(code), 1e-12))
        for lo in range(0, len(part), 64):
            rows = narrow[found[lo : lo + 64]]
            out[at[lo : lo + 64]] = np.einsum("utm,t->um", rows, decay)
        out[at] /= norm[:, None]
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-4):
    """Squared-hinge linear SVM with balanced classes, by Newton steps on its active rows."""
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    design = np.hstack((x, np.ones((len(x), 1)))).astype(np.float64)
    keep = ridge * np.eye(design.shape[1])
    keep[-1, -1] = 1e-9
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        active = 1 - sign * (design @ w) > 0
        rows = design[active] * weight[active, None]
        following = np.linalg.solve(keep + rows.T @ design[active], rows.T @ sign[active])
        if np.allclose(following, w):
            break
        w = following
    return w[:-1], float(w[-1])


def collapse(landmarks: list[str], white: np.ndarray, w: np.ndarray, bias: float) -> ToxicModel:
    """The weights per subsequence that equal the SVM on Nyström features."""
    share = white @ w
    weights = np.zeros(_LETTERS**ORDER)
    for length, at, part in by_length(landmarks):
        code = codes(part)
        index, decay = subsequences(length)
        norm = np.sqrt(np.maximum(self_kernel(code), 1e-12))
        for row, k, scale in zip(keys(code, index), at, norm):
            np.add.at(weights, row, share[k] * decay / scale)
    return ToxicModel(weights.astype(np.float32), bias)


def bag(text: str) -> dict[str, int]:
    """The units of a text and how often they occur, up to ``TOP``."""
    counts = Counter(w for c in units_of(text) for w in _windows(letters_of(c)) if len(w) >= ORDER)
    return {u: min(n, TOP) for u, n in sorted(counts.items())}


def _log_odds(toxic: int, clean: int) -> float:
    return float(np.log((toxic + 0.1) / (clean + 0.5)))


def _pieces(unit: str) -> set[str]:
    return {unit[k : k + n] for n in PIECES for k in range(len(unit) - n + 1)}


def named_by_pieces(toxic: list, clean: list) -> list[str]:
    """Units of toxic texts that hold a telling piece, one entry per text."""
    in_toxic, in_clean = (Counter(p for b in part for p in set().union(*map(_pieces, b))) for part in (toxic, clean))
    names: list[list[str]] = []
    for least in NAMED_ODDS:
        telling = {p for p in in_toxic if _log_odds(in_toxic[p], in_clean[p]) >= least}
        names = [[u for u in b if _pieces(u) & telling] for b in toxic]
        if 2 * sum(map(bool, names)) >= len(toxic):
            break
    named = [u for found in names for u in found]
    # too few texts to tell pieces apart
    return named or [u for b in toxic for u in b if _pieces(u)]


def named_whole(toxic: list, clean: list) -> list[str]:
    """Telling units of toxic texts, one entry per text."""
    in_toxic, in_clean = (Counter(u for b in part for u in b) for part in (toxic, clean))
    whole = {
        u
        for u, n in in_toxic.items()
        if n >= TELLING_TEXTS and _log_odds(n, in_clean[u]) >= TELLING_ODDS
    }
    return [u for b in toxic for u in b if u in whole]


def fit_bags(bags: list[dict[str, int]], y: np.ndarray, naming=named_by_pieces) -> ToxicModel | None:
    """A machine for the units that ``naming`` finds in toxic texts, None if it finds none."""
    toxic, clean = [b for b, v in zip(bags, y) if v], [b for b, v in zip(bags, y) if not v]
    named = naming(toxic, clean)
    if not named:
        return None
    clean_units = Counter(u for b in clean for u in b)
    usual = [u for u, _ in sorted(clean_units.items(), key=lambda p: (-p[1], p[0]))[:500]]
    rng = np.random.default_rng(7)
    all_clean = sorted(clean_units)
    pick = rng.choice(len(all_clean), min(3000, len(all_clean)), replace=False) if all_clean else []
    against = sorted({*usual, *(all_clean[k] for k in pick)})
    model, hard = None, []
    for _ in range(ROUNDS):
        top = [u for u, _ in sorted(Counter(named).items(), key=lambda p: (-p[1], p[0]))]
        landmarks = top[: LANDMARKS // 2]
        landmarks += hard[: LANDMARKS // 4]
        landmarks += [u for u in against if u not in landmarks][:: max(1, len(against) // (LANDMARKS // 4))]
        landmarks = list(dict.fromkeys(landmarks))[:LANDMARKS]
        own = kernel(landmarks, landmarks)
        value, vector = np.linalg.eigh((own + own.T) / 2)
        good = value > 1e-4
        white = vector[:, good] / np.sqrt(value[good])
        units = named + against
        x = kernel(units, landmarks) @ white
        w, b = fit_svm(x, np.array([1] * len(named) + [0] * len(against)))
        model = collapse(landmarks, white, w, b)
        told = sorted({u for b in bags for u in b})
        margin = dict(zip(told, model.margins(told)))
        worst = {u for b in clean for u in sorted(b, key=lambda u: -margin[u])[:3]}
        hard = sorted(worst, key=lambda u: (-margin[u], u))
        against = sorted({u for u in against if margin.get(u, 0) > -1.2} | worst)
    return model


def train_toxicity(
    docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE
) -> Committee | None:
    known = labels.select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")
    ).where((fold(F.col("id"), FOLDS) != HELD_OUT) & F.col("label").isin(0, 1))
    picked = None
    for value, most in sample.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # At most the ids of ``sample`` are broadcast. Whole texts become bags of units in the
    # tasks, and rows that repeat an id are limited once more.
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id")
    first = W.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    most = F.when(F.col("label") == 1, sample[1]).otherwise(sample[0])
    rows = rows.where(F.length("text") > 0).withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    rows = rows.mapInArrow(_bags, "id long, label int, units array<string>, counts array<int>").collect()
    rows.sort(key=lambda r: (r["id"] * 2654435761 % 4294967296, r["id"], r["units"], r["counts"]))
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    bags = [dict(zip(r["units"], r["counts"])) for r in rows]
    return train_bags([dict(zip(r["units"], r["counts"])) for r in rows], y)


def train_bags(bags: list[dict[str, int]], y: np.ndarray) -> Committee | None:
    held = np.arange(len(y)) % 4 == 3
    if not (0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum()):
        held = np.zeros(len(y), bool)
    check = held if held.any() else ~held
    some = lambda chosen: [b for b, c in zip(bags, chosen) if c]
    tops = lambda model, part: np.array([model.top(np.repeat(model.margins(list(b)), list(b.values()))) for b in part])
    first = fit_bags(some(~held), y[~held])
    if first is None:
        return None
    calibrate(first, tops(first, some(check)), y[check].astype(float), [(0.0,) * TOP])
    missed = (y == 0) | (first.score(tops(first, bags)) < PREDICT_AT)
    if y[missed].sum() < MISSED or not y[missed & check].any():
        return Committee([first])
    second = fit_bags(some(missed & ~held), y[missed & ~held], named_whole)
    if second is None:
        return Committee([first])
    worth = [(NEVER, 0.0, float(third)) for third in LIFTS]
    calibrate(second, tops(second, some(missed & check)), y[missed & check].astype(float), worth)
    return Committee([first, second])


def calibrate(model: ToxicModel, top: np.ndarray, y: np.ndarray, worth: list[tuple]) -> None:
    """Choose what a first, second and third unit are worth, among ``worth``, and the logistic
    curve, by least loss."""
    best = np.inf
    for lifts in worth:
        margin = (top + np.array(lifts)).max(1)
        slope, shift = fit_platt(margin, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if loss < best - 1e-9:
            best, model.lifts, model.slope, model.shift = loss, lifts, slope, shift


def _bags(batches):
    for batch in batches:
        bags = [bag(t) for t in tb.column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                tb.column(batch, "id").cast(pa.int64()),
                tb.column(batch, "label"),
                pa.array([list(b) for b in bags], pa.list_(pa.string())),
                pa.array([list(b.values()) for b in bags], pa.list_(pa.int32())),
            ],
            ["id", "label", "units", "counts"],
        )


def score_toxicity(docs: DataFrame, model: Committee | None) -> DataFrame:
    def rows(batches):
        known: dict[str, tuple[float, ...]] = {}
        for batch in batches:
            ids, held = tb.column(batch, "doc_id"), tb.column(batch, "held_out")
            texts = tb.column(batch, "text")
            for lo in range(0, len(texts), 256):
                part = [units_of(t or "") for t in texts.slice(lo, 256).to_pylist()]
                if model is None:
                    score = np.zeros(len(part))
                else:
                    if len(known) > REMEMBERED:
                        known.clear()
                    new = sorted({u for units in part for u in units if u not in known})
                    windows, owner = [], []
                    for k, chunk in enumerate(new):
                        for w in _windows(letters_of(chunk)):
                            windows.append(w)
                            owner.append(k)
                    best = np.full((len(model.machines), len(new)), -np.inf)
                    for row, margin in zip(best, model.margins(windows)):
                        np.maximum.at(row, owner, margin)
                    known.update(zip(new, zip(*best.tolist())))
                    score = np.array([model.score([known[c] for c in u]) for u in part])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, 256),
                        held.slice(lo, 256),
                        pa.array(score),
                        pa.array((score >= PREDICT_AT).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("long"), "text", held_out.alias("held_out")
    ).mapInArrow(rows, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, train_toxicity(docs, labels))
