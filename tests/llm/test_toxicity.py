import zlib
from itertools import combinations

import numpy as np
import pytest

from tillroll.llm import queries, toxicity as tox
from tests.llm.tables import ODD_TEXTS, docs_of, rows_by_id

SF = "/root/testdata/sf0.01"


def plain_kernel(a, b):
    """The scaled kernel by its definition: a sum over pairs of equal subsequences."""

    def raw(x, y):
        spans = lambda s: [
            (tuple(s[i] for i in at), at[-1] - at[0] + 1)
            for at in combinations(range(len(s)), tox.ORDER)
        ]
        return sum(tox.DECAY ** (m + n) for u, m in spans(x) for v, n in spans(y) if u == v)

    return raw(a, b) / np.sqrt(max(raw(a, a) * raw(b, b), 1e-24))


def test_kernel_by_definition():
    units = ["idiot", "idxiot", "scum", "lowei", "abcabcab", "aaaaaa", "abc", ""]
    got = tox.kernel(units, units[:6])
    for i, a in enumerate(units):
        for j, b in enumerate(units[:6]):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-4)


def test_collapsed_weights_equal_nystroem_features():
    rng = np.random.default_rng(0)
    marks = ["idiot", "moron", "thing", "worthless"]
    white, w = rng.normal(size=(4, 3)), rng.normal(size=3)
    units = ["idiot", "idiiot", "thinking", "zzzz", "on"]
    want = tox.kernel(units, marks) @ white @ w + 0.25
    assert tox.collapse(marks, white, w, 0.25).margins(units) == pytest.approx(want, abs=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return tox.train_toxicity(docs, labels)


def test_gaps_and_inserted_characters(spark, model):
    texts = ["and so the idiot went", "and so the i d i o t went", "so the id.io*t went", "so the iddiot went", "and so it went"]
    got = rows_by_id(tox.score_toxicity(docs_of(spark, texts), model))
    assert [got[i]["predicted"] for i in range(5)] == [1, 1, 1, 1, 0]


def test_odd_texts(spark, model):
    got = rows_by_id(tox.score_toxicity(docs_of(spark, ODD_TEXTS, extra=True), model))
    assert len(got) == len(ODD_TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert not any(got[i]["predicted"] for i in (0, 1, 2))
    assert tox.score_toxicity(docs_of(spark, []), model).count() == 0


def test_query_on_held_out_labels(spark):
    labels = rows_by_id(spark.read.parquet(f"{SF}/labels.parquet"))
    langs = rows_by_id(spark.read.parquet(f"{SF}/documents.parquet"))
    got = rows_by_id(queries.op9_toxicity(spark, SF))
    assert set(got) == set(langs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    english = [i for i, r in got.items() if r["held_out"] and i in labels and langs[i]["lang"] == "en"]
    right = sum(got[i]["predicted"] == labels[i]["toxic"] for i in english)
    assert right >= 0.95 * len(english)


def plain_scores(model, text):
    """The score of a text again: kernels by definition are tested above, here every window's
    margin by the plain subsequence sum, and the larger of the machines' scores."""
    best = 0.0
    for m in model.machines:
        margins = []
        for chunk in tox.units_of(text or ""):
            values = []
            for w in tox._windows(tox.letters_of(chunk)):
                value = m.bias
                if len(w) >= tox.ORDER:
                    code = tox.codes([w])[0]
                    total = 0.0
                    for at in combinations(range(len(w)), tox.ORDER):
                        key = 0
                        for i in at:
                            key = key * tox._LETTERS + int(code[i])
                        total += float(m.weights[key]) * tox.DECAY ** (at[-1] - at[0] + 1)
                    value += total / np.sqrt(max(float(tox.self_kernel(code[None])[0]), 1e-12))
                values.append(value)
            margins.append(max(values))
        least = min(m.bias, 0.0)
        top = sorted(margins, reverse=True)[: tox.TOP]
        top += [least] * (tox.TOP - len(top))
        margin = max(a + b for a, b in zip(top, m.lifts))
        best = max(best, 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30))))
    return best


def test_scores_against_brute_force(spark, model):
    texts = ODD_TEXTS[:12] + ["you idiot and you moron", "x" * 40 + " idiot", "i d i o t", "a b c d e f g h"]
    got = rows_by_id(tox.score_toxicity(docs_of(spark, texts), model))
    for i, text in enumerate(texts):
        assert got[i]["score"] == pytest.approx(plain_scores(model, text), abs=1e-5), text


def test_held_out_recall_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = rows_by_id(spark.read.parquet(f"{sf}/labels.parquet"))
    langs = rows_by_id(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"))
    got = rows_by_id(queries.op9_toxicity(spark, sf))
    held = [i for i, r in got.items() if r["held_out"] and i in labels]
    caught = lambda some: np.mean([got[i]["predicted"] for i in some])
    of = lambda lang, toxic: [i for i in held if langs[i]["lang"] == lang and labels[i]["toxic"] == toxic]
    for lang, recall, false in (("en", 0.9, 0.01), ("de", 0.8, 0.15), ("fr", 0.9, 0.15), ("es", 0.7, 0.1)):
        assert caught(of(lang, 1)) >= recall and caught(of(lang, 0)) <= false, lang
    assert caught([i for i in held if labels[i]["toxic"] == 1]) >= 0.9


def test_a_repeated_id_does_not_widen_the_sample(spark):
    docs = docs_of(spark, ["you idiot", "fine words"]).selectExpr("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id = 0").crossJoin(spark.range(50)).drop("id"))
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    original, tox.train_bags = tox.train_bags, lambda bags, y: seen.append(list(y)) or None
    try:
        tox.train_toxicity(docs, labels, {0: 5, 1: 3})
    finally:
        tox.train_bags = original
    assert sum(seen[0]) <= 3


def test_no_labels(spark):
    labels = spark.createDataFrame([(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    row = rows_by_id(tox.toxicity(docs_of(spark, ["x"]), labels))[0]
    assert row["score"] == 0 and row["predicted"] == 0
