import re

import pytest

from tillroll.llm import quality, queries
from tests.llm.tables import ODD_TEXTS, docs_of, rows_by_id


def base(text):
    """The base measures by plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": repeats,
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_odd_texts(spark):
    docs = docs_of(spark, ODD_TEXTS, extra=True)
    got = rows_by_id(quality.quality_rules(docs, no_labels(spark)))
    for i, text in enumerate(ODD_TEXTS):
        want = base(text)
        assert {k: got[i][k] for k in want} == want, i
        assert got[i]["score"] == 0.5 and got[i]["kept"] == (not want["base_failed"])


def test_empty_table(spark):
    assert quality.quality_rules(docs_of(spark, []), no_labels(spark)).count() == 0


def test_query_against_brute_force_and_labels(spark, sf_dir):
    texts = rows_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = rows_by_id(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = rows_by_id(queries.op1_quality_rules(spark, sf_dir))
    assert set(got) == set(texts)
    right = 0
    for i, row in got.items():
        want = base(texts[i]["text"])
        assert {k: row[k] for k in want} == want
        assert row["kept"] == (not row["base_failed"] and row["score"] >= quality.KEEP_AT)
        right += i in labels and (row["score"] >= 0.5) == (labels[i]["quality"] == 1)
    assert right >= 0.95 * len(labels)


def test_held_out_accuracy(spark):
    """Labels the model never saw, on the next larger tables."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(docs, labels.where("doc_id % 2 = 0"))
    got = rows_by_id(quality.score_quality(docs, model))
    held = [r for r in labels.collect() if r.doc_id % 2]
    right = sum((got[r.doc_id]["score"] >= 0.5) == (r.quality == 1) for r in held)
    assert right >= 0.95 * len(held)


@pytest.mark.parametrize("bad", [[(None, 1, 0)], [(0, None, 0)], [(0, 7, 0)], [(99, 1, 0)]])
def test_odd_labels(spark, bad):
    labels = spark.createDataFrame(bad, "doc_id long, quality int, toxic int")
    got = rows_by_id(quality.quality_rules(docs_of(spark, ["x y"]), labels))
    assert got[0]["score"] == 0.5
