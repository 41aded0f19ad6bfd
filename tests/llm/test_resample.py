import re
import zlib
from collections import Counter
from hashlib import sha256
from math import floor, log

import numpy as np
import pyarrow as pa

from tests.llm.tables import ODD_TEXTS, docs_of
from tillroll.llm import resample


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def buckets_of(text):
    return [zlib.crc32(g.encode()) % 10_000 for g in grams_of(text)]


def brute(docs, target, percent=5, min_words=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = [floor(1000.0 * log((t[b] + 1.0) * (S + 10_000) / ((s[b] + 1.0) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        found = buckets_of(text)
        h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + floor(-1000.0 * log(-log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words_of(text)) >= min_words])
    able = [r for r in rows if r[5]]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in df.dtypes} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


def target_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


TARGET = ["one two three four", None, "", "Same TEXT here, same text", "漢字 words"]


def test_crc_of_joined_strings():
    parts = [b"", b"a", "é漢".encode(), b"x" * 31, b"y" * 33, b"long " * 50_000, bytes(range(256))]
    left, right = [(a, b) for a in parts for b in parts], None
    left, right = zip(*left)
    crc = lambda of: np.array([zlib.crc32(x) for x in of], np.uint32)
    found = resample.crc_join(crc(left), crc(right), np.array([len(x) for x in right]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


def test_buckets_of_a_slice():
    texts = [t or "" for t in ODD_TEXTS]
    found = resample.Features(pa.array(texts, pa.large_string()), 10_000)
    expected = Counter(b for t in texts for b in buckets_of(t))
    counts = found.counts(10_000)
    assert {b: n for b, n in enumerate(counts) if n} == expected
    assert found.features().tolist() == [len(grams_of(t)) for t in texts]


def test_odd_texts(spark):
    texts = ODD_TEXTS + [f"{t} word{i} and so on" for i in range(40) for t in ("one two three " * 9, "other Words " * 12)]
    docs, target = docs_of(spark, texts), target_of(spark, TARGET)
    expected = brute(list(enumerate(texts)), TARGET, percent=30)
    assert got(resample.importance_resample(docs, target, percent=30)) == expected
    assert sum(r[4] is not None for r in expected) > 10
    extra = docs_of(spark, texts, extra=True).selectExpr("*", "'x' as weight", "'y' as rank", "1 as pos")
    assert got(resample.importance_resample(extra, target, percent=30)) == expected
    drawn = resample.resampled(extra, target, percent=30)
    assert drawn.columns == extra.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in expected if r[4]}


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "a b c " * 10), (7, "a b c " * 10), (7, "d e " * 15), (None, "a b " * 20), (None, None), (3, "x " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(resample.importance_resample(docs, target_of(spark, ["a b"]), percent=70)) == brute(rows, ["a b"], 70)


def test_empty_tables(spark):
    none, some = docs_of(spark, []), docs_of(spark, ["one two"] * 3)
    assert got(resample.importance_resample(none, target_of(spark, TARGET))) == []
    empty = target_of(spark, TARGET).where("item_id < 0")
    assert got(resample.importance_resample(some, empty)) == brute(list(enumerate(["one two"] * 3)), [])


def test_partitioning_changes_nothing(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = got(resample.importance_resample(rows.coalesce(1), target, percent=40))
    assert got(resample.importance_resample(rows.repartition(7), target, percent=40)) == one
    pairs = [(r.doc_id, r.text) for r in rows.collect()]
    assert one == brute(pairs, [r.text for r in target.collect()], 40)
