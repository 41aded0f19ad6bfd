import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.tables import ODD_TEXTS, docs_of
from tillroll.llm import simhash


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def print_of(text):
    w = words_of(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, radius=2):
    """The least position that each value reaches, by comparing all pairs."""
    values = np.array(values, np.uint64)
    least = list(range(len(values)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            a, b = sorted((top(i), top(int(j))))
            least[b] = a
    return [top(i) for i in range(len(values))]


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    groups = groups_of(prints)
    names = {}
    for (doc_id, _), g in zip(rows, groups):
        if doc_id is not None:
            names[g] = min(names.get(g, doc_id), doc_id)
    return sorted(((d, f"{p:016x}", names.get(g)) for (d, _), p, g in zip(rows, prints, groups)), key=str)


def got(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=str)


def test_hash_is_that_of_spark(spark):
    texts = ["a b c", "é 漢 😀", "x" * 100]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % (1 << 64) for r in found] == [simhash.shingle_hashes(t.encode())[0] for t in texts]


def test_odd_texts(spark):
    rows = list(enumerate(ODD_TEXTS))
    assert got(simhash.simhash_components(docs_of(spark, ODD_TEXTS))) == brute(rows)
    extra = docs_of(spark, ODD_TEXTS, extra=True).selectExpr("*", "'x' as fp", "'y' as bucket", "1 as n", "2 as least")
    assert got(simhash.simhash_components(extra)) == brute(rows)


def test_repeats_ties_and_null_ids(spark):
    rows = [(7, "a b c"), (7, "a b c"), (7, "d e"), (None, "a b c"), (None, "only null"), (None, None), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.simhash_components(docs)) == brute(rows)


def test_empty_table(spark):
    assert got(simhash.simhash_components(docs_of(spark, []))) == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_planes_against_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = []
    for v in base:
        for _ in range(9):
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                v = v ^ np.uint64(1 << int(bit))
            values.append(v)
    values = np.array(values, np.uint64)
    ends = np.repeat([7, 8, 150, len(values)], [7, 1, 142, len(values) - 150])
    found = {(int(i), int(j)) for a, b in simhash.near_pairs(values, ends, radius) for i, j in zip(a, b)}
    expected = {
        (i, j)
        for i in range(len(values))
        for j in range(i + 1, ends[i])
        if int(values[i] ^ values[j]).bit_count() <= radius
    }
    assert found == expected


def _near_values(rng, n, around, flips):
    """Distinct values, most of them within few bits of a few centres."""
    centres = [rng.getrandbits(64) for _ in range(around)]
    out = set()
    while len(out) < n:
        v = rng.choice(centres) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randrange(flips + 1)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize(
    "bucket,task_rows", [(simhash.BUCKET, 10**6), (3, 10**6), (1, 10**6), (3, 5), (simhash.BUCKET, 5)]
)
def test_large_buckets_lose_no_link(spark, bucket, task_rows):
    values = _near_values(random.Random(5), 1_500, 12, 7)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(4)
    at = {v: i for i, v in enumerate(values)}
    label = list(range(len(values)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in simhash.links(nodes, bucket, task_rows).collect():
        a, b = at[r.a % (1 << 64)], at[r.b % (1 << 64)]
        a, b = sorted((top(a), top(b)))
        label[b] = a
    assert [top(i) for i in range(len(values))] == groups_of(values)


def test_streamed_runs_of_any_size(monkeypatch):
    """Runs across batches, and one that is handed on while it streams by."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "ROWS", 50)
    sizes = [1, 2, 300, 5, 40, 41, 1, 7]
    bucket = np.repeat(np.arange(len(sizes)) % 3, sizes).astype(np.int32)
    key = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
    fp = np.arange(len(key), dtype=np.int64)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c[i : i + 16]) for c in (bucket, key, fp)], ["bucket", "key", "fp"])
        for i in range(0, len(key), 16)
    ]
    out = [r for b in simhash._compared(iter(batches), 40) for r in b.to_pylist()]
    large = {k for k, n in enumerate(sizes) if n > 40}
    assert sorted(r["fp"] for r in out if r["near"] is None) == [int(f) for f, k in zip(fp, key) if k in large]
    edges = [(r["fp"], r["near"]) for r in out if r["near"] is not None]
    assert all(key[a] == key[b] and int(a ^ b).bit_count() <= 2 * 6 for a, b in edges)
    joined = {k for a, _ in edges for k in [int(key[a])]}
    assert joined == {k for k, n in enumerate(sizes) if 1 < n <= 40}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows)
    assert got(simhash.simhash_components(docs)) == expected
    assert got(simhash.simhash_components(docs.repartition(9), bucket=2, task_rows=20)) == expected
    assert sum(d != c for d, _, c in expected) > 50
