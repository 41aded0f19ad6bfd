import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillroll.llm import jaccard, queries
from tillroll.llm.components import components
from tests.llm.tables import DOCS, ODD_TEXTS, docs_of, rows_by_id


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute(texts):
    """Components over all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    union, holders = Union(sets), defaultdict(list)
    for i in sorted(sets):
        met = Counter(j for g in sets[i] for j in holders[g])
        for j, shared in met.items():
            if 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                union.join(i, j)
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(sets[i]), union.find(i)) for i in sets}


def agree(df, texts):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in rows_by_id(df).items()}
    assert got == brute(texts)


def hard_texts(seed):
    """Chains of near copies, copies, a passage in many texts, frequent words, tiny sets."""
    rng = random.Random(seed)
    common = ["the", "of", "a", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        body = [word() for _ in range(rng.randint(30, 120))]
        texts.append(body[:20] + passage + body[20:])
    for _ in range(3):
        text = [word() for _ in range(rng.choice([30, 90, 200]))]
        for _ in range(50):  # each a step from the one before: links chain, ends are far apart
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
            texts.append(text)
    base = [word() for _ in range(150)]
    for _ in range(60):  # a wheel around one text
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = word()
        texts.append(near)
    texts += [[word() for _ in range(rng.randint(0, 6))] for _ in range(60)]
    texts += [list(t) for t in texts[:40]]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_odd_texts(spark):
    texts = ODD_TEXTS + ["One two", "one  TWO", "one two three", "a b c a b c a b c", "É x y", "é x y"]
    agree(jaccard.jaccard_components(docs_of(spark, texts, extra=True)), dict(enumerate(texts)))


def test_empty(spark):
    assert jaccard.jaccard_components(docs_of(spark, [])).count() == 0
    assert jaccard.jaccard_components(docs_of(spark, ["", None])).count() == 2


def test_hard_groups(spark):
    texts = hard_texts(5)
    agree(jaccard.jaccard_components(docs_of(spark, texts)), dict(enumerate(texts)))


def test_hot_pivots_and_few_hubs(spark, monkeypatch):
    """The numbers that steer the work change no link."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "spare", lambda regions: regions * 0)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 1)
    texts = hard_texts(8)
    agree(jaccard.jaccard_components(docs_of(spark, texts)), dict(enumerate(texts)))


def test_query_against_brute_force(spark, sf_dir):
    texts = {i: r["text"] for i, r in rows_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet")).items()}
    agree(queries.op6_jaccard_join(spark, sf_dir), texts)


def test_keep_one_of_each(spark):
    texts = ["a b c d e", "x y z", "a b c d e", None, ""]
    docs = docs_of(spark, texts)
    kept = jaccard.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") < 2, F.col("doc_id")))
    assert jaccard.keep_one_of_each(unnamed).count() == 4  # a copy without a doc_id is a copy


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 3), (4, 1)] + [(20 + k, 21 + k) for k in range(30)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {k: 20 for k in range(20, 51)}
    assert {r.id: r.label for r in got.collect()} == want


def _edited(rng, words, n):
    """Copies with ``n`` words changed each at places of their own."""
    out = list(words)
    for k in rng.sample(range(len(words)), n):
        out[k] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [1024, 5])
def test_a_large_group_on_both_sides_of_the_threshold(spark, monkeypatch, block):
    """Copies of one text, some within 0.9 of each other and most a little beyond."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PAIR_BATCH", 7)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(150)]
    texts = [_edited(rng, words, rng.choice([1, 2, 3, 4])) for _ in range(60)]
    got = rows_by_id(jaccard.jaccard_components(docs_of(spark, texts)))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    assert 1 < len(set(label)) < len(texts)


def test_runs_of_a_stream():
    import pyarrow as pa

    keys = [1] * 3 + [2] + [3] * 9 + [4] * 2 + [5]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + 4]), pa.array(range(i, min(i + 4, len(keys))))], ["k", "v"])
        for i in range(0, len(keys), 4)
    ]
    found = [t.column("v").to_pylist() for t in jaccard.runs(iter(batches), ["k"])]
    assert found == [[0, 1, 2], list(range(4, 13)), [13, 14]]


def test_one_row_of_each_group_whatever_the_ids(spark):
    copy, near = " ".join(f"w{k}" for k in range(60)), " ".join(["other", *(f"w{k}" for k in range(1, 60))])
    rows = [
        (9, copy), (9, copy), (4, near), (None, copy), (None, None), (None, "lone text of its own here"),
        (9, "another text under the same id"), (7, None), (7, ""), (None, "lone text of its own here"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one_of_each(docs).collect()]
    expected = [(4, near), (None, None), (None, "lone text of its own here"), (9, "another text under the same id")]
    sevens = [k for k in kept if k[0] == 7]
    assert len(sevens) == 1 and not sevens[0][1]
    assert sorted(map(str, (k for k in kept if k[0] != 7))) == sorted(map(str, expected))
    plain = docs_of(spark, [copy, copy, near, None, None, "a", "a"])
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each(plain).collect()) == [0, 3, 4, 5]


def test_links_fall_from_round_to_round(spark, monkeypatch):
    """The rounds together read few times the links, also of long paths."""
    from tillroll.llm import components as module

    sizes, write = [], module.materialize

    def counted(df, label):
        out = write(df, label)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(module, "materialize", counted)
    n = 400
    rows = components(spark.createDataFrame([(k, k + 1) for k in range(n)] + [(n, -5), (1000, 1001)], "a long, b long"))
    assert {r.id: r.label for r in rows.collect()} == {k: -5 for k in [-5, *range(n + 1)]} | {1000: 1000, 1001: 1000}
    links = [size for label, size in sizes if label == "links"]
    assert links[0] == n + 2 and links[-1] == 0 and all(a > b for a, b in zip(links, links[1:]))
    assert sum(links) < 4 * links[0]
