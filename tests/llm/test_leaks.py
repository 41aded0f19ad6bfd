import random
import re

import numpy as np
import pyarrow as pa

from tillroll.llm import leaks, queries, textbytes as tb
from tests.llm.tables import ODD_TEXTS, docs_of


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def infix(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(text):
            new.append(min(row[j + 1] + 1, row[j] + (w != x), new[-1] + 1))
        row = new
    return min(row)


def brute(texts, items):
    """All (text, item) within the limit, by the whole edit table."""
    out = {}
    for i, t in texts.items():
        tw = words(t)
        for k, it in items.items():
            iw = words(it)
            if len(iw) < leaks.MIN_WORDS:
                continue
            n = infix(iw, tw)
            if n <= len(iw) - -(-8 * len(iw) // 10):
                out[i, k] = n
    return out


def table(spark, items):
    return spark.createDataFrame(list(items.items()), "item_id long, text string")


def found(df):
    rows = df.collect()
    out = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert len(out) == len(rows)
    return out


def planted(seed, n_items=12, n_docs=240):
    """Documents with items edited by up to their limit, at the ends and in the middle."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=5))
    items = {k: [word() for _ in range(rng.randint(5, 50))] for k in range(n_items)}
    docs = {}
    for i in range(n_docs):
        body = [word() for _ in range(rng.randint(0, 80))]
        if i % 4:
            item = list(items[i % n_items])
            limit = len(item) - -(-8 * len(item) // 10)
            for _ in range(rng.randint(0, limit + 1)):
                at = rng.randrange(len(item))
                action = rng.random()
                if action < 0.34:
                    item[at] = word()
                elif action < 0.67:
                    item.insert(at, word())
                elif len(item) > 1:
                    item.pop(at)
            at = rng.choice([0, len(body), rng.randint(0, len(body))])
            body = body[:at] + item + body[at:]
        docs[i] = " ".join(body)
    return docs, {k: ", ".join(v) for k, v in items.items()}


def test_recall_against_brute_force(spark):
    docs, items = planted(3)
    want = brute(docs, items)
    got = found(leaks.leaks(docs_of(spark, list(docs.values())), table(spark, items)))
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) and len(want) > 100
    assert sum(got[p] == want[p] for p in got) >= 0.99 * len(got)


def test_places_of_exact_leaks(spark):
    item = "Alpha beta, gamma DELTA epsilon zeta eta theta"
    docs = ["x y " + item.lower() + " z", item, "alpha beta gamma", "no " + item[:30]]
    rows = leaks.leaks(docs_of(spark, docs), table(spark, {7: item})).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word, r.edits, r.similarity) for r in rows) == [
        (0, 7, 2, 10, 0, 1.0),
        (1, 7, 0, 8, 0, 1.0),
    ]


def test_odd_texts_and_items(spark):
    items = {1: None, 2: "", 3: "a a", 4: "one two three one two three four"}
    got = found(leaks.leaks(docs_of(spark, ODD_TEXTS, extra=True), table(spark, items)))
    assert got == brute(dict(enumerate(ODD_TEXTS)), {4: items[4]})
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(docs_of(spark, ODD_TEXTS), empty).count() == 0
    assert leaks.leaks(docs_of(spark, []), table(spark, items)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs, items = planted(4, 8, 60)
    whole = found(leaks.leaks(docs_of(spark, list(docs.values())), table(spark, items)))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    assert found(leaks.leaks(docs_of(spark, list(docs.values())), table(spark, items))) == whole
    kept = {r.doc_id for r in leaks.keep_clean(docs_of(spark, list(docs.values())), table(spark, items)).collect()}
    assert kept == set(docs) - {i for i, _ in whole}


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = found(queries.op5_decontaminate(spark, sf_dir))
    # Brute force where an item and a text share two neighbouring words.
    pairs = {(i, k): None for i, t in texts.items() for k, it in items.items()
             if len(set(zip(w := words(it), w[1:])) & set(zip(v := words(t), v[1:]))) >= len(w) // 4}
    want = {}
    for i, k in pairs:
        want |= brute({i: texts[i]}, {k: items[k]})
    assert got == want and got


def test_walks_keep_near_sequences_near():
    rng = np.random.default_rng(0)
    a = tb.mix(rng.integers(0, 1 << 40, (200, 40)).astype(np.uint64))
    b = a.copy()
    b[:, 10:-1] = a[:, 11:]  # one word left out, the rest moves up
    far = tb.mix(rng.integers(0, 1 << 40, (200, 40)).astype(np.uint64))
    sizes = np.full(200, 40)
    same = lambda x, y: (leaks.embed(x, sizes, 0) == leaks.embed(y, sizes, 0)).mean()
    assert same(a, b) > 0.6 and same(a, far) < 0.4
