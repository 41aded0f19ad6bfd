import re

from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.tables import docs_of, rows_by_id
from tests.llm.test_bpe import PATH, want
from tests.llm.test_jaccard import Union
from tests.llm.test_leaks import brute as leak_brute
from tests.llm.test_pii import base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    union, holders = Union(sets), {}
    for i in sorted(sets):
        met = {}
        for g in sets[i]:
            for j in holders.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            holders[g].append(i)
        for j, n in met.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                union.join(i, j)
    return {i: union.find(i) for i in sets}


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what its predecessor kept; the last against the library."""
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontaminate", "personal_data", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(cp.STAGES)
    texts = lambda df: {i: r["text"] for i, r in rows_by_id(df).items()}

    known = cp.materialize(stage["language_id"](spark, docs, sf_dir), "t")
    assert known.columns == COLUMNS and len(texts(known)) >= 0.97 * docs.count()

    single = cp.materialize(stage["near_duplicates"](spark, known, sf_dir), "t")
    assert single.columns == COLUMNS
    assert set(texts(single)) == {i for i, c in near_groups(texts(known)).items() if i == c}

    clean = cp.materialize(stage["decontaminate"](spark, single, sf_dir), "t")
    assert clean.columns == COLUMNS
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    gone = set(texts(single)) - set(texts(clean))
    assert gone and all(leak_brute({i: texts(single)[i]}, items) for i in gone)
    first = {k: " ".join(t.split()[:8]).lower() for k, t in items.items()}
    assert not any(f in t.lower() for t in texts(clean).values() for f in first.values() if len(f.split()) == 8)

    masked = cp.materialize(stage["personal_data"](spark, clean, sf_dir), "t")
    assert masked.columns == COLUMNS
    before, after = rows_by_id(clean), rows_by_id(masked)
    assert set(before) == set(after)
    for i, row in after.items():
        assert not base(row["text"])
        assert row == before[i] or row["n_chars"] == len(row["text"])

    got = rows_by_id(stage["bpe"](spark, masked, sf_dir))
    library = Tokenizer.from_file(PATH)
    assert set(got) == set(after)
    for i, r in got.items():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(library, after[i]["text"])
    assert rows_by_id(cp.run(spark, sf_dir)) == got


def test_empty_documents(spark, sf_dir):
    docs = docs_of(spark, [])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
