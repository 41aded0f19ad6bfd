import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from tests.llm.tables import DOCS, ODD_TEXTS, docs_of
from tillroll.llm import manifest


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        run = at - at % 16
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return path


def brute(rows):
    sources = defaultdict(list)
    for row in rows:
        leaf, other = leaf_of(row, row["text"]), None
        if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
            text = row["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            other = leaf_of(row, text)
        sources[row["source"]].append((row["doc_id"], leaf, other))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = tree_of([leaf for _, leaf, _ in sources[name]])
    top = tree_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (doc_id, leaf, other) in enumerate(sources[name]):
            path = path_of(trees[name], at) + path_of(top, k)
            digest = other or leaf
            for left, right in path:
                digest = H(left + digest + right)
            proof = H("".join(a + b for a, b in path))
            out.append((doc_id, leaf, trees[name][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in DOCS) for r in rows], DOCS).repartition(5)


def row(i, text="Some Text", source="s", lang="en"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text)}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257, 4097])
def test_one_source_of(spark, n):
    rows = [row(3 * i, f"Text {i}") for i in range(n)]
    assert got(manifest.merkle_manifest(frame(spark, rows))) == brute(rows)


def test_many_sources_one_hot(spark):
    rows = [row(i, f"Text {i % 50}", "hot" if i % 3 == 0 else f"src{i % 301}") for i in range(9_000)]
    rows += [row(i, "x", None) for i in range(40)]
    assert got(manifest.merkle_manifest(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [row(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [row(5, "AB"), row(5, "AB"), row(5, "Other"), row(None, "Q"), row(None, None, None, None)]
    rows += [row(10, "AB", "é"), row(15, "AB", "z"), row(20, "AB", ""), row(-5, "AB", "Z"), row(0, None, "z")]
    assert got(manifest.merkle_manifest(frame(spark, rows))) == brute(rows)


def test_clashing_columns_change_nothing(spark):
    plain = got(manifest.merkle_manifest(docs_of(spark, ODD_TEXTS)))
    more = docs_of(spark, ODD_TEXTS, extra=True).selectExpr("*", "'x' as tree", "1 as pos", "2 as size", "'y' as digest")
    assert got(manifest.merkle_manifest(more)) == plain


def test_empty_table(spark):
    assert got(manifest.merkle_manifest(docs_of(spark, []))) == []


def test_paths_lead_to_the_root(spark):
    rows = [row(i, f"Text {i}", f"s{i % 3}") for i in range(700)]
    for r in manifest.merkle_manifest(frame(spark, rows), keep_paths=True).collect():
        path = manifest.from_text(r.path)
        assert manifest.fold(r.leaf, path) == r.root
        assert H("".join(a + b for a, b in path)) == r.proof_sha256
        assert r.verified == (r.folded_root == r.root)


def test_only_every_third_level_is_written(spark):
    leaves = spark.range(20_000).selectExpr("'t' as tree", "id as pos", "20000L as size", "sha2(string(id), 256) as digest")
    forest = manifest.build(leaves)
    assert [level.count() for level in forest.levels] == [20_000, 5, 1]
    assert forest.roots().collect()[0].digest == tree_of([H(str(i)) for i in range(20_000)])[-1][0]
