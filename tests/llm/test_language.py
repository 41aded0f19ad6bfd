import zlib

from tillroll.llm import language, queries
from tests.llm.tables import DOCS, ODD_TEXTS, docs_of, rows_by_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = rows_by_id(docs)
    got = rows_by_id(queries.op2_language_id(spark, "/root/testdata/sf0.01"))
    assert set(got) == set(want)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [i for i in got if got[i]["held_out"]]
    right = sum(got[i]["lang_pred"] == want[i]["lang"] for i in held)
    assert right >= 0.98 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.01 * len(got)


def test_labels_and_source_are_no_inputs_of_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train_language(docs)
    plain = rows_by_id(language.predict_language(docs, model))
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "doc_id as source", "n_chars")
    assert rows_by_id(language.predict_language(other, model)) == plain


def test_odd_texts(spark):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"
    )
    odd = docs_of(spark, ODD_TEXTS + ["12 34 !!"]).selectExpr(
        "doc_id + 100000 as doc_id", "text", "cast(null as string) as lang", "source", "n_chars"
    )
    got = rows_by_id(language.language_id(known.unionByName(odd)))
    for k, text in enumerate(ODD_TEXTS + ["12 34 !!"]):
        lettered = bool(text) and any(c.isalpha() for c in text)
        row = got[100000 + k]
        assert (row["lang_pred"] == "und") == (not lettered), text
        assert lettered or (row["score"] == 0 and row["rejected"])


def test_far_texts_are_rejected(spark):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"
    )
    far = "ξενοφώντος κύρου ανάβασις δαρείου και παρυσάτιδος γίγνονται παίδες δύο " * 8
    odd = spark.createDataFrame([(100000, far, None, "s", 1)], DOCS)
    kept = rows_by_id(language.keep_known(known.unionByName(odd)))
    assert 100000 not in kept and len(kept) >= 0.98 * known.count()


def test_nothing_to_learn(spark):
    assert language.language_id(docs_of(spark, [])).count() == 0
    docs = docs_of(spark, ["some words"]).selectExpr(
        "doc_id", "text", "cast(null as string) as lang", "source", "n_chars", "'a' as lang_pred"
    )
    row = rows_by_id(language.language_id(docs))[0]
    assert row["lang_pred"] == "und" and row["rejected"]
