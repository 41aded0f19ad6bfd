"""Small inputs that the tests of this folder share."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Nulls, empty texts, blanks, ties, repeats, non-ASCII, separators, one very long text.
ODD_TEXTS = [
    None,
    "",
    " \t\r\n ",
    "a",
    "a a a a",
    "É à ß 漢字 😀   x\x1cy",
    "one two three one two three four",
    "line\nline\n\nline\r\n line",
    "#*$%&|<> <b>",
    "İstanbul K ſ Ǆ",
    "same text here",
    "same text here",
    "w" * 20_000,
    "very long text with many words. " * 5_000,
]


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        for name in ("label", "id", "kept", "score", "n_words", "hash", "row", "key"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def rows_by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out
