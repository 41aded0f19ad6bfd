import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillroll.llm import bpe, queries
from tests.llm.tables import ODD_TEXTS, docs_of, rows_by_id

PATH = public_tokenizers.path("word_bpe_49k.json")
MORE = [
    "it's we'll don't I'm 3²½Ⅷ x_y á ΑΣ ΣΑΣ <|endoftext|>hi<|startoftext|> <|end",
    "İI ſß ﬁ é ẛ̣ \x1c a\x1fb  x　y \x85z \x00\x01",
    "'S'T'RE ''s !!'s 日本語テスト 한국어 अनु 🎉🎉👨‍👩‍👧 🇩🇪",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (
        len(ids),
        sha(" ".join(map(str, ids))),
        sha(library.decode(ids, skip_special_tokens=False)),
    )


def test_odd_texts(spark, library):
    texts = ODD_TEXTS + MORE
    got = rows_by_id(bpe.bpe_digests(docs_of(spark, texts, extra=True), PATH))
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(library, text), text
    assert bpe.bpe_digests(docs_of(spark, []), PATH).count() == 0


def test_random_words(library):
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    for letters in ("theinagorsw", "abcdeéßÄñ'` .,!0123Σσς́‍\n中"):
        for _ in range(1500):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            ids = library.encode(text, add_special_tokens=False).ids
            assert vocabulary.encode(text) == ids
            assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark, sf_dir, library):
    texts = rows_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = rows_by_id(queries.op8_bpe(spark, sf_dir))
    assert set(got) == set(texts)
    for i, r in got.items():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(library, texts[i]["text"])


def test_ids_and_back(spark, library):
    docs = docs_of(spark, ["The cat's hat", None])
    tokens = bpe.bpe_tokens(docs, PATH)
    got = rows_by_id(bpe.bpe_texts(tokens, PATH))
    assert got[0]["text"] == "the</w> cat</w> 's</w> hat</w>" and got[1]["text"] == ""
