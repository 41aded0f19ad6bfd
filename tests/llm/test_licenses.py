import re

import pytest

from tillroll.llm import licenses, queries
from tests.llm.tables import ODD_TEXTS, docs_of, rows_by_id

BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in BASE.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
    }


TEXTS = ODD_TEXTS + [
    "MIT License mit-license MIT\nLicense, mit licensed permit license",
    "gnu general public license gnu general public license apache license",
    "Cc By cc by cc\x00by éapache license apache licenseé",
    "K cc by 4.0 [CC BY-NC]",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause",
    "x\nSPDX-License-Identifier: )( and\ny",
]


def test_odd_texts(spark):
    got = rows_by_id(licenses.license_scan(docs_of(spark, TEXTS, extra=True)))
    for i, text in enumerate(TEXTS):
        want = base(text)
        assert {k: got[i][k] for k in want} == want, text
        assert set(filter(None, want["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1
    assert licenses.license_scan(docs_of(spark, [])).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = rows_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = rows_by_id(queries.op7_license_scan(spark, sf_dir))
    assert set(got) == set(texts)
    for i, row in got.items():
        want = base(texts[i]["text"])
        assert {k: row[k] for k in want} == want
    assert sum(r["n_base"] for r in got.values()) > 0


@pytest.mark.parametrize(
    "line, labels, parsed, permissive",
    [
        ("MIT", ("mit",), True, True),
        ("GPL-2.0-or-later", ("gpl",), True, False),
        ("MIT OR GPL-3.0", ("gpl", "mit"), True, True),
        ("MIT AND GPL-3.0", ("gpl", "mit"), True, False),
        ("GPL-3.0 OR MIT AND Apache-2.0", ("apache", "gpl", "mit"), True, True),
        ("(GPL-3.0 OR MIT) AND LGPL-2.1", ("gpl", "lgpl", "mit"), True, False),
        ("Apache-2.0 WITH LLVM-exception */", ("apache",), True, True),
        ("MIT. More words", ("mit",), True, True),
        ("MIT AND", ("mit",), False, False),
        ("((MIT", ("mit",), False, False),
        ("", (), False, False),
    ],
)
def test_expressions(line, labels, parsed, permissive):
    got = licenses.read_expression(line)
    assert (got.labels, got.parsed, got.permissive) == (labels, parsed, permissive)
