"""Licence scan: identifier tags, notice phrases and licence expressions.

One Aho-Corasick automaton runs over the words of a text (lower-case, one blank between
words) and finds notice phrases where their words stand consecutively, and the words of
identifier tags. What follows a tag on its line is read as a licence expression by a
shunting-yard parser (``with`` binds tightest, then ``and``, then ``or``) and evaluated:
an expression holds if some choice of its ``or`` branches needs permissive licences only.

Defined cases: a null text counts as empty (no word, no label, score 0); overlapping and
repeated places all count; an expression that does not parse gives the labels of the
identifiers read so far and counts as not permissive; extra columns are ignored;
repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm import textbytes as tb

# Phrases of the base and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases of the method and their labels.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "released into the public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "proprietary",
}
# Words of a tag that an expression follows.
TAG = "spdx license identifier"
# Starts of identifiers and the labels they stand for; the longest wins.
FAMILIES = {
    "mit": "mit",
    "apache": "apache",
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "bsd": "bsd",
    "isc": "isc",
    "mpl": "mpl",
    "epl": "epl",
    "bsl": "bsl",
    "cc0": "cc0",
    "cc-by": "cc-by",
    "cc-by-sa": "cc-by-sa",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "unlicense": "public-domain",
}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "bsl", "cc0", "cc-by", "public-domain"}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, n_expressions long, permissive boolean"
)

_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[^\s()]+")
_TAG_LINE = re.compile(r"(?i)spdx[^0-9a-z\n]+license[^0-9a-z\n]+identifier[ \t:]*([^\r\n]*)")
#: bytes -> lower-case word bytes or blank
_WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if tb.ALNUM[b] else 0x20 for b in range(256)
)


def family(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    fits = [k for k in FAMILIES if name == k or name.startswith(k + "-")]
    return FAMILIES[max(fits, key=len)] if fits else name


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None for an expression that does not parse."""
    out, stack, operand = [], [], True
    for token in tokens:
        word = token.lower()
        if word in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


@dataclass(frozen=True)
class Expression:
    labels: tuple[str, ...]
    parsed: bool
    permissive: bool


def read_expression(line: str) -> Expression:
    """Read the start of ``line`` that can be an expression, and evaluate it."""
    tokens, operand, depth = [], True, 0
    for token in _TOKEN.findall(line):
        ends = False
        word = token.lower()
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif word in _BINDS and not operand:
            operand = True
        elif operand and word not in _BINDS and token not in "()" and re.fullmatch(r"[\w.+:-]+,?\.?", token):
            ends = token[-1] in ",."
            token = token.rstrip(",.")
            operand = False
        else:
            break
        tokens.append(token)
        if ends:
            break
    postfix = to_postfix(tokens)
    names, stack = [], []
    if postfix is None:
        found = [t for t in tokens if t.lower() not in _BINDS and t not in ("(", ")")]
        return Expression(tuple(sorted({family(t) for t in found})), False, False)
    for token in postfix:
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                names.remove(right[1])
                stack.append(left)
            elif token == "and":
                stack.append((left[0] and right[0], ""))
            else:
                stack.append((left[0] or right[0], ""))
        else:
            label = family(token)
            names.append(label)
            stack.append((label in PERMISSIVE, label))
    return Expression(tuple(sorted(set(names))), True, bool(stack[-1][0]))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrases, base in ((MORE_PHRASES, False), (BASE_PHRASES, True)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (len(phrase) + 1, label, base))
    found.add_word(f" {TAG} ", (len(TAG) + 1, None, False))
    found.make_automaton()
    return found


def scan_text(text: str, machine: ahocorasick.Automaton) -> tuple:
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, labels, tagged = [], set(), set(), False
    at = number = 0  # the word that starts at a place, counted on from the last match
    for end, (back, label, is_base) in machine.iter(joined):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            start = end - back
            step = joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at, number = start, number + step
            places.append(number)
    expressions = [read_expression(m) for m in _TAG_LINE.findall(text)] if tagged else []
    for e in expressions:
        labels.update(e.labels)
    # Evidence: a parsed tag is sure, a notice phrase nearly; each further place adds.
    doubt = 0.0 if any(e.parsed for e in expressions) else 0.2 ** min(len(labels), 10)
    return (
        len(words),
        len(places),
        min(places) if places else None,
        max(places) if places else None,
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        1.0 - doubt if labels else 0.0,
        len(expressions),
        all(e.permissive for e in expressions) if expressions else None,
    )


def _scan(batches):
    machine = automaton()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]
    for batch in batches:
        found = [scan_text(t or "", machine) for t in tb.column(batch, "text").to_pylist()]
        columns = zip(*found) if found else [[] for _ in names[1:]]
        yield pa.RecordBatch.from_arrays(
            [
                tb.column(batch, "doc_id"),
                *(pa.array(list(c), t) for c, t in zip(columns, types[1:])),
            ],
            names,
        )


def license_scan(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, SCHEMA)
